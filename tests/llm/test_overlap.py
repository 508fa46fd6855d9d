import random

import pytest

from weftline.llm import overlap as O

VOCABULARY = [f"w{i}" for i in range(70)]


def texts(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "id long, words string, split string, key int, cls int, grams int")


def found(o):
    return {(r.train_key, r.eval_key) for r in o.expand().collect()}


def brute(rows, threshold=0.8, least=12):
    sets = {}
    for i, w, s in rows:
        if i is not None and w and s and len(set(w.lower().split())) >= least:
            sets[i] = (set(w.lower().split()), s == "train")
    return {(a, b) for a, (x, t) in sets.items() if t for b, (y, u) in sets.items() if not u and len(x & y) >= threshold * len(x | y) - 1e-12}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[at] = rng.choice(VOCABULARY)
        elif rng.random() < 0.5:
            out.insert(at, rng.choice(VOCABULARY))
        elif len(out) > 1:
            out.pop(at)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot_rows", [20_000, 40])
def test_no_pair_is_lost_or_invented(spark, hot_rows):
    """A small vocabulary makes many near misses, ties at the threshold, and grams that many share."""
    rng = random.Random(5)
    rows = []
    for i in range(260):
        base = rng.sample(VOCABULARY, rng.randrange(11, 40)) if not rows or rng.random() < 0.4 else rng.choice(rows)[1].split()
        rows.append((i, " ".join(edited(rng, base, rng.randrange(0, 7))), rng.choice(["train", "train", "validation", "test"])))
    want = brute(rows)
    assert len(want) > 40
    assert found(O.text_overlaps(texts(spark, rows), "id", "words", "split", hot_rows=hot_rows)) == want


def test_hot_copies_long_texts_nulls_and_repeats(spark):
    same = " ".join(VOCABULARY[:20])
    long = " ".join(f"t{i}" for i in range(20_000))
    rows = [(i, same, "train" if i % 3 else "test") for i in range(400)]
    rows += [(1000, long, "train"), (1001, long + " more", "test"), (1002, None, "train"), (1003, "", "test"), (1004, "too few words", "test"), (None, same, "test"), (1005, same, None), (1006, "a " * 100_000, "train")]
    o = O.text_overlaps(texts(spark, rows + rows[:50]), "id", "words", "split")
    assert found(o) == brute(rows)
    assert o.pairs.count() == 2  # classes, not copies


def test_empty_tables(spark):
    assert found(O.text_overlaps(texts(spark, []), "id", "words", "split")) == set()
    assert found(O.field_overlaps(loans(spark, []), "id", "split", ["grade", "n"], ["x", "y", "z"])) == set()


def loans(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "id long, split string, grade string, n int, x double, y int, z double, cls int, key int, k string")


def test_fields_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.6:
            _, _, g, n, x, y, z = rng.choice(rows)
            jitter = lambda v, d: None if rng.random() < 0.06 else (v if v is None else v * (1 + rng.choice([-1, 1]) * d))
            g = None if rng.random() < 0.05 else (g and rng.choice([g, g.upper(), f" {g} "]))
            x, z = jitter(x, rng.choice([0.0, 0.004, 0.006])), jitter(z, rng.choice([0.0, 0.0049]))
        else:
            g, n, x, y, z = rng.choice(["a", "b"]), rng.randrange(2), rng.choice([0.0, -3.0, rng.uniform(1, 900)]), rng.choice([0, 5000]), rng.uniform(1, 90)
        rows.append((i, rng.choice(["train", "test"]), g, n, x, y, z))

    def alike(a, b):
        gap = 0
        for k in range(2, 7):
            p, q = a[k], b[k]
            if p is None or q is None:
                gap += 1
            elif k == 2 and p.strip().lower() != q.strip().lower() or k == 3 and p != q:
                return False
            elif k > 3 and abs(p - q) > 0.005 * max(abs(p), abs(q)) + 1e-12:
                return False
        return gap <= 1

    want = {(a[0], b[0]) for a in rows if a[1] == "train" for b in rows if b[1] == "test" and alike(a, b)}
    assert len(want) > 50
    assert found(O.field_overlaps(loans(spark, rows + rows[:9]), "id", "split", ["grade", "n"], ["x", "y", "z"])) == want
