import numpy as np
import pytest

from weftline.llm import ann


def brute(items, k):
    ids = sorted(items)
    out = {}
    for a in ids:
        sims = {b: round(items[a](items[b]), 6) for b in ids if b != a}
        out[a] = [(b, sims[b]) for b in sorted(sims, key=lambda b: (-sims[b], b))[:k]]
    return out


class Vec:
    def __init__(self, v):
        self.v = np.array(v, float)

    def __call__(self, o):
        return float(self.v @ o.v / np.linalg.norm(self.v) / np.linalg.norm(o.v))


SHAPE = "id long, v array<double>, mark int, rep int, asked int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SHAPE)


def clustered(n=400, dim=16):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, dim))
    return [(i, (centres[i % 40] * 3 + rng.normal(size=dim)).tolist()) for i in range(n)]


def test_recall_of_dense_search(spark):
    rows = clustered()
    got: dict = {}
    for r in ann.similar_vectors(frame(spark, rows), "id", "v", ann.Dense(16), k=5, files=(("plain", 4),), list_rows=20, sub=4).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    want = brute({i: Vec(v) for i, v in rows}, 5)
    assert np.mean([len(got[i] & {b for b, _ in want[i]}) / 5 for i in want]) >= 0.9


def test_queries_are_sought_among_all_rows(spark):
    rows = clustered()
    out = ann.similar_vectors(frame(spark, rows), "id", "v", ann.Dense(16), k=3, files=(("plain", 100),), list_rows=50, sub=4, rerank=400, queries="id % 100 = 0").collect()
    want = brute({i: Vec(v) for i, v in rows}, 3)
    assert {(r.key, r.neighbour) for r in out} == {(i, b) for i in want if i % 100 == 0 for b, _ in want[i]}
    assert sorted({r.rank for r in out}) == [1, 2, 3]


def test_copies_ties_unusable_vectors_and_repeats(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0]
    rows = [(i, a) for i in range(300)] + [(500, b), (501, [2.0, 0.0, 0.0, 0.0]), (600, None), (601, [0.0] * 4), (602, [1.0]), (603, [float("nan"), 1.0, 0.0, 0.0]), (604, [None, 1.0, 1.0, 1.0]), (None, a), (605, [])]
    out: dict = {}
    for r in ann.similar_vectors(frame(spark, rows + rows[:5]), "id", "v", ann.Dense(4), k=3, sub=2).where("similarity >= 0.9").orderBy("key", "rank").collect():
        out.setdefault(r.key, []).append(r.neighbour)
    assert out[0] == [1, 2, 3] and out[1] == [0, 2, 3] and out[299] == [0, 1, 2]
    assert out[500] == [0, 1, 2] and out[501] == [0, 1, 2]
    assert set(out) == {*range(300), 500, 501}


@pytest.mark.parametrize("kind", [ann.Dense(4), ann.Sparse()])
def test_empty_table(spark, kind):
    df = frame(spark, []) if isinstance(kind, ann.Dense) else spark.createDataFrame([], "id long, v map<string,double>")
    assert ann.similar_vectors(df, "id", "v", kind, files=(("signs", 0.5),)).count() == 0


@pytest.mark.parametrize("files", [(("signs", 6),), (("learned", 0.3), ("signs", 2))])
def test_sparse_search(spark, files):
    rng = np.random.default_rng(1)
    groups = [{f"g{g}_{t}": float(rng.uniform(3, 9)) for t in range(6)} for g in range(30)]
    rows = [(i, {**groups[i % 30], **{f"c{rng.integers(40)}": 1.0 for _ in range(5)}, f"u{i}": 2.0}) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, {}), (901, None), (902, {"x": None}), (903, {"x": 0.0, "y": float("nan")}), (None, {"x": 1.0})], "id long, v map<string,double>")
    got: dict = {}
    for r in ann.similar_vectors(df, "id", "v", ann.Sparse(), k=5, files=files, list_rows=16, rerank=64).where("similarity >= 0.5").collect():
        got.setdefault(r.key, {})[r.neighbour] = r.similarity

    class Bag(dict):
        def __call__(self, o):
            dot = sum(v * o.get(t, 0.0) for t, v in self.items())
            return dot / np.sqrt(sum(v * v for v in self.values()) * sum(v * v for v in o.values()))

    want = brute({i: Bag(v) for i, v in rows}, 5)
    pairs = {(i, b) for i in want for b, s in want[i] if s >= 0.5}
    mine = {(i, b) for i in got for b in got[i]}
    assert len(pairs & mine) >= 0.9 * len(pairs)
    true = {(i, b): s for i in want for b, s in want[i]}
    assert all(abs(got[i][b] - true[i, b]) < 1e-5 for i, b in pairs & mine)


def test_copies_that_are_not_all_asked_find_all_neighbours(spark):
    """The first copy of each class is not asked, the others are; their neighbours lie in other cells."""
    x = np.random.default_rng(3).normal(size=(300, 8))
    rows = [(i + 1000 * c, x[i].tolist()) for i in range(300) for c in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in ann.similar_vectors(df, "id", "v", ann.Dense(8), k=5, files=(("plain", 8192),), list_rows=8, sub=4, rerank=900, queries="id >= 1000").collect():
        got.setdefault(r.key, []).append((r.rank, r.neighbour))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(y @ y.T, 6)
    assert set(got) == {1000 * c + i for i in range(300) for c in (1, 2)}
    for i in range(300):
        j = max((j for j in range(300) if j != i), key=lambda j: sim[i, j])
        assert [n for _, n in sorted(got[1000 + i])] == [i, 2000 + i, j, 1000 + j, 2000 + j]
        assert [n for _, n in sorted(got[2000 + i])] == [i, 1000 + i, j, 1000 + j, 2000 + j]


def test_probes_as_a_share_of_the_lists(spark):
    x = np.random.default_rng(4).normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    few, every = (ann.similar_vectors(df, "id", "v", ann.Dense(8), k=5, files=(("plain", p),), list_rows=8, sub=4, rerank=200).orderBy("key", "rank").collect() for p in (0.99999, 25))
    assert few == every and len(every) == 1000


def test_exact_products_of_sparse_vectors():
    rng = np.random.default_rng(5)
    bags = [{f"t{j}": float(rng.normal()) for j in rng.choice(60, rng.integers(1, 20), replace=False)} for _ in range(50)]
    import pyarrow as pa

    payloads = ann.Sparse().payloads(pa.array([list(b.items()) for b in bags], pa.map_(pa.string(), pa.float64())))
    a, b = (rng.integers(50, size=500) for _ in range(2))
    norm = [np.sqrt(sum(v * v for v in x.values())) for x in bags]
    want = [sum(v * bags[j].get(t, 0.0) for t, v in bags[i].items()) / norm[i] / norm[j] for i, j in zip(a, b, strict=True)]
    assert np.allclose(ann.Sparse().exact(payloads)(a, b), want, atol=1e-6)


def test_a_crowded_cell_is_cut_into_blocks_of_rows_and_seekers(spark, monkeypatch):
    """Blocks change the work, not the result."""
    rows = clustered(300)
    search = lambda: {(r.key, r.rank): r.neighbour for r in ann.similar_vectors(frame(spark, rows), "id", "v", ann.Dense(16), k=4, files=(("plain", 0.5), ("plain", 0.2)), list_rows=20, sub=4, rerank=300).collect()}
    whole, fit = search(), ann.IvfPq.fit.__func__
    monkeypatch.setattr(ann.IvfPq, "fit", classmethod(lambda cls, *a, **k: fit(cls, *a[:4], 20.0, **k)))
    assert search() == whole and len(whole) == 1200


def test_payloads_come_back_from_packing():
    import pyarrow as pa

    bags = [[(f"t{j}", 1.0 + j) for j in range(i, 2 * i + 1)] for i in range(30)]
    payloads = ann.Sparse().payloads(pa.array(bags, pa.map_(pa.string(), pa.float64())))
    for sample in (payloads, payloads[:3]):
        packing = ann.Sparse().packing(sample)
        back = packing.unpack(packing.pack(payloads))
        as_map = lambda p: dict(zip(np.frombuffer(p, np.uint32, len(p) // 8).tolist(), np.frombuffer(p, np.float32, len(p) // 8, len(p) // 2).tolist(), strict=True))
        assert [as_map(a) for a in back] == [as_map(a) for a in payloads]


@pytest.mark.parametrize("block", [1000, 7])
def test_all_sparse_pairs_above_a_similarity(spark, block):
    rng = np.random.default_rng(6)
    maps = []
    for g in range(60):
        core = {f"g{g}_{t}": float(rng.uniform(2, 5)) for t in range(3)}
        for _ in range(rng.integers(1, 9)):
            maps.append({**core, f"u{len(maps)}": float(rng.uniform(0, 7)), "the": 1.0, f"c{rng.integers(5)}": float(rng.uniform(0, 4))})
    maps += [maps[0]] * 8 + [maps[5]] * 2 + [{"solo": 1.0}]
    rows = [(i, m, 1, 2) for i, m in enumerate(maps)] + [(0, maps[0], 1, 2), (900, {}, 1, 2), (901, None, 1, 2), (902, {"a": 0.0}, 1, 2), (None, {"a": 1.0}, 1, 2)]
    df = spark.createDataFrame(rows, "id long, m map<string,double>, rep int, mark int")
    got: dict = {}
    for r in sorted(ann.similar_above(df, "id", "m", 0.5, 3, block).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.key, []).append((r.neighbour, round(r.similarity, 6)))
    norm = [sum(v * v for v in m.values()) ** 0.5 for m in maps]
    dot = lambda a, b: sum(v * maps[b].get(t, 0) for t, v in maps[a].items()) / norm[a] / norm[b]
    want = {}
    for a in range(len(maps)):
        sims = {b: round(dot(a, b), 6) for b in range(len(maps)) if b != a}
        if near := [(b, sims[b]) for b in sorted(sims, key=lambda b: (-sims[b], b))[:3] if sims[b] >= 0.5]:
            want[a] = near
    assert len(want) > 100 and {a: [b for b, _ in v] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in want.items()}
    assert ann.similar_above(df.limit(0), "id", "m", 0.5).count() == 0


def test_p4_found_finds_all_pairs_just_above_the_bound(spark, tmp_path):
    """Pairs of similarity 0.52 that share one rare term, among many records of the same common terms."""
    from weftline.llm.queries import p4_found

    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        common = rng.choice(40, 12, replace=False)
        rest = rng.uniform(0.5, 1.5, 12)
        rest *= np.sqrt(0.5) / np.linalg.norm(rest)
        rows.append((i, {f"p{i // 2}": float(np.sqrt(0.5)), **{f"c{t}": float(x) for t, x in zip(common, rest, strict=True)}}))
    spark.createDataFrame(rows, "id long, tfidf map<string,double>").write.parquet(f"{tmp_path}/people_wiki.parquet")
    spark.createDataFrame([], "id long, deep_features array<double>").write.parquet(f"{tmp_path}/image_train.parquet")
    x = np.zeros((3000, 1540))
    for i, m in rows:
        for t, w in m.items():
            x[i, int(t[1:]) + (1500 if t[0] == "c" else 0)] = w
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -1)
    want = set()
    for a in range(3000):
        for b in np.lexsort((np.arange(3000), -np.round(sims[a], 6)))[:5].tolist():
            if round(sims[a, b], 6) >= 0.5:
                want.add((min(a, b), max(a, b)))
    got = {(r.id_a, r.id_b) for r in p4_found(spark, str(tmp_path)).collect()}
    assert len(want) > 1000 and got == want
