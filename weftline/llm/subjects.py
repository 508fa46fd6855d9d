"""Subject areas of documents: bisecting k-means leaves, labelled by discriminative terms, mixed per document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import materialize

# openings and phrases of sentences that tell of somebody else, of a pastime or of a wish
KIN = "mother father parents brother sister cousin aunt uncle son daughter wife husband spouse grandmother grandfather grandparents nephew niece stepfather stepmother twin relative namesake"
OTHERS = (
    r"same name|not be confused|namesake",
    r"on weekends|in (?:his|her|their) (?:spare|free) time|as a hobby|hobby|for fun|pastime|\benjoys\b|\bamateur\b",
    r"wanted to|wished to|wishes to|hoped to|hopes to|dream(?:ed|t|s) of|would have liked|would like to|planned to become",
)
_KIN_FIRST = re.compile(r"^\W*(?:(?:a|an|one|the|his|her|their|my)\s+)?(?:\w+\s+)?(?:" + "|".join(KIN.split()) + r")\b")
_OTHERS = re.compile("|".join(OTHERS))
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def _plain_sentences(text: str | None) -> Iterator[tuple[list[str], str]]:
    """Words of each sentence with any, and the sentence."""
    for part in _END.split((text or "").lower()):
        plain = " ".join(part.split())
        words = _WORD.findall(plain)
        if words:
            yield words, plain


def own_sentences(text: str | None) -> Iterator[tuple[list[str], bool]]:
    """Words of each sentence and whether it may tell of the person's own work."""
    for words, plain in _plain_sentences(text):
        yield words, not (_KIN_FIRST.search(plain) or _OTHERS.search(plain))


@dataclass
class Leaves:
    """Unit centroids of the leaves, kept as the leaves and weights of each word."""

    start: np.ndarray
    leaf: np.ndarray
    weight: np.ndarray
    number: int

    @staticmethod
    def of(centroids: list[tuple[np.ndarray, np.ndarray]], n_words: int) -> Leaves:
        """From the words and weights of each leaf."""
        word = np.concatenate([w for w, _ in centroids]) if centroids else np.zeros(0, np.int64)
        leaf = np.repeat(np.arange(len(centroids)), [len(w) for w, _ in centroids])
        weight = np.concatenate([v for _, v in centroids]) if centroids else np.zeros(0)
        by = np.lexsort((leaf, word))
        return Leaves(np.searchsorted(word[by], np.arange(n_words + 1)), leaf[by], weight[by].astype(np.float32), len(centroids))

    def times(self, values: np.ndarray) -> np.ndarray:
        """Leaves x columns of ``values`` (words x columns)."""
        word = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        out = np.zeros((self.number, values.shape[1]))
        np.add.at(out, self.leaf, self.weight[:, None] * values[word])
        return out

    def nearest(self, words: np.ndarray, values: np.ndarray) -> int:
        near = np.zeros(self.number, np.float32)
        for i, v in zip(words, values, strict=True):
            at = slice(self.start[i], self.start[i + 1])
            near[self.leaf[at]] += v * self.weight[at]
        return int(near.argmax())


@dataclass
class SubjectModel:
    """Leaves of a bisecting k-means over sentence vectors, with a mixture of subjects each."""

    subjects: list[str]
    place: dict[str, int]
    idf: np.ndarray
    leaves: Leaves
    mixture: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    cache: dict[tuple, int] = field(default_factory=dict)

    def known(self, words: list[str]) -> tuple[int, ...]:
        """Places of the known words, in order. Names are no known words, so few different sentences remain."""
        return tuple(sorted(self.place[w] for w in words if w in self.place))

    def vector(self, known: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Words and weights of the unit vector."""
        at, n = np.unique(np.array(known, np.int64), return_counts=True)
        x = n * self.idf[at]
        return at, (x / max(float(np.linalg.norm(x)), 1e-9)).astype(np.float32)

    def leaf(self, words: list[str]) -> int:
        """Nearest leaf, -1 where no word is known."""
        return self.leaf_of(self.known(words))

    def leaf_of(self, key: tuple[int, ...]) -> int:
        """The same by the places of the known words."""
        found = self.cache.get(key)
        if found is None:
            found = self.leaves.nearest(*self.vector(key)) if key and self.leaves.number else -1
            if len(self.cache) < 100_000:
                self.cache[key] = found
        return found


#: Runs a task, given the state and all rows, and returns what it sends.
Run = Callable[[Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str, tuple], pa.Table]


def _look(state: tuple, b: pa.RecordBatch):
    """Row, word and weight of the entries of a batch, and the node where each of its rows ends.

    The state is the first child of each node, the width of a node's keys, and
    how much more each word speaks for the second child, by node and word. Weights are multiples of
    2^-24, so that their sums are exact in whatever order they are added.
    """
    child, stride, keys, values = state
    words, weights = b.column(1), b.column(2)
    row = np.repeat(np.arange(b.num_rows), np.diff(words.offsets.to_numpy()))
    w, x = words.flatten().to_numpy().astype(np.int64), np.rint(weights.flatten().to_numpy().astype(float) * 2**24) / 2**24
    node = b.column(4).to_numpy() if b.num_columns > 4 else np.zeros(b.num_rows, np.int64)
    while True:
        inner = child[node] >= 0
        if not inner.any():
            return row, w, x, node
        on = inner[row]
        key = node[row[on]] * stride + w[on]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        part = np.where(keys[at] == key, values[at], 0.0) * x[on] if len(keys) else np.zeros(len(key))
        side = np.bincount(row[on], part, minlength=b.num_rows) > 1e-9
        node = np.where(inner, child[node] + side, node)


class _Bisection:
    """Splits sparse unit vectors (rows ``mark, words, weights, times``, and maybe the ``node`` they stand at) level by level.

    A row stands for ``times`` sentences: nodes of fewer than twice ``least`` rows are split only if they have ``enough``
    sentences to judge their halves. In all else a row counts once, so that a frequent sentence does not hide the others.
    ``run`` gives a task all rows and returns what the tasks send: sums of nodes, never rows. A node's split
    depends on its rows alone, so the leaves are those of splitting the node of the greatest spread again and
    again, and it does not matter where a node is split.
    """

    def __init__(self, run: Run, n_words: int, seed: int = 5, rounds: int = 6, least: int = 4, enough: int = 100) -> None:
        self.run, self.stride, self.seed, self.rounds, self.least, self.enough = run, n_words + 2, seed, rounds, least, enough
        # of each node: its first child (the second follows), its way from the root, its rows and sentences, the length of the rows' sum, its words and their sums
        self.child: list[int] = [-1]
        self.way: list[str] = [""]
        self.n: list[float] = []
        self.times: list[float] = []
        self.norm: list[float] = []
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []
        # how much more each word speaks for the second child, by node and word
        self.keys, self.values = np.zeros(0, np.int64), np.zeros(0)

    def state(self, extra: dict[int, int] | None = None, keys: np.ndarray | None = None, values: np.ndarray | None = None) -> tuple:
        """What ``_look`` needs, with the splits in ``extra`` that are not settled yet."""
        child = np.full(len(self.child) + 2 * len(extra or ()), -1, np.int64)
        child[: len(self.child)] = self.child
        for node, first in (extra or {}).items():
            child[node] = first
        return child, self.stride, self.keys if keys is None else keys, self.values if values is None else values

    def _add(self, rows: float, times: float, words: np.ndarray, total: np.ndarray) -> None:
        self.n.append(rows)
        self.times.append(times)
        self.norm.append(float(np.linalg.norm(total)))
        self.sums.append((words, total))

    def _sums(self, state: tuple, wanted: np.ndarray) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
        """Rows, sentences, words and sums of the wanted nodes."""
        stride = self.stride

        def add(state: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                row, w, x, node = _look(state, b)
                mine = np.isin(node, wanted)
                on, own = mine[row], node[mine]
                # the last two places of a node count its sentences and its rows
                key = np.concatenate([key, node[row[on]] * stride + w[on], own * stride + stride - 2, own * stride + stride - 1])
                total = np.concatenate([total, x[on], b.column(3).to_numpy()[mine], np.ones(len(own))])
                key, at = np.unique(key, return_inverse=True)
                total = np.bincount(at, total, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["key", "total"])

        sent = self.run(add, "key long, total double", state)
        key, at = np.unique(sent.column(0).to_numpy(), return_inverse=True)
        total = np.bincount(at, sent.column(1).to_numpy(), minlength=len(key))
        out = {}
        for node in np.unique(key // stride).tolist():
            a, b = np.searchsorted(key, [node * stride, (node + 1) * stride])
            out[node] = (float(total[b - 1]), float(total[b - 2]), key[a : b - 2] - node * stride, total[a : b - 2])
        return out

    def _least(self, nodes: list[int], scores: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """Words and weights of the row of each node with the least of each of the scores."""
        chosen = set(nodes)
        shape = pa.schema([("node", pa.int64()), ("kind", pa.int32()), ("score", pa.float64()), ("mark", pa.int64()), ("words", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])

        def choose(state: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], tuple] = {}
            for b in batches:
                row, w, x, node = _look(state, b)
                mark = b.column(0).to_numpy()
                for kind, score in enumerate(scores(mark, row, w, x, node)):
                    by = np.lexsort((mark, score, node))
                    found, first = np.unique(node[by], return_index=True)
                    for n, i in zip(found.tolist(), by[first].tolist(), strict=True):
                        if n in chosen and ((n, kind) not in best or (score[i], mark[i]) < best[n, kind][:2]):
                            best[n, kind] = (float(score[i]), int(mark[i]), b.column(1)[i].as_py(), b.column(2)[i].as_py())
            flat = [(n, kind, *v) for (n, kind), v in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [[]] * 6, shape.types, strict=True)], schema=shape)

        best: dict[int, dict[int, tuple]] = {n: {} for n in nodes}
        for r in self.run(choose, "node long, kind int, score double, mark long, words array<int>, weights array<float>", self.state()).to_pylist():
            held, new = best[r["node"]], (r["score"], r["mark"], r["words"], r["weights"])
            held[r["kind"]] = min(held.get(r["kind"], new), new)
        return {n: [(np.array(held[kind][2], np.int64), np.array(held[kind][3], float)) for kind in sorted(held)] for n, held in best.items()}

    def _seeds(self, nodes: list[int]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """A row of each node drawn by hash, and the row farthest from another one."""
        seed, stride = self.seed, self.stride
        mixed = lambda mark, salt: ((mark.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float)
        drawn = self._least(nodes, lambda mark, row, w, x, node: [mixed(mark, seed), mixed(mark, seed + 0x5BD1E995)])
        order = sorted(nodes)
        key, value = np.concatenate([n * stride + drawn[n][1][0] for n in order]), np.concatenate([drawn[n][1][1] for n in order])

        def near(mark, row, w, x, node) -> list[np.ndarray]:
            of = node[row] * stride + w
            at = np.minimum(np.searchsorted(key, of), len(key) - 1)
            return [np.round(np.bincount(row, np.where(key[at] == of, value[at], 0.0) * x, minlength=len(node)), 6)]

        far = self._least(nodes, near)
        return {n: [drawn[n][0], far[n][0]] for n in nodes}

    def _split(self, nodes: list[int]) -> None:
        centers = self._seeds(nodes)
        extra = {n: len(self.child) + 2 * i for i, n in enumerate(nodes)}
        wanted = np.array([extra[n] + j for n in nodes for j in (0, 1)])
        sums: dict[int, tuple[float, float, np.ndarray, np.ndarray]] = {}
        for _ in range(self.rounds):
            new_keys = np.concatenate([n * self.stride + w for n in nodes for w, _ in centers[n]])
            new_values = np.concatenate([v * (2 * j - 1) for n in nodes for j, (_, v) in enumerate(centers[n])])
            new_keys, at = np.unique(new_keys, return_inverse=True)
            keys = np.concatenate([self.keys, new_keys])
            by = np.argsort(keys, kind="stable")
            keys, values = keys[by], np.concatenate([self.values, np.bincount(at, new_values, minlength=len(new_keys))])[by]
            before, sums = sums, self._sums(self.state(extra, keys, values), wanted)
            for n in nodes:
                for j in (0, 1):
                    if (got := sums.get(extra[n] + j)) is not None:
                        centers[n][j] = (got[2], got[3] / max(float(np.linalg.norm(got[3])), 1e-9))
            if before.keys() == sums.keys() and all(before[n][0] == s[0] and np.array_equal(before[n][2], s[2]) and np.array_equal(before[n][3], s[3]) for n, s in sums.items()):
                break
        self.keys, self.values = keys, values
        for n in nodes:
            for j in (0, 1):
                self.child.append(-1)
                self.way.append(f"{self.way[n]}{j}")
                self._add(*sums.get(extra[n] + j, (0.0, 0.0, np.zeros(0, np.int64), np.zeros(0))))
            self.child[n] = extra[n]

    def kept(self, k: int) -> tuple[set[int], list[int]]:
        """The at most ``k`` - 1 nodes that are split, as far as is known, and those of them that have no children yet."""
        spread = lambda i: self.n[i] - self.norm[i]
        halves = lambda i: all(self.n[self.child[i] + j] for j in (0, 1))
        ends = [i for i, c in enumerate(self.child) if c < 0 and spread(i) >= 0.05 * self.n[i] and (self.n[i] >= 2 * self.least or self.times[i] >= self.enough)]
        split = [i for i, c in enumerate(self.child) if c >= 0 and halves(i)]
        best = set(sorted([*split, *ends], key=lambda i: (-spread(i), self.way[i]))[: k - 1])
        return best & set(split), [i for i in ends if i in best]

    def grow(self, k: int, over: int = 0, settle: Callable[[_Bisection, list[int]], None] | None = None) -> bool:
        """Splits all nodes of more than ``over`` rows that are needed for ``k`` leaves; False where there are no rows."""
        if not self.n:
            whole = self._sums(self.state(), np.array([0]))
            if not whole:
                return False
            self._add(*whole[0])
        while todo := [i for i in self.kept(k)[1] if self.n[i] > over]:
            if settle:
                settle(self, todo)
            self._split(todo)
        return True

    def ends(self, k: int) -> list[int]:
        """The leaves, at most ``k``."""
        kept, out, todo = self.kept(k)[0], [], [0]
        while todo:
            i = todo.pop()
            if i in kept:
                todo.extend((self.child[i], self.child[i] + 1))
            else:
                out.append(i)
        return out


def _unit(words: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words, total / max(float(np.linalg.norm(total)), 1e-9)


def _held_tree(rows: pa.RecordBatch, n_words: int, k: int) -> _Bisection:
    """The splits of rows (``mark, words, weights, times``) that are at hand; rows of settled nodes are set aside."""
    rows = pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(np.zeros(rows.num_rows, np.int64))], ["mark", "words", "weights", "times", "node"])
    held = [rows]

    def settle(tree: _Bisection, todo: list[int]) -> None:
        node = _look(tree.state(), held[0])[3]
        moved = pa.RecordBatch.from_arrays([*held[0].columns[:4], pa.array(node)], held[0].schema.names)
        held[0] = moved.take(pa.array(np.flatnonzero(np.isin(node, todo))))
        tree.keys, tree.values = np.zeros(0, np.int64), np.zeros(0)

    tree = _Bisection(lambda task, _, state: pa.Table.from_batches(task(state, iter(held))), n_words)
    tree.grow(k, settle=settle)
    return tree


def bisecting_means(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of at most ``k`` leaves; the leaf with the greatest spread is split next."""
    words = pa.array([np.flatnonzero(v).astype(np.int32) for v in x], pa.list_(pa.int32()))
    weights = pa.array([v[v != 0].astype(np.float32) for v in x], pa.list_(pa.float32()))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int64)), words, weights, pa.array(np.ones(len(x)))], ["mark", "words", "weights", "times"])
    tree = _held_tree(rows, x.shape[1], k)
    found = [_unit(*tree.sums[i]) for i in tree.ends(k)] if tree.n else []
    out = np.zeros((len(found), x.shape[1]), np.float32)
    for i, (w, v) in enumerate(found):
        out[i, w] = v
    return out


def _leaves(vectors: DataFrame, n_words: int, k: int, task_rows: int = 200_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words and weights of the unit centroids of at most ``k`` leaves of the table ``mark, words, weights`` and maybe ``times``.

    Nodes of more than ``task_rows`` rows are split by sums over the whole
    table; a smaller node goes to one task, which splits it to the end, in the
    same way: the leaves are the same wherever that begins. The driver gets
    the sizes of these nodes, and the sums of the leaves that are kept.
    """
    context = vectors.sparkSession.sparkContext
    times = F.col("times").cast("double") if "times" in vectors.columns else F.lit(1.0)
    vectors = vectors.select("mark", "words", "weights", times.alias("times"))

    def run(task, shape: str, state: tuple) -> pa.Table:
        # sent apart from the task, so that it can be removed at once
        shared = context.broadcast(state)
        try:
            return vectors.mapInArrow(lambda batches: task(shared.value, batches), shape).toArrow()
        finally:
            shared.destroy()

    tree = _Bisection(run, n_words)
    if not tree.grow(k, task_rows):
        return []
    todo = tree.kept(k)[1]
    if todo:
        shared = context.broadcast((tree.state(), np.array(todo)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, wanted = shared.value
            for b in batches:
                node = _look(state, b)[3]
                moved = pa.RecordBatch.from_arrays([pa.array(node), *b.columns[:4]], ["node", "mark", "words", "weights", "times"])
                yield moved.take(pa.array(np.flatnonzero(np.isin(node, wanted))))

        def finish(group: pa.Table) -> pa.Table:
            own = group.select(["mark", "words", "weights", "times"]).combine_chunks().to_batches()[0]
            part = _held_tree(own, n_words, k)
            words, sums = (pa.array([v[i] for v in part.sums], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.float64())))
            root = pa.array(np.full(len(part.n), group.column("node")[0].as_py()))
            return pa.table({"root": root, "i": pa.array(range(len(part.n)), pa.int32()), "child": pa.array(part.child, pa.int32()), "way": pa.array(part.way), "n": pa.array(part.n), "times": pa.array(part.times), "norm": pa.array(part.norm), "words": words, "sums": sums})

        rows = vectors.mapInArrow(place, "node long, mark long, words array<int>, weights array<float>, times double")
        below = rows.groupBy("node").applyInArrow(finish, "root long, i int, child int, way string, n double, times double, norm double, words array<int>, sums array<double>")
        below = materialize(below, "subject-nodes")
        shared.destroy()
        of: dict[int, tuple[int, int]] = {}
        for part in below.select("root", "i", "child", "way", "n", "times", "norm").toPandas().sort_values(["root", "i"]).groupby("root"):
            root, nodes = part
            # node 0 of a part is its root; the others follow the nodes that are known so far
            name = lambda i, root=root, first=len(tree.child): root if i == 0 else first + i - 1
            for i, child, way, n, times, norm in zip(*(nodes[c] for c in ("i", "child", "way", "n", "times", "norm")), strict=True):
                of[name(i)] = (int(root), int(i))
                if i:
                    tree.child.append(-1)
                    tree.way.append(tree.way[root] + way)
                    tree.n.append(n)
                    tree.times.append(times)
                    tree.norm.append(norm)
                    tree.sums.append((np.zeros(0, np.int64), np.zeros(0)))
                if child >= 0:
                    tree.child[name(i)] = name(child)
        ends = tree.ends(k)
        wanted = vectors.sparkSession.createDataFrame([of[i] for i in ends if i in of] or [(-1, -1)], "root long, i int")
        sums = {(r["root"], r["i"]): (np.array(r["words"], np.int64), np.array(r["sums"], float)) for r in below.join(F.broadcast(wanted), ["root", "i"]).select("root", "i", "words", "sums").toArrow().to_pylist()}
        return [_unit(*(sums[of[i]] if i in of else tree.sums[i])) for i in ends]
    return [_unit(*tree.sums[i]) for i in tree.ends(k)]


def _vocabulary(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Words of at least 3 texts that are no names, and their idf over sentences, counted over all texts.

    Words that stand with a capital inside sentences are names (places, persons, months); they tell of no subject.
    Nor do words that one text alone repeats: mostly names that never stand inside a sentence. Words that no text in
    both cases has inside a sentence may be names too: they must stand in one of 10,000 of such texts, if there are any.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df, n_texts, inside, capital, small = Counter(), Counter(), Counter(), Counter(), Counter()
            for t in b.column(0).to_pylist():
                every = set()
                for words, _ in _plain_sentences(t):
                    df.update(own := set(words))
                    every |= own
                    df[""] += 1  # all sentences
                n_texts.update(every)
                if not (t.isupper() or t.islower()):
                    n_texts[""] += 1  # texts in both cases
                    for part in _END.split(t):
                        inside.update(_WORD.findall(part)[1:])
            for w, n in inside.items():
                (capital if w[0].isupper() else small)[w.lower()] += n
            every = sorted({*df, *capital, *small})
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in (df, n_texts, capital, small))], ["word", "n", "texts", "capital", "small"])

    sums = texts.mapInArrow(count, "word string, n long, texts long, capital long, small long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "texts", "capital", "small")))
    found = {r.word: r for r in sums.where("word = '' or (texts >= 3 and capital <= 3 * small)").collect()}
    every = found.pop("", None)
    kept = sorted(w for w, r in found.items() if r.small or 10_000 * r.texts >= every.texts)
    return kept, np.array([np.log(every.n / found[w].n) for w in kept], np.float32)


def _split(texts: DataFrame, model: SubjectModel) -> DataFrame:
    """``key, example, known, own``: the known words of the sentences of each text (``key, example, t``), and whether they may tell of own work.

    Kept, so that the texts are split once for all that follows. The places of the words are packed.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    key_type = dict(texts.dtypes)["key"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            known, own = [], []
            for t in b.column(2).to_pylist():
                found = [(key, o) for w, o in own_sentences(t) if (key := m.known(w))]
                known.append([np.array(key, np.int32).tobytes() for key, _ in found])
                own.append([o for _, o in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(known, pa.list_(pa.binary())), pa.array(own, pa.list_(pa.bool_()))], ["key", "example", "known", "own"])

    return materialize(texts.mapInArrow(place, f"key {key_type}, example boolean, known array<binary>, own array<boolean>"), "subject-split")


def _sentences(split: DataFrame, model: SubjectModel) -> DataFrame:
    """``mark, words, weights, times``: the vector of every distinct sentence of the texts that may tell of own work, and how often it stands there.

    Only these are given a leaf later; the others would take leaves away from them.
    """
    shared = split.sparkSession.sparkContext.broadcast(model)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(k, np.int32) for k in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], ["known", "times"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shared.value.vector(tuple(k)) for k in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in at], pa.list_(pa.int32())), pa.array([v for _, v in at], pa.list_(pa.float32())), b.column(2)], ["mark", "words", "weights", "times"])

    told = split.select(F.inline(F.arrays_zip("known", "own"))).where("own")
    distinct = told.groupBy("known").agg(F.count("*").alias("times")).mapInArrow(unpack, "known array<int>, times long")
    return materialize(distinct.select(F.xxhash64("known").alias("mark"), "known", "times").mapInArrow(weigh, "mark long, words array<int>, weights array<float>, times long"), "subject-sentences")


def train(records: DataFrame, text_col: str, examples: DataFrame, leaves: int = 1500, sharpen: int = 3, spread: float = 0.5, most_examples: int = 20_000) -> SubjectModel:
    """The model of ``_fit``."""
    return _fit(records, None, text_col, examples, leaves, sharpen, spread, most_examples)[0]


def _fit(records: DataFrame, key_col: str | None, text_col: str, examples: DataFrame, leaves: int = 1500, sharpen: int = 3, spread: float = 0.5, most_examples: int = 20_000) -> tuple[SubjectModel, DataFrame | None]:
    """Fits leaves on the sentences of all texts and labels them from the examples and the whole collection.

    Words are counted over all texts, and the rounds of the clustering are sums
    over the vectors of all distinct sentences. Only the labelled examples come
    to the driver; over ``most_examples`` of these are an error. Leaves are labelled by discriminative terms of the
    examples (``subject``, ``text``). What no example shows is learnt from all
    records: a leaf takes the subjects of the documents in which its sentences
    stand, so far as these exceed the subjects of all documents, and the
    labels are sharpened ``sharpen`` times over the whole collection.

    Returns the model and, if it has leaves, the ``key`` (the column ``key_col``)
    and the leaves of the own sentences of each record with a text.
    """
    given = [(r.subject, r.text) for r in examples.where("subject is not null and text is not null").select("subject", "text").limit(most_examples + 1).collect()]
    if len(given) > most_examples:
        raise ValueError(f"over {most_examples} labelled examples")
    subjects = sorted({s for s, _ in given})
    shown = [(subjects.index(s), w) for s, t in given for w, own in own_sentences(t) if own]
    key = (F.col(key_col) if key_col else F.lit(None).cast("long")).alias("key")
    texts = records.where(F.col(text_col).isNotNull()).select(key, F.lit(False).alias("example"), F.col(text_col).cast("string").alias("t"))
    if given:
        told = records.sparkSession.createDataFrame([(t,) for _, t in given], "t string")
        texts = texts.unionByName(told.select(F.lit(None).cast(dict(texts.dtypes)["key"]).alias("key"), F.lit(True).alias("example"), "t"))
    kept, idf = _vocabulary(texts.select("t"))
    model = SubjectModel(subjects, {w: i for i, w in enumerate(kept)}, idf, Leaves.of([], len(kept)))
    if kept and subjects:
        split = _split(texts, model)
        vectors = _sentences(split, model)
        model.leaves = Leaves.of(_leaves(vectors, len(kept), leaves), len(kept))
    if not model.leaves.number:
        model.mixture = np.zeros((1, len(subjects)))
        return model, None

    # discriminative terms: how much more often a term stands in a subject's examples than in all
    n_of = np.ones((len(subjects), len(kept)))
    for s, w in shown:
        for i in {model.place[x] for x in w if x in model.place}:
            n_of[s, i] += 1
    share = n_of / n_of.sum(1, keepdims=True)
    strength = np.log(share / share.mean(0))
    strength[:, n_of.sum(0) < len(subjects) + 2] = 0
    score = model.leaves.times(np.maximum(strength, 0).T)
    seen = np.zeros((model.leaves.number, len(subjects)))
    for s, w in shown:
        if (leaf := model.leaf(w)) >= 0:
            seen[leaf, s] += 1
    total = seen.sum(1, keepdims=True)
    pure = np.where(total > 0, seen / np.maximum(total, 1), 0.0)
    by_terms = np.where(score >= np.maximum(1.0, 0.9 * score.max(1, keepdims=True)), 1.0, 0.0)
    # seeds: leaves whose examples agree and whose terms say the same
    model.mixture = np.where((pure >= 0.8) & (by_terms > 0), pure, 0.0)

    lists = _leaf_lists(split.where("not example"), model)
    for _ in range(sharpen):
        together, alone = _co_occurrence(lists, model)
        base = together.sum(0) / max(alone.sum(), 1.0)
        rate = together / np.maximum(alone[:, None], 1.0)
        lift = np.maximum(rate - base, 0) / np.maximum(1 - base, 1e-9)
        learnt = np.where((lift >= spread) & (lift >= lift.max(1, keepdims=True)) & (alone[:, None] >= 3), lift, 0.0)
        model.mixture = np.where(alone[:, None] >= 3, learnt, model.mixture)
    return model, lists


def _leaf_lists(split: DataFrame, model: SubjectModel) -> DataFrame:
    """``key, leaves``: the leaves of the own sentences of every text, kept for all rounds."""
    shared = split.sparkSession.sparkContext.broadcast(model)
    key_type = dict(split.dtypes)["key"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held: dict[bytes, int] = {}
        for b in batches:
            lists = []
            for known, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lists.append([])
                for key, o in zip(known, own, strict=True):
                    if o:
                        if (leaf := held.get(key)) is None:
                            leaf = m.leaf_of(tuple(np.frombuffer(key, np.int32).tolist()))
                            if len(held) < 100_000:
                                held[key] = leaf
                        lists[-1].append(leaf)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], ["key", "leaves"])

    return materialize(split.select("key", "known", "own").mapInArrow(place, f"key {key_type}, leaves array<int>"), "subject-leaves")


def _co_occurrence(lists: DataFrame, model: SubjectModel) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf: documents with its sentences by subjects that other sentences have, and all such documents.

    Every task sends one matrix of leaves x subjects, whatever its number of records.
    """
    mixture = model.mixture
    n_leaves, n_subjects = mixture.shape
    shared = lists.sparkSession.sparkContext.broadcast(mixture)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = shared.value
        together, alone = np.zeros((n_leaves, n_subjects)), np.zeros(n_leaves)
        for b in batches:
            for found in map(sorted, map(set, b.column(0).to_pylist())):
                # what the other sentences tell, for each leaf of the document
                rest = mix[found].sum(0) - mix[found]
                told = rest.sum(1) > 1e-9
                at = np.array(found, int)[told]
                together[at] += rest[told] > 0.25
                alone[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array([together.ravel().tolist()]), pa.array([alone.tolist()])], ["together", "alone"])

    rows = lists.select("leaves").mapInArrow(count, "together array<double>, alone array<double>")
    sums = rows.select(F.posexplode(F.concat("together", "alone"))).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    flat = np.zeros(n_leaves * (n_subjects + 1))
    for r in sums:
        flat[r.pos] = r.n
    return flat[: n_leaves * n_subjects].reshape(n_leaves, n_subjects), flat[n_leaves * n_subjects :]


def subject_areas(records: DataFrame, key_col: str, text_col: str, model: SubjectModel, least_sentences: int = 2, clear: float = 0.5) -> DataFrame:
    """Subjects of each document by the mixtures of its sentences' leaves.

    A sentence counts for the subject that has most of its leaf's mixture, if
    that is at least ``clear`` and the sentence does not tell of relatives, namesakes, pastimes
    or wishes. A document has every subject with at least ``least_sentences``
    sentences; ``share`` is the subject's part of the sentences that count.

    Null keys, null and empty texts give no rows; a repeated row gives its
    subjects again; other columns are ignored. One narrow pass, no shuffle.

    Returns ``<key>, subject, n_sentences, share``.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    key_type = dict(records.dtypes)[key_col]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lists = [[m.leaf(words) for words, own in own_sentences(text) if own and m.subjects] for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], ["key", "leaves"])

    given = records.where(F.col(key_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return _areas(given.mapInArrow(place, f"key {key_type}, leaves array<int>"), key_col, model, least_sentences, clear)


def fitted_areas(records: DataFrame, key_col: str, text_col: str, examples: DataFrame, least_sentences: int = 2, clear: float = 0.5) -> DataFrame:
    """``subject_areas`` of the records on which the model is trained; their texts are split once for both."""
    model, lists = _fit(records, key_col, text_col, examples)
    if lists is None:
        return subject_areas(records, key_col, text_col, model, least_sentences, clear)
    return _areas(lists.where("key is not null"), key_col, model, least_sentences, clear)


def _areas(lists: DataFrame, key_col: str, model: SubjectModel, least_sentences: int, clear: float) -> DataFrame:
    """Subjects of each ``key`` with the ``leaves`` of its own sentences (-1: none)."""
    key_type = dict(lists.dtypes)["key"]
    subjects = model.subjects
    of_leaf = np.where(model.mixture.max(1) >= clear, model.mixture.argmax(1), -1) if subjects else np.zeros(0, int)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, leaves in enumerate(b.column(1).to_pylist()):
                told = Counter(int(of_leaf[leaf]) for leaf in leaves if leaf >= 0 and of_leaf[leaf] >= 0)
                for s, n in sorted(told.items()):
                    if n >= least_sentences:
                        at.append(i)
                        rows.append((subjects[s], n, n / told.total()))
            if rows:
                s, n, share = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(s), pa.array(n, pa.int32()), pa.array(share)], ["key", "subject", "n_sentences", "share"])

    return lists.mapInArrow(scan, f"key {key_type}, subject string, n_sentences int, share double").withColumnRenamed("key", key_col)
