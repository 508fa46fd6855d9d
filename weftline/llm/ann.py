"""k most similar vectors of every vector: inverted file with product-quantised residuals and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.overlap import _mix
from weftline.runtime import materialize

#: Dimensions of the sign projection and of the learned one that stand for a sparse vector in the index; reranking uses the sparse vector itself.
SKETCH_DIM = 128
LEARNED_DIM = 256
#: Terms and sampled vectors that the learned projection is fitted on: a documented bound on the fit, every row is indexed.
LEARNED_TERMS = 2048
LEARNED_ROWS = 8000


# --- vectors ---------------------------------------------------------------------------------


class Dense:
    """Arrays of a fixed length. Unusable: null, another length, a null or NaN or infinite component, zero norm."""

    def __init__(self, dim: int) -> None:
        self.dim = self.index_dim = dim

    def payloads(self, column: pa.Array) -> list[bytes | None]:
        size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
        good = np.flatnonzero(size == self.dim)
        out: list[bytes | None] = [None] * len(column)
        if len(good):
            flat = column.take(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, self.dim)
            norm = np.sqrt((flat**2).sum(1))
            usable = np.isfinite(norm) & (norm > 0)
            unit = (flat[usable] / norm[usable, None]).astype(np.float32)
            for k, row in zip(good[usable], unit, strict=True):
                out[k] = row.tobytes()
        return out

    def sketch(self, payloads: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(payloads), np.float32).reshape(-1, self.dim)

    def packing(self, sample: list[bytes]) -> _Plain:
        return _Plain()

    def view(self, name: str, number: int, sample: list[bytes]) -> Callable[[list[bytes]], np.ndarray]:
        """What an inverted file is built on: the vector itself."""
        return self.sketch

    def exact(self, payloads: list[bytes]):
        x = self.sketch(payloads).astype(np.float64)

        def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.empty(len(a))
            for s in range(0, len(a), 100_000):
                total[s : s + 100_000] = np.einsum("ij,ij->i", x[a[s : s + 100_000]], x[b[s : s + 100_000]])
            return total

        return dots


class Sparse:
    """Maps from term to weight. Null, NaN and zero weights are left out; unusable: null, or nothing left.

    Terms travel as 32-bit hashes: in a pair of records of a hundred terms each,
    two different terms are taken for one with a chance of 2 in a million.
    """

    index_dim = SKETCH_DIM

    def payloads(self, column: pa.Array) -> list[bytes | None]:
        offsets = column.offsets.to_numpy()
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        keys = column.keys.dictionary_encode()
        weights = column.items.cast(pa.float64()).to_numpy(zero_copy_only=False)
        ours = np.fromiter((xxhash.xxh32_intdigest(t) for t in keys.dictionary.to_pylist()), np.uint32)
        terms = ours[keys.indices.to_numpy()] if len(ours) else np.zeros(0, np.uint32)
        out: list[bytes | None] = []
        for k in range(len(column)):
            a, b = offsets[k], offsets[k + 1]
            if not valid[k] or a == b:
                out.append(None)
                continue
            w, t = weights[a:b], terms[a:b]
            kept = np.isfinite(w) & (w != 0)
            if not kept.any():
                out.append(None)
                continue
            w, t = w[kept], t[kept]
            order = np.argsort(t)
            w = w[order] / math.sqrt(float(w @ w))
            out.append(np.concatenate([t[order].view(np.uint8), w.astype(np.float32).view(np.uint8)]).tobytes())
        return out

    @staticmethod
    def _parts(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.fromiter((len(p) // 8 for p in payloads), np.int64, len(payloads))
        terms = np.frombuffer(b"".join(p[: 4 * k] for p, k in zip(payloads, n, strict=True)), np.uint32).astype(np.uint64)
        weights = np.frombuffer(b"".join(p[4 * k :] for p, k in zip(payloads, n, strict=True)), np.float32)
        return n, terms, weights

    def packing(self, sample: list[bytes]) -> _ShortTerms:
        terms, n = np.unique(self._parts(sample)[1], return_counts=True)
        return _ShortTerms(np.sort(terms[np.argsort(-n, kind="stable")[:65_535]]).astype(np.uint32))

    def view(self, name: str, number: int, sample: list[bytes]) -> Callable[[list[bytes]], np.ndarray]:
        """What an inverted file is built on.

        ``signs``: a random sign projection, which keeps all terms alike and so
        finds near twins by whatever they share; files of different ``number``
        have independent signs. ``learned``: the principal directions of the
        terms that weigh most in the sample, which rank vectors that share no
        more than their common terms; its length tells how much of a vector it
        explains, so it is not normalised.
        """
        if name == "signs":
            return _Signs(number)
        if name == "learned":
            return _Learned.fit(sample)
        raise ValueError(f"no view of sparse vectors is called {name!r}")

    def exact(self, payloads: list[bytes]):
        n, terms, weights = self._parts(payloads)
        start = np.cumsum(n) - n
        # terms are numbered within the group; some records at a time lie open, the others' terms look up their weights
        number = np.unique(terms, return_inverse=True)[1]
        width = int(number.max()) + 1 if len(number) else 1
        together = max(1, 2_000_000 // width)
        open_rows = np.zeros((together, width), np.float32)

        def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places of the entries of rows, and their number in each."""
            many = n[rows]
            return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[rows], many), many

        def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.zeros(len(a))
            by = np.argsort(a, kind="stable")
            own, first = np.unique(a[by], return_index=True)
            first = np.append(first, len(a))
            for s in range(0, len(own), together):
                rows = own[s : s + together]
                at, many = spread(rows)
                slot = np.repeat(np.arange(len(rows)), many)
                open_rows[slot, number[at]] = weights[at]
                end = first[s + len(rows)]
                for lo in range(first[s], end, 20_000):
                    some = by[lo : min(lo + 20_000, end)]
                    other, count = spread(b[some])
                    where = np.repeat(np.searchsorted(rows, a[some]), count)
                    value = open_rows[where, number[other]].astype(np.float64) * weights[other]
                    total[some] = np.add.reduceat(value, np.cumsum(count) - count)
                open_rows[slot, number[at]] = 0.0
            return total

        return dots


class _Plain:
    """Payloads travel as they are."""

    def pack(self, payloads: list[bytes]) -> list[bytes]:
        return payloads

    unpack = pack


@dataclass
class _ShortTerms:
    """Payloads travel with two bytes in place of four for each of the (at most 65,535) most frequent terms of the sample."""

    terms: np.ndarray

    def pack(self, payloads: list[bytes]) -> list[bytes]:
        out = []
        for p in payloads:
            t = np.frombuffer(p, np.uint32, len(p) // 8)
            at = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
            short = self.terms[at] == t
            w = np.frombuffer(p, np.float32, len(t), 4 * len(t))
            parts = (np.array([len(t), short.sum()], np.uint32), at[short].astype(np.uint16), t[~short], w[short], w[~short])
            out.append(b"".join(x.tobytes() for x in parts))
        return out

    def unpack(self, packed: list[bytes]) -> list[bytes]:
        out = []
        for p in packed:
            n, s = (int(v) for v in np.frombuffer(p, np.uint32, 2))
            at = 8 + 2 * s
            rest = 4 * (n - s)
            out.append(self.terms[np.frombuffer(p, np.uint16, s, 8)].tobytes() + p[at : at + rest] + p[at + rest :])
        return out


class _Signs:
    """Sum of a vector's weights under random signs of its terms, in ``SKETCH_DIM`` dimensions, normalised."""

    def __init__(self, number: int) -> None:
        self.number = number

    def __call__(self, payloads: list[bytes]) -> np.ndarray:
        out = np.empty((len(payloads), SKETCH_DIM), np.float32)
        for s in range(0, len(payloads), 400):
            n, terms, weights = Sparse._parts(payloads[s : s + 400])
            bits = np.stack([_mix(terms, 11 + 2 * self.number), _mix(terms, 12 + 2 * self.number)], 1).view(np.uint8)
            signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
            signs *= weights[:, None]
            out[s : s + 400] = np.add.reduceat(signs, np.cumsum(n) - n, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class _Learned:
    """Projection on the principal directions of the heaviest terms."""

    terms: np.ndarray
    directions: np.ndarray

    @classmethod
    def fit(cls, sample: list[bytes]) -> _Learned:
        n, terms, weights = Sparse._parts(sample[:LEARNED_ROWS])
        names, number = np.unique(terms, return_inverse=True)
        mass = np.bincount(number, weights=weights.astype(float) ** 2)
        kept = np.sort(np.argsort(-mass, kind="stable")[:LEARNED_TERMS])
        model = cls(names[kept], np.eye(len(kept), dtype=np.float32))
        spread = np.zeros((len(kept), len(kept)), np.float32)
        for s in range(0, len(n), 1000):
            x = model._open(sample[s : min(s + 1000, len(n))])
            spread += x.T @ x
        model.directions = np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1][:, :LEARNED_DIM])
        # the codes take parts of equal width
        short = -model.directions.shape[1] % 32
        if short:
            model.directions = np.pad(model.directions, ((0, 0), (0, short)))
        return model

    def _open(self, payloads: list[bytes]) -> np.ndarray:
        n, terms, weights = Sparse._parts(payloads)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        x = np.zeros((len(n), len(self.terms)), np.float32)
        x[np.repeat(np.arange(len(n)), n)[hit], at[hit]] = weights[hit]
        return x

    def __call__(self, payloads: list[bytes]) -> np.ndarray:
        parts = [self._open(payloads[s : s + 400]) @ self.directions for s in range(0, len(payloads), 400)]
        return np.concatenate(parts) if parts else np.zeros((0, self.directions.shape[1]), np.float32)


# --- index -----------------------------------------------------------------------------------


def _sums(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows of each label."""
    order = np.argsort(label, kind="stable")
    found, first = np.unique(label[order], return_index=True)
    total, number = np.zeros((k, x.shape[1]), np.float32), np.zeros(k, np.int64)
    if len(found):
        total[found] = np.add.reduceat(x[order], first, axis=0)
        number[found] = np.diff(np.append(first, len(label)))
    return total, number


def _spherical_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, start: np.ndarray | None = None) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)] if start is None else start
    for _ in range(rounds):
        near = np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])
        total = _sums(x, near, len(c))[0]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c


@dataclass
class IvfPq:
    """Coarse centroids (grouped into cells, the unit of shuffling) and codebooks of the residuals."""

    centroids: np.ndarray
    cell_of: np.ndarray
    books: np.ndarray
    blocks: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, n_lists: int, n_cells: int, sub: int, expected: float, seed: int = 7) -> IvfPq:
        rng = np.random.default_rng(seed)
        top = _spherical_means(sample, n_cells, rng)
        home = (sample @ top.T).argmax(1)
        lists, cells = [], []
        for c in range(len(top)):
            own = sample[home == c]
            if len(own):
                part = _spherical_means(own, max(1, round(n_lists * len(own) / len(sample))), rng)
                lists.append(part)
                cells.append(np.full(len(part), c))
        centroids, cell_of = np.concatenate(lists), np.concatenate(cells)
        # the lists of one cell know nothing of those beside it: two rounds over all of them
        centroids = _spherical_means(sample, len(centroids), rng, 2, centroids)
        near = np.concatenate([(sample[s : s + 4096] @ centroids.T).argmax(1) for s in range(0, len(sample), 4096)])
        residual = sample - centroids[near]
        width = sample.shape[1] // sub
        books = np.zeros((sub, 256, width), np.float32)
        rows = residual[rng.choice(len(residual), min(len(residual), 10_000), replace=False)]
        for m in range(sub):
            x = rows[:, m * width : (m + 1) * width]
            book = x[rng.choice(len(x), 256, replace=len(x) < 256)]
            for _ in range(5):
                total, count = _sums(x, cls._nearest(x, book), 256)
                book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
            books[m] = book
        # a cell that holds far more than its share of the sample is split into blocks of base rows
        share = np.bincount(cell_of[near], minlength=len(top)) / len(sample)
        blocks = np.maximum(1, np.ceil(share * expected)).astype(int)
        return cls(centroids, cell_of, books, blocks)

    @staticmethod
    def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book**2).sum(1)[None] - 2 * x @ book.T).argmin(1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists with the most similar centroids, the best first."""
        n = min(n, len(self.centroids))
        out = np.empty((len(x), n), np.int32)
        for s in range(0, len(x), 2048):
            sims = x[s : s + 2048] @ self.centroids.T
            some = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.tile(np.arange(n), (len(sims), 1))
            order = np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable")
            out[s : s + 2048] = np.take_along_axis(some, order, 1)
        return out

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual, width = x - self.centroids[lists], self.books.shape[2]
        return np.stack([self._nearest(residual[:, m * width : (m + 1) * width], b) for m, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables: inner products of each query part with each codeword."""
        width = self.books.shape[2]
        return np.stack([q[:, m * width : (m + 1) * width] @ b.T for m, b in enumerate(self.books)], 0)

    def approximate(self, q: np.ndarray, tables: np.ndarray, codes: np.ndarray, which_list: int) -> np.ndarray:
        """Inner products of queries with the coded rows of a list."""
        score = np.repeat((q @ self.centroids[which_list])[:, None], len(codes), 1)
        for m in range(len(self.books)):
            score += tables[m][:, codes[:, m]]
        return score


@dataclass
class _Files:
    """The inverted files of one search: a view and an index each, their cells numbered through."""

    views: list[Callable[[list[bytes]], np.ndarray]]
    indexes: list[IvfPq]
    probes: list[int]
    first_cell: np.ndarray
    packing: _Plain | _ShortTerms

    @staticmethod
    def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12).astype(np.float32)
        return (x / norm[:, None]).astype(np.float32), norm


def similar_vectors(
    records: DataFrame,
    key_col: str,
    vector_col: str,
    kind: Dense | Sparse,
    k: int = 5,
    files: tuple[tuple[str, float], ...] = (("plain", 8),),
    list_rows: int = 32,
    max_lists: int = 8192,
    train_rows: int = 30_000,
    sub: int = 16,
    rerank: int = 128,
    queries: str | None = None,
    at_least: float | None = None,
) -> DataFrame:
    """The ``k`` most similar other records of every record, by cosine similarity.

    Each of the inverted ``files`` (view, probes; see ``Sparse.view``) is
    fitted on a sample of at most ``train_rows`` vectors (a documented bound;
    drawn by hash of the key) from a start of its own, so that what one misses
    another finds; every usable vector stands in every file. In each file a vector is sent
    once to its own cell and once to each other cell that holds one of its
    nearest lists, as many as there are ``probes`` (below 1: a share of the
    lists). There the rows of these lists are scored with asymmetric tables
    against the codes, the best ``rerank`` of a cell are scored exactly, and
    partial results of all cells and files meet in a top-k. A cell that holds
    more than its share is cut into a grid of blocks of rows and of seekers.
    Pairs of an exact similarity below ``at_least`` are left out of the result.
    ``queries``, an SQL condition on the key, restricts the records for which
    neighbours are sought, never the records among which.

    Exact copies are searched once: each record first gets its copies by
    ascending key. Ties go to the smaller key. Unusable vectors (see ``Dense``
    and ``Sparse``) and null keys take no part, repeated deliveries count once,
    an empty table gives no rows; other columns are ignored.

    Returns ``key, neighbour, similarity, rank``.
    """
    spark = records.sparkSession
    key_type = dict(records.dtypes)[key_col]
    asked = F.coalesce(F.expr(queries), F.lit(False)) if queries else F.lit(True)
    source = records.select(F.col(key_col).alias("key"), F.col(vector_col).alias("v"), asked.alias("asked"))
    source = source.where("key is not null and v is not null")

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [p and xxhash.xxh3_128_digest(p) for p in kind.payloads(b.column(1))]
            kept = pa.array([i for i, m in enumerate(marks) if m])
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), pa.array([m for m in marks if m], pa.binary()), b.column(2).take(kept)], ["key", "mark", "asked"])

    ids = materialize(source.mapInArrow(fingerprints, f"key {key_type}, mark binary, asked boolean").distinct(), "vector-ids")
    classes = ids.groupBy("mark").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked"))
    copies = materialize(classes.where("n > 1"), "vector-copies")
    extra, repeated = copies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = ids.count()
    distinct = total - extra + repeated
    if not total:
        return ids.select("key", F.col("key").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    # at most 1000 classes can hold a thousandth of all rows
    hot_rows = copies.where(F.col("n") > max(100, total // 1000)).collect()
    hot = {bytes(r.mark): r.rep for r in hot_rows}
    hot_asked = {bytes(r.mark) for r in hot_rows if r.asked}

    per_10000 = max(1, min(10_000, 11_000 * train_rows // total))
    picked = source.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(10_000)) < per_10000).select("v").limit(2 * train_rows).mapInArrow(_payload_rows(kind), "p binary").toPandas()["p"].tolist()
    if not picked:
        picked = source.select("v").limit(train_rows).mapInArrow(_payload_rows(kind), "p binary").toPandas()["p"].tolist()
    sample = list(dict.fromkeys(map(bytes, picked)))[:train_rows]
    n_lists = max(1, min(max_lists, distinct // list_rows))
    n_cells = max(1, min(n_lists, max(4, distinct // 15_000)))
    views = [kind.view(name, i, sample) for i, (name, _) in enumerate(files)]
    indexes = [IvfPq.fit(_Files.unit(v(sample))[0], n_lists, n_cells, sub, distinct / 24_000, seed=7 + i) for i, v in enumerate(views)]
    probes = [max(1, math.ceil(p * len(ix.centroids))) if p < 1 else int(p) for (_, p), ix in zip(files, indexes, strict=True)]
    shared = spark.sparkContext.broadcast(_Files(views, indexes, probes, np.cumsum([0, *(len(ix.blocks) for ix in indexes)]), kind.packing(sample)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                payloads, keys, asked = kind.payloads(b.column(1)), b.column(0).to_pylist(), b.column(2).to_pylist()
                kept = []
                for i, p in enumerate(payloads):
                    if p is not None:
                        if hot and (mark := xxhash.xxh3_128_digest(p)) in hot:
                            if hot[mark] != keys[i]:
                                continue
                            asked[i] = mark in hot_asked
                        kept.append(i)
                if not kept:
                    continue
                some = [payloads[i] for i in kept]
                packed = dict(zip(kept, held.packing.pack(some), strict=True))
                for view, ix, n_probe, offset in zip(held.views, held.indexes, held.probes, held.first_cell.tolist(), strict=False):
                    lists = ix.probes(held.unit(view(some))[0], n_probe)
                    rows: list[tuple] = []
                    for r, i in enumerate(kept):
                        own = int(ix.cell_of[lists[r, 0]])
                        reached: dict[int, list[int]] = {own: []}
                        if asked[i]:
                            for one in lists[r].tolist():
                                reached.setdefault(int(ix.cell_of[one]), []).append(one)
                        for cell, probed in reached.items():
                            # a grid of blocks: rows by line, seekers by column; a vector of both meets itself in one place
                            n = int(ix.blocks[cell])
                            at = xxhash.xxh32_intdigest(payloads[i]) % n
                            places = {(at, j) for j in range(n)} if cell == own else set()
                            if probed:
                                places |= {(j, at) for j in range(n)}
                            for line, column in sorted(places):
                                base = cell == own and line == at
                                rows.append((offset + cell, line * n + column, keys[i], int(lists[r, 0]) if base else -1, probed if column == at else [], packed[i]))
                    cell, block, key, base, probed, payload = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(key, b.column(0).type), pa.array(base, pa.int32()), pa.array(probed, pa.list_(pa.int32())), pa.array(payload, pa.binary())],
                        ["cell", "block", "key", "base_list", "probed", "payload"],
                    )

    def search(group: pa.Table) -> pa.Table:
        held = shared.value
        file = int(np.searchsorted(held.first_cell, group.column("cell")[0].as_py(), "right")) - 1
        ix = held.indexes[file]
        keys, base_list, probed, payloads = (group.column(c).to_pylist() for c in ("key", "base_list", "probed", "payload"))
        # copies and repeated deliveries meet here: the smallest key stands for them
        rows: dict[bytes, int] = {}
        wants: dict[bytes, list] = {}
        bases: dict[bytes, int] = {}
        for i, p in enumerate(payloads):
            if p not in rows or keys[i] < keys[rows[p]]:
                rows[p] = i
            if probed[i]:
                wants[p] = probed[i]
            if base_list[i] >= 0:
                bases[p] = base_list[i]
        names = list(rows)
        unit = [keys[rows[p]] for p in names]
        rank_of = np.empty(len(unit), np.int64)
        rank_of[sorted(range(len(unit)), key=unit.__getitem__)] = np.arange(len(unit))
        kt = group.schema.field("key").type
        vectors = held.packing.unpack(names)
        x, norm = held.unit(held.views[file](vectors))
        exact = kind.exact(vectors)
        # rows by list, and what each seeker asks of each list, seekers in portions of bounded work
        of = np.array([bases.get(p, -1) for p in names])
        by_list = np.argsort(of, kind="stable")
        base_start = np.searchsorted(of[by_list], np.arange(len(ix.centroids) + 1))
        ask_who = np.repeat(np.arange(len(names)), [len(wants.get(p, ())) for p in names])
        ask_list = np.array([one for p in names for one in wants.get(p, ())], np.int64)
        met = np.diff(base_start)[ask_list] if len(ask_list) else np.zeros(0, np.int64)
        portion = np.cumsum(met) // 4_000_000
        portion = np.maximum.accumulate(portion[np.searchsorted(ask_who, ask_who)]) if len(met) else portion
        codes = np.zeros((len(names), len(ix.books)), np.uint8)
        held_here = np.flatnonzero(of >= 0)
        codes[held_here] = ix.encode(x[held_here], of[held_here])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for one in np.unique(portion).tolist():
            asks = np.flatnonzero(portion == one)
            asks = asks[np.argsort(ask_list[asks], kind="stable")]
            lists, first = np.unique(ask_list[asks], return_index=True)
            who, whom, scores = [], [], []
            for a, z, which in zip(first.tolist(), [*first[1:].tolist(), len(asks)], lists.tolist(), strict=True):
                base = by_list[base_start[which] : base_start[which + 1]]
                if not len(base):
                    continue
                for s in range(a, z, 1000):
                    q = ask_who[asks[s : min(s + 1000, z)]]
                    score = ix.approximate(x[q], ix.tables(x[q]), codes[base], which) * norm[base][None]
                    score[q[:, None] == base[None]] = -np.inf
                    if len(base) > rerank:
                        bar = -np.partition(-score, rerank - 1, axis=1)[:, rerank - 1 : rerank]
                        score[score < bar] = -np.inf
                    i, j = np.nonzero(score > -np.inf)
                    who.append(q[i])
                    whom.append(base[j])
                    scores.append(score[i, j])
            if not who:
                continue
            a, b, score = np.concatenate(who), np.concatenate(whom), np.concatenate(scores).astype(np.float64)
            # the best of all lists of the cell
            order = np.argsort(a * 8.0 - score, kind="stable")
            a, b = a[order], b[order]
            best = np.arange(len(a)) - np.searchsorted(a, a) < rerank
            a, b = a[best], b[best]
            sims = np.round(exact(a, b), 6)
            order = np.lexsort((rank_of[b], -sims, a))
            a, b, sims = a[order], b[order], sims[order]
            best = np.arange(len(a)) - np.searchsorted(a, a) < k
            if at_least is not None:
                best &= sims >= at_least - 1e-6
            found.append((a[best], b[best], sims[best]))
        a, b, sims = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"rep": pa.array([unit[i] for i in a], kt), "other": pa.array([unit[i] for i in b], kt), "similarity": pa.array(np.asarray(sims, float))})

    if queries:
        # a class of copies is sent as one row, under its smallest key, if any of its records is asked
        vector_type = dict(source.dtypes)["v"]

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                marks = [p and xxhash.xxh3_128_digest(p) for p in kind.payloads(b.column(1))]
                kept = pa.array([i for i, (m, key) in enumerate(zip(marks, b.column(0).to_pylist(), strict=True)) if m and hot.get(m, key) == key], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(kept) for i in range(3)), pa.array(marks, pa.binary()).take(kept)], ["key", "v", "asked", "mark"])

        rows = source.mapInArrow(marked, f"key {key_type}, v {vector_type}, asked boolean, mark binary")
        rows = rows.join(copies.select("mark", "rep", F.col("asked").alias("any")), "mark", "left").where("rep is null or key = rep")
        source = rows.select("key", "v", F.coalesce("any", "asked").alias("asked"))
    sent = source.mapInArrow(send, f"cell int, block int, key {key_type}, base_list int, probed array<int>, payload binary")
    part = sent.groupBy("cell", "block").applyInArrow(search, f"rep {key_type}, other {key_type}, similarity double")
    out = _ranked(part, ids, copies, k)
    return out if at_least is None else out.where(F.col("similarity") >= at_least - 1e-6)


def _payload_rows(kind: Dense | Sparse):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for p in kind.payloads(b.column(0)) if p], pa.binary())], ["p"])

    return rows


# --- all pairs above a similarity ----------------------------------------------------------------


def prefix_meetings(vectors: DataFrame, min_similarity: float, block: int = 1000) -> DataFrame:
    """``node, meeting, payload``, sorted by meeting: any two sparse vectors of at least this similarity meet.

    Two vectors can only be that similar if they share a term of the part of
    each that remains after its most common terms of norm below
    ``min_similarity`` are set aside, in one order of terms for all. So only
    records that share such a term meet. The order puts terms of over a
    thousandth of all records last, by frequency (a list of bounded length);
    the order affects speed, not the result. Meetings of over ``block``
    records are split into pairs of blocks.
    """
    kind, spark, key_type = Sparse(), vectors.sparkSession, dict(vectors.dtypes)["node"]

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, t, _ = kind._parts(b.column(0).to_pylist())
            u, c = np.unique(t, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c)], ["term", "n"])

    n_vectors = vectors.count()
    counted = vectors.select("payload").mapInArrow(terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    common = counted.where(F.col("n") > max(1, n_vectors // 1000)).toPandas() if n_vectors else pd.DataFrame({"term": [], "n": []})
    order = spark.sparkContext.broadcast((np.sort(common["term"].to_numpy(np.int64)), common.sort_values("term")["n"].to_numpy(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, freq = order.value
        for b in batches:
            n, t, w = kind._parts(b.column(1).to_pylist())
            if not len(n):
                continue
            t = t.astype(np.int64)
            place = np.minimum(np.searchsorted(names, t), max(len(names) - 1, 0))
            rank = np.where(names[place] == t, freq[place], 0) if len(names) else np.zeros(len(t), np.int64)
            row = np.repeat(np.arange(len(n)), n)
            by = np.lexsort((t, rank, row))
            t, w2, row = t[by], w[by].astype(np.float64) ** 2, row[by]
            # mass from each term to the end of its record, in the order of terms
            total = np.cumsum(w2)
            end = np.cumsum(n) - 1
            rest = total[end][row] - total + w2
            used = rest >= min_similarity**2 * (1 - 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[used])), pa.array(t[used])], ["node", "term"])

    meets = vectors.select("node", "payload").mapInArrow(prefixes, f"node {key_type}, term long")
    shared = meets.groupBy("term").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    meets = meets.join(shared, "term")
    blocks = F.ceil(F.col("c") / block)
    own = F.pmod(F.xxhash64("node"), blocks)
    meets = meets.select("node", "term", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    meets = meets.select("node", F.xxhash64("term", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"))
    return meets.join(vectors.select("node", "payload"), "node").repartition("meeting").sortWithinPartitions("meeting")


def whole_groups(batches: Iterator[pa.RecordBatch], extra: bool = False, rows: int = 3000) -> Iterator[tuple]:
    """Rows sorted by ``meeting``, in portions of whole meetings."""
    held: pa.Table | None = None

    def portion(t: pa.Table) -> tuple:
        out = (t.column("meeting").to_numpy(), t.column("node").to_numpy(), t.column("payload").to_pylist())
        return (*out, t.column("cluster").to_numpy()) if extra else out

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= rows:
            m = held.column("meeting").to_numpy()
            end = int(np.searchsorted(m, m[-1]))
            if end:
                yield portion(held.slice(0, end))
                held = held.slice(end)
    if held is not None and held.num_rows:
        yield portion(held)


def pairs_of_groups(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of the same group; groups are contiguous."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    later = np.repeat(first + size, size) - np.arange(len(group)) - 1
    a = np.repeat(np.arange(len(group)), later)
    b = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later) + a + 1
    return a, b


def similar_above(records: DataFrame, key_col: str, map_col: str, at_least: float, k: int = 5, block: int = 1000) -> DataFrame:
    """Those of the ``k`` most similar other records of every record (maps) whose similarity is at least ``at_least``.

    Exact: every such pair meets (``prefix_meetings``), whatever the size of the table; a meeting
    emits the ``k`` best of each of its records. What ``similar_vectors`` says of copies, ties,
    unusable vectors and repeated deliveries holds here.

    Returns ``key, neighbour, similarity, rank``.
    """
    kind = Sparse()
    key_type = dict(records.dtypes)[key_col]
    source = records.select(F.col(key_col).alias("key"), F.col(map_col).alias("v")).where("key is not null and v is not null")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = kind.payloads(b.column(1))
            kept = pa.array([i for i, x in enumerate(p) if x], pa.int64())
            marks = [xxhash.xxh3_128_digest(x) for x in p if x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), pa.array(marks, pa.binary()), pa.array([x for x in p if x], pa.binary())], ["key", "mark", "payload"])

    prepared = source.mapInArrow(prepare, f"key {key_type}, mark binary, payload binary")
    vectors = prepared.groupBy("mark").agg(F.min("key").alias("node"), F.first("payload").alias("payload"))
    vectors = materialize(vectors, "vector-distinct")
    ids = materialize(prepared.select("key", "mark", F.lit(True).alias("asked")).distinct(), "vector-ids")
    copies = materialize(ids.groupBy("mark").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "vector-copies")

    def best_of_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meeting, node, payloads in whole_groups(batches):
            distinct, where = np.unique(node, return_inverse=True)
            first = np.unique(where, return_index=True)[1]
            dots = kind.exact([payloads[i] for i in first])
            a, b = pairs_of_groups(meeting)
            x, y = where[a], where[b]
            code = np.unique(np.minimum(x, y) * len(distinct) + np.maximum(x, y))
            x, y = code // len(distinct), code % len(distinct)
            found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
            for s in range(0, len(x), 500_000):
                p, q = x[s : s + 500_000], y[s : s + 500_000]
                sims = np.round(dots(p, q), 6)
                good = (sims >= at_least - 1e-6) & (p != q)
                found.append((p[good], q[good], sims[good]))
            p, q, sims = (np.concatenate(c) for c in zip(*found, strict=True))
            # both ways; the distinct keys are in order, so places decide ties as keys do
            rep, other, sims = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([sims, sims])
            order = np.lexsort((other, -sims, rep))
            rep, other, sims = rep[order], other[order], sims[order]
            best = np.arange(len(rep)) - np.searchsorted(rep, rep) < k
            yield pa.RecordBatch.from_arrays([pa.array(distinct[rep[best]]), pa.array(distinct[other[best]]), pa.array(sims[best])], ["rep", "other", "similarity"])

    part = prefix_meetings(vectors, at_least - 1e-6, block).mapInArrow(best_of_meetings, f"rep {key_type}, other {key_type}, similarity double")
    return _ranked(part, ids, copies, k)


def _ranked(part: DataFrame, ids: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """``key, neighbour, similarity, rank`` of the asked records, from pairs of classes of copies (``rep, other, similarity``)."""
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    near = part.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

    # only classes of several records need their members; every other record is its own class
    members = ids.join(copies.select("mark", "rep"), "mark").select("key", "rep", "asked")
    first = F.row_number().over(Window.partitionBy("rep").orderBy("key"))
    firsts = members.withColumn("r", first).where(F.col("r") <= k + 1).select(F.col("rep").alias("other"), F.col("key").alias("neighbour"))
    found = near.unionByName(copies.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity")))
    offered = found.join(firsts, "other", "left").withColumn("neighbour", F.coalesce("neighbour", "other"))
    few = Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbour")
    offered = offered.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).select("rep", "neighbour", "similarity")
    # an inner join, which can be split where one class holds a great part of all rows, and the classes of one record beside it
    several = offered.join(members.where("asked"), "rep").select("key", "neighbour", "similarity")
    single = offered.join(copies.select("rep"), "rep", "left_anti").select(F.col("rep").alias("key"), "neighbour", "similarity")
    each = several.unionByName(single).where("key <> neighbour")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "neighbour", "similarity", "rank")
