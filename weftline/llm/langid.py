"""Languages of documents and of the segments of mixed ones, by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by
the forward algorithm; pieces never cross word boundaries, so each distinct
word is scored once per worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: codes of the languages told apart, with three-letter codes and English names
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch"),
}
MISSING = ("", "und", "unknown")  # fixed values: labels that name no language

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# links, addresses, marks and tokens with digits; tokens are tried from their start only, so that a very long one costs no more than its length
_NOISE = re.compile(r"(?:https?://|www\.)\S+|(?<![^\s>\]])[^\s@]+@[^\s.]+\.\S+|<[^<>]*>|\[[^\[\]]{0,12}\]|(?<![^\s>\]])\S*\d\S*")
_BREAK = re.compile(r"(?<=[.!?])[\"')\]]*\s+|[\r\n]+|\s[-–—]\s")
_PIECE_CHARS = 16


def folded(text: str) -> str:
    """Lower case without accents; texts come in one case and without accents too."""
    text = text.lower().replace("ß", "ss").replace("’", "'").replace("œ", "oe").replace("æ", "ae")
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def sentences(text: str | None) -> list[list[str]]:
    """Folded words of each sentence; links, marks and tokens with digits are no words, pieces without a word no sentences."""
    out = []
    for part in _BREAK.split(text or ""):
        words = _WORD.findall(folded(_NOISE.sub(" ", part)))
        if any(len(w) > 1 for w in words):
            out.append(words)
    return out


def label_language(label: Column) -> Column:
    """Two-letter code that a label names, however spelt; null where it names none; other labels come back as they are."""
    plain = F.lower(F.trim(label))
    head = F.split(plain, "[-_]")[0]
    named = F.when(plain.isNull() | plain.isin(*MISSING), None)
    for code, others in LANGUAGES.items():
        named = named.when(head.isin(code, *others), code)
    return named.otherwise(head)


@dataclass
class PieceModel:
    """Piece probabilities per language, mixed with a background so that unseen words tell nothing."""

    vocabulary: frozenset[str]
    codes: list[str]
    background_share: float = 0.02
    most: float = 4.0
    probability: dict[str, np.ndarray] = field(default_factory=dict)
    cache: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    row_of: dict[str, int] | None = None
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def load(cls, path: str, codes: list[str]) -> PieceModel:
        """``path``: a sentencepiece model; only its piece list is used, folded like the texts."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {folded(sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        letters = set("abcdefghijklmnopqrstuvwxyz'▁")
        return cls(frozenset(p for p in pieces | letters if p and set(p) <= letters and len(p) <= _PIECE_CHARS), codes)

    def _pieces(self, word: str) -> list[list[str]]:
        """For each end position of "▁" + word, the vocabulary pieces that end there."""
        s = "▁" + word
        return [[s[i:j] for i in range(max(0, j - _PIECE_CHARS), j) if s[i:j] in self.vocabulary] for j in range(1, len(s) + 1)]

    def _expected(self, counts: dict[str, float], p: dict[str, float], floor: float) -> Counter:
        """Expected piece counts over all segmentations (forward-backward)."""
        out: Counter = Counter()
        for word, n in counts.items():
            ends = self._pieces(word)
            size = len(ends)
            forward, backward = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for j, pieces in enumerate(ends, 1):
                forward[j] = sum(forward[j - len(x)] * p.get(x, floor) for x in pieces)
            for j in range(size, 0, -1):
                for x in ends[j - 1]:
                    backward[j - len(x)] += p.get(x, floor) * backward[j]
            if forward[size] > 0:
                for j, pieces in enumerate(ends, 1):
                    for x in pieces:
                        out[x] += n * forward[j - len(x)] * p.get(x, floor) * backward[j] / forward[size]
        return out

    def fit(self, words: dict[str, Counter], rounds: int = 4) -> PieceModel:
        """Expectation maximisation per language over its word counts."""
        usable = {c: {w: n for w, n in words.get(c, {}).items() if len(w) < 40 and w.isascii()} for c in self.codes}
        per = {}
        for code in self.codes:
            p: dict[str, float] = {}
            start: Counter = Counter()
            for w, n in usable[code].items():
                for pieces in self._pieces(w):
                    for x in pieces:
                        start[x] += n * len(x)
            p = {x: n / max(1, start.total()) for x, n in start.items()}
            for _ in range(rounds):
                got = self._expected(usable[code], p, 0.0)
                total = got.total() or 1.0
                p = {x: n / total for x, n in got.items() if n > 1e-6}
            per[code] = p
        pooled: dict[str, float] = defaultdict(float)
        for p in per.values():
            for x, v in p.items():
                pooled[x] += v / len(per)
        share = self.background_share
        self.probability = {
            x: np.array([(1 - share) * per[c].get(x, 0.0) + share * (0.5 * pooled.get(x, 0.0) + 0.5 * 30.0 ** -len(x)) for c in self.codes]) for x in pooled
        }
        self.cache, self.table, self.row_of = {}, np.zeros((0, len(self.codes))), None
        return self

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        # longer tokens are scored in parts, so that nothing underflows
        parts = [(i, w[k : k + 32]) for i, w in enumerate(words) for k in range(0, len(w), 32)]
        total = np.zeros((len(words), len(self.codes)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for at, (_, part) in enumerate(parts):
            by_length[len(part)].append(at)
        for length, some in by_length.items():
            for s in range(0, len(some), 5_000):
                own = some[s : s + 5_000]
                np.add.at(total, [parts[i][0] for i in own], self._forward([parts[i][1] for i in own], length + 1))
        return total

    def evidence(self, parts: list[list[str]]) -> np.ndarray:
        """Evidence of each sentence: the sum of its words' log ratios to their best language, none below -``most``.

        The bound on a word keeps one name or foreign title from outvoting the
        sentence. Words are kept until there are 200,000, then all are dropped.
        """
        if len(self.cache) > 200_000:
            self.cache, self.table = {}, np.zeros((0, len(self.codes)))
        cache = self.cache
        new = list(dict.fromkeys(w for p in parts for w in p if w not in cache))
        if new:
            ratio = self.words(new)
            rows = np.maximum(ratio - ratio.max(1, keepdims=True), -self.most)
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])
        at = np.array([cache[w] for p in parts for w in p])
        first = np.cumsum([0, *(len(p) for p in parts[:-1])])
        return np.add.reduceat(self.table[at], first, axis=0)

    def _forward(self, words: list[str], size: int) -> np.ndarray:
        """Forward algorithm for words of one length: log of the sum over all segmentations of "▁" + word."""
        if self.row_of is None:
            share = 0.5 * self.background_share
            known = sorted(self.vocabulary)
            tiny = [share * 30.0 ** -len(x) for x in known]
            rows = [self.probability.get(x, np.full(len(self.codes), t)) for x, t in zip(known, tiny, strict=True)]
            # the first row is no piece
            self.row_of, self.rows = {x: i + 1 for i, x in enumerate(known)}, np.vstack([np.zeros(len(self.codes)), *rows])
        get = self.row_of.get
        spans = [(j, n) for j in range(1, size + 1) for n in range(1, min(_PIECE_CHARS, j) + 1)]
        cuts = [(j - n, j) for j, n in spans]
        found = np.array([[get(w[a:b], 0) for a, b in cuts] for w in ("▁" + w for w in words)], np.int32)
        alpha = np.zeros((size + 1, len(words), len(self.codes)))
        alpha[0] = 1.0
        some = np.zeros((size + 1, len(words)), bool)
        for k, (j, n) in enumerate(spans):
            own = np.flatnonzero(found[:, k])
            if len(own):
                alpha[j, own] += alpha[j - n, own] * self.rows[found[own, k]]
                some[j, own] = True
            if n == min(_PIECE_CHARS, j) and not some[j].all():  # a character outside the vocabulary tells nothing
                off = ~some[j]
                alpha[j, off] = alpha[j - 1, off] * (0.5 * self.background_share / 30.0)
        return np.log(np.maximum(alpha[size], 1e-300))

    def all_segments(self, texts: list[str | None], switch: float = 8.0) -> list[list[tuple[str, float, int]]]:
        """``segments`` of many texts: one look at their words, and a search only where sentences disagree."""
        parts = [sentences(t) for t in texts]
        flat = [s for p in parts for s in p]
        if not flat or not self.codes:
            return [[] for _ in texts]
        score = self.evidence(flat)
        best = score.argmax(1)
        out: list[list[tuple[str, float, int]]] = []
        at = 0
        for p in parts:
            end = at + len(p)
            if not p:
                out.append([])
            elif (best[at:end] == best[at]).all():
                # each sentence is likeliest in this language, so no other sequence can be better
                out.append([self._run(score[at:end], int(best[at]))])
            else:
                out.append(self._best(score[at:end], switch))
            at = end
        return out

    def _run(self, score: np.ndarray, lang: int) -> tuple[str, float, int]:
        total = score.sum(0)
        rest = np.exp(np.clip(total - total[lang], -700, 700)).sum()
        return self.codes[lang], float(1 / rest), len(score)

    def segments(self, text: str | None, switch: float = 8.0) -> list[tuple[str, float, int]]:
        """(language, confidence, sentences) of the longest runs of sentences in one language.

        The best sequence of languages under a cost of ``switch`` nats for a
        change (Viterbi), so a sentence that tells little follows its
        neighbours. Confidence is the posterior of the language over the run.
        """
        return self.all_segments([text], switch)[0]

    def _best(self, score: np.ndarray, switch: float) -> list[tuple[str, float, int]]:
        best, back = score[0].copy(), []
        for row in score[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - switch
            back.append(np.where(stay, np.arange(len(best)), top))
            best = np.where(stay, best, best[top] - switch) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        out, first = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[first]:
                out.append(self._run(score[first:i], path[first]))
                first = i
        return out


def train(samples: DataFrame, vocabulary_path: str, labelled: DataFrame | None = None, labelled_rows: int = 4000, rounds: int = 3, anchor: int = 5, most_samples: int = 20_000) -> PieceModel:
    """Fits the model on ``samples`` (text, lang) and at most ``labelled_rows`` rows of ``labelled``.

    The languages are those of the samples; more than ``most_samples`` of these are an error. The bound is on the number of labelled documents, drawn by hash of their
    text. Their labels may be wrong and the documents mixed: the first fit
    takes every sentence under its document's label, as most labels are right;
    each later one puts every sentence under the language that the model so
    far gives it. The samples count ``anchor`` times throughout.
    """
    given = samples.select("text", label_language(F.col("lang")).alias("lang")).where("lang is not null and text is not null").limit(most_samples + 1).collect()
    if len(given) > most_samples:
        raise ValueError(f"over {most_samples} samples of known language")
    codes = sorted({row.lang for row in given})
    base: dict[str, Counter] = {c: Counter() for c in codes}
    for row in given:
        for s in sentences(row.text):
            for w in s:
                base[row.lang][w] += anchor
    model = PieceModel.load(vocabulary_path, codes)
    if labelled is None or not codes:
        return model.fit(base)
    some = labelled.select("text", label_language(F.col("lang")).alias("lang")).where(F.col("lang").isin(codes) & F.col("text").isNotNull())
    rows = some.orderBy(F.xxhash64("text"), "lang").limit(labelled_rows).collect()
    told = Counter((r.lang, tuple(s)) for r in rows for s in sentences(r.text))
    for k in range(rounds):
        words = {c: Counter(n) for c, n in base.items()}
        if k:
            every = list(dict.fromkeys(sentence for _, sentence in told))
            now = dict(zip(every, model.evidence([list(x) for x in every]).argmax(1).tolist(), strict=True)) if every else {}
        for (lang, sentence), n in told.items():
            if k:
                lang = codes[now[sentence]]
            for w in sentence:
                words[lang][w] += n
        model = model.fit(words)
    return model


def document_languages(documents: DataFrame, key_col: str, text_col: str, label_col: str, model: PieceModel) -> DataFrame:
    """Every segment of every document with its language and confidence.

    Texts without a sentence, nulls and empty texts give no rows; null keys
    take no part; a repeated row gives its segments again; other columns are
    ignored. ``label`` is the language that the document's label names (null:
    none). One narrow pass, no shuffle.

    Returns ``<key>, label, n_segments, seg_no, lang, confidence, n_sentences``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    key_type = dict(documents.dtypes)[key_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                at, rows = [], []
                for i, found in enumerate(m.all_segments(b.column(2).to_pylist())):
                    for k, (lang, confidence, n) in enumerate(found, 1):
                        at.append(i)
                        rows.append((len(found), k, lang, confidence, n))
                if rows:
                    n, k, lang, conf, size = zip(*rows, strict=True)
                    at = pa.array(at)
                    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip((n, k, lang, conf, size), kinds, strict=True))], ["key", "label", "n_segments", "seg_no", "lang", "confidence", "n_sentences"]
                    )

    given = documents.where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("key"), label_language(F.col(label_col)).alias("label"), F.col(text_col).cast("string").alias("text"))
    out = given.mapInArrow(scan, f"key {key_type}, label string, n_segments int, seg_no int, lang string, confidence double, n_sentences int")
    return out.withColumnRenamed("key", key_col)
