"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the split pattern that belongs to the byte-level vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[str, object] = {}


def vocabulary() -> str:
    """The byte-level vocabulary; WEFTLINE_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def encoding(path: str):
    """The tokenizer, loaded once per worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("weftline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def with_sizes(documents: DataFrame, key_col: str, text_col: str, path: str, *columns: str) -> DataFrame:
    """``key``, ``columns`` and ``n_tokens`` of every document with a key; null texts have size 0."""
    key_type = dict(documents.dtypes)
    shape = ", ".join([f"key {key_type[key_col]}", *(f"`{c}` {key_type[c]}" for c in columns), "n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(n, pa.int64())], ["key", *columns, "n_tokens"])

    given = documents.where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("key"), *columns, F.col(text_col).cast("string").alias("__text"))
    return given.mapInArrow(count, shape)
