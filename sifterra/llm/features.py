"""Hashed features of whole texts and the small optimiser that the classifiers share."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import binaries, slices

#: Words whose numbers a worker remembers.
REMEMBERED = 50_000


class Hashed(dict):
    """Feature numbers of byte strings below a fixed size, remembered up to a bound."""

    def __init__(self, size: int, salt: int = 0):
        super().__init__()
        self.size, self.salt = size, salt

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = zlib.crc32(word, self.salt) % self.size
        if len(word) <= 64:
            self[word] = value
        return value


UPPER, LOWER, DIGIT, PUNCT = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
BREAKS = re.compile(rb"[.!?]")


def structure(text: bytes, words: list[bytes]) -> list[float]:
    """Seventeen figures of a text's form, each near 0 to 1 and never undefined."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    size, n = max(1, len(raw)), max(1, len(words))
    letters = max(1, int(counts[UPPER].sum() + counts[LOWER].sum() + counts[128:].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words)) / n
    return [
        counts[UPPER].sum() / letters, counts[DIGIT].sum() / size, counts[PUNCT].sum() / size, counts[128:].sum() / size,
        counts[list(b"#*$%&|<>")].sum() / size, counts[ord("!")] / size, counts[ord("|")] / size, counts[list(b".,;:")].sum() / size,
        counts[10] / size * 10, min(1.0, len(text) / n / 20), distinct, len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(len(words)) / 10), min(1.0, n / max(1, len(BREAKS.findall(text))) / 50),
        float(len(words) == 0), float(np.count_nonzero(np.frombuffer(b"".join(w[:1] for w in words), np.uint8) < 97) / n) if words else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ]


N_STRUCTURE = 17


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``key``: a fixed sample, whatever the partitions."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse rows: feature numbers, values and row starts."""

    def __init__(self, numbers: list[np.ndarray], values: list[np.ndarray]):
        self.size = np.array([len(x) for x in numbers], np.int64)
        self.number = np.concatenate(numbers).astype(np.int64) if numbers else np.zeros(0, np.int64)
        self.value = np.concatenate(values) if values else np.zeros(0)
        self.row = np.repeat(np.arange(len(numbers)), self.size)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.number], len(self.size))

    def dot_t(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.number, self.value * x[self.row], n)


def score_texts(docs: DataFrame, id_col: str, text_col: str, extra: list[str], columns: str, score) -> DataFrame:
    """(id, whatever ``score`` returns) for every row: one narrow pass over whole texts.

    ``score(texts, extras)`` gets lists for a batch and returns one array for each column of ``columns``.
    """
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]
    source = docs.select(F.col(id_col), F.col(text_col), *extra)

    def scan(batches):
        for batch in slices(batches, 1):
            arrays = score([x or b"" for x in binaries(batch.column(1))], [batch.column(2 + i).to_pylist() for i in range(len(extra))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, arrays)], names=names)

    kind = source.schema.fields[0].dataType.simpleString()
    return source.mapInArrow(scan, f"`{id_col}` {kind}, {columns}")
