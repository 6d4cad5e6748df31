"""Document fingerprints: every shingle hash below a fixed fraction of their range.

A sketch holds the same share of any set, so the sketch of a union is the union
of the sketches, and the share of one sketch in another estimates how much of
the one text stands in the other, however unequal their lengths.  The smallest
hash is always kept, above the fraction too: a short text has a sketch, and
unions stay exact.  A fingerprint is text: ten hexadecimal digits for each
hash, ascending.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import distinct, shingle_sets

#: Words of a shingle, and the share of all hashes that is kept: one in so many.
WIDTH, SCALE = 5, 8
#: Bytes of a hash in a fingerprint.
BYTES = 5


def below(hashes: np.ndarray, scale: int) -> np.ndarray:
    """Of sorted hashes those below the fraction, or else the smallest."""
    n = int(np.searchsorted(hashes, np.uint64(((1 << 64) - 1) // scale)))
    return hashes[: max(n, 1)]


def to_text(hashes: np.ndarray) -> str:
    """The first ``BYTES`` bytes of each sorted hash, each once."""
    short = distinct(hashes >> np.uint64(64 - 8 * BYTES)) if len(hashes) else hashes
    return short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes().hex()


def from_text(fingerprint: str | None) -> np.ndarray:
    held = np.zeros((len(fingerprint or "") // (2 * BYTES), 8), np.uint8)
    held[:, :BYTES] = np.frombuffer(bytes.fromhex(fingerprint or ""), np.uint8).reshape(-1, BYTES)
    return held.view(">u8").ravel().astype(np.uint64)


def fingerprint(text: Column, *, width: int = WIDTH, scale: int = SCALE) -> Column:
    """A text's fingerprint. Words are runs of anything but ASCII blanks, A-Z as a-z; fewer words than ``width`` are one
    shingle. NULL, empty and blank texts give the empty string; equal texts equal fingerprints.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.string(), from_pandas=True)
        return pd.Series([to_text(below(s, scale)) for s in shingle_sets(column, width)], dtype=object)

    return run(text)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Estimated containment of the smaller of two sets in the other: shared hashes over those of the smaller sketch.

    Two empty fingerprints are alike (1), an empty one is unlike any other (0). NULL counts as empty.
    """
    out = []
    for x, y in zip(map(from_text, a), map(from_text, b), strict=True):
        least = min(len(x), len(y))
        out.append(len(np.intersect1d(x, y, assume_unique=True)) / least if least else float(len(x) == len(y)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def containment(a: pd.Series, b: pd.Series) -> pd.Series:
    """Estimated share of the first text's shingles that stand in the second; an empty first one is contained (1)."""
    pairs = zip(map(from_text, a), map(from_text, b), strict=True)
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 1.0 for x, y in pairs], dtype="float64")


def merge(a: Column, b: Column, *, scale: int = SCALE) -> Column:
    """The fingerprint of both texts' shingles together, of fingerprints of one ``scale``. NULL counts as empty."""

    @F.pandas_udf("string")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(map(from_text, left), map(from_text, right), strict=True)
        return pd.Series([to_text(below(np.union1d(x, y), scale)) if len(x) + len(y) else "" for x, y in pairs], dtype=object)

    return run(a, b)
