"""Fill-in-the-middle texts: each document is cut at two seeded code points and its parts are put in another order.

Where the code points of a text begin is kept as an Elias-Fano list, about two
bits each, from which any boundary is read without walking through the text.
Texts that several documents share are grouped by their whole content and listed
once; the documents, as ids only, join their text's list, hot texts dealt to
several tasks.  A bounded filter of the hashes that occur twice tells which
texts may be shared: all others are listed and cut where they are read, so
that they never travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, bound_batches, materialise, spread_join
from .kernels import binaries, slices

#: Marks of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of the upper bits for which the directory keeps one count.
BLOCK = 64
#: How many bits a byte has set.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class Boundaries:
    """Elias-Fano list of the n + 1 byte positions at which the code points of a text begin, its end included.

    The low bits of a position are stored as they are; position i sets bit (high bits + i) of the upper bits. Every
    ``BLOCK`` bytes of those the directory tells how many bits were set before.
    """

    def __init__(self, n: int, n_bytes: int, upper: np.ndarray, lower: np.ndarray, counts: np.ndarray):
        self.n, self.n_bytes, self.upper, self.lower, self.counts = n, n_bytes, upper, lower, counts
        self.low = self.low_bits(n, n_bytes)

    @staticmethod
    def low_bits(n: int, n_bytes: int) -> int:
        return max(0, ((n_bytes + 1) // (n + 1)).bit_length() - 1)

    @classmethod
    def build(cls, raw: bytes) -> Boundaries:
        data = np.frombuffer(raw, np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        n, low = len(at) - 1, cls.low_bits(len(at) - 1, len(data))
        bits = np.zeros((len(data) >> low) + n + 1, bool)
        bits[(at >> low) + np.arange(n + 1)] = True
        upper = np.packbits(bits)
        lower = np.packbits((at[:, None] >> np.arange(low) & 1).astype(bool).ravel())
        sums = np.concatenate([[0], np.cumsum(ONES[upper])])
        return cls(n, len(data), upper, lower, sums[:-1:BLOCK].astype("<u4"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.n_bytes, len(self.upper), len(self.lower)], "<i8").tobytes() + self.counts.tobytes() + self.upper.tobytes() + self.lower.tobytes()

    @classmethod
    def from_bytes(cls, held: bytes) -> Boundaries:
        n, n_bytes, upper, lower = np.frombuffer(held, "<i8", 4).tolist()
        blocks = -(-upper // BLOCK)
        data = np.frombuffer(held, np.uint8, offset=32 + 4 * blocks)
        return cls(n, n_bytes, data[:upper], data[upper : upper + lower], np.frombuffer(held, "<u4", blocks, 32))

    def select(self, i: int) -> int:
        """Byte position at which code point ``i`` begins; the text's length in bytes for ``i`` = n."""
        block = int(np.searchsorted(self.counts, i, side="right")) - 1
        bits = np.unpackbits(self.upper[block * BLOCK : (block + 1) * BLOCK])
        high = block * BLOCK * 8 + int(np.flatnonzero(bits)[i - int(self.counts[block])]) - i
        if not self.low:
            return high
        first = i * self.low
        bits = np.unpackbits(self.lower[first >> 3 : (first + self.low + 7) >> 3])[first & 7 :][: self.low]
        return high << self.low | int(bits @ (1 << np.arange(self.low)))


def seeds(key: Column, seed: int) -> list[Column]:
    """Four integers below 2^32 of a key written in decimal; a NULL key is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arrange(raw: bytes, at: Boundaries, draws: tuple[int, int, int, int], plain_percent: int, spm_percent: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of prefix and middle, output) of one document."""
    a, b = sorted((draws[0] % (at.n + 1), draws[1] % (at.n + 1)))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not raw or any(m in raw for m in marks) or draws[2] % 100 >= 100 - plain_percent:
        return "plain", None, None, raw
    i, j = at.select(a), at.select(b)
    prefix, middle, suffix = marks[0] + raw[:i], marks[2] + raw[i:j], marks[1] + raw[j:]
    if draws[3] % 100 < spm_percent:
        return "spm", a, b - a, suffix + prefix + middle
    return "psm", a, b - a, prefix + suffix + middle


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(key, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``), one row for each row of ``docs``.

    ``n`` is the text's number of code points. Both cuts and the form come from a digest of seed and key alone.
    Empty texts and those that hold a mark stay plain. A NULL text is empty; rows with the same key are cut at the same
    draws, a NULL key draws as the empty string; other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    twice = materialise(rows.groupBy("hash").count().filter("count > 1").select(F.col("hash").alias("id")), "text-hashes")
    passing = IdFilter(twice)

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series) -> pd.Series:
        return pd.Series(passing.wanted(x.to_numpy()))

    rows = rows.withColumn("shared", maybe(F.pmod(F.xxhash64("hash"), F.lit(passing.bits))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (key, four draws, text, list or NULL) to the result's columns."""
        for batch in slices(batches, 5):
            draws = zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
            out = []
            for raw, held, four in zip(binaries(batch.column(5)), batch.column(6).to_pylist(), draws, strict=True):
                at = Boundaries.build(raw) if held is None else Boundaries.from_bytes(held)
                out.append((at.n, *arrange(raw, at, four, plain_percent, spm_percent)))
            columns = zip(*out, strict=True) if out else ([],) * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            made = pa.array([Boundaries.build(raw).to_bytes() for raw in binaries(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=["content", "text", "copies", "list"])

    def numbers(df: DataFrame) -> DataFrame:
        return df.select("key", *[x.alias(f"h{i}") for i, x in enumerate(seeds(F.col("key"), seed))], "text", "list")

    alone = numbers(rows.filter("not shared").withColumn("list", F.lit(None).cast("binary")))
    copied = rows.filter("shared").withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # grouped by the texts themselves, so that no digest decides what is equal
    groups = copied.groupBy("content", "text").agg(F.count("*").alias("copies"))
    index = materialise(groups.mapInArrow(listed, "content binary, text string, copies long, list binary"), "text-index")
    if index.groupBy("content").count().filter("count > 1").limit(1).count():
        raise ValueError("two texts with one SHA-256 digest")
    joined = spread_join(copied.select("key", "content"), index, ["content"], n="copies", by="key")
    schema = f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    out = alone.union(numbers(joined)).mapInArrow(cut, schema)
    return out.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made of, read from the output alone: a text with marks is never rearranged."""
    spm, mark = form == "spm", len(PREFIX)
    second = F.instr(output, F.when(spm, PREFIX).otherwise(SUFFIX))
    third = F.instr(output, F.lit(MIDDLE))
    one, two = F.substr(output, F.lit(mark + 1), second - 1 - mark), F.substr(output, second + mark, third - second - mark)
    middle = F.substr(output, third + mark)
    return F.when(form == "plain", output).when(spm, F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
