"""Quality rules: words and repetition of a text, and lines that recur across a host's documents."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, positional, spread_join
from .kernels import BLANK, binaries, flat_bytes, hashed_words, slices, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
DIGITS = re.compile(rb"[0-9]+")

#: A line goes when more of its host's documents hold it than both bounds say.
MAX_SHARE, MIN_DOCUMENTS = 0.10, 10
#: A document is rejected when fewer of its words than this share remain.
MIN_REMAINING = 0.20
MIN_WORDS, MAX_REPEAT = 50, (50, 100)

#: Up to so many frequent lines of all hosts are broadcast.
BROADCAST_LINES = 200_000

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_left")


def _repeated(hashes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    runs = windows(hashes, 3)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    hit = np.zeros(len(runs), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(np.count_nonzero(covered))


def _key(inner: list[bytes]) -> int:
    """Hash of a line's words: lower case, digit runs made one 0."""
    return int.from_bytes(hashlib.md5(DIGITS.sub(b"0", b" ".join(inner).lower())).digest()[:8], "big", signed=True)


def _lines(text: bytes) -> list[int]:
    """The distinct normalised lines, hashed."""
    return list({_key(inner) for line in text.split(b"\n") if (inner := line.split())})


def _duplicates(text: bytes) -> int:
    """Lines that repeat an earlier one."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def _without(text: bytes, gone: set[int]) -> tuple[bytes, int]:
    """The text without the lines whose hash is in ``gone``, and how many distinct ones it held."""
    left, removed = [], set()
    for line in text.split(b"\n"):
        inner = line.split()
        if inner and (key := _key(inner)) in gone:
            removed.add(key)
        else:
            left.append(line)
    return (b"\n".join(left), len(removed)) if removed else (text, 0)


def _per_row(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[at[1:]] - sums[at[:-1]]


def hashed_lines(docs: DataFrame, *, text_col: str, host_col: str) -> DataFrame:
    """Per row: host, digest of the text and the hashes of its distinct lines. One pass, no shuffle."""
    from xxhash import xxh3_128_digest

    source = docs.select(F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))

    def scan(batches):
        for batch in slices(batches, 1):
            raw = [x or b"" for x in binaries(batch.column(1))]
            arrays = [pa.array(map(xxh3_128_digest, raw), pa.binary()), pa.array(map(_lines, raw), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["__host", "__content", "__lines"])

    return source.mapInArrow(scan, f"__host {source.schema.fields[0].dataType.simpleString()}, __content binary, __lines array<long>")


def host_key(host: Column) -> Column:
    """A text for each host that also tells NULL from empty."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def frequent_lines(docs: DataFrame, *, text_col: str, host_col: str, max_share: float, min_documents: int) -> tuple[DataFrame, bool]:
    """(``__host``, ``__gone``, ``__rows``): the hashed lines of each host that pass both limits and the host's rows; and whether they are few."""
    host = F.col("__host")
    facts = materialise(hashed_lines(docs, text_col=text_col, host_col=host_col).withColumn("__host", host_key(host)), "line-facts")
    contents = facts.groupBy(host, "__content").agg(F.count("*").alias("n")).groupBy(host).agg(F.count("*").alias("contents"), F.sum("n").alias("__rows"))
    held = facts.select(host, "__content", F.explode("__lines").alias("line")).distinct().groupBy(host, "line").agg(F.count("*").alias("documents")).filter(F.col("documents") > min_documents)
    frequent = held.join(contents, "__host").filter(F.col("documents") > F.col("contents") * max_share)
    frequent = materialise(frequent.select("__host", "line", "__rows"), "frequent-lines")
    # a host has at most 1 / max_share times the lines of its mean document
    lists = frequent.groupBy("__host", "__rows").agg(F.collect_list("line").alias("__gone"))
    discard(facts)
    return lists, frequent.count() <= BROADCAST_LINES


def clean(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` with their texts rid of frequent lines, and ``__`` with each of ``FIGURES`` beside.

    Words are runs of anything but ASCII blanks; NULL text has none and stays NULL.
    """
    lists, few = frequent_lines(docs, text_col=text_col, host_col=host_col, max_share=max_share, min_documents=min_documents)
    named = docs.withColumn("__host", host_key(F.col(host_col)))
    if few:
        source = named.join(F.broadcast(lists), "__host", "left")
    else:
        source = spread_join(named, materialise(lists, "host-lines"), ["__host"], n="__rows", by=text_col, how="left")
    source = source.select(*docs.columns, "__gone")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"__{x}", T.LongType()) for x in FIGURES)])
    at_text = docs.columns.index(text_col)

    def scan(batches):
        for batch in slices(batches, at_text):
            column, lists = batch.column(at_text), batch.column(len(batch.columns) - 1)
            hashes, first = hashed_words(column, False)
            data, at = flat_bytes(column)
            raw = binaries(column)
            cleaned = [_without(text, set(listed.as_py())) if text and listed.is_valid else (text, 0) for text, listed in zip(raw, lists, strict=True)]
            words = np.diff(first)
            left = [n if not x[1] else len(x[0].split()) for x, n in zip(cleaned, words.tolist(), strict=True)]
            repeated = [_repeated(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            # bytes that begin a code point: all but 10xxxxxx
            figures = [words, _per_row(~BLANK[data] & ((data & 0xC0) != 0x80), at), _per_row(SYMBOLS[data], at), [_duplicates(x or b"") for x in raw], repeated, [x[1] for x in cleaned], left]
            columns = list(batch.columns[:-1])
            if any(x[1] for x in cleaned):
                large = pa.types.is_large_string(column.type)
                columns[at_text] = pa.array([x[0] for x in cleaned], pa.large_binary() if large else pa.binary()).view(column.type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in figures)], names=schema.names)

    return source.mapInArrow(scan, schema)


def judge(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS, min_remaining: float = MIN_REMAINING, min_words: int = MIN_WORDS, max_repeat: tuple[int, int] = MAX_REPEAT) -> DataFrame:
    """``clean`` with the verdicts ``__base_failed`` and ``__kept``."""
    out = clean(docs, text_col=text_col, host_col=host_col, max_share=max_share, min_documents=min_documents)
    n = F.col("__n_words")
    failed = (n < min_words) | (F.lit(max_repeat[1]) * F.col("__n_repeat_words") > F.lit(max_repeat[0]) * n)
    return out.withColumn("__base_failed", failed).withColumn("__kept", ~failed & (F.col("__n_words_left") >= n * min_remaining))


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """One row per input row: id, host, base figures, ``n_lines_removed``, ``n_words_left``, ``base_failed``, ``kept``, ``text_key`` (xxhash64 of the given text) and the text without its frequent lines.

    Lines are lower-cased, blanks squeezed and digit runs made one 0, then hashed.
    A line's documents at a host are counted as distinct contents: exact copies
    count once, near copies count each.  Lines held by more
    than ``max_share`` of the host's distinct contents and by more than
    ``min_documents`` are removed from the texts; ``n_lines_removed`` counts
    distinct lines.  A document that keeps less than
    ``min_remaining`` of its words is rejected.  A document also fails with
    fewer than ``min_words`` words or when words inside repeated 3-word windows
    pass ``max_repeat``; both are taken from the given text.

    NULL or empty text has no words and fails; a NULL host is a host of its own;
    repeated rows get equal verdicts; very long texts are read whole; an empty
    table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host_name"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__whole"))
    out = judge(source, text_col="__whole", host_col="__host_name", **limits)
    return out.select(
        F.col("__id").alias(id_col), F.col("__host_name").alias(host_col), *[F.col(f"__{x}").alias(x) for x in FIGURES],
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__key").alias("text_key"), F.col("__whole").alias(text_col),
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that pass ``apply_rules``, their texts without frequent lines; other columns stay as they are, whatever their names.

    NULL and empty texts fail; an empty table gives no rows.
    """
    plain, names = positional(docs)
    kept = judge(plain, text_col=names[text_col], host_col=names[host_col], **limits).filter("__kept")
    return kept.select(*plain.columns).toDF(*docs.columns)
