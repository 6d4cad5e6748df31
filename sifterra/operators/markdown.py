"""Markdown documents to sections, and sections to chunks.

A document is a row, and so are its sections and chunks: lines are arrays that
never leave their row, so nothing is shuffled.  The walk from line to line that
SQL has no words for sees only what it needs: for sections the few lines that
look like fences or headings, for chunks the lengths of lines.  Documents kept
as tables of lines, of any length, go through ``line_sections``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, text
from . import outline


@dataclass(frozen=True)
class ChunkerConfig:
    max_lines: int = 40
    max_chars: int = 3_000
    overlap_lines: int = 5
    max_fence_overlap_lines: int = 10

    def __post_init__(self) -> None:
        for wrong, message in (
            (self.max_lines <= 0, "max_lines must be positive"),
            (self.max_chars <= 0, "max_chars must be positive"),
            (self.overlap_lines < 0, "overlap_lines must be non-negative"),
            (self.overlap_lines >= self.max_lines, "overlap_lines must be smaller than max_lines"),
            (self.max_fence_overlap_lines < 0, "max_fence_overlap_lines must be non-negative"),
        ):
            if wrong:
                raise ValueError(message)


#: Lines of a document that stay together where documents come as lines.
BLOCK = 8192


def _structural(lines: Column) -> Column:
    """(number, line) of the lines that may matter, as an array."""
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(outline.STRUCTURAL), F.struct(i.alias("pos"), x.alias("line"))))
    return F.filter(marked, lambda x: x.isNotNull())


def _rows(cells: pd.Series) -> Iterator[list[tuple[int, str]]]:
    for cell in cells:
        yield [] if cell is None else [(x["pos"], x["line"]) for x in cell]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType()))])))
def _headings(cells: pd.Series) -> pd.Series:
    """Headings outside of fences with the titles above them, from ``_structural`` lines."""
    found = [[{"pos": p, "path": [t for _, t in s.stack]} for p, event, s in outline.walk(outline.State(), rows) if event == "heading"] for rows in _rows(cells)]
    return pd.Series(found, dtype=object)


def _full(lines: Column) -> Column:
    """For each line 1 if it isn't blank, else 0."""
    return F.transform(lines, lambda x: (~text.is_blank(x)).cast("int"))


def sections(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Sections of (document_id, content, ``keep``): path of headings, trimmed content and its line numbers.

    Headings begin in the first column and are not looked for inside fences. Text before the first heading is a
    section without a path. A section stays if it has a path or content.
    """
    lines = documents.filter("content IS NOT NULL").select("document_id", *keep, text.split_lines(F.col("content")).alias("lines"))
    headed = lines.select("document_id", *keep, "lines", _headings(_structural(F.col("lines"))).alias("headings"))
    first = F.array(F.struct(F.lit(-1).alias("pos"), F.array().cast("array<string>").alias("path")))
    headed = headed.select("document_id", *keep, "lines", F.concat(first, "headings").alias("headings"))

    def cut(h: Column, i: Column) -> Column:
        upto = F.coalesce(F.try_element_at("headings", i + 2)["pos"], F.size("lines"))
        body = F.slice("lines", h["pos"] + 2, upto - h["pos"] - 1)
        return F.struct(i.alias("section_ordinal"), h["path"].alias("section_path"), h["pos"].alias("first"), body.alias("body"), _full(body).alias("full"))

    return _trimmed(headed.select("document_id", *keep, F.inline(F.transform("headings", cut))), keep)


def _trimmed(parts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Sections of (document_id, section_ordinal, section_path, ``first``: line of the heading, ``body``, ``full``)."""
    lead, trail = F.array_position("full", 1) - 1, F.array_position(F.reverse("full"), 1) - 1
    start = F.when(F.array_contains("full", 1), F.col("first") + 2 + lead)
    kept = F.size("body") - lead - trail
    out = parts.select(
        "document_id", "section_ordinal", "section_path", F.when(start.isNull(), "").otherwise(F.array_join(F.slice("body", lead.cast("int") + 1, F.greatest(kept, F.lit(0)).cast("int")), "\n")).alias("content"),
        F.greatest(F.col("first") + 1, F.lit(1)).alias("start_line"), start.cast("int").alias("content_start_line"), F.coalesce(start + kept - 1, F.col("first") + 1).cast("int").alias("end_line"), *keep,
    )
    return out.filter((F.size("section_path") > 0) | (F.col("content") != ""))


def line_sections(lines: DataFrame) -> DataFrame:
    """``sections`` of documents that come as lines (document_id, ``pos`` from 0, ``line``), of any length and in any order.

    Lines are dealt to blocks of ``BLOCK``; the headings that ``outline`` finds, and one entry for each block that a
    section runs into, join them there, so a task holds no more than a block and, at the end, one section's text.
    """
    lines = lines.select("document_id", F.col("pos").cast("int").alias("pos"), "line")
    heads = outline.outline(lines, "document_id").filter("event = 'heading'").select("document_id", F.col("pos").cast("int").alias("pos"), "ordinal", "path")
    sizes = lines.groupBy("document_id").agg(F.max("pos").alias("last"))
    upto = F.coalesce(F.lead("pos").over(W.partitionBy("document_id").orderBy("pos")) - 1, F.col("last"))
    reach = heads.join(sizes, "document_id").select("document_id", "pos", "ordinal", "path", upto.alias("upto"))
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    entry = F.struct("ordinal", "path", F.col("pos").alias("first"))
    starts = reach.select("document_id", F.explode(F.sequence(block("pos"), block("upto"))).alias("block"), "pos", entry.alias("head"))
    starts = starts.select("document_id", "block", F.greatest("pos", F.col("block") * BLOCK - 1).alias("pos"), F.lit(None).cast("string").alias("line"), "head")
    plain = lines.select("document_id", block("pos").alias("block"), "pos", "line", F.lit(None).cast(starts.schema["head"].dataType).alias("head"))
    before = W.partitionBy("document_id", "block").orderBy("pos", F.col("line").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = plain.union(starts).withColumn("head", F.last("head", ignorenulls=True).over(before)).filter(F.col("line").isNotNull() & (F.col("head").isNull() | (F.col("pos") > F.col("head.first"))))
    none = F.struct(F.lit(0).alias("ordinal"), F.array().cast("array<string>").alias("path"), F.lit(-1).alias("first"))
    gathered = placed.withColumn("head", F.coalesce("head", none)).groupBy("document_id", F.col("head.ordinal").alias("section_ordinal")).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("body"))
    every = heads.select("document_id", F.col("ordinal").alias("section_ordinal"), "path", F.col("pos").alias("first"))
    whole = every.join(gathered, ["document_id", "section_ordinal"], "full")
    body = F.transform(F.coalesce("body", F.array().cast(gathered.schema["body"].dataType)), lambda x: x["line"])
    parts = whole.select("document_id", "section_ordinal", F.coalesce("path", none["path"]).alias("section_path"), F.coalesce("first", F.lit(-1)).alias("first"), body.alias("body"))
    return _trimmed(parts.withColumn("full", _full(F.col("body"))))


def spans_of(sizes: np.ndarray, rows: list[tuple[int, str]], config: ChunkerConfig) -> list[tuple[int, int]]:
    """[from, to) line ranges of a section's chunks, from the lengths of its lines and the lines that may be fences.

    Visits the chunks, not the lines: where a chunk must end is looked up in the running sums of lengths.
    """
    opens, closes, total = [], [], len(sizes)
    for pos, event, state in outline.walk(outline.State(), rows):
        if event == "open":
            opens.append(pos)
            closes.append(total)
        elif event == "close":
            closes[-1] = pos
    sums = np.concatenate([[0], np.cumsum(sizes + 1)])
    out, start = [], 0
    while start < total:
        fit = int(np.searchsorted(sums, sums[start] + config.max_chars + 1, side="right")) - 1
        end = min(max(start + 1, min(fit, start + config.max_lines)), total)
        at = bisect_left(opens, end) - 1
        if end < total and at >= 0 and end <= closes[at]:
            end = min(closes[at] + 1, total)
        out.append((start, end))
        if end >= total:
            break
        back = end - config.overlap_lines
        at = bisect_right(opens, back) - 1
        if at >= 0 and back <= closes[at] < total:
            back = opens[at] if closes[at] - opens[at] + 1 <= config.max_fence_overlap_lines else closes[at] + 1
        start = back if back > start else end
    return out


def chunk_spans(sections: DataFrame, config: ChunkerConfig = ChunkerConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """(section key, ``ordinal``, ``content``, ``start_line``, ``end_line``, ``keep``): chunks of each section, untitled and unnumbered.

    ``sections`` needs ``section_key``, ``content`` and ``content_start_line``.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])))
    def spans(sizes: pd.Series, marked: pd.Series) -> pd.Series:
        cut = [spans_of(np.asarray(n, np.int64), rows, config) for n, rows in zip(sizes, _rows(marked), strict=True)]
        return pd.Series([[{"from": a, "to": b} for a, b in x] for x in cut], dtype=object)

    lines = sections.select("section_key", "content_start_line", *keep, text.split_lines(F.col("content")).alias("all"))
    fences = F.filter(_structural(F.col("all")), lambda x: x["line"].rlike(text.FENCE))
    lines = lines.withColumn("spans", spans(F.transform("all", F.length), fences))
    part = lambda s, i: F.struct(i.alias("ordinal"), s["from"].alias("from"), F.slice("all", s["from"] + 1, s["to"] - s["from"]).alias("lines"))
    cut = lines.select("section_key", "content_start_line", *keep, F.inline(F.transform("spans", part)))
    cut = cut.withColumn("full", _full(F.col("lines"))).filter(F.array_contains("full", 1))
    lead, trail = F.array_position("full", 1) - 1, F.array_position(F.reverse("full"), 1) - 1
    first = F.col("content_start_line") + F.col("from") + F.col("lead")
    cut = cut.withColumn("lead", lead.cast("int")).withColumn("kept", F.size("lines") - F.col("lead") - trail.cast("int"))
    return cut.select("section_key", "ordinal", F.array_join(F.slice("lines", F.col("lead") + 1, F.col("kept")), "\n").alias("content"), first.cast("int").alias("start_line"), (first + F.col("kept") - 1).cast("int").alias("end_line"), *keep)


def _full_sections(sections: DataFrame) -> DataFrame:
    keyed = sections.withColumn("section_key", F.struct("document_id", "section_ordinal"))
    wrong = F.raise_error(F.lit("Non-empty section must have content_start_line")).cast("int")
    return keyed.filter(~text.is_blank(F.col("content"))).withColumn("content_start_line", F.coalesce("content_start_line", wrong))


def _numbered(spans: DataFrame) -> DataFrame:
    """Chunk rows of spans with (section_key, section_path, document_id, source_name, relative_path)."""
    placed = spans.select("*", F.col("section_key.document_id").alias("key"), F.col("section_key.section_ordinal").alias("section_ordinal"))
    per_section = W.partitionBy("key", "section_ordinal").orderBy("ordinal")
    per_document = W.partitionBy("key").orderBy("section_ordinal", "ordinal")
    numbered = placed.select("*", (F.row_number().over(per_section) - 1).alias("section_chunk_index"), (F.row_number().over(per_document) - 1).alias("chunk_index"))
    path, content = F.col("section_path"), F.col("content")
    return numbered.select(
        ids.chunk_id(F.col("document_id"), path, F.col("section_chunk_index"), content).alias("chunk_id"), "document_id", "source_name", "relative_path",
        F.try_element_at(path, F.lit(-1)).alias("title"), "section_path", "content", text.searchable(path, content).alias("searchable_text"),
        "chunk_index", "section_chunk_index", "start_line", "end_line", ids.content_hash(content).alias("content_hash"),
    )


def _text_spans(sections: DataFrame, config: ChunkerConfig, keep: Sequence[str]) -> DataFrame:
    return chunk_spans(_full_sections(sections), config, keep).filter(~text.is_separator_only(F.col("content")))


def chunks(documents: DataFrame, sections: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Numbered chunks of all documents. Sections of unknown documents are an error."""
    known = documents.select("document_id", "source_name", "relative_path")
    spans = _text_spans(sections, config, ["section_path"])
    whole = spans.join(known, F.col("section_key.document_id") == known["document_id"], "left")
    missing = F.raise_error(F.lit("Section document_id does not match Document document_id")).cast("string")
    return _numbered(whole.withColumn("relative_path", F.when(F.col("document_id").isNull(), missing).otherwise(F.col("relative_path"))))


def chunk_documents(documents: DataFrame, config: ChunkerConfig = ChunkerConfig(), watch: Callable[[DataFrame], DataFrame] = lambda sections: sections) -> DataFrame:
    """``chunks`` of all sections of ``documents`` in one pass, with one shuffle, that of the numbers. ``watch`` may observe the sections."""
    names = ["source_name", "relative_path"]
    made = watch(sections(documents, names))
    return _numbered(_text_spans(made, config, ["section_path", *names]).withColumn("document_id", F.col("section_key.document_id")))
