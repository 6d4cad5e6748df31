"""Figures of a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_lines, has_fence


def check_limits(max_chars: int, max_lines: int, largest_limit: int, smallest_limit: int) -> None:
    for wrong, message in (
        (max_chars <= 0, "max_chars must be positive"),
        (max_lines <= 0, "max_lines must be positive"),
        (largest_limit < 0, "largest_limit must be non-negative"),
        (smallest_limit < 0, "smallest_limit must be non-negative"),
    ):
        if wrong:
            raise ValueError(message)


def sizes(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_pos", "chunk_id", "document_id", "relative_path", "section_path", F.length("content").alias("char_count"), count_lines(F.col("content")).alias("line_count"), "start_line", "end_line", has_fence(F.col("content")).alias("fence"))


def summary(chunks: DataFrame, *, max_chars: int = 3_000, max_lines: int = 40) -> DataFrame:
    """One row of counts, extremes and means in one pass; zeros for an empty table."""
    check_limits(max_chars, max_lines, 0, 0)
    n, lines, zero = F.col("char_count"), F.col("line_count"), F.lit(0)
    return sizes(chunks).agg(
        F.count("*").alias("chunk_count"), F.count_distinct("document_id").alias("document_count"),
        F.coalesce(F.min(n), zero).alias("min_chars"), F.coalesce(F.avg(n), F.lit(0.0)).alias("average_chars"), F.coalesce(F.max(n), zero).alias("max_chars"),
        F.coalesce(F.min(lines), zero).alias("min_lines"), F.coalesce(F.avg(lines), F.lit(0.0)).alias("average_lines"), F.coalesce(F.max(lines), zero).alias("max_lines"),
        F.count_if("fence").alias("chunks_with_code_fence"), F.count_if(n > max_chars).alias("chunks_over_char_limit"), F.count_if(lines > max_lines).alias("chunks_over_line_limit"),
    )


def largest(chunks: DataFrame, limit: int) -> DataFrame:
    """Top ``limit`` by characters; equal sizes keep their order."""
    check_limits(1, 1, limit, 0)
    return sizes(chunks).orderBy(F.desc("char_count"), "chunk_pos").limit(limit)


def smallest(chunks: DataFrame, limit: int) -> DataFrame:
    check_limits(1, 1, 0, limit)
    return sizes(chunks).orderBy("char_count", "chunk_pos").limit(limit)
