"""JSON lines: strict sources that name the failing line, and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .scratch import bound_batches, materialise


def _object(value: object, what: str = "JSON value") -> dict:
    if not isinstance(value, dict):
        raise TypeError(f"{what} must be an object")
    return value


def _list(record: dict, field: str, of: type | None = None) -> list:
    value = record[field]
    if not isinstance(value, list):
        raise TypeError(f"{field} must be a list")
    if of is not None and not all(isinstance(x, of) for x in value):
        raise TypeError(f"{field} must contain only strings")
    return value


def _string(record: dict, field: str) -> str:
    if not isinstance(record[field], str):
        raise TypeError(f"{field} must be a string")
    return record[field]


def chunk_record(value: object) -> dict:
    """A chunk; other fields are ignored, and only the object and its section path are checked for type."""
    record = _object(value)
    path = _list(record, "section_path")
    return {f: record[f] for f in schemas.CHUNK_FIELDS} | {"section_path": [str(p) for p in path]}


def golden_record(value: object) -> dict:
    record = _object(value)

    def judged(item: object) -> dict:
        item = _object(item, "relevant_chunks item")
        if not isinstance(item["relevance"], int):
            raise TypeError("relevance must be an integer")
        return {"chunk_id": _string(item, "chunk_id"), "relative_path": _string(item, "relative_path"), "section_path": _list(item, "section_path", str), "relevance": int(item["relevance"])}

    chunks = _list(record, "relevant_chunks")
    return {"query_id": _string(record, "query_id"), "query": _string(record, "query"), "relevant_chunks": [judged(x) for x in chunks], "notes": _string(record, "notes")}


def evaluation_record(value: object) -> dict:
    record = _object(value)

    def found(item: object) -> dict:
        item = _object(item, "retrieved_chunks item")
        path = _list(item, "section_path", str)
        return {"chunk_id": _string(item, "chunk_id"), "rank": int(item["rank"]), "score": float(item["score"]), "relevance": int(item["relevance"]), "relative_path": _string(item, "relative_path"), "section_path": path, "content": _string(item, "content")}

    judged, retrieved, first = _list(record, "relevant_chunk_ids", str), _list(record, "retrieved_chunks"), record["first_relevant_rank"]
    if first is not None and not isinstance(first, int):
        raise TypeError("first_relevant_rank must be an integer or null")
    numbers = {f: float(record[f]) for f in ("hit_rate_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")}
    return {"query_id": _string(record, "query_id"), "query": _string(record, "query"), "relevant_chunk_ids": judged, "retrieved_chunks": [found(x) for x in retrieved], "first_relevant_rank": first} | numbers


#: Splits of files up to which their numbers of lines are broadcast; beyond, both sides are shuffled.
BROADCAST_SPLITS = 100_000


def split_lines(spark: SparkSession, path: str, decode: Callable[[Iterator[str]], Iterator[tuple]], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, splits) of a text file or a folder of them.

    ``decode`` makes one tuple of ``schema`` of each line. ``rows`` has them with ``split`` (file, first byte) and ``at``,
    the line's place in its split; a task reads many splits, and the engine deals them in any order, so only what a
    split says of itself is used. ``splits`` has ``split``, its ``lines`` and ``before``: the lines of all splits before it,
    by part number where files are named by it, by name and by first byte. Lines are read and decoded once, into a
    table in the shared folder.
    """
    bound_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, 0
        for batch in batches:
            places = []
            for split in zip(batch["file_path"].tolist(), batch["file_block_start"].tolist(), strict=True):
                now, at = split, at + 1 if split == now else 0
                places.append(at)
            columns = zip(*decode(iter(batch["value"].tolist())), strict=True) if len(batch) else [()] * len(schema)
            made = {f.name: pd.Series(list(c), dtype=object) for f, c in zip(schema, columns, strict=True)}
            yield pd.DataFrame({"file": batch["file_path"], "byte": batch["file_block_start"], "at": pd.Series(places, dtype="int64")} | made)

    kind = T._parse_datatype_string("file string, byte long, at long")
    rows = materialise(lines.mapInPandas(number, T.StructType([*kind, *schema])), "lines")
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    order = W.orderBy(F.regexp_extract("file", "^(.*)/", 1), part.asc_nulls_last(), "file", "byte")
    # one row for each split
    splits = rows.groupBy("file", "byte").agg(F.count("*").alias("lines")).withColumn("before", F.sum("lines").over(order) - F.col("lines"))
    return rows, splits


def line_numbers(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with ``number``: the line's place among all lines, from 0."""
    splits = materialise(splits.select("file", "byte", "before"), "splits")
    small = splits.count() <= BROADCAST_SPLITS
    return rows.join(F.broadcast(splits) if small else splits, ["file", "byte"]).withColumn("number", F.col("before") + F.col("at")).drop("file", "byte", "before", "at")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``number``, ``line``) of a text file or a folder of them, numbered from 0 in order of files and bytes."""
    return line_numbers(*split_lines(spark, path, lambda lines: ((x,) for x in lines), T._parse_datatype_string("line string")))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(``category``, ``number``, ``line``) of a folder that was written with a folder ``category=<name>`` for each; numbers ascend within one."""
    rows, splits = split_lines(spark, path, lambda lines: ((x,) for x in lines), T._parse_datatype_string("line string"))
    named = rows.withColumn("category", F.regexp_extract("file", "/category=([^/]*)/", 1))
    return line_numbers(named, splits).select("category", "number", "line")


def read_jsonl(spark: SparkSession, path: str, record: Callable[[object], dict], schema: str, what: str, pos: str = "pos") -> DataFrame:
    """Checked records of a JSONL file, or of a folder of them, with the number of their line (from 0) in ``pos``. Blank lines are skipped.

    The first bad line, in order of files and lines, raises ValueError with its number (from 1), so a result is all good
    or nothing. Each line is decoded once, by the pass that finds its errors.
    """
    kind = T._parse_datatype_string(schema)
    names = [f.name for f in kind.fields]
    empty = (None,) * len(names)

    def decode(lines: Iterator[str]) -> Iterator[tuple]:
        """(blank, error, fields)"""
        for line in lines:
            if not line.strip():
                yield (True, None, *empty)
                continue
            try:
                value = json.loads(line)
            except ValueError:
                yield (False, "Invalid JSONL at line {}", *empty)
                continue
            try:
                made = record(value)
            except (TypeError, ValueError, KeyError) as error:
                yield (False, f"Invalid {what} at line {{}}: {error}", *empty)
            else:
                yield (False, None, *(made[n] for n in names))

    flags = [T.StructField("blank", T.BooleanType()), T.StructField("error", T.StringType())]
    rows, splits = split_lines(spark, path, decode, T.StructType([*flags, *kind]))
    placed = line_numbers(rows, splits)
    bad = placed.filter("error IS NOT NULL").agg(F.min_by("error", "number").alias("error"), F.min("number").alias("number")).first()
    if bad["error"] is not None:
        raise ValueError(bad["error"].replace("{}", str(bad["number"] + 1), 1))
    return placed.filter("NOT blank").select(F.col("number").alias(pos), *names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, chunk_record, schemas.CHUNKS, "chunk", "chunk_pos")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, golden_record, schemas.GOLDEN, "golden query", "query_pos")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, evaluation_record, schemas.QUERY_EVAL, "query evaluation result")


def as_json(df: DataFrame) -> DataFrame:
    """One compact object per row; NULL fields are kept, other scripts stay as they are."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_file(df: DataFrame, path: str | Path, order: list[str]) -> int:
    """One ordered local file; rows stream through the driver a partition at a time. Returns their number."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    columns = [c for c in df.columns if c not in ("pos", "chunk_pos", "query_pos")]
    rows = df.orderBy(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    n = 0
    with path.open("w", encoding="utf-8", newline="\n") as file:
        for row in rows.toLocalIterator():
            file.write(row["value"] + "\n")
            n += 1
    return n


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Many files in a folder of any store, in parallel; ranges of ``order`` follow each other."""
    (as_json(df.orderBy(*order)) if order else as_json(df)).write.mode("overwrite").text(path)
