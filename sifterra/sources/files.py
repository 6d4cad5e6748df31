"""Scan of a file tree into documents."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import ids
from ..functions.text import universal_newlines

#: Directory names that are never entered, file patterns that are never read (fixed values).
EXCLUDED_DIRS = (
    ".git", ".venv", "venv", "env", "rec_venv", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".ipynb_checkpoints",
    ".runtime", ".cache", ".clinerules", "qdrant_storage", "node_modules", "data", "0 images",
)
EXCLUDED_FILES = ("*_plan*.md",)


@dataclass(frozen=True)
class ScannerConfig:
    included_extensions: frozenset[str] = frozenset({".md"})
    excluded_dir_names: frozenset[str] = frozenset(EXCLUDED_DIRS)
    excluded_file_patterns: tuple[str, ...] = EXCLUDED_FILES


def wanted(relative: str, config: ScannerConfig) -> bool:
    """Whether a file's relative POSIX path is in scope. Extensions match in any case, names as written."""
    path = Path(relative)
    return (
        not config.excluded_dir_names.intersection(path.parts)
        and path.suffix.lower() in config.included_extensions
        and not any(fnmatch.fnmatchcase(path.name, p) for p in config.excluded_file_patterns)
    )


@dataclass
class Subtree(InputPartition):
    """A folder below the root, with all that is in it or with its own files alone."""

    path: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str, config: ScannerConfig, tasks: int):
        self.root, self.config, self.tasks = root, config, tasks

    def partitions(self) -> list[Subtree]:
        """Folders are opened level by level until there are enough of them; what lies below is listed by the tasks."""
        level, out = [""], []
        while level and len(level) < self.tasks:
            below = []
            for folder in level:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    below += [os.path.join(folder, e.name) for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.config.excluded_dir_names]
            out += [Subtree(folder, False) for folder in level]
            level = below
        return out + [Subtree(folder, True) for folder in level]

    def read(self, partition: Subtree) -> Iterator[tuple[str, str]]:
        for folder, folders, names in os.walk(os.path.join(self.root, partition.path)):
            folders[:] = [] if not partition.deep else sorted(set(folders) - self.config.excluded_dir_names)
            for name in sorted(names):
                path = Path(folder, name)
                relative = path.relative_to(self.root).as_posix()
                if wanted(relative, self.config) and path.is_file():
                    yield relative, path.read_bytes().decode("utf-8")


class TreeSource(DataSource):
    """``spark.read.format("text_tree")``: (relative_path, content) of a file tree, hidden names included.

    Options: ``path``, and as JSON lists ``extensions``, ``excluded_dirs`` and ``excluded_files``; ``tasks`` folders at
    least are dealt out, if there are so many.
    """

    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def schema(self) -> str:
        return "relative_path string, content string"

    def reader(self, schema: object) -> TreeReader:
        given = lambda name, default: json.loads(self.options.get(name, json.dumps(sorted(default))))
        plain = ScannerConfig()
        config = ScannerConfig(
            frozenset(given("extensions", plain.included_extensions)), frozenset(given("excluded_dirs", plain.excluded_dir_names)), tuple(given("excluded_files", plain.excluded_file_patterns)),
        )
        return TreeReader(self.options["path"], config, int(self.options.get("tasks", "64")))


def scan_documents(spark: SparkSession, root: str | Path, source_name: str, config: ScannerConfig = ScannerConfig()) -> DataFrame:
    """Documents of a tree on a file system that driver and executors share, in no particular order.

    Spark's own listing drops names that begin with ``_`` or ``.``, so ``TreeSource`` reads the tree: the driver sees the
    upper folders only, tasks list and read the rest. Bad UTF-8 is an error. Line ends become ``\\n`` before hashing.
    """
    base = Path(root).resolve()
    if not base.exists():
        raise FileNotFoundError(f"Repository root does not exist: {root}")
    if not base.is_dir():
        raise NotADirectoryError(f"Repository root is not a directory: {root}")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format(TreeSource.name()).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    for name, value in (("extensions", config.included_extensions), ("excluded_dirs", config.excluded_dir_names), ("excluded_files", config.excluded_file_patterns)):
        reader = reader.option(name, json.dumps(sorted(value)))
    return _identified(reader.load(str(base)).withColumn("content", universal_newlines(F.col("content"))), source_name)


def write_tree(documents: DataFrame, root: str | Path) -> None:
    """Files of (relative_path, content) below a folder that all executors share, written by the tasks."""
    base = Path(root)

    def write(rows: Iterator) -> None:
        for row in rows:
            path = base / row["relative_path"]
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(row["content"].encode())

    documents.select(ids.normalize_relative_path(F.col("relative_path")).alias("relative_path"), "content").foreachPartition(write)


def load_documents(spark: SparkSession, path: str, source_name: str, *, pattern: str = "*.md") -> DataFrame:
    """Documents of a tree in any store that Spark reads. Names that begin with ``_`` or ``.`` are not seen there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    bad = F.raise_error(F.concat(F.lit("invalid UTF-8: "), F.col("path"))).cast("string")
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + path.rstrip("/").split("://")[-1].lstrip("/") + "\\E/", "")
    raw = files.select(relative.alias("relative_path"), universal_newlines(F.when(F.is_valid_utf8(text), text).otherwise(bad)).alias("content"))
    return _identified(raw, source_name)


def _identified(raw: DataFrame, source_name: str) -> DataFrame:
    source, path = F.lit(source_name), F.col("relative_path")
    return raw.select(ids.document_id(source, path).alias("document_id"), source.alias("source_name"), path, "content", ids.content_hash(F.col("content")).alias("content_hash"))


def file_sha256(path: str | Path) -> str:
    """SHA-256 of a file's bytes, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 16):
            digest.update(block)
    return digest.hexdigest()


def table_sha256(chunks: DataFrame) -> str:
    """Digest of a chunk table's logical rows (position, id), whatever its files: hashes of rows, sorted by position."""
    rows = chunks.select(F.sha2(F.concat_ws("\x1f", F.col("chunk_pos").cast("string"), "chunk_id"), 256).alias("h"), (F.col("chunk_pos") / 65536).cast("long").alias("block"), "chunk_pos")
    blocks = rows.groupBy("block").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_pos", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    digest = hashlib.sha256()
    for row in blocks.orderBy("block").toLocalIterator():
        digest.update(row["h"].encode())
    return digest.hexdigest()
