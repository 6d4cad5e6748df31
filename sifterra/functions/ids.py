"""Stable identifiers: SHA-256 over parts joined by the unit separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator of hashed parts (a fixed value).
SEPARATOR = "\x1f"


def stable_hash(*parts: Column) -> Column:
    """Hex SHA-256 of the parts; an array part counts as its elements."""
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def normalize_relative_path(path: Column) -> Column:
    """POSIX form of a relative path; absolute, empty and climbing paths raise an error."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(posix, "/"), lambda p: (p != "") & (p != "."))
    joined = F.array_join(parts, "/")
    fail = lambda message: F.raise_error(F.lit(message)).cast("string")
    return (
        F.when(posix.startswith("/"), fail("Path must be relative"))
        .when(F.array_contains(parts, ".."), fail("Path must not contain '..'"))
        .when(F.size(parts) == 0, fail("Path must not be empty"))
        .otherwise(joined)
    )


def document_id(source_name: Column, relative_path: Column) -> Column:
    return stable_hash(source_name, normalize_relative_path(relative_path))


def content_hash(content: Column) -> Column:
    return stable_hash(content)


def chunk_id(document_id: Column, section_path: Column, section_chunk_index: Column, content: Column) -> Column:
    return stable_hash(document_id, section_path, section_chunk_index.cast("string"), content)
