"""Text functions with Python's Unicode rules, as native columns where Spark can say them."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters that end a line, and those that count as white space (fixed values of Unicode).
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
SPACES = r"[\t-\r\x1C-\x20\x85\xA0  -     　]"
#: A token: letters or digits, joined by single hyphens or underscores.
TOKEN = r"[\p{L}\p{N}]+(?:[_-][\p{L}\p{N}]+)*"
#: Small letters whose case folding differs from lower case, beyond sharp s: final sigma, long s.
FOLD_FROM, FOLD_TO = "ςſ", "σs"
#: Opening of a code fence, and a heading with marks and title.
FENCE = r"^[ \t]{0,3}(`{3,}|~{3,})"
HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
SEPARATORS = ("---", "***", "___")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last end adds no line, an empty text has none."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACES}+\\z", "")


def strip(text: Column) -> Column:
    return rstrip(lstrip(text))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?s).*[^{SPACES[1:-1]}].*")


def casefold(text: Column) -> Column:
    """Lower case, with sharp s, final sigma and long s folded; ``tokenize(exact=True)`` folds everything."""
    return F.replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), F.lit("ß"), F.lit("ss"))


def _as_class(code_points: Iterable[int]) -> str:
    """Inside of a character class: ranges of code points."""
    out: list[list[int]] = []
    for c in sorted(code_points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


@functools.cache
def _python_token() -> str:
    """``TOKEN`` with Python's letters and digits: the JVM's classes, and what the two disagree about."""
    mine, others = [], []
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000:
            (mine if chr(c).isalnum() else others).append(chr(c))
    row = SparkSession.active().createDataFrame(pa.table({"mine": ["".join(mine)], "others": ["".join(others)]}))
    known = row.select(F.regexp_replace("mine", r"[\p{L}\p{N}]", "").alias("more"), F.regexp_replace("others", r"[^\p{L}\p{N}]", "").alias("less")).first()
    more, less = (_as_class(map(ord, x)) for x in known)
    letter = rf"[\p{{L}}\p{{N}}{more}]"
    letter = f"[{letter}&&[^{less}]]" if less else letter
    return f"{letter}+(?:[_-]{letter}+)*"


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, what they fold to, and those that fold to several."""
    folded = {chr(c): chr(c).casefold() for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
    one = {a: b for a, b in folded.items() if len(b) == 1}
    return "".join(one), "".join(one.values()), {a: b for a, b in folded.items() if len(b) > 1}


def casefold_exact(text: Column) -> Column:
    """Python's full case folding, character by character."""
    source, target, several = _folds()
    spread = functools.reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), several.items(), text)
    return F.translate(F.when(text.rlike(f"[{_as_class(map(ord, several))}]"), spread).otherwise(text), source, target)


def tokenize(text: Column, exact: bool = False) -> Column:
    """Tokens in order. ``exact`` follows Python's full case folding and its newer Unicode tables, natively too."""
    if exact:
        return F.regexp_extract_all(casefold_exact(text), F.lit(_python_token()), F.lit(0))
    return F.regexp_extract_all(casefold(text), F.lit(TOKEN), F.lit(0))


def is_separator_only(content: Column) -> Column:
    """Blank, or nothing but Markdown rules."""
    kept = F.filter(F.transform(split_lines(content), strip), lambda line: line != "")
    return F.forall(kept, lambda line: line.isin(*SEPARATORS))


def has_fence(content: Column) -> Column:
    """Any line that begins, after white space of any width, with three backticks or tildes."""
    return F.exists(split_lines(content), lambda line: lstrip(line).rlike("^(```|~~~)"))


def count_lines(content: Column) -> Column:
    return F.size(split_lines(content))


def searchable(section_path: Column, content: Column) -> Column:
    return F.when(F.size(section_path) > 0, F.concat(F.array_join(section_path, " > "), F.lit("\n\n"), content)).otherwise(content)


def truncate(content: Column, limit: int, hidden: str, mark: str) -> Column:
    """At most ``limit`` characters, then ``mark``; ``hidden`` for a limit of 0."""
    if limit == 0:
        return F.lit(hidden)
    return F.when(F.length(content) <= limit, content).otherwise(F.concat(rstrip(F.substring(content, 1, limit)), F.lit(mark)))


def code_fence(content: Column) -> Column:
    """A fence of backticks longer than any run inside."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("(`+)")), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def universal_newlines(content: Column) -> Column:
    return F.regexp_replace(content, "\r\n?", "\n")
