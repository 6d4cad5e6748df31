import hashlib

import pytest
from pyspark.sql import functions as F

from sifterra.functions import ids, text


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


TOKENS = {
    "BM25 Search RETRIEVAL": ["bm25", "search", "retrieval"],
    "Поиск Документов": ["поиск", "документов"],
    "TF-IDF top-k cross-encoder": ["tf-idf", "top-k", "cross-encoder"],
    "chunk_id max_tokens": ["chunk_id", "max_tokens"],
    "sparse/dense": ["sparse", "dense"],
    "python3.12": ["python3", "12"],
    "a - b -- _ __ c": ["a", "b", "c"],
    "... --- ___ ": [],
    "": [],
    "Straße ΑΣ": ["strasse", "ασ"],
}


@pytest.mark.parametrize("exact", [False, True])
def test_tokens(spark, exact):
    assert column(spark, TOKENS, lambda t: text.tokenize(t, exact)) == list(TOKENS.values())


LINES = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h ", "  \t", "x\n---"]


def test_lines_and_blanks_follow_python(spark):
    assert column(spark, LINES, text.split_lines) == [x.splitlines() for x in LINES]
    blanks = ["", " ", " 　\x1f", "a", " \n ", "\n a"]
    assert column(spark, blanks, text.is_blank) == [not x.strip() for x in blanks]
    edges = ["  a b ", " x\n", "", "\x1c y \x1f"]
    assert column(spark, edges, text.strip) == [x.strip() for x in edges]


def test_markdown_predicates(spark):
    values = ["---", "---\n\n***", "", "--- x", "a\n    ```\n", "~~~", "``", "plain"]
    assert column(spark, values, text.is_separator_only) == [True, True, True, False, False, False, False, False]
    assert column(spark, values, text.has_fence) == [False, False, False, False, True, True, False, False]
    assert column(spark, ["a", "```", "x ```` y"], text.code_fence) == ["```", "````", "`````"]
    assert column(spark, ["abc  def", "ab"], lambda c: text.truncate(c, 5, "", "...")) == ["abc...", "ab"]
    assert column(spark, ["abc"], lambda c: text.truncate(c, 0, "<hidden>", "")) == ["<hidden>"]


def test_ids(spark):
    sha = lambda *p: hashlib.sha256("\x1f".join(p).encode()).hexdigest()
    rows = spark.createDataFrame([("notes", "a\\.//b.md", ["H1", "H2"], 3, "text")], "s string, p string, path array<string>, n int, c string")
    got = rows.select(ids.document_id(F.col("s"), F.col("p")), ids.chunk_id(F.lit("d"), F.col("path"), F.col("n"), F.col("c")), ids.content_hash(F.col("c"))).first()
    assert tuple(got) == (sha("notes", "a/b.md"), sha("d", "H1", "H2", "3", "text"), sha("text"))


@pytest.mark.parametrize(("path", "message"), [("/a", "relative"), ("a/../b", "'..'"), (".", "empty"), ("", "empty")])
def test_bad_paths(spark, path, message):
    with pytest.raises(Exception, match=message):
        column(spark, [path], ids.normalize_relative_path)
