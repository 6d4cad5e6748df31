"""The outline of documents of any length against a stepwise walk."""

import random

import pytest
from pyspark.sql import functions as F

from sifterra.operators import markdown, outline

PIECES = ["text", "", "```", "````", "`````py", "~~~", "~~~~~~", "   ```", "    ```", "# one", "## two ##", "### three", "#none", "###### six", "# "]


def lines_of(rng, n):
    return [rng.choice(PIECES) for _ in range(n)]


def test_functions_compose():
    """A stretch's function gives what walking it gives, from every state, and so do two in a row."""
    rng = random.Random(1)
    states = [outline.State(), *[outline.State((s, n, -5), 3, ((1, "a"), (3, "b"))) for s in "`~" for n in (3, 4, 5, 9)], outline.State(None, 2, ((2, "x"), (6, "y")))]
    for _ in range(300):
        lines = list(enumerate(lines_of(rng, rng.randrange(12))))
        cut = rng.randint(0, len(lines))
        for state in states:
            want = state
            for pos, line in lines:
                want, _ = outline.step(want, pos, line)
            assert outline.summarise(lines).on(state) == want
            assert outline.summarise(lines[cut:]).on(outline.summarise(lines[:cut]).on(state)) == want


def walked(docs):
    """(document, line, event, first line of the fence, ordinal, path)"""
    for key, lines in docs.items():
        for pos, event, s in outline.walk(outline.State(), enumerate(lines)):
            yield key, pos, event, None if event == "heading" else s.fence[2], s.ordinal, [t for _, t in s.stack]


def test_outline_over_ranges(spark):
    rng = random.Random(2)
    docs = {f"d{i}": lines_of(rng, rng.randrange(40)) for i in range(30)} | {"long": lines_of(rng, 3000), "open": ["```", *["# no"] * 500]}
    rows = [(k, i, x) for k, v in docs.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "document_id string, pos int, line string").repartition(5)
    got = [tuple(r) for r in outline.outline(frame, "document_id").collect()]
    assert sorted(got, key=repr) == sorted(walked(docs), key=repr)
    assert outline.outline(frame.limit(0), "document_id").collect() == []


@pytest.mark.parametrize("block", [3, 8192])
def test_sections_of_lines(spark, monkeypatch, block):
    monkeypatch.setattr(markdown, "BLOCK", block)
    rng = random.Random(3)
    docs = {f"d{i}": lines_of(rng, rng.randrange(60)) for i in range(60)} | {"none": ["a", "", "b"], "blank": ["", ""], "heads": ["# a", "# b"]}
    whole = spark.createDataFrame([(k, "\n".join(v) + "\n" if v else "") for k, v in docs.items()], "document_id string, content string")
    lines = spark.createDataFrame([(k, i, x) for k, v in docs.items() for i, x in enumerate(v)], "document_id string, pos long, line string").repartition(6)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(markdown.line_sections(lines)) == rows(markdown.sections(whole))


def test_long_document_in_several_tasks(spark):
    """400,000 lines with 16,000 fences: the ranges' functions carry the state from task to task."""
    n, every = 400_000, 50
    at = F.col("id") % every
    line = F.when(at == 1, "```sql").when(at == 3, "# inside").when(at == 5, "~~~").when(at == 26, "````").when(at == 30, F.concat(F.lit("## h"), F.col("id"))).otherwise("text")
    lines = spark.range(n).select(F.lit("d").alias("document_id"), F.col("id").alias("pos"), line.alias("line"))
    found = outline.outline(lines, "document_id").cache()
    per_event = {r["event"]: r["count"] for r in found.groupBy("event").count().collect()}
    assert per_event == {"open": n // every, "close": n // every, "heading": n // every}
    assert found.filter("event = 'close'").select((F.col("pos") - F.col("opened")).alias("d")).distinct().collect()[0]["d"] == 25
    last = found.filter("event = 'heading'").orderBy(F.desc("pos")).first()
    assert (last["ordinal"], last["path"]) == (n // every, [f"h{n - 20}"])
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    found.unpersist()
