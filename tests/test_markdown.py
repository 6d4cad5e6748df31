import random
import re

import pytest

from sifterra import schemas
from sifterra.operators import markdown as m

FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")


def spans(spark, contents, config):
    """Chunks by section number: (content, first line, last line)."""
    rows = spark.createDataFrame([(i, c, at) for i, (c, at) in enumerate(contents)], "section_key int, content string, content_start_line int")
    out = {i: [] for i in range(len(contents))}
    for r in m.chunk_spans(rows, config).orderBy("section_key", "ordinal").collect():
        out[r["section_key"]].append((r["content"], r["start_line"], r["end_line"]))
    return [out[i] for i in range(len(contents))]


FIVE = "\n".join(f"line {i}" for i in range(1, 6))
CASES = [
    (FIVE, 10, (2, 1000, 0), [(10, 11), (12, 13), (14, 14)]),
    ("abcd\nefgh\nij", 5, (100, 6, 0), [(5, 5), (6, 6), (7, 7)]),
    ("x" * 100, 1, (10, 20, 0), [(1, 1)]),
    (FIVE, 1, (3, 1000, 1), [(1, 3), (3, 5)]),
    ("Before\n```python\na\nb\n```\nAfter", 1, (3, 1000, 0), [(1, 5), (6, 6)]),
    ("Before\n~~~python\na\nb\n~~~\nAfter", 1, (3, 1000, 0), [(1, 5), (6, 6)]),
    ("```\na\nb\nc", 1, (2, 1000, 0), [(1, 4)]),
    ("Intro\n```\ncode\n```\none\ntwo", 1, (3, 1000, 2, 3), [(1, 4), (2, 4), (5, 6)]),
    ("Intro\n```\na\nb\nc\nd\n```\none\ntwo", 1, (3, 1000, 2, 3), [(1, 7), (8, 9)]),
    ("```\n~~~\na\n```\nend", 1, (2, 1000, 0), [(1, 4), (5, 5)]),
    ("a\nb\n\n\nc", 10, (4, 1000, 0), [(10, 11), (14, 14)]),
]


def test_chunk_vectors(spark):
    for content, at, config, want in CASES:
        (got,) = spans(spark, [(content, at)], m.ChunkerConfig(*config))
        assert [(a, b) for _, a, b in got] == want, (content, config)


def spec(lines, c):
    """A stepwise model of ours: walk the lines, remember the open fence."""

    def step(state, line):
        hit = FENCE.match(line)
        if not hit:
            return state
        if state is None:
            return hit[1][0], len(hit[1])
        return None if hit[1][0] == state[0] and len(hit[1]) >= state[1] else state

    fences, state, opened = [], None, None
    for i, line in enumerate(lines):
        after = step(state, line)
        if state is None and after is not None:
            opened = i
        if state is not None and after is None:
            fences.append((opened, i))
        state = after
    out, start = [], 0
    while start < len(lines):
        end, size, state, full = start, 0, None, False
        while end < len(lines):
            added = len(lines[end]) + (end > start)
            if end > start and (end - start >= c.max_lines or size + added > c.max_chars):
                full = True
                if state is None:
                    break
            state, size, end = step(state, lines[end]), size + added, end + 1
            if full and state is None:
                break
        idx = [i for i in range(start, end) if lines[i].strip()]
        if idx:
            out.append(("\n".join(lines[idx[0] : idx[-1] + 1]), idx[0] + 1, idx[-1] + 1))
        if end >= len(lines):
            break
        back = end - c.overlap_lines
        for a, b in fences:
            if a <= back <= b:
                back = a if b - a + 1 <= c.max_fence_overlap_lines else b + 1
                break
        start = back if back > start else end
    return out


@pytest.mark.parametrize("config", [(3, 1000, 1, 3), (4, 30, 2, 2), (2, 12, 0, 10), (5, 1000, 4, 4)])
def test_random_documents_agree_with_the_stepwise_model(spark, config):
    rng = random.Random(5)
    pieces = ["a", "bb", "word word", "", "```", "````x", "~~~", "   ```", "long line of text", "# h"]
    texts = []
    while len(texts) < 120:
        lines = [rng.choice(pieces) for _ in range(rng.randint(1, 25))]
        if lines[0].strip() and lines[-1].strip():
            texts.append(lines)
    config = m.ChunkerConfig(*config)
    assert spans(spark, [("\n".join(x), 1) for x in texts], config) == [spec(x, config) for x in texts]


def document(spark, *contents):
    return spark.createDataFrame([(f"d{i}", "s", f"{i}.md", c, "h") for i, c in enumerate(contents)], schemas.DOCUMENTS)


def section_rows(spark, content):
    return [(tuple(r["section_path"]), r["content"], r["start_line"], r["content_start_line"], r["end_line"]) for r in m.sections(document(spark, content)).orderBy("section_ordinal").collect()]


def test_sections(spark):
    text = "# Retrieval\n\nRetrieval finds relevant documents.\n\n## BM25\n\nBM25 is a lexical ranking algorithm.\n"
    assert section_rows(spark, text) == [(("Retrieval",), "Retrieval finds relevant documents.", 1, 3, 3), (("Retrieval", "BM25"), "BM25 is a lexical ranking algorithm.", 5, 7, 7)]
    assert section_rows(spark, "") == []
    assert section_rows(spark, "no heading\n") == [((), "no heading", 1, 1, 1)]
    assert section_rows(spark, "# A\n## B\n# C\nx") == [(("A",), "", 1, None, 1), (("A", "B"), "", 2, None, 2), (("C",), "x", 3, 4, 4)]
    assert section_rows(spark, "# A\n```\n# no\n```\n### C#\ny") == [(("A",), "```\n# no\n```", 1, 2, 4), (("A", "C"), "y", 5, 6, 6)]
    assert section_rows(spark, "\n\n text\n\n") == [((), " text", 1, 3, 3)]
    assert section_rows(spark, "#no\n ## no") == [((), "#no\n ## no", 1, 1, 2)]


def test_random_headings_agree_with_a_stack(spark):
    rng, texts = random.Random(3), []
    for _ in range(60):
        texts.append([rng.randint(1, 6) for _ in range(rng.randint(1, 12))])
    docs = document(spark, *["\n".join(f"{'#' * n} t{i}" for i, n in enumerate(levels)) for levels in texts])
    got = {}
    for r in m.sections(docs).orderBy("document_id", "section_ordinal").collect():
        got.setdefault(r["document_id"], []).append(r["section_path"])
    for i, levels in enumerate(texts):
        stack, want = [], []
        for k, n in enumerate(levels):
            stack = [x for x in stack if x[0] < n] + [(n, f"t{k}")]
            want.append([x[1] for x in stack])
        assert got[f"d{i}"] == want


def test_numbering_and_separators(spark):
    docs = document(spark, "# A\na\nb\n# B\nc\nd\n# S\n---\n# E\n---\n\nuseful")
    rows = m.chunks(docs, m.sections(docs), m.ChunkerConfig(1, 100, 0)).orderBy("chunk_index").collect()
    assert [(r["content"], r["chunk_index"], r["section_chunk_index"], r["title"]) for r in rows] == [("a", 0, 0, "A"), ("b", 1, 1, "A"), ("c", 2, 0, "B"), ("d", 3, 1, "B"), ("useful", 4, 0, "E")]
    assert rows[0]["searchable_text"] == "A\n\na"
    assert len({r["chunk_id"] for r in rows}) == 5


@pytest.mark.parametrize(("args", "message"), [((0,), "max_lines must be positive"), ((1, 0, 0), "max_chars"), ((3, 1, -1), "overlap_lines must be non-negative"), ((3, 1, 3), "smaller than max_lines"), ((3, 1, 0, -1), "max_fence")])
def test_config(args, message):
    with pytest.raises(ValueError, match=message):
        m.ChunkerConfig(*args)


def test_unknown_document_is_an_error(spark):
    docs, others = document(spark, "# A\nx"), document(spark, "# A\nx").filter("false")
    with pytest.raises(Exception, match="does not match"):
        m.chunks(others, m.sections(docs)).collect()
