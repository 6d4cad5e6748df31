"""What the commands print, and the dump of an evaluation."""

import json
import sys
import types

import numpy as np
import pytest

from sifterra import cli, console, schemas
from sifterra.operators import dense


def chunk(i, content, path=("Python", "Example"), doc="d"):
    row = {"chunk_id": f"c{i}", "document_id": f"{doc}{i}", "source_name": "s", "relative_path": f"notes/{i}.md", "title": "t", "section_path": list(path), "content": content, "searchable_text": content, "chunk_index": i, "section_chunk_index": 0, "start_line": 1, "end_line": 3, "content_hash": "h"}
    assert list(row) == schemas.CHUNK_FIELDS
    return json.dumps(row)


@pytest.fixture
def shown(spark, capsys):
    def run(*arguments):
        code = cli.main([str(a) for a in arguments])
        text = capsys.readouterr()
        return code, text.out, text.err

    return run


def test_stats(shown, tmp_path):
    path = tmp_path / "chunks.jsonl"
    path.write_text(chunk(1, "short", ()) + "\n" + chunk(2, "```python\nprint()\n```") + "\n")
    code, out, _ = shown("stats", path, "--max-chars", 10, "--max-lines", 2, "--smallest-limit", 1)
    assert code == 0 and out.split("\n") == [
        "Documents: 2", "Chunks: 2", "", "Characters:", "  Min: 5", "  Average: 13.00", "  Max: 21", "", "Lines:", "  Min: 1", "  Average: 2.00", "  Max: 3", "",
        "Chunks with code fence: 1", "Chunks over 10 chars: 1", "Chunks over 2 lines: 1", "", "Largest chunks:", "1. notes/2.md:1-3", "   Section: Python > Example", "   Size: 21 chars, 3 lines",
        "2. notes/1.md:1-3", "   Section: <no heading>", "   Size: 5 chars, 1 lines", "", "Smallest chunks:", "1. notes/1.md:1-3", "   Section: <no heading>", "   Size: 5 chars, 1 lines", "",
    ]
    code, out, _ = shown("stats", path, "--largest-limit", 0, "--smallest-limit", 0)
    assert code == 0 and "Chunks: 2" in out and "Largest" not in out and "Smallest" not in out
    path.write_text("")
    assert "Documents: 0\nChunks: 0\n" in shown("stats", path)[1]
    code, out, err = shown("stats", tmp_path / "none.jsonl")
    assert code == 1 and not out and "Statistics failed: Chunks JSONL does not exist" in err


def test_search_and_dump(shown, tmp_path):
    path, golden = tmp_path / "chunks.jsonl", tmp_path / "golden.jsonl"
    path.write_text(chunk(1, "lexical ranking   of words") + "\n" + chunk(2, "lexical\n\nother", ()) + "\n" + chunk(3, "nothing") + "\n")
    code, out, _ = shown("lexical-search", "lexical ranking", "--chunks", path, "--content-limit", 17)
    lines = out.split("\n")
    assert code == 0 and lines[0].startswith("1. Score: ") and lines[1:6] == ["   Path: notes/1.md", "   Section: Python > Example", "   Chunk ID: c1", "   Content:", "     lexical ranking..."]
    assert lines[6] == "" and lines[7].startswith("2. Score: ") and lines[9:15] == ["   Section: <no heading>", "   Chunk ID: c2", "   Content:", "     lexical", "     ", "     other"]
    assert shown("lexical-search", "absent", "--chunks", path)[1] == "No matching chunks found.\n"
    judged = lambda i: [{"chunk_id": f"c{i}", "relative_path": f"notes/{i}.md", "section_path": ["Python", "Example"], "relevance": 1}]
    golden.write_text("\n".join(json.dumps({"query_id": q, "query": t, "relevant_chunks": j, "notes": ""}) for q, t, j in (("a", "ranking", judged(1)), ("b", "ranking", judged(3)), ("c", "x", []))) + "\n")
    out = tmp_path / "all.jsonl"
    assert shown("retrieval-dump", golden, path, "--output", out)[1] == f"Evaluated queries: 2\nWritten queries: 2\nOutput: {out}\n"
    assert shown("retrieval-dump", golden, path, "--output", out, "--only-misses")[1] == f"Evaluated queries: 2\nWritten queries: 1\nOutput: {out}\n"
    assert [json.loads(x)["query_id"] for x in out.read_text().splitlines()] == ["b"]
    text = shown("validate-golden", golden, path)[1]
    assert "Golden dataset is valid." in text and text.endswith("Queries: 3\nAnswerable queries: 2\nNo-answer queries: 1\nRelevance judgments: 2\n")
    text = shown("lexical-evaluate", golden, path, "--top-k", 2)[1]
    assert "Top-K: 2\nQueries: 3\nEvaluated queries: 2\nNo-answer queries: 1\n\nHitRate@2: 0.5000\nRecall@2: 0.5000\nMRR@2: 0.5000\nnDCG@2: 0.5000\n" in text


def test_lines():
    row = {"rank": 1, "score": 0.5, "relative_path": "p", "section_path": [], "start_line": 2, "end_line": 3, "chunk_id": "c", "content": "x"}
    assert console.hits([row, row], 0, True) == ["1. Score: 0.5000", "   Path: p", "   Section: <no heading>", "   Lines: 2-3", "   Chunk ID: c", "   Content:", "", "", *console.hits([row], 0, True)]
    assert console.hits([], 5, False) == ["No matching chunks found."]


class Stub:
    """Stands for the sentence-transformers library's model."""

    made = []

    def __init__(self, name, device):
        self.made.append((name, device))
        self.calls = []

    def get_sentence_embedding_dimension(self):
        return self.dimension

    def encode(self, texts, **options):
        self.calls.append((texts, options))
        return np.array([[len(t), 1.0] for t in texts], np.float32)


def test_sentence_transformer_adapter(monkeypatch):
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Stub))
    Stub.dimension = 2
    model = dense.SentenceTransformerModel("m", batch_size=7, device="cuda")
    assert Stub.made[-1] == ("m", "cuda") and isinstance(model, dense.EmbeddingModel)
    assert model.config == dense.EmbeddingModelConfig("sentence-transformers", "m", 2, "query: ", "passage: ")
    assert model.embed_documents(["a", "bc"]).tolist() == [[10, 1], [11, 1]] and model.embed_query("a").tolist() == [8, 1]
    assert model.model.calls[0] == (["passage: a", "passage: bc"], {"batch_size": 7, "convert_to_numpy": True, "normalize_embeddings": False, "show_progress_bar": False})
    assert model.model.calls[1][0] == ["query: a"]
    made = dense.create_model(dense.EmbeddingModelConfig("sentence-transformers", "n", 2, "q", "d"), batch_size=3, device="cpu")
    assert (made.config.query_prefix, made.config.document_prefix, made.batch_size) == ("q", "d", 3)
    for bad, message in (({"model_name": " "}, "name must not be empty"), ({"model_name": "m", "batch_size": 0}, "batch_size must be at least 1")):
        with pytest.raises(ValueError, match=message):
            dense.SentenceTransformerModel(**bad)
    Stub.dimension = None
    with pytest.raises(ValueError, match="dimension is unknown"):
        dense.SentenceTransformerModel("m")
    with pytest.raises(ValueError, match="Unsupported embedding model provider"):
        dense.create_model(dense.EmbeddingModelConfig("other", "n", 2))
