import json

import pytest
from pyspark.sql import functions as F

from sifterra import cli, schemas
from sifterra.operators import dense, markdown
from sifterra.plans import pipelines, report
from sifterra.sources import dense_store, files, jsonl
from sifterra.streaming import incremental


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "notes"
    for name, text in {
        "retrieval.md": "# Retrieval\n\nRetrieval finds relevant documents.\n\n## BM25\n\nBM25 is a lexical ranking algorithm.\nIt uses term frequencies.\nIt also considers document length.\n",
        "_draft/.x/Y.MD": "# Hidden\r\ntext\r\n",
        "1_plan.md": "# no",
        "node_modules/a.md": "# no",
        "note.txt": "no",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return root


def test_scan(spark, notes, tmp_path):
    rows = {r["relative_path"]: r for r in files.scan_documents(spark, notes, "s").collect()}
    assert set(rows) == {"retrieval.md", "_draft/.x/Y.MD"}
    assert rows["_draft/.x/Y.MD"]["content"] == "# Hidden\ntext\n"
    assert files.scan_documents(spark, notes, "s", files.ScannerConfig(included_extensions=frozenset({".txt"}))).count() == 1
    with pytest.raises(FileNotFoundError, match="does not exist"):
        files.scan_documents(spark, tmp_path / "none", "s")
    with pytest.raises(NotADirectoryError):
        files.scan_documents(spark, notes / "note.txt", "s")
    (notes / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="utf-8"):
        files.scan_documents(spark, notes, "s").collect()
    with pytest.raises(Exception, match="invalid UTF-8"):
        files.load_documents(spark, str(notes), "s").collect()
    (notes / "bad.md").unlink()
    assert [r["relative_path"] for r in files.load_documents(spark, str(notes), "s", pattern="r*.md").collect()] == ["retrieval.md"]


def test_index_search_evaluate_compare_report(spark, notes, tmp_path):
    path = str(tmp_path / "out/chunks.jsonl")
    result = pipelines.build_chunks(spark, notes, path, config=markdown.ChunkerConfig(2, 1000, 0))
    assert (result.documents, result.sections, result.chunks) == (2, 3, 4)
    lines = [json.loads(x) for x in open(path, encoding="utf-8")]
    assert [list(x) for x in lines][0] == schemas.CHUNK_FIELDS
    assert [(x["chunk_index"], x["section_chunk_index"], x["start_line"], x["end_line"]) for x in lines[1:]] == [(0, 0, 3, 3), (1, 0, 7, 8), (2, 1, 9, 9)]
    chunks = jsonl.read_chunks(spark, path)
    assert [r["chunk_id"] for r in chunks.orderBy("chunk_pos").collect()] == [x["chunk_id"] for x in lines]
    assert pipelines.numbered(chunks.drop("chunk_pos")).count() == 4
    first = pipelines.lexical_search(spark, path, "lexical ranking", 1).first()
    assert first["chunk_id"] == lines[2]["chunk_id"]

    golden = tmp_path / "golden.jsonl"
    judged = lambda i: {"chunk_id": lines[i]["chunk_id"], "relative_path": lines[i]["relative_path"], "section_path": lines[i]["section_path"], "relevance": 2}
    rows = [("q1", "lexical ranking", [judged(2)]), ("q2", "nothing here", [judged(0)]), ("q3", "no answer", [])]
    golden.write_text("\n".join(json.dumps({"query_id": q, "query": t, "relevant_chunks": j, "notes": ""}) for q, t, j in rows) + "\n\n")
    assert pipelines.validate_golden_files(spark, str(golden), path)["answerable_count"] == 2

    config = dense.EmbeddingModelConfig("hashing", "hash", 64)
    vectors, meta = str(tmp_path / "vectors"), tmp_path / "meta.json"
    pipelines.build_dense_index(spark, path, vectors, meta, pipelines.model_maker(config))
    index = pipelines.load_dense_index(spark, path, vectors, meta)
    assert pipelines.dense_search(index, "term frequencies", 2).count() == 2
    out = tmp_path / "analysis"
    one = pipelines.analyze(spark, str(golden), path, "lexical", out, 2)
    two = pipelines.analyze(spark, str(golden), path, "dense", out, 2, embeddings_path=vectors, metadata_path=meta)
    assert (one["query_count"], one["miss_count"]) == (2, 1)
    counts = pipelines.compare_files(spark, one["results_path"], two["results_path"], out / "cmp")
    assert sum(counts.values()) == 2 and (out / "cmp/both_miss.jsonl").exists()
    read = lambda p: jsonl.read_evaluation(spark, p)
    made, told = report.write_report(jsonl.read_golden(spark, str(golden)), read(one["results_path"]), read(two["results_path"]), meta, out, 2, 20)
    text = made.read_text()
    assert text.startswith("# Retrieval Error Analysis\n") and text.endswith("TODO\n") and told == counts
    assert made == out / "top_2/error_analysis.md"

    run = lambda *a: cli.main(list(a))
    assert run("stats", path) == 0 and run("lexical-search", "lexical", "--chunks", path) == 0
    assert run("lexical-evaluate", str(golden), path) == 0 and run("validate-golden", str(golden), path) == 0
    assert run("dense-search", "bm25", "--chunks", path, "--embeddings", vectors, "--metadata", str(meta)) == 0
    assert run("retrieval-compare", one["results_path"], two["results_path"], "--output-dir", str(out / "c2")) == 0
    assert run("index", str(tmp_path / "none")) == 1 and run("stats", str(tmp_path / "none.jsonl")) == 1

    with open(path, "a") as file:
        file.write("\n")
    with pytest.raises(ValueError, match="does not match the current chunks file"):
        pipelines.load_dense_index(spark, path, vectors, meta)
    with pytest.raises(ValueError, match="Unsupported retriever type"):
        pipelines.analyze(spark, str(golden), path, "other", out, 2)
    with pytest.raises(ValueError, match="embeddings_path"):
        pipelines.analyze(spark, str(golden), path, "dense", out, 2)


@pytest.mark.parametrize(("line", "message"), [("{", "Invalid JSONL at line 3"), ("[]", "Invalid chunk at line 3: JSON value must be an object"), ('{"section_path": "x"}', "Invalid chunk at line 3: section_path must be a list"), ('{"section_path": []}', "Invalid chunk at line 3")])
def test_bad_chunk_lines(spark, tmp_path, line, message):
    good = json.dumps(dict.fromkeys(schemas.CHUNK_FIELDS, "x") | {"section_path": [], "extra": 1} | dict.fromkeys(("chunk_index", "section_chunk_index", "start_line", "end_line"), 1))
    path = tmp_path / "c.jsonl"
    path.write_text(f"{good}\n\n{line}\n{good}\n")
    with pytest.raises(ValueError, match=message):
        jsonl.read_chunks(spark, str(path))
    path.write_text("")
    assert jsonl.read_chunks(spark, str(path)).count() == 0


def test_bad_golden_and_metadata(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    for bad, message in (({"query_id": 1}, "relevant_chunks"), ({"query_id": 1, "relevant_chunks": [], "query": "", "notes": ""}, "query_id must be a string"), ({"query_id": "a", "query": "b", "notes": "", "relevant_chunks": [{"chunk_id": "c", "relative_path": "p", "section_path": [1], "relevance": 1}]}, "only strings")):
        path.write_text(json.dumps(bad) + "\n")
        with pytest.raises(ValueError, match=message):
            jsonl.read_golden(spark, str(path))
    meta = dense.DenseMetadata(dense.EmbeddingModelConfig("hashing", "m", 3), "x")
    dense_store.write_metadata(meta, tmp_path / "m.json")
    assert dense_store.read_metadata(tmp_path / "m.json") == meta
    value = json.loads((tmp_path / "m.json").read_text())
    for field, bad, message in (("schema_version", True, "integer"), ("schema_version", 1, "Unsupported schema_version: 1"), ("normalized", 1, "boolean"), ("chunks_sha256", "", "not be empty"), ("embedding_model", [], "object")):
        (tmp_path / "m.json").write_text(json.dumps(value | {field: bad}))
        with pytest.raises(ValueError, match=message):
            dense_store.read_metadata(tmp_path / "m.json")


def test_vectors_round_trip(spark, tmp_path):
    meta = dense.DenseMetadata(dense.EmbeddingModelConfig("hashing", "m", 2), "x")
    table = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], schemas.DENSE)
    dense_store.write_embeddings(table, str(tmp_path / "v"))
    back = dense_store.read_embeddings(spark, str(tmp_path / "v"), meta)
    assert sorted(map(tuple, back.select("chunk_pos", "chunk_id").collect())) == [(0, "a"), (1, "b")]
    dense_store.export_npy(back, tmp_path / "v.npy")
    assert dense_store.import_npy(spark, tmp_path / "v.npy", ["a", "b"], 2).count() == 2
    with pytest.raises(ValueError, match="chunk IDs count"):
        dense_store.import_npy(spark, tmp_path / "v.npy", ["a"], 2)
    other = dense.DenseMetadata(dense.EmbeddingModelConfig("hashing", "m", 3), "x")
    with pytest.raises(ValueError, match="dimension"):
        dense_store.read_embeddings(spark, str(tmp_path / "v"), other)
    jsonl.write_table(table, str(tmp_path / "j"), ["chunk_pos"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert files.table_sha256(table) == files.table_sha256(table.orderBy(F.desc("chunk_pos")))


def test_stream(spark, tmp_path):
    """New, changed, reverted and emptied documents: only a content other than the last one is written."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*versions):
        spark.createDataFrame([(d, "s", f"{d}.md", text, str(hash(text))) for d, text in versions], schemas.DOCUMENTS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.DOCUMENTS).parquet(source)
        incremental.chunk_stream(stream, out, str(tmp_path / "state")).awaitTermination()
        return {(r["document_id"], r["content"]) for r in incremental.latest_chunks(spark, out).collect()}

    assert arrive(("d", "# A\nx"), ("e", "# E\nsame")) == {("d", "x"), ("e", "same")}
    assert arrive(("d", "# A\nnew"), ("e", "# E\nsame")) == {("d", "new"), ("e", "same")}
    assert arrive(("d", "# A\nx")) == {("d", "x"), ("e", "same")}
    assert arrive(("d", "")) == {("e", "same")}
    assert spark.read.parquet(f"{out}/versions").groupBy("document_id").count().filter("document_id = 'e'").first()["count"] == 1
