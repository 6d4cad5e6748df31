"""Line positions over files of any number and size, and the first failure among them."""

import json
import random

import pytest

from sifterra.sources import jsonl


def written(folder, files, rising, lines, padding=2000):
    """``lines`` dealt to files whose numbers of lines rise or fall; the file's name is its number."""
    folder.mkdir()
    weights = [1 + i for i in range(files)]
    weights = weights if rising else weights[::-1]
    done = 0
    for i in range(files):
        upto = len(lines) if i == files - 1 else done + len(lines) * weights[i] // sum(weights)
        (folder / f"part-{i + 99_990:05d}-x.txt").write_text("".join(x + "\n" for x in lines[done:upto]), encoding="utf-8")
        done = upto
    return str(folder)


def golden(i, padding):
    return json.dumps({"query_id": f"q{i}", "query": "x" * padding, "relevant_chunks": [], "notes": ""})


@pytest.mark.parametrize("files", [1, 4, 40])
@pytest.mark.parametrize("rising", [True, False])
def test_positions_and_first_failure(spark, tmp_path, files, rising):
    rng = random.Random(files)
    lines = [golden(i, rng.randrange(300)) for i in range(900)]
    for at in (0, 5, 333, 899):
        lines.insert(at, " ")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = jsonl.read_golden(spark, written(tmp_path / "good", files, rising, lines)).orderBy("query_pos").collect()
        want = [(i, json.loads(x)["query_id"]) for i, x in enumerate(lines) if x.strip()]
        assert [(r["query_pos"], r["query_id"]) for r in got] == want
        lines[700], lines[350], lines[800] = "[]", "{", "{"
        with pytest.raises(ValueError, match="^Invalid JSONL at line 351$"):
            jsonl.read_golden(spark, written(tmp_path / "bad", files, rising, lines))
        lines[120] = '{"query_id": 3}'
        with pytest.raises(ValueError, match="^Invalid golden query at line 121"):
            jsonl.read_golden(spark, written(tmp_path / "worse", files, rising, lines))
        numbered = jsonl.read_lines(spark, str(tmp_path / "bad")).orderBy("number").collect()
        assert [(r["number"], r["line"]) for r in numbered][700] == (700, "[]") and len(numbered) == len(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_wide_and_shuffled_splits_agree(spark, tmp_path, monkeypatch):
    rows = [(i, f"q{i:05d}") for i in range(400)]
    df = spark.createDataFrame(rows, "n long, query_id string").selectExpr("query_id", "'x' AS query", "cast(array() AS array<struct<chunk_id: string, relative_path: string, section_path: array<string>, relevance: int>>) AS relevant_chunks", "'' AS notes", "n")
    path = str(tmp_path / "t")
    jsonl.write_table(df, path, ["n"])
    for bound in (0, 10):
        monkeypatch.setattr(jsonl, "BROADCAST_SPLITS", bound)
        got = [(r["query_pos"], r["query_id"]) for r in jsonl.read_golden(spark, path).orderBy("query_pos").collect()]
        assert got == rows


def test_matrix_bytes_and_subtrees(spark, tmp_path):
    """A matrix file written by ranges has NumPy's own bytes; a tree's folders are dealt out level by level."""
    import numpy as np

    from sifterra.sources import dense_store, files

    held = np.random.default_rng(1).normal(size=(357, 9)).astype(np.float32)
    rows = [(3 * i - 40, f"c{i}", v.tolist()) for i, v in enumerate(held)]
    table = spark.createDataFrame(rows, "chunk_pos long, chunk_id string, embedding array<float>").repartition(7)
    dense_store.export_npy(table, tmp_path / "m.npy")
    np.save(tmp_path / "n.npy", held)
    assert (tmp_path / "m.npy").read_bytes() == (tmp_path / "n.npy").read_bytes()
    back = dense_store.import_npy(spark, tmp_path / "m.npy", [r[1] for r in rows], 9).orderBy("chunk_pos").collect()
    assert [r["chunk_id"] for r in back] == [r[1] for r in rows] and np.array_equal(np.array([r["embedding"] for r in back], np.float32), held)
    dense_store.export_npy(table.limit(0), tmp_path / "e.npy")
    assert np.load(tmp_path / "e.npy").shape == (0, 0)

    made = {f"a/{i}/x{i}.md" for i in range(4)} | {"a/0/_h/.d/y.md", "top.md", "b/.hidden.md"}
    for name in made | {"a/node_modules/z.md", "b/q_plan.md", "b/c/t.txt"}:
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(name)
    for tasks in (1, 3, 100):
        reader = files.TreeReader(str(tmp_path / "tree"), files.ScannerConfig(), tasks)
        parts = reader.partitions()
        assert sorted(x for p in parts for x in reader.read(p)) == sorted((n, n) for n in made)
        assert tasks == 1 or len(parts) > 3
    assert {r["relative_path"] for r in files.scan_documents(spark, tmp_path / "tree", "s").collect()} == made
