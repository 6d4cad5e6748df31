import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifterra.operators import dense, evaluation, lexical, statistics


def chunk_table(spark, texts, ids=None):
    rows = [(i, ids[i] if ids else f"chunk-{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_pos long, chunk_id string, searchable_text string")


def ask(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")


def ranked(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


def plain_bm25(texts, query, k1, b):
    docs = [t.lower().split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        s = 0.0
        for t in dict.fromkeys(query.lower().split()):
            df = sum(t in x for x in docs)
            tf = d.count(t)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        out.append(s)
    return out


@pytest.mark.parametrize(("k1", "b"), [(1.5, 0.75), (0.1, 0.0), (2.0, 1.0)])
def test_bm25_scores(spark, k1, b):
    texts = ["the cat sat", "the dog", "cat cat cat dog the", "", "bird"]
    got = dict(ranked(lexical.BM25Index.build(chunk_table(spark, texts), k1=k1, b=b).search(ask(spark, "cat dog cat"), 10))["q0"])
    for i, s in enumerate(plain_bm25(texts, "cat dog cat", k1, b)):
        assert got.get(f"chunk-{i}", 0.0) == pytest.approx(s)


def test_bm25_ties_empties_and_checks(spark):
    index = lexical.BM25Index.build(chunk_table(spark, ["retrieval", "retrieval", "x"], ["chunk-b", "chunk-a", "c"]))
    assert [c for c, _ in ranked(index.search(ask(spark, "retrieval"), 5))["q0"]] == ["chunk-a", "chunk-b"]
    assert index.search(ask(spark, "", "   ", "unknown"), 5).count() == 0
    assert lexical.BM25Index.build(chunk_table(spark, ["", ""])).search(ask(spark, "a"), 3).count() == 0
    with pytest.raises(ValueError, match="top_k must be at least 1, got 0"):
        index.search(ask(spark, "x"), 0)
    for k1, b, message in ((0, 0.5, "k1 must be greater than 0"), (1, 1.1, "b must be between 0 and 1"), (1, -0.1, "b must be")):
        with pytest.raises(ValueError, match=message):
            lexical.BM25Index.build(chunk_table(spark, ["a"]), k1=k1, b=b)


def vectors(spark, rows):
    return spark.createDataFrame([(i, f"chunk-{i}", [float(x) for x in v]) for i, v in enumerate(rows)], "chunk_pos long, chunk_id string, embedding array<float>")


def test_cosine_top_k(spark):
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, embedding array<float>")
    rows = dense.cosine_top_k(asked, vectors(spark, [[1, 0, 0], [0.8, 0.6, 0], [0, 1, 0], [1, 0, 0]]), 3).orderBy("rank").collect()
    assert [(r["chunk_pos"], round(r["score"], 6)) for r in rows] == [(3, 1.0), (0, 1.0), (1, 0.8)]
    assert dense.cosine_top_k(asked, vectors(spark, [[-1, 0, 0]]), 5).first()["score"] == -1.0
    assert dense.cosine_top_k(asked.limit(0), vectors(spark, [[1, 0, 0]]), 5).count() == 0


def test_normalise(spark):
    rows = vectors(spark, [[3, 4, 0], [0, 0, 2]]).select(dense.l2_normalize(F.col("embedding")).alias("e")).collect()
    assert np.allclose([r["e"] for r in rows], [[0.6, 0.8, 0], [0, 0, 1]])
    for bad, message in (([0, 0], "zero vectors"), ([float("nan"), 1], "finite"), ([float("inf"), 1], "finite")):
        with pytest.raises(Exception, match=message):
            vectors(spark, [bad]).select(dense.l2_normalize(F.col("embedding"))).collect()


CONFIG = dense.EmbeddingModelConfig("hashing", "hash", 32, "", "")


def make():
    return dense.HashingEmbedder(CONFIG)


def test_dense_index(spark):
    chunks = chunk_table(spark, ["alpha beta", "gamma", "delta epsilon zeta"])
    embeddings, metadata = dense.build_dense(chunks, make, "digest")
    embeddings = embeddings.persist()
    index = dense.DenseIndex(chunks, embeddings, metadata, make)
    assert ranked(index.search(ask(spark, "gamma"), 1))["q0"][0] == ("chunk-1", pytest.approx(1.0, abs=1e-6))
    with pytest.raises(Exception, match="Query must not be empty"):
        index.search(ask(spark, "  "), 1).collect()
    with pytest.raises(ValueError, match="row count"):
        dense.DenseIndex(chunks.limit(2), embeddings, metadata, make)
    with pytest.raises(ValueError, match="unique"):
        dense.build_dense(chunk_table(spark, ["a", "b"], ["x", "x"]), make, "digest")
    other = dense.DenseMetadata(dense.EmbeddingModelConfig("hashing", "other", 32), "digest")
    with pytest.raises(ValueError, match="configuration does not match"):
        dense.DenseIndex(chunks, embeddings, other, make)
    with pytest.raises(ValueError, match="Unsupported embedding model provider: x"):
        dense.create_model(dense.EmbeddingModelConfig("x", "y", 1))


@pytest.mark.parametrize("bad", [("", "m", 1), ("p", " ", 1), ("p", "m", 0)])
def test_embedding_config(bad):
    with pytest.raises(ValueError, match="Embedding"):
        dense.EmbeddingModelConfig(*bad)


def golden_table(spark, *rows):
    """(query_id, query, [(chunk_id, grade), ...])"""
    data = [(i, q, t, [(c, "p.md", ["A"], g) for c, g in js], "") for i, (q, t, js) in enumerate(rows)]
    return spark.createDataFrame(data, "query_pos long, query_id string, query string, relevant_chunks array<struct<chunk_id:string,relative_path:string,section_path:array<string>,relevance:int>>, notes string")


def hit_table(spark, **found):
    return spark.createDataFrame([(q, c, i) for q, cs in found.items() for i, c in enumerate(cs, 1)], "query_id string, chunk_id string, rank int")


def test_bounded_search(spark):
    """Blocks are skipped, and hits and scores stay those of the whole search, ties included."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 400) for _ in range(600)] + ["rare pair of words", "rare pair"] * 3
    chunks = chunk_table(spark, texts, [f"c{i % 590:04d}x{i}" for i in range(len(texts))])
    queries = ask(spark, "rare pair", "w1 w2 w3", "w7 w350", "nothing", "w1", "")
    index = lexical.BM25Index.build(chunks)
    for k in (1, 3, 50):
        hits, counts = index.search_bounded(queries, k, rows=8)
        key = lambda r: (r["query_id"], r["rank"], r["pos"], r["chunk_id"], round(r["score"], 9))
        assert sorted(map(key, hits.collect())) == sorted(map(key, index.search(queries, k).collect()))
        total = counts.agg(F.sum("blocks").alias("blocks"), F.sum("visited").alias("visited")).first()
        assert k > 3 or total["visited"] < total["blocks"]
    index.close()
    with pytest.raises(ValueError, match="top_k"):
        index.search_bounded(queries, 0)


@pytest.mark.parametrize("query_bytes", [1 << 20, 1600, 160])
def test_top_k_on_a_grid(spark, query_bytes):
    """One block of queries that is broadcast, and grids of several blocks, against sorting every score."""
    rng = np.random.default_rng(3)
    held = rng.integers(-2, 3, (300, 4)).astype(np.float64)
    held = np.concatenate([held[np.abs(held).sum(axis=1) > 0], held[:5] + 0.5])
    held = (held / np.linalg.norm(held, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame([(10 * i, v.tolist()) for i, v in enumerate(held)], "chunk_pos long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(held[:40])], "query_id string, embedding array<float>")
    for k in (1, 7, 1000):
        got = {}
        for r in dense.cosine_top_k(asked, table, k, query_bytes=query_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_pos"], round(r["score"], 9)))
        scores = held[:40].astype(np.float64) @ held.astype(np.float64).T
        for i, row in enumerate(scores):
            best = sorted(range(len(held)), key=lambda j: (-round(row[j], 9), -j))[:k]  # noqa: B023
            assert got[f"q{i}"] == [(n, 10 * j, round(row[j], 9)) for n, j in enumerate(best, 1)]


def test_metrics(spark):
    golden = golden_table(spark, ("q0", "x", [("a", 2), ("b", 1), ("c", 1)]), ("q1", "x", [("a", 2), ("b", 1)]), ("q2", "x", []), ("q3", "x", [("z", 1)]), ("q4", "x", [("a", 0)]))
    hits = hit_table(spark, q0=["a", "x", "b"], q1=["x", "a", "b"], q2=["a"], q4=["a"])
    got = {r["query_id"]: r for r in evaluation.query_metrics(golden, hits, 3).collect()}
    assert set(got) == {"q0", "q1", "q3", "q4"}
    assert got["q0"]["recall_at_k"] == pytest.approx(2 / 3)
    assert (got["q1"]["hit_rate_at_k"], got["q1"]["recall_at_k"], got["q1"]["reciprocal_rank"], got["q1"]["first_relevant_rank"]) == (1.0, 1.0, 0.5, 2)
    dcg, ideal = 3 / math.log2(3) + 1 / 2, 3 + 1 / math.log2(3)
    assert got["q1"]["ndcg_at_k"] == pytest.approx(dcg / ideal)
    assert got["q3"]["first_relevant_rank"] is None and got["q3"]["ndcg_at_k"] == 0.0
    assert (got["q4"]["hit_rate_at_k"], got["q4"]["ndcg_at_k"]) == (1.0, 0.0)
    means = evaluation.macro_averages(golden, evaluation.query_metrics(golden, hits, 3)).first()
    assert (means["query_count"], means["evaluated_query_count"], means["no_answer_count"]) == (5, 4, 1)
    assert means["mrr"] == pytest.approx((1 + 0.5 + 0 + 1) / 4)
    empty = evaluation.macro_averages(golden.limit(0), evaluation.query_metrics(golden.limit(0), hits, 3)).first()
    assert (empty["query_count"], empty["mrr"]) == (0, 0.0)
    with pytest.raises(ValueError, match="at least 1"):
        evaluation.query_metrics(golden, hits, 0)


BAD = [
    ([(" ", "x", [])], "query_id must not be empty"),
    ([("q", " ", [])], "q: query must not be empty"),
    ([("q", "x", []), ("q", "x", [])], "Duplicate query_id: q"),
    ([("q", "x", [("a", 3)])], "q: relevance must be 1 or 2, got 3"),
    ([("q", "x", [("", 1)])], "q: chunk_id must not be empty"),
    ([("q", "x", [("a", 1), ("a", 1)])], "q: duplicate chunk_id a"),
    ([("q", "x", [("nope", 1)])], "q: unknown chunk_id nope"),
    ([("q", "x", [("b", 1)])], "q: relative_path mismatch for chunk b"),
    ([("q", "x", [("c", 1)])], "q: section_path mismatch for chunk c"),
    ([("q", "x", [("nope", 1)]), ("r", " ", [])], "unknown chunk_id"),
]


@pytest.mark.parametrize(("rows", "message"), BAD)
def test_golden_rules(spark, rows, message):
    chunks = spark.createDataFrame([(0, "a", "p.md", ["A"]), (1, "b", "other.md", ["A"]), (2, "c", "p.md", ["B"])], "chunk_pos long, chunk_id string, relative_path string, section_path array<string>")
    with pytest.raises(ValueError, match=message):
        evaluation.validate_golden(golden_table(spark, *rows), chunks)
    counts = evaluation.validate_golden(golden_table(spark, ("q", "x", [("a", 1)]), ("r", "y", [])), chunks).first()
    assert tuple(counts) == (2, 1, 1, 1)


def test_comparison(spark):
    def side(**ranks):
        return spark.createDataFrame([(i, q, "text", r) for i, (q, r) in enumerate(ranks.items())], "pos long, query_id string, query string, first_relevant_rank int")

    got = evaluation.compare(side(a=None, b=1, c=2, d=None), side(a=3, b=None, c=1, d=None))
    assert {r["query_id"]: r["category"] for r in got.collect()} == {"a": "dense_only_hits", "b": "lexical_only_hits", "c": "both_hit", "d": "both_miss"}
    with pytest.raises(ValueError, match="same query IDs"):
        evaluation.compare(side(a=1), side(b=1))
    with pytest.raises(ValueError, match="same query text for query ID a"):
        evaluation.compare(side(a=1), side(a=1).withColumn("query", F.lit("other")))


def test_statistics(spark):
    rows = [(0, "c0", "d", "p", ["A"], "abc", 1, 1), (1, "c1", "d", "p", [], "x\n```\ny", 2, 4), (2, "c2", "e", "p", [], "zzz", 5, 5)]
    chunks = spark.createDataFrame(rows, "chunk_pos long, chunk_id string, document_id string, relative_path string, section_path array<string>, content string, start_line int, end_line int")
    s = statistics.summary(chunks, max_chars=3, max_lines=2).first()
    assert (s["chunk_count"], s["document_count"], s["min_chars"], s["max_chars"], s["max_lines"], s["chunks_with_code_fence"], s["chunks_over_char_limit"], s["chunks_over_line_limit"]) == (3, 2, 3, 7, 3, 1, 1, 1)
    assert [r["chunk_id"] for r in statistics.largest(chunks, 2).collect()] == ["c1", "c0"]
    assert [r["chunk_id"] for r in statistics.smallest(chunks, 2).collect()] == ["c0", "c2"]
    empty = statistics.summary(chunks.limit(0)).first()
    assert (empty["chunk_count"], empty["average_chars"], empty["max_lines"]) == (0, 0.0, 0)
    for args, message in (((0, 1, 0, 0), "max_chars"), ((1, 0, 0, 0), "max_lines"), ((1, 1, -1, 0), "largest"), ((1, 1, 0, -1), "smallest")):
        with pytest.raises(ValueError, match=message):
            statistics.check_limits(*args)
