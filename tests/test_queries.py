"""Registered queries on small made tables that once gave other rows than their SQL, or moved more than they need."""

import random

import duckdb
import numpy as np

from sifterra.operators import dense, evaluation, lexical
from sifterra.plans import queries


def same(spark, folder, name, **tables):
    """The query's rows and those of its SQL, sorted."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    mine = queries.QUERIES[name](spark, str(folder))
    sql = con.execute(queries.ORACLES[name])
    assert mine.columns == [c[0] for c in sql.description]
    return sorted(map(tuple, mine.collect()), key=repr), sorted(sql.fetchall(), key=repr)


def test_repeated_turns_have_one_chunk_each(spark, tmp_path):
    """The same words of the same speaker twice in a talk: two chunks of one id."""
    turns = [(1, 0, "user", "Yes."), (1, 1, "assistant", "Well."), (1, 2, "user", "Yes."), (1, 3, "assistant", "Well."), (2, 0, "user", "No.\nNo.\nNo.")]
    got, want = same(spark, tmp_path, "chunk_jsonl", conversations=spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    assert got == want and len(got) > len({r[0] for r in got})


def shuffled(spark, run):
    """Bytes that ``run`` wrote to shuffles."""
    done = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = done()
    run()
    return done() - before


def test_a_row_counts_its_own_terms(spark):
    docs = spark.createDataFrame([(0, "b a b c b"), (1, ""), (2, None), (3, "a")], "pos long, text string")
    tokens = lexical.tokenized(docs, "pos", "text")
    got = sorted(map(tuple, lexical.counted_terms(tokens, "pos").collect()))
    assert got == sorted((r["pos"], r["term"], r["tf"]) for r in lexical.postings(tokens).collect()) == [(0, "a", 1), (0, "b", 3), (0, "c", 1), (3, "a", 1)]


def test_scores_of_many_queries_are_summed_where_the_row_is(spark):
    """Two hundred queries of common words: the pairs of queries and rows are not shuffled."""
    docs = spark.createDataFrame([(i, f"c{i}", f"of the and w{i}") for i in range(1000)], "chunk_pos long, chunk_id string, searchable_text string")
    asked = spark.createDataFrame([(f"q{i}", f"of the and w{i}") for i in range(200)], "query_id string, query string")
    index = lexical.BM25Index.build(docs)
    assert shuffled(spark, lambda: index.search(asked, 2).collect()) < 1_000_000
    index.close()


def test_each_vector_travels_once(spark):
    rng = np.random.default_rng(1)
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 16)))], "chunk_pos long, embedding array<double>")
    asked = held.limit(60).withColumnRenamed("chunk_pos", "query_id")
    assert shuffled(spark, lambda: dense.cosine_top_k(asked, held, 2, query_bytes=128).collect()) < 1_000_000


def test_texts_that_are_no_hits_stay_where_they_are(spark):
    """Both the nested evaluation and the judgments read large texts without shuffling them."""
    rng = random.Random(3)
    content = [f"text {i} " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000)) for i in range(150)]
    chunks = spark.createDataFrame([(i, f"c{i}", "p", ["A"], t) for i, t in enumerate(content)], "chunk_pos long, chunk_id string, relative_path string, section_path array<string>, content string")
    golden = spark.createDataFrame([("q", 0, "text", [("c3", "p", ["A"], 1)], "")], "query_id string, query_pos long, query string, relevant_chunks array<struct<chunk_id:string,relative_path:string,section_path:array<string>,relevance:int>>, notes string")
    hits = spark.createDataFrame([("q", 3, "c3", 1.0, 1)], "query_id string, pos long, chunk_id string, score double, rank int")
    rows = []
    assert shuffled(spark, lambda: rows.extend(evaluation.evaluate_queries(golden, hits, chunks, 5).collect())) < 1_000_000
    assert [c["content"] for c in rows[0]["retrieved_chunks"]] == [content[3]]
