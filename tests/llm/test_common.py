"""Joins of hot keys, shared storage and small tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sifterra.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [True, False])
def test_spread_join(spark, how, hot):
    """Nine rows in ten have one key: the rows are those of a plain join, and no task gets that key's rows alone."""
    key = F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id")) if hot else F.col("id") % 500
    left = spark.range(4000).select(key.alias("k"), F.col("id").alias("x"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m")).filter("k <> 30")
    joined = common.spread_join(left, right, ["k"], n="n", by="x", how=how)
    assert joined.columns == ["k", "x", "m"]
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, left.join(right.drop("n"), ["k"], how).collect()))
    if hot:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            parts = common.spread_join(left, right, ["k"], n="n", by="x", how=how).groupBy(F.spark_partition_id()).count().collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert max(r["count"] for r in parts) < 2400


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake)
    Fake.sparkContext.getConf = staticmethod(lambda: {"spark.checkpoint.dir": "hdfs://x/y/"})
    assert common.shared_dir(Fake) == "hdfs://x/y"


def test_small_tables(spark):
    assert common.small_table(spark, {"a": pa.array([], pa.int64()), "b": pa.array([], pa.string())}).dtypes == [("a", "bigint"), ("b", "string")]
    assert common.small_table(spark, {"a": pa.array([1, 2])}).count() == 2


def test_drop_rows(spark):
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(500)], "__maybe long, c0 long")
    bad = spark.range(20).select(F.when(F.col("id") > 2, F.col("id")).alias("__maybe"))
    got = common.drop_rows(docs, bad, "__maybe")
    assert got.columns == docs.columns
    assert sorted(r["c0"] for r in got.collect()) == [i for i in range(500) if not i % 7 or not 2 < i % 50 < 20]
    assert common.drop_rows(docs, bad.limit(0), "__maybe").count() == 500 and common.drop_rows(docs.limit(0), bad, "__maybe").count() == 0


def test_hot_groups_in_every_operator(spark):
    """Nine rows in ten are one text, vector or first turn: results are those of any other input."""
    from sifterra.llm import chat_tree, jaccard_join, sharding, vector_dedup
    from sifterra.llm.queries import public_tokenizer

    rows = [(i, "one text that nearly all rows hold", "h") if i % 10 else (i, f"text number {i} is not like the others", "h") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_similar(docs, width=4, threshold=(85, 100)).collect()}
    assert joined == {i: (4 if i % 10 else 5, 1 if i % 10 else i) for i in range(400)}
    kept = jaccard_join.keep_one(docs, width=4, threshold=(85, 100))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({1, *range(0, 400, 10)})

    points = spark.createDataFrame([(i, [1.0, 0.0] if i % 10 else [float(i), 1000.0 - i * i]) for i in range(1, 200)], "vec_id long, embedding array<double>")
    near = {r["vec_id"]: r for r in vector_dedup.near_vectors(points).collect()}
    same = [i for i in range(1, 200) if i % 10]
    assert all(near[i]["component_id"] == 1 and near[i]["n_links"] >= len(same) - 1 for i in same)

    placed = sharding.assign_shards(docs, 8).collect()
    sizes = [sum(r["size"] for r in placed if r["shard"] == s) for s in range(8)]
    assert len(placed) == 400 and max(sizes) - min(sizes) <= 2 * 50 + 0.04 * sum(sizes) / 8

    talks = [(c, t, ("user", "assistant")[t % 2], "hello" if t == 0 and c % 10 else f"{c} {t}") for c in range(60) for t in range(3)]
    files = public_tokenizer()
    segments, paths = chat_tree.build_tree(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"), **files)
    back = chat_tree.read_back(segments, paths, tokenizer=files["tokenizer"])
    assert {r["conv_id"]: [t["text"] for t in r["turns"]] for r in back.collect()} == {c: [x[3] for x in talks if x[0] == c] for c in range(60)}


def test_names_with_dots(spark):
    """Columns whose names hold dots and back quotes pass through the operators that keep them."""
    from sifterra.llm import jaccard_join, line_rules, mixing, quality_fm

    word = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    rows = [(i, " ".join(word(7 * i + j * j) for j in range(80)), "s.1" if i % 2 else None, 9, "x", "y") for i in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "n_chars", "a.b", "c`d.e"])
    out = mixing.emit(mixing.mix(docs))
    assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} == {"x"}
    for kept in (quality_fm.keep_scored(docs, None, 0.3), line_rules.keep_good(docs), jaccard_join.keep_one(docs, width=5, threshold=(80, 100))):
        assert kept.columns == docs.columns and {r["c`d.e"] for r in kept.collect()} == {"y"}
    renamed = docs.withColumnsRenamed({"text": "t.x", "source": "s.x", "doc_id": "i.x"})
    mixed = mixing.mix(renamed, text_col="t.x", source_col="s.x", id_col="i.x").collect()
    plain = mixing.mix(docs).collect()
    assert sorted((r["row"]["i.x"], r["size"], r["copies"]) for r in mixed) == sorted((r["row"]["doc_id"], r["size"], r["copies"]) for r in plain)
