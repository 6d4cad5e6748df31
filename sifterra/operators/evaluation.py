"""Golden judgments, graded metrics per query and their means, and comparison of two retrievers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lexical import check_top_k, named


def judgments(golden: DataFrame) -> DataFrame:
    """(query_id, at, chunk_id, relative_path, section_path, relevance), one row for each judged chunk."""
    return golden.select("query_id", F.posexplode("relevant_chunks").alias("at", "j")).select("query_id", "at", "j.*")


def golden_violations(golden: DataFrame, chunks: DataFrame, *, order: str = "query_pos") -> DataFrame:
    """(query_pos, judgment_pos, rule, message) of every broken rule; the least row is the first failure in file order.

    ``chunks`` needs ``chunk_pos``: where ids repeat, the last chunk counts.
    """
    q = F.col("query_id")
    path = lambda c: F.concat(F.lit("('"), F.array_join(c, "', '"), F.when(F.size(c) == 1, "',)").otherwise("')"))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    seen = golden.select(F.col(order).alias("query_pos"), "query_id", "query", "relevant_chunks", F.row_number().over(W.partitionBy("query_id").orderBy(order)).alias("nth"))
    rule = lambda n, message: F.struct(F.lit(n).alias("rule"), message.alias("message"))
    whole = F.when(F.trim(q) == "", rule(1, F.lit("query_id must not be empty"))).when(F.trim("query") == "", rule(2, F.concat(q, F.lit(": query must not be empty")))).when(F.col("nth") > 1, rule(3, F.concat(F.lit("Duplicate query_id: "), q)))
    of_query = seen.select("query_pos", F.lit(-1).alias("judgment_pos"), whole.alias("v")).filter("v is not null")
    judged = seen.select("query_pos", "query_id", F.posexplode("relevant_chunks").alias("judgment_pos", "j")).select("query_pos", "query_id", "judgment_pos", "j.*")
    judged = judged.withColumn("nth", F.row_number().over(W.partitionBy("query_pos", "chunk_id").orderBy("judgment_pos")))
    last = chunks.groupBy("chunk_id").agg(F.max_by(F.struct(F.col("relative_path").alias("p"), F.col("section_path").alias("s")), "chunk_pos").alias("actual"))
    held = judged.join(last, "chunk_id", "left")
    mismatch = lambda what, c, real: F.concat(q, F.lit(f": {what} mismatch for chunk "), F.col("chunk_id"), F.lit(". Expected "), real, F.lit(", got "), c)
    broken = (
        F.when(~F.col("relevance").isin(1, 2), rule(4, F.concat(q, F.lit(": relevance must be 1 or 2, got "), F.col("relevance").cast("string"))))
        .when(F.trim("chunk_id") == "", rule(5, F.concat(q, F.lit(": chunk_id must not be empty"))))
        .when(F.col("nth") > 1, rule(6, F.concat(q, F.lit(": duplicate chunk_id "), F.col("chunk_id"))))
        .when(F.col("actual").isNull(), rule(7, F.concat(q, F.lit(": unknown chunk_id "), F.col("chunk_id"))))
        .when(F.col("relative_path") != F.col("actual.p"), rule(8, mismatch("relative_path", quoted(F.col("relative_path")), quoted(F.col("actual.p")))))
        .when(F.col("section_path") != F.col("actual.s"), rule(9, mismatch("section_path", path(F.col("section_path")), path(F.col("actual.s")))))
    )
    of_chunk = held.select("query_pos", "judgment_pos", broken.alias("v")).filter("v is not null")
    return of_query.union(of_chunk).select("query_pos", "judgment_pos", "v.*")


def golden_counts(golden: DataFrame) -> DataFrame:
    """One row: queries, answerable, without an answer, judgments."""
    n = F.size("relevant_chunks")
    return golden.agg(F.count("*").alias("query_count"), F.count_if(n > 0).alias("answerable_count"), F.count_if(n == 0).alias("no_answer_count"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("judgment_count"))


def validate_golden(golden: DataFrame, chunks: DataFrame, *, order: str = "query_pos") -> DataFrame:
    """Counts of a valid golden set; otherwise the first failure as ValueError."""
    first = golden_violations(golden, chunks, order=order).orderBy("query_pos", "judgment_pos", "rule").limit(1).collect()
    if first:
        raise ValueError(first[0]["message"])
    return golden_counts(golden)


def query_metrics(golden: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
    """(query_id, first_relevant_rank, hit_rate_at_k, recall_at_k, reciprocal_rank, ndcg_at_k) of each answerable query.

    ``hits``: (query_id, chunk_id, rank). Queries without hits score zero. Any judged chunk counts for hit, recall
    and reciprocal rank, whatever its grade; nDCG takes gains 2^grade - 1 and discounts log2(rank + 1).
    """
    check_top_k(top_k)
    judged = judgments(golden).select("query_id", "chunk_id", "relevance")
    found = hits.join(judged, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", "relevance")
    gain = lambda r: F.pow(F.lit(2.0), r) - 1
    near = F.col("rank") <= top_k
    of_hits = found.groupBy("query_id").agg(
        F.min("rank").alias("first"), F.count_distinct(F.when(near, F.col("chunk_id"))).alias("n_found"),
        F.sum(F.when(near, gain(F.col("relevance")) / F.log2(F.col("rank") + F.lit(1.0)))).alias("dcg"),
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id"))
    ideal = judged.withColumn("place", place).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("place") <= top_k, gain(F.col("relevance")) / F.log2(F.col("place") + F.lit(1.0)))).alias("ideal"))
    both = ideal.join(of_hits, "query_id", "left")
    none = F.lit(0.0)
    return both.select(
        "query_id", F.col("first").cast("int").alias("first_relevant_rank"), F.when(F.coalesce("n_found", F.lit(0)) > 0, 1.0).otherwise(none).alias("hit_rate_at_k"),
        F.coalesce(F.col("n_found") / F.col("n"), none).alias("recall_at_k"), F.coalesce(F.lit(1.0) / F.col("first"), none).alias("reciprocal_rank"),
        F.when(F.coalesce("ideal", none) > 0, F.coalesce(F.col("dcg") / F.col("ideal"), none)).otherwise(none).alias("ndcg_at_k"),
    )


def macro_averages(golden: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: counts and means over answerable queries, 0.0 without any."""
    means = metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("hit_rate_at_k", "hit_rate_at_k"), ("recall_at_k", "recall_at_k"), ("reciprocal_rank", "mrr"), ("ndcg_at_k", "ndcg_at_k"))])
    counts = golden_counts(golden).select("query_count", F.col("answerable_count").alias("evaluated_query_count"), "no_answer_count")
    return counts.crossJoin(means)  # one row with one row


def evaluate_queries(golden: DataFrame, hits: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """The nested evaluation of each answerable query. ``hits``: (query_id, pos, chunk_id, score, rank)."""
    grades = judgments(golden).select("query_id", "chunk_id", "relevance")
    told = named(hits, chunks.select(F.col("chunk_pos").alias("pos"), "relative_path", "section_path", "content"), "pos").join(grades, ["query_id", "chunk_id"], "left")
    fields = F.struct("rank", "chunk_id", "score", F.coalesce("relevance", F.lit(0)).alias("relevance"), "relative_path", "section_path", "content")
    lists = told.groupBy("query_id").agg(F.sort_array(F.collect_list(fields)).alias("found"))  # top_k rows
    shaped = F.transform("found", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["rank"].cast("int").alias("rank"), x["score"].alias("score"), x["relevance"].alias("relevance"), x["relative_path"].alias("relative_path"), x["section_path"].alias("section_path"), x["content"].alias("content")))
    asked = golden.filter(F.size("relevant_chunks") > 0).select("query_id", "query", F.transform("relevant_chunks", lambda j: j["chunk_id"]).alias("relevant_chunk_ids"))
    out = asked.join(query_metrics(golden, hits, top_k), "query_id").join(lists.select("query_id", shaped.alias("retrieved_chunks")), "query_id", "left")
    kind = lists.select(shaped.alias("x")).schema["x"].dataType.simpleString()
    return out.select("query_id", "query", "relevant_chunk_ids", F.coalesce("retrieved_chunks", F.array().cast(kind)).alias("retrieved_chunks"), "first_relevant_rank", "hit_rate_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")


def misses(results: DataFrame) -> DataFrame:
    return results.filter(F.col("first_relevant_rank").isNull())


CATEGORIES = ("dense_only_hits", "lexical_only_hits", "both_hit", "both_miss")


def compare(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """(query_id, query, category, lexical_result, dense_result); both sides must answer the same queries.

    A query id that repeats in a file counts once, its last row (``pos``, where given, which is then the order).
    """

    def side(results: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[c for c in results.columns if c != "pos"])
        if "pos" not in results.columns:
            return results.groupBy("query_id").agg(F.any_value(row).alias(name), F.lit(0).alias(f"{name}_pos"))
        return results.groupBy("query_id").agg(F.max_by(row, "pos").alias(name), F.min("pos").alias(f"{name}_pos"))

    both = side(lexical, "lexical_result").join(side(dense, "dense_result"), "query_id", "full")
    bad = both.agg(F.count_if(F.col("lexical_result").isNull() | F.col("dense_result").isNull()).alias("ids"), F.min(F.when(F.col("lexical_result.query") != F.col("dense_result.query"), F.col("query_id"))).alias("text")).first()
    if bad["ids"]:
        raise ValueError("Lexical and dense results must contain the same query IDs")
    if bad["text"] is not None:
        raise ValueError(f"Lexical and dense results must contain the same query text for query ID {bad['text']}")
    return both.select("query_id", F.col("lexical_result.query").alias("query"), category(F.col("lexical_result.first_relevant_rank"), F.col("dense_result.first_relevant_rank")).alias("category"), "lexical_result", "dense_result", F.col("lexical_result_pos").alias("pos"))


def category(lexical_rank, dense_rank):
    """Which side found a judged chunk."""
    return F.when(lexical_rank.isNull() & dense_rank.isNotNull(), CATEGORIES[0]).when(lexical_rank.isNotNull() & dense_rank.isNull(), CATEGORIES[1]).when(lexical_rank.isNotNull(), CATEGORIES[2]).otherwise(CATEGORIES[3])


def category_counts(compared: DataFrame) -> DataFrame:
    """(``category``, ``n``) of all categories, also of those that don't occur."""
    every = compared.sparkSession.createDataFrame(pa.table({"category": list(CATEGORIES)}))
    found = compared.groupBy("category").agg(F.count("*").alias("n"))
    return every.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
