"""The registered queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import dense, evaluation, lexical, markdown, statistics
from ..sources import dense_store, files, jsonl
from ..sources.scratch import bound_batches, materialise, scratch
from . import pipelines, report

TOP_K = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark, sf_dir):
    """Documents as chunks: one each, in order of id."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_pos"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("relative_path"), F.array("lang").alias("section_path"), F.col("text").alias("content"), F.col("text").alias("searchable_text"), F.col("source").alias("document_id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))


def _benchmark(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("item_id").alias("query_pos"), F.col("text").alias("query"))


def _golden(spark, sf_dir):
    """A benchmark item is answered by the documents that quote it: found through shared words, then by the text itself.

    An inner word of the item leads to candidates, since a text that quotes the item holds it whole.  Up to
    ``BROADCAST_TERMS`` items go to the texts, which are looked through where they are read; of more of them pairs of ids
    are made before the texts join again.  Items without an inner word, which are few and short, are looked for in
    every text.  Written at once: judgments are few, and read several times.
    """
    items = _benchmark(spark, sf_dir).filter(F.trim("query") != "")
    docs = _corpus(spark, sf_dir).select("chunk_pos", "chunk_id", "relative_path", "section_path", "content")
    tokens = text.tokenize(F.col("query"))
    inner = items.select("query_id", "query", F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))).alias("words"))
    longest = F.element_at(F.array_sort(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    led = inner.filter(F.size("words") > 0).select("query_id", "query", longest.alias("term"))
    term = F.explode(F.array_distinct(text.tokenize(F.col("content")))).alias("term")
    if items.count() <= lexical.BROADCAST_TERMS:
        quoted = docs.select("*", term).join(F.broadcast(led), "term").drop("term").filter(F.contains("content", "query"))
    else:
        found = docs.select("chunk_pos", term).join(led, "term").select("chunk_pos", "query_id", "query")
        quoted = docs.join(found, "chunk_pos").filter(F.contains("content", "query"))
    anywhere = docs.join(inner.filter(F.size("words") == 0).select("query_id", "query"), F.contains("content", "query"))
    grade = F.when(F.length("content") % 2 == 0, 2).otherwise(1)
    lists = quoted.select("query_id", *docs.columns).unionByName(anywhere.select("query_id", *docs.columns)).groupBy("query_id")
    lists = lists.agg(F.array_sort(F.collect_list(F.struct("chunk_id", "relative_path", "section_path", grade.alias("relevance")))).alias("relevant_chunks"))
    none = F.array().cast(lists.schema["relevant_chunks"].dataType)
    golden = items.join(lists, "query_id", "left").select("query_id", "query_pos", "query", F.coalesce("relevant_chunks", none).alias("relevant_chunks"), F.lit("").alias("notes"))
    return materialise(golden, "golden")


def _lexical_hits(spark, sf_dir, top_k=TOP_K):
    """Written at once: few rows, which every step behind would search for again."""
    index = lexical.BM25Index.build(_corpus(spark, sf_dir))
    hits = materialise(index.search(_benchmark(spark, sf_dir), top_k), "lexical-hits")
    index.close()
    return hits


def bm25_topk(spark, sf_dir):
    hits = _lexical_hits(spark, sf_dir)
    return hits.select(F.col("query_id").cast("long").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("pos").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_bounded(spark, sf_dir):
    """``bm25_topk`` by blocks of postings, of which those that can't reach the best five are skipped."""
    index = lexical.BM25Index.build(_corpus(spark, sf_dir))
    hits, _ = index.search_bounded(_benchmark(spark, sf_dir), TOP_K)
    return hits.select(F.col("query_id").cast("long").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("pos").alias("doc_id"), F.round("score", 6).alias("score"))


def _tokens(spark, sf_dir):
    return lexical.tokenized(_table(spark, sf_dir, "documents"), "doc_id", "text")


def postings(spark, sf_dir):
    return lexical.postings(_tokens(spark, sf_dir)).select(F.col("pos").alias("doc_id"), "term", "tf")


def term_df_idf(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return lexical.document_frequencies(tokens).crossJoin(F.broadcast(lexical.corpus_size(tokens))).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 9).alias("idf"))


def doc_lengths(spark, sf_dir):
    return _tokens(spark, sf_dir).select(F.col("pos").alias("doc_id"), F.col("dl").cast("long").alias("dl"))


def corpus_size(spark, sf_dir):
    return lexical.corpus_size(_tokens(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _unit_vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_pos"), F.col("vec_id").cast("string").alias("chunk_id"), dense.l2_normalize(F.col("embedding")).alias("embedding"))


def dense_topk(spark, sf_dir):
    """Vectors whose id is divisible by 100 ask all vectors."""
    vectors = _unit_vectors(spark, sf_dir)
    asked = vectors.filter(F.col("chunk_pos") % 100 == 0).select(F.col("chunk_pos").alias("query_id"), "embedding")
    return dense.cosine_top_k(asked, vectors, TOP_K).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_pos").alias("vec_id"), F.round("score", 6).alias("score"))


def l2_normalize(spark, sf_dir):
    return _unit_vectors(spark, sf_dir).select(F.col("chunk_pos").alias("vec_id"), F.posexplode("embedding").alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), F.round(F.col("x").cast("double"), 5).alias("x"))


def golden_validate(spark, sf_dir):
    return evaluation.golden_counts(_golden(spark, sf_dir))


def golden_violations(spark, sf_dir):
    """The golden set with planted faults: an unknown chunk for items divisible by 3, a bad grade for the rest divisible by 5,
    else a repeated judgment for those divisible by 7; and each item divisible by 11 a second time, without judgments.
    """
    golden, at = _golden(spark, sf_dir), F.col("query_pos")
    judged = F.transform("relevant_chunks", lambda j: j.withField("chunk_id", F.when(at % 3 == 0, F.concat(F.lit("x"), j["chunk_id"])).otherwise(j["chunk_id"])).withField("relevance", F.when((at % 5 == 0) & (at % 3 != 0), 7).otherwise(j["relevance"])))
    judged = F.when((at % 7 == 0) & (at % 3 != 0) & (at % 5 != 0), F.concat(judged, judged)).otherwise(judged)
    again = golden.filter(at % 11 == 0).select("query_id", (at + 1_000_000).alias("query_pos"), "query", F.slice("relevant_chunks", 1, 0).alias("relevant_chunks"), "notes")
    bad = evaluation.golden_violations(golden.withColumn("relevant_chunks", judged).union(again), _corpus(spark, sf_dir))
    return bad.select("query_pos", F.col("judgment_pos").cast("long").alias("judgment_pos"), F.col("rule").cast("long").alias("rule"), "message")


def _metrics(spark, sf_dir):
    golden = _golden(spark, sf_dir)
    return golden, evaluation.query_metrics(golden, _lexical_hits(spark, sf_dir), TOP_K)


def eval_per_query(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("hit_rate_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")]
    return _metrics(spark, sf_dir)[1].select("query_id", F.col("first_relevant_rank").cast("long").alias("first_relevant_rank"), *rounded)


def eval_macro(spark, sf_dir):
    row = evaluation.macro_averages(*_metrics(spark, sf_dir))
    return row.select("query_count", "evaluated_query_count", "no_answer_count", *[F.round(c, 6).alias(c) for c in ("hit_rate_at_k", "recall_at_k", "mrr", "ndcg_at_k")])


#: The model of the dense side: signed hashes of words, so that SQL can say it too.
HASHING = dense.EmbeddingModelConfig("hashing", "hashing-64", 64, "query: ", "passage: ")


def _model() -> dense.EmbeddingModel:
    return dense.create_model(HASHING)


def _dense_hits(spark, sf_dir):
    """The dense index over the corpus: built, written, read back, checked and asked every benchmark item."""
    chunks = _corpus(spark, sf_dir).withColumn("searchable_text", F.coalesce("searchable_text", F.lit("")))
    vectors, metadata = dense.build_dense(chunks.select("chunk_pos", "chunk_id", "searchable_text"), _model, files.table_sha256(chunks.select("chunk_pos", "chunk_id")))
    path = scratch(spark, "vectors")
    dense_store.write_embeddings(vectors, path)
    metadata = dense_store.decode_metadata(json.loads(json.dumps(metadata.to_dict())))
    index = dense.DenseIndex(chunks, dense_store.read_embeddings(spark, path, metadata), metadata, _model)
    return index.search(_benchmark(spark, sf_dir).filter(F.trim("query") != ""), TOP_K)


def dense_index(spark, sf_dir):
    hits = _dense_hits(spark, sf_dir)
    return hits.select(F.col("query_id").cast("long").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("pos").alias("doc_id"), F.round("score", 5).alias("score"))


def eval_misses(spark, sf_dir):
    """Benchmark items for which the dense side finds no judged document."""
    return evaluation.misses(evaluation.query_metrics(_golden(spark, sf_dir), _dense_hits(spark, sf_dir), TOP_K)).select("query_id")


def _compared(spark, sf_dir):
    """BM25 against the dense index, five hits each."""
    golden, found = _metrics(spark, sf_dir)
    other = evaluation.query_metrics(golden, _dense_hits(spark, sf_dir), TOP_K)
    wide = lambda df: df.join(golden.select("query_id", "query"), "query_id").select("query_id", "query", "first_relevant_rank")
    return evaluation.compare(wide(found), wide(other))


def compare_categories(spark, sf_dir):
    return _compared(spark, sf_dir).select("query_id", "category")


def compare_counts(spark, sf_dir):
    return evaluation.category_counts(_compared(spark, sf_dir))


def _through_jsonl(df, order, read):
    """What a JSONL sink and the strict source behind it make of ``df``."""
    path = scratch(df.sparkSession, "jsonl")
    jsonl.write_table(df, path, order)
    return read(df.sparkSession, path)


def golden_jsonl(spark, sf_dir):
    """Judgments of the golden set after a round trip through JSONL."""
    golden = _through_jsonl(_golden(spark, sf_dir).select("query_id", "query", "relevant_chunks", "notes"), ["query_id"], jsonl.read_golden)
    judged = golden.select("query_id", F.md5(F.col("query").cast("binary")).alias("query_md5"), F.explode_outer("relevant_chunks").alias("j"))
    return judged.select("query_id", "query_md5", F.col("j.chunk_id").alias("chunk_id"), F.col("j.relative_path").alias("relative_path"), F.array_join("j.section_path", ">").alias("section"), F.col("j.relevance").cast("long").alias("relevance"))


def evaluation_jsonl(spark, sf_dir):
    """Nested evaluations after a round trip through JSONL: one row for each retrieved chunk."""
    golden, chunks = _golden(spark, sf_dir), _corpus(spark, sf_dir)
    results = evaluation.evaluate_queries(golden, _lexical_hits(spark, sf_dir), chunks, TOP_K)
    back = _through_jsonl(results, ["query_id"], jsonl.read_evaluation)
    rows = back.select("query_id", F.size("relevant_chunk_ids").cast("long").alias("judged"), F.round("recall_at_k", 6).alias("recall"), F.explode("retrieved_chunks").alias("c"))
    return rows.select("query_id", "judged", "recall", F.col("c.rank").cast("long").alias("rank"), F.col("c.chunk_id").alias("chunk_id"), F.round("c.score", 6).alias("score"), F.col("c.relevance").cast("long").alias("relevance"), F.md5(F.col("c.content").cast("binary")).alias("content_md5"))


def _both_sides(spark, sf_dir):
    """Whole evaluations of BM25 and of the dense index, compared."""
    golden, chunks = _golden(spark, sf_dir), _corpus(spark, sf_dir)
    lexical_side = evaluation.evaluate_queries(golden, _lexical_hits(spark, sf_dir), chunks, TOP_K)
    dense_side = evaluation.evaluate_queries(golden, _dense_hits(spark, sf_dir), chunks, TOP_K)
    with_pos = lambda df: df.join(golden.select("query_id", F.col("query_pos").alias("pos")), "query_id")
    return golden, evaluation.compare(*(materialise(with_pos(x), "side") for x in (lexical_side, dense_side)))


def report_counts(spark, sf_dir):
    """What the error report of BM25 against the dense index says in its summary, and how often its parts show a result."""
    golden, compared = _both_sides(spark, sf_dir)
    titles = F.create_map(*[F.lit(x) for title, key in report.SUMMARY for x in (key, title)])
    summary = evaluation.category_counts(compared).select(titles[F.col("category")].alias("fact"), "n")
    asked = evaluation.golden_counts(golden).select(F.lit("queries").alias("fact"), F.col("query_count").alias("n"))
    lines = report.query_parts(compared, TOP_K, 100).select(F.explode("lines").alias("line"))
    shown = lines.agg(F.lit("shown").alias("fact"), F.count_if(F.col("line").startswith("   - **Relevance:**")).alias("n"))
    return summary.union(asked).union(shown)


def report_text(spark, sf_dir):
    """The report's part of every query that a side missed: its lines and their digest."""
    parts = report.query_parts(_both_sides(spark, sf_dir)[1], TOP_K, 100)
    whole = parts.withColumn("text", F.array_join("lines", "\n"))
    return whole.select("query_id", "category", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.md5(F.col("text").cast("binary")).alias("md5"))


def _talks(spark, sf_dir):
    """Conversations as Markdown: a heading for each, one below for each turn."""
    return _as_documents(_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("part")))


def _as_documents(rows):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"])
    body = rows.groupBy("conv_id").agg(F.concat(F.lit("# talk "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(parts, "")).alias("content"))
    path = F.concat(F.lit("talks/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return body.select(ids.document_id(F.lit("talks"), path).alias("document_id"), F.lit("talks").alias("source_name"), path.alias("relative_path"), "content", ids.content_hash(F.col("content")).alias("content_hash"))


def documents_hashed(spark, sf_dir):
    return _talks(spark, sf_dir).select("document_id", "relative_path", "content_hash")


def _section_rows(made):
    long = lambda c: F.col(c).cast("long").alias(c)
    return made.select("document_id", long("section_ordinal"), F.array_join("section_path", " > ").alias("path"), "content", long("start_line"), F.coalesce("content_start_line", F.lit(0)).cast("long").alias("content_start_line"), long("end_line"))


def sections(spark, sf_dir):
    return _section_rows(markdown.sections(_talks(spark, sf_dir)))


def _talk_chunks(spark, sf_dir):
    talks = _talks(spark, sf_dir)
    return markdown.chunks(talks, markdown.sections(talks), markdown.ChunkerConfig(2, 400, 0))


def _chunk_rows(made, *more):
    return made.select("chunk_id", "relative_path", "title", "searchable_text", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "section_chunk_index", "start_line", "end_line")], "content_hash", *more)


def chunk_ids(spark, sf_dir):
    """Chunks of the talks, of at most 2 lines and 400 characters, without overlap."""
    return _chunk_rows(_talk_chunks(spark, sf_dir))


def chunk_jsonl(spark, sf_dir):
    """The same chunks after a round trip through JSONL, numbered in order of path and index."""
    back = _through_jsonl(_talk_chunks(spark, sf_dir), ["relative_path", "chunk_index"], jsonl.read_chunks)
    # ids repeat where a talk says the same under the same heading twice, so nothing is joined by them
    before = F.lag("chunk_pos").over(W.partitionBy("relative_path").orderBy("chunk_index"))
    return _chunk_rows(back.withColumn("ordered", F.coalesce(before < F.col("chunk_pos"), F.lit(True))), F.array_join("section_path", " > ").alias("path"), "ordered")


def chunk_pack(spark, sf_dir):
    """Documents as one section each, 40 lines, 3000 characters, 5 lines of overlap."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_key"), F.coalesce("text", F.lit("")).alias("content"), F.lit(1).alias("content_start_line"))
    made = markdown.chunk_spans(docs.filter(~text.is_blank(F.col("content"))))
    return made.select(F.col("section_key").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("content").cast("binary")).alias("md5"))


def chunk_stats(spark, sf_dir):
    row = statistics.summary(_corpus(spark, sf_dir))
    means = {c: F.round(c, 6) for c in ("average_chars", "average_lines")}
    return row.withColumns(means | {c: F.col(c).cast("long") for c in row.columns if c not in means})


def largest_chunks(spark, sf_dir):
    return statistics.largest(_corpus(spark, sf_dir), 10).select(F.col("chunk_pos").alias("doc_id"), F.col("char_count").cast("long").alias("char_count"), F.col("line_count").cast("long").alias("line_count"))


def smallest_chunks(spark, sf_dir):
    return statistics.smallest(_corpus(spark, sf_dir), 10).select(F.col("chunk_pos").alias("doc_id"), F.col("char_count").cast("long").alias("char_count"), F.col("line_count").cast("long").alias("line_count"))


def fence_detect(spark, sf_dir):
    """Documents with a fence put around the texts of even ids."""
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" \t```\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", text.has_fence(body).alias("fenced"), text.is_separator_only(body).alias("separator_only"), F.length(text.truncate(body, 100, "", "...")).cast("long").alias("shown"), text.code_fence(body).alias("fence"))


def embed_udf(spark, sf_dir):
    """Unit vectors of every document, one row for each component."""
    vectors = dense.embed(F.coalesce("text", F.lit("")), _model)
    made = _table(spark, sf_dir, "documents").select("doc_id", vectors.alias("raw")).select("doc_id", F.posexplode(dense.l2_normalize(F.col("raw"))).alias("at", "x"))
    return made.select("doc_id", F.col("at").cast("long").alias("at"), F.round(F.col("x").cast("double"), 5).alias("x"))


def _fenced_talks(spark, sf_dir):
    """``_talks`` with a fence around each turn of even number, in which a line looks like a heading."""
    fence = F.when(F.col("turn") % 4 == 0, "```").otherwise("~~~~")
    inside = F.concat(fence, F.lit("md\n# no heading\n"), F.coalesce("text", F.lit("")), F.lit("\n"), fence, F.lit("\n"))
    body = F.when(F.col("turn") % 2 == 0, inside).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), body).alias("part"))
    return _as_documents(rows)


def sections_fenced(spark, sf_dir):
    """Sections of talks with fences: what looks like a heading inside a fence is text."""
    return _section_rows(markdown.sections(_fenced_talks(spark, sf_dir)))


def sections_lines(spark, sf_dir):
    """The same documents as a table of lines, through the path for documents of any length."""
    talks = _fenced_talks(spark, sf_dir)
    lines = talks.select("document_id", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "line"))
    return _section_rows(markdown.line_sections(lines))


#: At most 4 lines and 300 characters, 2 lines of overlap, none with fences of more than 3 lines.
FENCED = markdown.ChunkerConfig(4, 300, 2, 3)


def chunk_fenced(spark, sf_dir):
    """Talks whose even turns stand in fences, as one section each; every fifth talk leaves its last fence open."""
    rows = _table(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(W.partitionBy("conv_id")))
    fence = F.when(F.col("turn") % 4 == 0, "```").otherwise("~~~~")
    end = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") >= F.col("last") - 1), "").otherwise(F.concat(fence, F.lit("\n")))
    # a line of the turn for each of its sentences, so that fences are short and long
    words = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))
    body = F.when(F.col("turn") % 2 == 0, F.concat(fence, F.lit("md\n"), words, F.lit("\n"), end)).otherwise(F.concat(words, F.lit("\n")))
    talks = _as_documents(rows.select("conv_id", "turn", body.alias("part"))).withColumn("conv_id", F.regexp_extract("relative_path", r"(-?\d+)\.md", 1).cast("long"))
    made = markdown.chunk_spans(talks.select(F.col("conv_id").alias("section_key"), "content", F.lit(1).alias("content_start_line")), FENCED)
    return made.select(F.col("section_key").alias("conv_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("content").cast("binary")).alias("md5"))


def jsonl_positions(spark, sf_dir):
    """Documents in order of id as lines of 12 files that grow and of 12 that shrink: the number of each one's line."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), F.array().cast("array<string>").alias("relevant_chunks"), F.lit("").alias("notes"), "doc_id")
    last, found = F.lit(docs.agg(F.max("doc_id")).first()[0]), []
    for name, at in (("rising", F.col("doc_id")), ("falling", last - F.col("doc_id"))):
        file = F.floor(12 * F.sqrt(at / last)) * (1 if name == "rising" else -1)
        path = scratch(spark, name)
        jsonl.as_json(docs.withColumn("file", file).repartitionByRange(12, "file").sortWithinPartitions("file", "doc_id").drop("file", "doc_id")).write.text(path)
        found.append(jsonl.read_golden(spark, path).select(F.lit(name).alias("files"), F.col("query_id").cast("long").alias("doc_id"), F.col("query_pos").alias("line"), F.md5(F.col("query").cast("binary")).alias("md5")))
    return found[0].union(found[1])


def compare_sinks(spark, sf_dir):
    """The comparison after one write into a folder for each category, read back with the places of its lines."""
    compared = _compared(spark, sf_dir).withColumn("pos", F.col("query_id").cast("long"))
    path = scratch(spark, "compared")
    pipelines.write_compared(compared, path)
    lines = jsonl.read_categories(spark, path).withColumn("query_id", F.get_json_object("line", "$.query_id").cast("long"))
    rank = lambda side: F.coalesce(F.get_json_object("line", f"$.{side}_result.first_relevant_rank").cast("long"), F.lit(0)).alias(side)
    place = F.row_number().over(W.partitionBy("category").orderBy("number"))
    return lines.select("category", place.cast("long").alias("place"), "query_id", rank("lexical"), rank("dense"))


def scan_tree(spark, sf_dir):
    """Talks written as files, some below hidden folders, beside files that are out of scope; scanned again."""
    talks = _as_documents(_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), F.col("role"), F.lit("\r\n\n"), F.coalesce("text", F.lit("")), F.lit("\r")).alias("part")))
    name = F.regexp_extract("relative_path", r"(-?\d+)\.md", 1)
    at = F.when(name.cast("long") % 3 == 0, F.concat(F.lit("_deep/.hidden/"), name, F.lit(".MD"))).otherwise(F.concat(F.lit("talks/"), name, F.lit(".md")))
    decoys = F.array(at, *[F.concat(F.lit(a), name, F.lit(b)) for a, b in (("talks/node_modules/", ".md"), ("talks/x_plan", ".md"), ("talks/", ".txt"))])
    root = scratch(spark, "tree").removeprefix("file://")
    files.write_tree(talks.select(F.explode(F.when(name.cast("long") % 5 == 0, decoys).otherwise(F.array(at))).alias("relative_path"), "content"), root)
    return files.scan_documents(spark, root, "talks").select("document_id", "relative_path", "content_hash")


def index_counts(spark, sf_dir):
    """What indexing the talks counts while it writes their chunks: documents, sections and chunks of one pass."""
    seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("documents", "sections", "chunks")}
    talks = _talks(spark, sf_dir).observe(seen["documents"], F.count(F.lit(1)).alias("n"))
    chunks = markdown.chunk_documents(talks, markdown.ChunkerConfig(2, 400, 0), lambda made: made.observe(seen["sections"], F.count(F.lit(1)).alias("n")))
    chunks.observe(seen["chunks"], F.count(F.lit(1)).alias("n")).write.parquet(scratch(spark, "chunks"))
    return spark.createDataFrame(pa.table({"what": list(seen), "n": [x.get["n"] for x in seen.values()]}))


def matrix_file(spark, sf_dir):
    """Unit vectors written to one matrix file by byte ranges and mapped again: the components that differ, and sums of some."""
    vectors = _unit_vectors(spark, sf_dir).select("chunk_pos", "chunk_id", "embedding")
    path = scratch(spark, "matrix").removeprefix("file://") + ".npy"
    dense_store.export_npy(vectors, path)
    ids_ = vectors.select((F.row_number().over(W.orderBy("chunk_pos")) - 1).cast("long").alias("chunk_pos"), "chunk_id")
    back = dense_store.import_npy(spark, path, ids_, len(vectors.first()["embedding"]))
    return back.select(F.col("chunk_id").cast("long").alias("vec_id"), F.posexplode("embedding").alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), F.round(F.col("x").cast("double"), 5).alias("x"))


def dense_topk_grid(spark, sf_dir):
    """``dense_topk`` with blocks of a few queries, so that queries and vectors meet on a grid."""
    vectors = _unit_vectors(spark, sf_dir)
    asked = vectors.filter(F.col("chunk_pos") % 100 == 0).select(F.col("chunk_pos").alias("query_id"), "embedding")
    found = dense.cosine_top_k(asked, vectors, TOP_K, query_bytes=1 << 11)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_pos").alias("vec_id"), F.round("score", 6).alias("score"))


_TOKENS = r"regexp_extract_all(replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'), '[\p{L}\p{N}]+(?:[_-][\p{L}\p{N}]+)*')"
_DOC_TOKENS = f"toks AS (SELECT doc_id, coalesce({_TOKENS}, []) AS t FROM documents)"
_HITS = f"""{_DOC_TOKENS}, size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
asked AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark),
tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, CAST(doc_id AS VARCHAR), doc_id) AS rank FROM scores QUALIFY rank <= 5)"""
_GOLD = """gold AS (SELECT item_id, doc_id, CASE WHEN length(d.text) % 2 = 0 THEN 2 ELSE 1 END AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE trim(b.text) <> '')"""
_METRICS = f"""{_HITS}, {_GOLD},
found AS (SELECT g.item_id, min(rank) AS first, count(*) AS n, sum((pow(2.0::DOUBLE, rel) - 1) / log2(rank + 1)) AS dcg FROM gold g JOIN hits h ON g.item_id = h.item_id AND g.doc_id = h.doc_id GROUP BY 1),
ideal AS (SELECT item_id, count(*) AS n, sum(CASE WHEN place <= 5 THEN (pow(2.0::DOUBLE, rel) - 1) / log2(place + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rel DESC) AS place FROM gold) GROUP BY 1),
metrics AS (SELECT CAST(i.item_id AS VARCHAR) AS query_id, first AS first_relevant_rank, CASE WHEN f.n > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_at_k, coalesce(f.n::DOUBLE / i.n, 0) AS recall_at_k,
    coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank, coalesce(dcg / ideal, 0) AS ndcg_at_k FROM ideal i LEFT JOIN found f USING (item_id))"""
_WORDS = "list_filter(regexp_split_to_array(lower({prefix} || coalesce({text}, '')), '\\s+'), lambda w: w <> '')"
_EMBED = """{name}_parts AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN ('0x' || substr(md5(w), 10, 1))::BIGINT & 1 = 1 THEN 1.0::DOUBLE ELSE -1 END) AS x
    FROM (SELECT {id} AS id, unnest({words}) AS w FROM {table}) GROUP BY ALL),
{name}_raw AS (SELECT id, dim, coalesce(x, 0) AS x FROM (SELECT {id} AS id, unnest(range(64)) AS dim FROM {table}) LEFT JOIN {name}_parts USING (id, dim)),
{name}_norm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM {name}_raw GROUP BY id),
{name} AS (SELECT id, dim, CASE WHEN norm = 0 THEN CASE WHEN dim = 0 THEN 1.0 ELSE 0 END ELSE x / norm END::FLOAT::DOUBLE AS x FROM {name}_raw JOIN {name}_norm USING (id))"""
_VECTORS = _EMBED.format(name="vectors", id="doc_id", table="documents", words=_WORDS.format(prefix="'passage: '", text="text"))
_QUESTIONS = _EMBED.format(name="questions", id="item_id", table="(SELECT * FROM benchmark WHERE trim(text) <> '')", words=_WORDS.format(prefix="'query: '", text="text"))
_DENSE_HITS = f"""{_VECTORS}, {_QUESTIONS},
dense_scores AS (SELECT q.id AS item_id, v.id AS doc_id, sum(q.x * v.x) AS score FROM questions q JOIN vectors v USING (dim) GROUP BY ALL),
dense_hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM dense_scores QUALIFY rank <= 5)"""
_TALKS = """talks AS (SELECT conv_id, 'talks/' || conv_id || '.md' AS relative_path, '# talk ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id),
docs AS (SELECT *, sha256('talks' || chr(31) || relative_path) AS document_id FROM talks)"""
_LINES = """raw AS (SELECT document_id, relative_path, string_split(content, chr(10)) AS all_lines FROM docs),
lines AS (SELECT document_id, relative_path, unnest(all_lines) AS line, unnest(range(1, len(all_lines) + 1)) AS no, len(all_lines) AS total FROM raw),
kept AS (SELECT * FROM lines WHERE NOT (no = total AND line = '')),
headed AS (SELECT *, regexp_matches(line, '^#{1,6}[ \\t]+') AS h, length(regexp_extract(line, '^(#{1,6})[ \\t]', 1)) AS level, trim(regexp_extract(line, '^#{1,6}[ \\t]+(.*?)[ \\t]*#*[ \\t]*$', 1)) AS title FROM kept),
numbered AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY document_id ORDER BY no) AS section_ordinal,
    max(CASE WHEN h AND level = 1 THEN title END) OVER (PARTITION BY document_id) AS top FROM headed),
parts AS (SELECT document_id, relative_path, section_ordinal, min(no) AS start_line, max(CASE WHEN h THEN CASE WHEN level = 1 THEN title ELSE top || ' > ' || title END END) AS path, max(CASE WHEN h THEN title END) AS title,
    min(CASE WHEN NOT h AND trim(line) <> '' THEN no END) AS a, max(CASE WHEN NOT h AND trim(line) <> '' THEN no END) AS b FROM numbered GROUP BY 1, 2, 3),
secs AS (SELECT p.*, coalesce((SELECT string_agg(line, chr(10) ORDER BY no) FROM numbered n WHERE n.document_id = p.document_id AND n.section_ordinal = p.section_ordinal AND no BETWEEN a AND b), '') AS content FROM parts p)"""
_SIZES = """sizes AS (SELECT doc_id, source, length(text) AS char_count, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS line_count,
    regexp_matches(text, '(?m)^[ \\t]*(```|~~~)') AS fence FROM documents)"""


_FENCED = """talks AS (SELECT conv_id, 'talks/' || conv_id || '.md' AS relative_path, '# talk ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || CASE WHEN turn % 2 = 0
    THEN f || 'md' || chr(10) || '# no heading' || chr(10) || coalesce(text, '') || chr(10) || f || chr(10) ELSE coalesce(text, '') || chr(10) END, '' ORDER BY turn) AS content
    FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN '```' ELSE '~~~~' END AS f FROM conversations) GROUP BY conv_id),
docs AS (SELECT *, sha256('talks' || chr(31) || relative_path) AS document_id FROM talks)"""
# every planted fence opens or closes one: a line stands inside after an odd number of them
_FENCED_LINES = _LINES.replace("headed AS (SELECT *, regexp_matches(line, '^#{1,6}[ \\t]+') AS h", "marked AS (SELECT *, sum(CASE WHEN line IN ('```', '```md', '~~~~', '~~~~md') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY no) % 2 = 1 AS inside FROM kept),\nheaded AS (SELECT *, NOT inside AND regexp_matches(line, '^#{1,6}[ \\t]+') AS h").replace("AS title FROM kept)", "AS title FROM marked)")


def _spans(source: str, max_lines: int, max_chars: int, overlap: int) -> str:
    """SQL of greedy packing without fences over ``source`` (k, no from 0, line)."""
    return f"""base AS ({source}),
sums AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY k ORDER BY no) AS s, count(*) OVER (PARTITION BY k) AS total FROM base),
ends AS (SELECT a.k, a.no, a.total, least(a.total, a.no + 1 + (SELECT count(*) FROM sums b WHERE b.k = a.k AND b.no > a.no AND b.no < a.no + {max_lines} AND b.s - (a.s - length(a.line) - 1) - 1 <= {max_chars})) AS e FROM sums a),
spans AS (WITH RECURSIVE walk(k, a, e, total, ordinal) AS (SELECT k, no, e, total, 0 FROM ends WHERE no = 0
    UNION ALL SELECT n.k, n.no, n.e, n.total, w.ordinal + 1 FROM walk w JOIN ends n ON n.k = w.k AND n.no = CASE WHEN w.e - {overlap} > w.a THEN w.e - {overlap} ELSE w.e END WHERE w.e < w.total) SELECT * FROM walk),
trimmed AS (SELECT s.k, s.ordinal, min(no) AS a, max(no) AS b FROM spans s JOIN base l ON l.k = s.k AND l.no >= s.a AND l.no < s.e AND trim(l.line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2)"""


_FENCED_TALKS = """parts AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '```' ELSE '~~~~' END AS f, replace(coalesce(text, ''), '. ', '.' || chr(10)) AS w, conv_id % 5 = 0 AND turn >= max(turn) OVER (PARTITION BY conv_id) - 1 AS open FROM conversations),
talks AS (SELECT conv_id, '# talk ' || conv_id || chr(10) || string_agg(CASE WHEN turn % 2 = 0 THEN f || 'md' || chr(10) || w || chr(10) || CASE WHEN open THEN '' ELSE f || chr(10) END ELSE w || chr(10) END, '' ORDER BY turn) AS content FROM parts GROUP BY conv_id),
all_lines AS (SELECT conv_id AS k, unnest(l) AS line, unnest(range(len(l))) AS no, len(l) AS c FROM (SELECT conv_id, string_split(content, chr(10)) AS l FROM talks)),
base AS (SELECT k, no, line FROM all_lines WHERE no < c - 1),
marks AS (SELECT k, no, row_number() OVER (PARTITION BY k ORDER BY no) AS r, lead(no) OVER (PARTITION BY k ORDER BY no) AS close FROM base WHERE regexp_matches(line, '^(```|~~~~)(md)?$')),
fences AS (SELECT k, no AS open, close FROM marks WHERE r % 2 = 1)"""
_FENCED_SPANS = f"""WITH RECURSIVE {_FENCED_TALKS},
sums AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY k ORDER BY no) AS s, count(*) OVER (PARTITION BY k) AS total FROM base),
fits AS (SELECT a.k, a.no, a.total, least(a.total, a.no + 1 + (SELECT count(*) FROM sums b WHERE b.k = a.k AND b.no > a.no AND b.no < a.no + 4 AND b.s - (a.s - length(a.line) - 1) - 1 <= 300)) AS e FROM sums a),
ends AS (SELECT n.k, n.no, n.total, CASE WHEN f.open IS NOT NULL THEN coalesce(f.close + 1, n.total) ELSE n.e END AS e
    FROM fits n LEFT JOIN fences f ON f.k = n.k AND n.e < n.total AND f.open < n.e AND (f.close IS NULL OR n.e <= f.close)),
backs AS (SELECT n.*, CASE WHEN f.open IS NULL THEN n.e - 2 WHEN f.close - f.open + 1 <= 3 THEN f.open ELSE f.close + 1 END AS b
    FROM ends n LEFT JOIN fences f ON f.k = n.k AND f.close IS NOT NULL AND n.e - 2 BETWEEN f.open AND f.close),
spans AS (SELECT k, no, e, total, b, 0 AS ordinal FROM backs WHERE no = 0
    UNION ALL SELECT n.k, n.no, n.e, n.total, n.b, w.ordinal + 1 FROM spans w JOIN backs n ON n.k = w.k AND n.no = CASE WHEN w.b > w.no THEN w.b ELSE w.e END WHERE w.e < w.total),
trimmed AS (SELECT s.k, s.ordinal, min(l.no) AS a, max(l.no) AS b FROM spans s JOIN base l ON l.k = s.k AND l.no >= s.no AND l.no < s.e AND trim(l.line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2)
SELECT t.k AS conv_id, t.a + 1 AS start_line, t.b + 1 AS end_line, md5(string_agg(line, chr(10) ORDER BY no)) AS md5 FROM trimmed t JOIN base l ON l.k = t.k AND l.no BETWEEN t.a AND t.b GROUP BY t.k, t.ordinal, t.a, t.b"""

_PACKED = _spans("SELECT doc_id AS k, unnest(range(len(l))) AS no, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text <> '')", 40, 3000, 5)
_TALK_SPANS = _spans("SELECT document_id || '/' || section_ordinal AS k, no - a AS no, line FROM secs JOIN numbered USING (document_id, section_ordinal) WHERE no BETWEEN a AND b", 2, 400, 0)

_CHUNK_IDS = f"""WITH {_TALKS}, {_LINES}, {_TALK_SPANS},
        texts AS (SELECT t.k, t.ordinal, t.a, t.b, string_agg(line, chr(10) ORDER BY no) AS content FROM trimmed t JOIN base l ON l.k = t.k AND l.no BETWEEN t.a AND t.b GROUP BY 1, 2, 3, 4),
        placed AS (SELECT s.document_id, relative_path, title, path, section_ordinal, x.content, x.ordinal, s.a + x.a AS start_line, s.a + x.b AS end_line FROM texts x JOIN secs s ON x.k = s.document_id || '/' || s.section_ordinal),
        counted AS (SELECT *, row_number() OVER (PARTITION BY document_id, section_ordinal ORDER BY ordinal) - 1 AS section_chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY section_ordinal, ordinal) - 1 AS chunk_index FROM placed)
        SELECT sha256(document_id || chr(31) || replace(path, ' > ', chr(31)) || chr(31) || section_chunk_index || chr(31) || content) AS chunk_id, relative_path, title, path || chr(10) || chr(10) || content AS searchable_text,
        chunk_index, section_chunk_index, start_line, end_line, sha256(content) AS content_hash/* more */ FROM counted"""

QUERIES = {
    "bm25_topk": bm25_topk, "postings": postings, "term_df_idf": term_df_idf, "doc_lengths": doc_lengths, "corpus_size": corpus_size, "dense_topk": dense_topk, "l2_normalize": l2_normalize,
    "golden_validate": golden_validate, "golden_violations": golden_violations, "eval_per_query": eval_per_query, "eval_macro": eval_macro, "eval_misses": eval_misses,
    "compare_categories": compare_categories, "compare_counts": compare_counts, "documents_hashed": documents_hashed, "sections": sections, "chunk_ids": chunk_ids, "chunk_pack": chunk_pack,
    "chunk_stats": chunk_stats, "largest_chunks": largest_chunks, "smallest_chunks": smallest_chunks, "fence_detect": fence_detect, "embed_udf": embed_udf,
    "dense_index": dense_index, "golden_jsonl": golden_jsonl, "evaluation_jsonl": evaluation_jsonl, "chunk_jsonl": chunk_jsonl, "report_counts": report_counts, "sections_fenced": sections_fenced,
    "sections_lines": sections_lines, "chunk_fenced": chunk_fenced, "jsonl_positions": jsonl_positions,
    "compare_sinks": compare_sinks, "scan_tree": scan_tree, "index_counts": index_counts, "matrix_file": matrix_file, "dense_topk_grid": dense_topk_grid, "bm25_bounded": bm25_bounded, "report_text": report_text,
}

_DENSE_FIRST = "dense_first AS (SELECT g.item_id, min(rank) AS other FROM gold g LEFT JOIN dense_hits h ON g.item_id = h.item_id AND g.doc_id = h.doc_id GROUP BY 1)"
_CATEGORY = f"""{_DENSE_HITS}, {_DENSE_FIRST},
both_sides AS (SELECT query_id, CASE WHEN first_relevant_rank IS NULL AND other IS NULL THEN 'both_miss' WHEN first_relevant_rank IS NULL THEN 'dense_only_hits' WHEN other IS NULL THEN 'lexical_only_hits' ELSE 'both_hit' END AS category
    FROM metrics JOIN dense_first ON query_id = CAST(item_id AS VARCHAR))"""
_ROUNDED = "round(hit_rate_at_k, 6) AS hit_rate_at_k, round(recall_at_k, 6) AS recall_at_k"
_LARGEST = "SELECT doc_id, CAST(char_count AS BIGINT) AS char_count, CAST(line_count AS BIGINT) AS line_count FROM sizes ORDER BY char_count {}, doc_id LIMIT 10"
ORACLES = {
    "bm25_topk": f"WITH {_HITS} SELECT item_id, rank, doc_id, round(score, 6) AS score FROM hits",
    "postings": f"WITH {_DOC_TOKENS} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL",
    "term_df_idf": f"WITH {_DOC_TOKENS}, d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY term) SELECT term, df, round(ln(1 + ((SELECT count(*) FROM toks) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 9) AS idf FROM d",
    "doc_lengths": f"WITH {_DOC_TOKENS} SELECT doc_id, len(t) AS dl FROM toks",
    "corpus_size": f"WITH {_DOC_TOKENS} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM toks",
    "dense_topk": """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), v AS (SELECT vec_id, list_transform(e, lambda x: (x / sqrt(list_inner_product(e, e)))::FLOAT)::DOUBLE[] AS e FROM u),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 100 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id DESC) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 5""",
    "l2_normalize": "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM u) SELECT vec_id, CAST(unnest(range(len(e))) AS BIGINT) AS at, round(unnest(list_transform(e, lambda x: (x / norm)::FLOAT::DOUBLE)), 5) AS x FROM n",
    "golden_validate": f"WITH {_GOLD}, n AS (SELECT item_id, count(g.doc_id) AS c FROM (SELECT item_id FROM benchmark WHERE trim(text) <> '') LEFT JOIN gold g USING (item_id) GROUP BY 1) SELECT count(*) AS query_count, count(*) FILTER (c > 0) AS answerable_count, count(*) FILTER (c = 0) AS no_answer_count, CAST(sum(c) AS BIGINT) AS judgment_count FROM n",
    "golden_violations": f"""WITH {_GOLD}, j AS (SELECT item_id AS query_pos, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS judgment_pos FROM gold)
        SELECT query_pos, judgment_pos, CAST(CASE WHEN query_pos % 3 = 0 THEN 7 ELSE 4 END AS BIGINT) AS rule, CASE WHEN query_pos % 3 = 0 THEN query_pos || ': unknown chunk_id x' || doc_id ELSE query_pos || ': relevance must be 1 or 2, got 7' END AS message FROM j WHERE query_pos % 3 = 0 OR query_pos % 5 = 0
        UNION ALL SELECT query_pos, judgment_pos + count(*) OVER (PARTITION BY query_pos), 6, query_pos || ': duplicate chunk_id ' || doc_id FROM j WHERE query_pos % 7 = 0 AND query_pos % 3 <> 0 AND query_pos % 5 <> 0
        UNION ALL SELECT item_id + 1000000, -1, 3, 'Duplicate query_id: ' || item_id FROM benchmark WHERE item_id % 11 = 0 AND trim(text) <> ''""",
    "eval_per_query": f"WITH {_METRICS} SELECT query_id, first_relevant_rank, {_ROUNDED}, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_at_k, 6) AS ndcg_at_k FROM metrics",
    "eval_macro": f"WITH {_METRICS}, n AS (SELECT count(*) AS c FROM benchmark WHERE trim(text) <> '') SELECT (SELECT c FROM n) AS query_count, count(*) AS evaluated_query_count, (SELECT c FROM n) - count(*) AS no_answer_count, round(avg(hit_rate_at_k), 6) AS hit_rate_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k FROM metrics",
    "eval_misses": f"WITH {_DENSE_HITS}, {_GOLD}, {_DENSE_FIRST} SELECT CAST(item_id AS VARCHAR) AS query_id FROM dense_first WHERE other IS NULL",
    "embed_udf": f"WITH {_VECTORS} SELECT id AS doc_id, CAST(dim AS BIGINT) AS at, round(x, 5) AS x FROM vectors",
    "dense_index": f"WITH {_DENSE_HITS} SELECT item_id, rank, doc_id, round(score, 5) AS score FROM dense_hits",
    "golden_jsonl": f"WITH {_GOLD} SELECT CAST(b.item_id AS VARCHAR) AS query_id, md5(b.text) AS query_md5, CAST(doc_id AS VARCHAR) AS chunk_id, source AS relative_path, lang AS section, CAST(rel AS BIGINT) AS relevance FROM (SELECT * FROM benchmark WHERE trim(text) <> '') b LEFT JOIN gold g USING (item_id) LEFT JOIN documents USING (doc_id)",
    "evaluation_jsonl": f"""WITH {_METRICS}, judged AS (SELECT item_id, count(*) AS judged FROM gold GROUP BY 1)
        SELECT query_id, judged, round(recall_at_k, 6) AS recall, rank, CAST(h.doc_id AS VARCHAR) AS chunk_id, round(score, 6) AS score, CAST(coalesce(rel, 0) AS BIGINT) AS relevance, md5(d.text) AS content_md5
        FROM metrics JOIN judged ON query_id = CAST(item_id AS VARCHAR) JOIN hits h USING (item_id) JOIN documents d USING (doc_id) LEFT JOIN gold g ON g.item_id = h.item_id AND g.doc_id = h.doc_id""",
    "report_counts": f"""WITH {_METRICS}, {_CATEGORY}, c AS (SELECT category, count(*) AS n FROM both_sides GROUP BY 1),
        open_items AS (SELECT query_id FROM both_sides WHERE category <> 'both_hit'),
        facts AS (SELECT * FROM (VALUES ('Dense only hit', 'dense_only_hits'), ('Lexical only hit', 'lexical_only_hits'), ('Both hit', 'both_hit'), ('Both miss', 'both_miss')) t(fact, category))
        SELECT fact, coalesce(n, 0) AS n FROM facts LEFT JOIN c USING (category) UNION ALL SELECT 'queries', count(*) FROM benchmark WHERE trim(text) <> ''
        UNION ALL SELECT 'shown', (SELECT count(*) FROM hits WHERE CAST(item_id AS VARCHAR) IN (SELECT query_id FROM open_items)) + (SELECT count(*) FROM dense_hits WHERE CAST(item_id AS VARCHAR) IN (SELECT query_id FROM open_items))""",
    "compare_categories": f"WITH {_METRICS}, {_CATEGORY} SELECT query_id, category FROM both_sides",
    "compare_counts": f"WITH {_METRICS}, {_CATEGORY} SELECT category, count(query_id) AS n FROM (VALUES ('dense_only_hits'), ('lexical_only_hits'), ('both_hit'), ('both_miss')) t(category) LEFT JOIN both_sides USING (category) GROUP BY category",
    "compare_sinks": f"WITH {_METRICS}, {_CATEGORY} SELECT category, row_number() OVER (PARTITION BY category ORDER BY CAST(query_id AS BIGINT)) AS place, CAST(query_id AS BIGINT) AS query_id, coalesce(first_relevant_rank, 0) AS lexical, coalesce(other, 0) AS dense FROM both_sides JOIN metrics USING (query_id) JOIN dense_first ON query_id = CAST(item_id AS VARCHAR)",
    "scan_tree": """WITH talks AS (SELECT CASE WHEN conv_id % 3 = 0 THEN '_deep/.hidden/' || conv_id || '.MD' ELSE 'talks/' || conv_id || '.md' END AS relative_path,
        '# talk ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id)
        SELECT sha256('talks' || chr(31) || relative_path) AS document_id, relative_path, sha256(content) AS content_hash FROM talks""",
    "index_counts": f"""{_CHUNK_IDS.split(" SELECT sha256(document_id ||")[0].replace("/* more */", "")}
        SELECT 'documents' AS what, (SELECT count(*) FROM docs) AS n UNION ALL SELECT 'sections', (SELECT count(*) FROM secs WHERE path IS NOT NULL OR content <> '') UNION ALL SELECT 'chunks', (SELECT count(*) FROM counted)""",
    "documents_hashed": f"WITH {_TALKS} SELECT document_id, relative_path, sha256(content) AS content_hash FROM docs",
    "sections": f"WITH {_TALKS}, {_LINES} SELECT document_id, section_ordinal, path, content, start_line, coalesce(a, 0) AS content_start_line, coalesce(b, start_line) AS end_line FROM secs",
    "sections_fenced": f"WITH {_FENCED}, {_FENCED_LINES} SELECT document_id, section_ordinal, path, content, start_line, coalesce(a, 0) AS content_start_line, coalesce(b, start_line) AS end_line FROM secs",
    "chunk_fenced": _FENCED_SPANS,
    "jsonl_positions": "SELECT files, doc_id, row_number() OVER (PARTITION BY files ORDER BY doc_id) - 1 AS line, md5(coalesce(text, '')) AS md5 FROM documents, (VALUES ('rising'), ('falling')) t(files)",
    "chunk_ids": _CHUNK_IDS, "chunk_jsonl": _CHUNK_IDS.replace("/* more */", ", path, true AS ordered"),
    "chunk_pack": f"WITH {_PACKED} SELECT t.k AS doc_id, t.a + 1 AS start_line, t.b + 1 AS end_line, md5(string_agg(line, chr(10) ORDER BY no)) AS md5 FROM trimmed t JOIN base l ON l.k = t.k AND l.no BETWEEN t.a AND t.b GROUP BY t.k, t.ordinal, t.a, t.b",
    "chunk_stats": f"WITH {_SIZES} SELECT count(*) AS chunk_count, count(DISTINCT source) AS document_count, CAST(min(char_count) AS BIGINT) AS min_chars, round(avg(char_count), 6) AS average_chars, CAST(max(char_count) AS BIGINT) AS max_chars, CAST(min(line_count) AS BIGINT) AS min_lines, round(avg(line_count), 6) AS average_lines, CAST(max(line_count) AS BIGINT) AS max_lines, count(*) FILTER (fence) AS chunks_with_code_fence, count(*) FILTER (char_count > 3000) AS chunks_over_char_limit, count(*) FILTER (line_count > 40) AS chunks_over_line_limit FROM sizes",
    "largest_chunks": f"WITH {_SIZES} {_LARGEST.format('DESC')}",
    "smallest_chunks": f"WITH {_SIZES} {_LARGEST.format('ASC')}",
    "fence_detect": "WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ' ' || chr(9) || '```' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS t FROM documents) SELECT doc_id, regexp_matches(t, '(?m)^[ \\t]*(```|~~~)') AS fenced, NOT regexp_matches(regexp_replace(t, '(?m)^\\s*(---|\\*\\*\\*|___)\\s*$', '', 'g'), '\\S') AS separator_only, CAST(CASE WHEN length(t) <= 100 THEN length(t) ELSE length(regexp_replace(t[:100], '\\s+$', '')) + 3 END AS BIGINT) AS shown, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda r: length(r))), 0))) AS fence FROM b",
}
ORACLES["sections_lines"] = ORACLES["sections_fenced"]
ORACLES["dense_topk_grid"], ORACLES["matrix_file"] = ORACLES["dense_topk"], ORACLES["l2_normalize"]
ORACLES["bm25_bounded"] = ORACLES["bm25_topk"]
_SHOWN = """shown AS (SELECT doc_id, source, lang, shown, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(shown, '`+'), lambda x: length(x))), 0) + 1)) AS fence
    FROM (SELECT doc_id, source, lang, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(substring(text, 1, 100), '\\s+$', '') || chr(10) || chr(10) || '<content truncated>' END AS shown FROM documents))"""
_SIDE = """{name}_side AS (SELECT h.item_id, string_agg(rank || '. `' || h.doc_id || '` — score `' || printf('%.6f', h.score) || '`' || chr(10) || '   - **Relevance:** ' || coalesce(rel, 0) || CASE WHEN rel > 0 THEN ' (релевантный по golden)' ELSE ' (не размечен как релевантный)' END || chr(10)
        || '   - **Path:** `' || source || '`' || chr(10) || '   - **Section:** ' || coalesce(nullif(lang, ''), '<no heading>') || chr(10) || chr(10) || '<details>' || chr(10) || '<summary>Показать content</summary>' || chr(10) || chr(10)
        || fence || 'text' || chr(10) || shown || chr(10) || fence || chr(10) || chr(10) || '</details>' || chr(10), chr(10) ORDER BY rank) AS body
    FROM {hits} h JOIN shown USING (doc_id) LEFT JOIN gold g ON g.item_id = h.item_id AND g.doc_id = h.doc_id GROUP BY h.item_id)"""
_PART = """'#### {title} top-5' || chr(10) || chr(10) || '**Первый релевантный rank:** ' || coalesce(CAST({rank} AS VARCHAR), 'не найден') || chr(10) || chr(10) || coalesce({name}_side.body, 'Нет результатов.' || chr(10))"""
_GUESS = " ".join(f"WHEN '{key}' THEN '{guess}'" for _, key, guess in report.GROUPS)
ORACLES["report_text"] = f"""WITH {_METRICS}, {_CATEGORY}, {_SHOWN}, {_SIDE.format(name="lexical", hits="hits")}, {_SIDE.format(name="dense", hits="dense_hits")},
judged_ids AS (SELECT item_id, string_agg('- `' || doc_id || '`', chr(10) ORDER BY CAST(doc_id AS VARCHAR)) AS ids FROM gold GROUP BY 1),
whole AS (SELECT query_id, category, '### query-id: `' || query_id || '`' || chr(10) || chr(10) || '**Запрос:** ' || b.text || chr(10) || chr(10) || '**Golden chunks:**' || chr(10) || chr(10) || ids || chr(10) || chr(10)
    || '**Автоматическая гипотеза:** ' || CASE category {_GUESS} END || chr(10) || chr(10) || {_PART.format(title="BM25", name="lexical", rank="first_relevant_rank")} || chr(10) || {_PART.format(title="Dense", name="dense", rank="other")} || chr(10)
    || '{chr(10).join(report.TODO)}' AS text
    FROM both_sides JOIN metrics USING (query_id) JOIN benchmark b ON query_id = CAST(b.item_id AS VARCHAR) JOIN judged_ids USING (item_id) JOIN dense_first USING (item_id)
    LEFT JOIN lexical_side USING (item_id) LEFT JOIN dense_side USING (item_id) WHERE category <> 'both_hit')
SELECT query_id, category, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, md5(text) AS md5 FROM whole"""
