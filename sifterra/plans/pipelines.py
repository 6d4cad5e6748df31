"""What a user runs: index, search, evaluate, analyse, compare. Each function is a few plans and a sink."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass
from enum import StrEnum
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, markdown, statistics
from ..operators.dense import DenseIndex, DenseMetadata, EmbeddingModel, EmbeddingModelConfig, build_dense, create_model
from ..operators.lexical import BM25Index, check_top_k
from ..sources import dense_store, files, jsonl
from ..sources.scratch import materialise, scratch


class RetrieverType(StrEnum):
    LEXICAL = "lexical"
    DENSE = "dense"


@dataclass(frozen=True)
class IndexingResult:
    documents: int
    sections: int
    chunks: int
    output_path: str


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunk_pos``: (path, index) order made explicit, ascending but not dense. A range sort, no single task; write it before use."""
    return chunks.orderBy("relative_path", "chunk_index").withColumn("chunk_pos", F.monotonically_increasing_id())


def build_chunks(spark: SparkSession, root: str | Path, output: str | Path, *, source_name: str = "notes", config: markdown.ChunkerConfig = markdown.ChunkerConfig()) -> IndexingResult:
    """Scan, section, chunk, write one JSONL file."""
    if not Path(root).exists():
        raise FileNotFoundError(f"Repository path does not exist: {root}")
    if not Path(root).is_dir():
        raise NotADirectoryError(f"Repository path is not a directory: {root}")
    seen = {name: Observation(name) for name in ("documents", "sections")}
    documents = files.scan_documents(spark, root, source_name).observe(seen["documents"], F.count(F.lit(1)).alias("n"))
    chunks = markdown.chunk_documents(documents, config, lambda sections: sections.observe(seen["sections"], F.count(F.lit(1)).alias("n")))
    # the pass that writes the table counts; the file is made of the table
    n = jsonl.write_file(materialise(chunks, "chunks"), output, ["relative_path", "chunk_index"])
    return IndexingResult(seen["documents"].get["n"], seen["sections"].get["n"], n, str(output))


def _asked(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([("query", query)], "query_id string, query string")


def lexical_search(spark: SparkSession, chunks_path: str, query: str, top_k: int = 5, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    chunks = jsonl.read_chunks(spark, chunks_path)
    hits = BM25Index.build(chunks, k1=k1, b=b).search(_asked(spark, query), top_k)
    return hits.join(chunks.withColumnRenamed("chunk_pos", "pos").drop("chunk_id"), "pos").orderBy("rank")


def build_dense_index(spark: SparkSession, chunks_path: str, embeddings_path: str, metadata_path: str | Path, make: Callable[[], EmbeddingModel]) -> DenseMetadata:
    """Embed a chunk file; the metadata keeps the digest of that file."""
    embeddings, metadata = build_dense(jsonl.read_chunks(spark, chunks_path), make, files.file_sha256(chunks_path))
    dense_store.write_embeddings(embeddings, embeddings_path)
    dense_store.write_metadata(metadata, metadata_path)
    return metadata


def model_maker(config: EmbeddingModelConfig, batch_size: int = 32, device: str = "cpu") -> Callable[[], EmbeddingModel]:
    return lambda: create_model(config, batch_size=batch_size, device=device)


def load_dense_index(spark: SparkSession, chunks_path: str, embeddings_path: str, metadata_path: str | Path, make: Callable[[], EmbeddingModel] | None = None) -> DenseIndex:
    """The index, if the chunk file is still the one it was made of."""
    metadata = dense_store.read_metadata(metadata_path)
    if files.file_sha256(chunks_path) != metadata.chunks_sha256:
        raise ValueError("Dense index metadata does not match the current chunks file")
    embeddings = dense_store.read_embeddings(spark, embeddings_path, metadata)
    return DenseIndex(jsonl.read_chunks(spark, chunks_path), embeddings, metadata, make or model_maker(metadata.embedding_model))


def dense_search(index: DenseIndex, query: str, top_k: int = 5) -> DataFrame:
    hits = index.search(_asked(index.chunks.sparkSession, query), top_k)
    return hits.join(index.chunks.withColumnRenamed("chunk_pos", "pos").drop("chunk_id"), "pos").orderBy("rank")


def evaluate(golden: DataFrame, chunks: DataFrame, retriever, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(nested results per answerable query, one row of means). The golden set is validated before anything is searched."""
    check_top_k(top_k)
    evaluation.validate_golden(golden, chunks)
    hits = retriever.search(golden.filter(F.size("relevant_chunks") > 0).select("query_id", "query"), top_k).persist()
    results = evaluation.evaluate_queries(golden, hits, chunks, top_k).join(golden.select("query_id", F.col("query_pos").alias("pos")), "query_id")
    return results, evaluation.macro_averages(golden, evaluation.query_metrics(golden, hits, top_k))


def evaluate_lexical(spark: SparkSession, golden_path: str, chunks_path: str, top_k: int = 5, *, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    chunks = jsonl.read_chunks(spark, chunks_path)
    return evaluate(jsonl.read_golden(spark, golden_path), chunks, BM25Index.build(chunks, k1=k1, b=b), top_k)


def evaluate_dense(spark: SparkSession, golden_path: str, index: DenseIndex, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    return evaluate(jsonl.read_golden(spark, golden_path), index.chunks, index, top_k)


def analyze(spark: SparkSession, golden_path: str, chunks_path: str, retriever: str, output_root: str | Path, top_k: int = 5, *, k1: float = 1.5, b: float = 0.75, embeddings_path: str | None = None, metadata_path: str | None = None, make: Callable[[], EmbeddingModel] | None = None) -> dict:
    """``<root>/<retriever>/top_<k>/results.jsonl`` and ``misses.jsonl``; counts and paths."""
    check_top_k(top_k)
    if retriever == RetrieverType.LEXICAL:
        results, _ = evaluate_lexical(spark, golden_path, chunks_path, top_k, k1=k1, b=b)
    elif retriever == RetrieverType.DENSE:
        if embeddings_path is None:
            raise ValueError("embeddings_path is required for dense retrieval")
        if metadata_path is None:
            raise ValueError("metadata_path is required for dense retrieval")
        results, _ = evaluate_dense(spark, golden_path, load_dense_index(spark, chunks_path, embeddings_path, metadata_path, make), top_k)
    else:
        raise ValueError(f"Unsupported retriever type: {retriever}")
    folder = Path(output_root) / str(retriever) / f"top_{top_k}"
    results = results.persist()
    n = jsonl.write_file(results, folder / "results.jsonl", ["pos"])
    missed = jsonl.write_file(evaluation.misses(results), folder / "misses.jsonl", ["pos"])
    results.unpersist()
    return {"query_count": n, "miss_count": missed, "results_path": str(folder / "results.jsonl"), "misses_path": str(folder / "misses.jsonl")}


def dump_lexical(spark: SparkSession, golden_path: str, chunks_path: str, output: str | Path, top_k: int = 5, *, only_misses: bool = False) -> tuple[int, int]:
    """One JSON line for each answerable query of a BM25 evaluation, or for those without a hit; evaluated and written queries."""
    results = evaluate_lexical(spark, golden_path, chunks_path, top_k)[0].persist()
    n = results.count()
    written = jsonl.write_file(results.filter("hit_rate_at_k = 0") if only_misses else results, output, ["pos"])
    results.unpersist()
    return n, written


def write_compared(compared: DataFrame, path: str) -> None:
    """All categories in one write: a folder ``category=<name>`` of JSON lines for each, its files in order of position."""
    order = ["category", "pos", "query_id"]
    rows = compared.repartitionByRange(*order).sortWithinPartitions(*order)
    value = F.to_json(F.struct("query_id", "query", "lexical_result", "dense_result"), {"ignoreNullFields": "false"})
    rows.select("category", value.alias("value")).write.mode("overwrite").partitionBy("category").text(path)


def compare_files(spark: SparkSession, lexical_path: str, dense_path: str, output_dir: str | Path) -> dict[str, int]:
    """One file for each category; its rows hold both results. The written folders are joined file by file, line by line."""
    output_dir, counts = Path(output_dir), {}
    compared = evaluation.compare(jsonl.read_evaluation(spark, lexical_path), jsonl.read_evaluation(spark, dense_path))
    folder = scratch(spark, "compared")
    write_compared(compared, folder)
    lines = jsonl.read_categories(spark, folder)
    output_dir.mkdir(parents=True, exist_ok=True)
    with ExitStack() as stack:
        out = {c: stack.enter_context((output_dir / f"{c}.jsonl").open("w", encoding="utf-8", newline="\n")) for c in evaluation.CATEGORIES}
        counts = dict.fromkeys(evaluation.CATEGORIES, 0)
        for row in lines.orderBy("category", "number").toLocalIterator():
            out[row["category"]].write(row["line"] + "\n")
            counts[row["category"]] += 1
    return counts


def chunk_file_statistics(spark: SparkSession, path: str, *, max_chars: int = 3_000, max_lines: int = 40, largest_limit: int = 10, smallest_limit: int = 10) -> dict:
    statistics.check_limits(max_chars, max_lines, largest_limit, smallest_limit)
    if not Path(path).exists():
        raise FileNotFoundError(f"Chunks JSONL does not exist: {path}")
    if not Path(path).is_file():
        raise IsADirectoryError(f"Chunks JSONL path is not a file: {path}")
    chunks = jsonl.read_chunks(spark, path).persist()
    top = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a stated number of rows
    out = statistics.summary(chunks, max_chars=max_chars, max_lines=max_lines).first().asDict()
    out |= {"largest": top(statistics.largest(chunks, largest_limit)), "smallest": top(statistics.smallest(chunks, smallest_limit))}
    chunks.unpersist()
    return out


def validate_golden_files(spark: SparkSession, golden_path: str, chunks_path: str) -> dict:
    return evaluation.validate_golden(jsonl.read_golden(spark, golden_path), jsonl.read_chunks(spark, chunks_path)).first().asDict()
