"""Command line: ``python -m sifterra.cli <command> --help``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import console
from .operators.dense import EmbeddingModel
from .operators.markdown import ChunkerConfig
from .plans import pipelines, report
from .sources import dense_store, jsonl


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sifterra").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _maker(a: argparse.Namespace):
    from .operators.dense import EmbeddingModelConfig, HashingEmbedder, SentenceTransformerModel

    def make() -> EmbeddingModel:
        if a.provider == "hashing":
            return HashingEmbedder(EmbeddingModelConfig("hashing", a.model_name, 256, a.query_prefix, a.document_prefix))
        return SentenceTransformerModel(a.model_name, batch_size=a.batch_size, device=a.device, query_prefix=a.query_prefix, document_prefix=a.document_prefix)

    return make


def _index(spark, a):
    config = pipelines.dense_store.read_metadata(a.metadata).embedding_model
    return pipelines.load_dense_index(spark, a.chunks, a.embeddings, a.metadata, pipelines.model_maker(config, a.batch_size, a.device))


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The lines that a command shows."""
    rows = lambda hits: [r.asDict() for r in hits.collect()]  # noqa: E731  top_k rows
    if a.command == "index":
        r = pipelines.build_chunks(spark, a.root, a.output, source_name=a.source_name, config=ChunkerConfig(a.max_lines, a.max_chars, a.overlap_lines, a.max_fence_overlap_lines))
        return console.pairs({"Documents": r.documents, "Sections": r.sections, "Chunks": r.chunks, "Output": r.output_path})
    if a.command == "stats":
        return console.statistics(pipelines.chunk_file_statistics(spark, a.chunks, max_chars=a.max_chars, max_lines=a.max_lines, largest_limit=a.largest_limit, smallest_limit=a.smallest_limit), a.max_chars, a.max_lines)
    if a.command == "lexical-search":
        return console.hits(rows(pipelines.lexical_search(spark, a.chunks, a.query, a.top_k, k1=a.k1, b=a.b)), a.content_limit, False)
    if a.command == "dense-search":
        return console.hits(rows(pipelines.dense_search(_index(spark, a), a.query, a.top_k)), a.content_limit, True)
    if a.command == "retrieval-dump":
        n, written = pipelines.dump_lexical(spark, a.golden, a.chunks, a.output, a.top_k, only_misses=a.only_misses)
        return console.pairs({"Evaluated queries": n, "Written queries": written, "Output": a.output})
    headline = [f"\x1b[32m{console.HEADLINES[a.command]}\x1b[0m"]
    if a.command == "validate-golden":
        r = pipelines.validate_golden_files(spark, a.golden, a.chunks)
        return headline + console.pairs({"Queries": r["query_count"], "Answerable queries": r["answerable_count"], "No-answer queries": r["no_answer_count"], "Relevance judgments": r["judgment_count"]})
    if a.command == "lexical-evaluate":
        return headline + console.means(pipelines.evaluate_lexical(spark, a.golden, a.chunks, a.top_k, k1=a.k1, b=a.b)[1].first(), a.top_k)
    if a.command == "dense-evaluate":
        return headline + console.means(pipelines.evaluate_dense(spark, a.golden, _index(spark, a), a.top_k)[1].first(), a.top_k)
    if a.command == "dense-index":
        m = pipelines.build_dense_index(spark, a.chunks, a.embeddings, a.metadata, _maker(a)).embedding_model
        n = jsonl.read_chunks(spark, a.chunks).count()
        return headline + console.pairs({"Model": m.model_name, "Chunks": n, "Dimension": m.dimension, "Embeddings": a.embeddings, "Metadata": a.metadata})
    if a.command == "retrieval-analyze":
        make = pipelines.model_maker(dense_store.read_metadata(a.metadata).embedding_model, a.batch_size, a.device) if a.metadata else None
        r = pipelines.analyze(spark, a.golden, a.chunks, a.retriever, a.output_root, a.top_k, k1=a.k1, b=a.b, embeddings_path=a.embeddings, metadata_path=a.metadata, make=make)
        return headline + console.pairs({"Retriever": a.retriever, "Top-K": a.top_k, "Queries": r["query_count"], "Misses": r["miss_count"], "Results": r["results_path"], "Misses file": r["misses_path"]})
    if a.command == "retrieval-compare":
        return headline + console.categories(pipelines.compare_files(spark, a.lexical, a.dense, a.output_dir)) + [f"Output: {a.output_dir}"]
    read = lambda path: jsonl.read_evaluation(spark, path)
    golden = jsonl.read_golden(spark, a.golden)
    path, counts = report.write_report(golden, read(a.lexical), read(a.dense), a.metadata, a.output_root, a.top_k, a.content_limit)
    return headline + console.pairs({"Queries": golden.count(), "Answerable queries": sum(counts.values())}) + console.categories(counts) + [f"Output: {path}"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sifterra", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, positional: Sequence[str], *options: tuple[str, object]) -> None:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for flag, default in options:
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=type(default) if default is not None else str)

    chunks, top_k, bm25 = ("--chunks", "data/chunks.jsonl"), ("--top-k", 5), (("--k1", 1.5), ("--b", 0.75))
    dense = (("--embeddings", "data/dense/embeddings"), ("--metadata", "data/dense/metadata.json"), ("--batch-size", 32), ("--device", "cpu"))
    command("index", ["root"], ("--source-name", "notes"), ("--output", "data/chunks.jsonl"), ("--max-lines", 40), ("--max-chars", 3000), ("--overlap-lines", 5), ("--max-fence-overlap-lines", 10))
    command("stats", ["chunks"], ("--max-chars", 3000), ("--max-lines", 40), ("--largest-limit", 10), ("--smallest-limit", 10))
    command("validate-golden", ["golden", "chunks"])
    command("lexical-search", ["query"], chunks, top_k, *bm25, ("--content-limit", 500))
    command("lexical-evaluate", ["golden", "chunks"], top_k, *bm25)
    command("dense-index", [], ("--provider", "sentence-transformers"), ("--model-name", "intfloat/multilingual-e5-base"), chunks, *dense, ("--query-prefix", "query: "), ("--document-prefix", "passage: "))
    command("dense-search", ["query"], chunks, *dense, top_k, ("--content-limit", 500))
    command("dense-evaluate", ["golden", "chunks"], *dense, top_k)
    command("retrieval-analyze", ["golden", "chunks"], ("--retriever", "lexical"), ("--output-root", "data/analysis"), top_k, *bm25, ("--embeddings", None), ("--metadata", None), *dense[2:])
    command("retrieval-compare", ["lexical", "dense"], ("--output-dir", "data/comparison"))
    command("retrieval-report", ["golden", "lexical", "dense", "metadata"], ("--output-root", "data/reports"), top_k, ("--content-limit", 1500))
    command("retrieval-dump", ["golden", "chunks"], ("--output", "artifacts/retrieval_evaluation.jsonl"), top_k, ("--only-misses", False))
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print("\n".join(run(session(), args)))
    except (ValueError, OSError) as error:
        print(f"\x1b[31m{console.FAILURES[args.command]}: {error}\x1b[0m", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
