"""The Markdown error report of a comparison. The part of each query is made where its row is; the driver writes them one after another."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_fence, truncate
from ..operators import evaluation
from ..sources.dense_store import read_metadata

#: Fixed texts of the report's format.
CATEGORIES = ("vocabulary_mismatch", "exact_term_needed", "ranking_error", "chunk_boundary", "context_missing", "duplicate_or_similar_chunks", "golden_incomplete", "golden_incorrect", "query_ambiguous", "content_missing")
GROUPS = (
    ("Both miss", "both_miss", "Требуется ручная проверка. Возможны `ranking_error`, `golden_incomplete`, `chunk_boundary` или `content_missing`."),
    ("Lexical only hit", "lexical_only_hits", "Предварительная гипотеза: `exact_term_needed`."),
    ("Dense only hit", "dense_only_hits", "Предварительная гипотеза: `vocabulary_mismatch`."),
)
OPEN_SECTIONS = ("Где Dense сильнее", "Где BM25 сильнее", "Ошибки golden dataset", "Ошибки chunking", "Ограничения обоих retriever-ов", "Вывод для Hybrid Retrieval")
SUMMARY = (("Dense only hit", "dense_only_hits"), ("Lexical only hit", "lexical_only_hits"), ("Both hit", "both_hit"), ("Both miss", "both_miss"))
TODO = (
    "**Итоговая категория:** `TODO`", "", "**Причина:**", "", "TODO", "", "**Действие:**", "", "TODO", "",
    "**Нужно изменить golden dataset:** `TODO`", "", "**Нужно изменить chunking:** `TODO`", "", "---", "",
)
HIDDEN, CUT = "<content hidden>", "\n\n<content truncated>"


def block(title: str, *lines: str) -> list[str]:
    return [title, "", *lines, ""] if lines else [title, ""]


def _texts(*lines: str | Column) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])


def _said(*parts: str | Column) -> Column:
    return F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])


def result_lines(name: str, result: Column, top_k: int, content_limit: int) -> Column:
    """Lines of one retriever's result for a query."""

    def chunk(c: Column) -> Column:
        shown = truncate(c["content"], content_limit, HIDDEN, CUT)
        fence = code_fence(shown)
        label = F.when(c["relevance"] > 0, "релевантный по golden").otherwise("не размечен как релевантный")
        section = F.when(F.size(c["section_path"]) > 0, F.array_join(c["section_path"], " > ")).otherwise("<no heading>")
        section = F.when(section == "", "<no heading>").otherwise(section)
        head = _texts(
            _said(c["rank"], ". `", c["chunk_id"], "` — score `", F.format_string("%.6f", c["score"]), "`"), _said("   - **Relevance:** ", c["relevance"], " (", label, ")"),
            _said("   - **Path:** `", c["relative_path"], "`"), _said("   - **Section:** ", section), "", "<details>", "<summary>Показать content</summary>", "", _said(fence, "text"),
        )
        return F.concat(head, F.split(shown, "\n", -1), _texts(fence, "", "</details>", ""))

    rank = F.coalesce(result["first_relevant_rank"].cast("string"), F.lit("не найден"))
    head = _texts(f"#### {name} top-{top_k}", "", _said("**Первый релевантный rank:** ", rank), "")
    found = result["retrieved_chunks"]
    return F.concat(head, F.when(F.size(found) == 0, _texts("Нет результатов.", "")).otherwise(F.flatten(F.transform(found, chunk))))


def query_parts(compared: DataFrame, top_k: int, content_limit: int) -> DataFrame:
    """(``part``, ``category``, ``pos``, ``query_id``, ``lines``) of every query that at least one retriever missed."""
    order = {key: i for i, (_, key, _) in enumerate(GROUPS)}
    part = F.coalesce(*[F.when(F.col("category") == key, i) for key, i in order.items()])
    guess = F.coalesce(*[F.when(F.col("category") == key, text) for _, key, text in GROUPS])
    one, two = F.col("lexical_result"), F.col("dense_result")
    lines = F.concat(
        _texts(_said("### query-id: `", F.col("query_id"), "`"), "", _said("**Запрос:** ", F.col("query")), "", "**Golden chunks:**", ""),
        F.transform(one["relevant_chunk_ids"], lambda c: _said("- `", c, "`")), _texts("", _said("**Автоматическая гипотеза:** ", guess), ""),
        result_lines("BM25", one, top_k, content_limit), result_lines("Dense", two, top_k, content_limit), _texts(*TODO),
    )
    return compared.filter(F.col("category").isin(*order)).select(part.alias("part"), "category", "pos", "query_id", lines.alias("lines"))


def report_lines(golden: DataFrame, compared: DataFrame, model_name: str, top_k: int, content_limit: int) -> tuple[Iterator[str], dict[str, int]]:
    """The report line by line, of which the driver holds one query's at a time, and the number of queries in each category."""
    counts = {r["category"]: r["n"] for r in evaluation.category_counts(compared).collect()}
    total = evaluation.golden_counts(golden).first()
    if sum(counts.values()) != total["answerable_count"]:
        raise ValueError(f"Comparison query count does not match answerable golden query count: {sum(counts.values())} != {total['answerable_count']}")

    def lines() -> Iterator[str]:
        yield from block("# Retrieval Error Analysis") + block(
            "## Контекст", f"- Golden queries: {total['query_count']}", f"- Answerable queries: {total['answerable_count']}", f"- Top-K: {top_k}", "- Lexical retriever: BM25", f"- Dense retriever: `{model_name}`"
        )
        yield from block("## Сводка", "| Группа | Количество |", "|---|---:|", *(f"| {title} | {counts[key]} |" for title, key in SUMMARY))
        yield from block("## Категории ошибок", *(f"- `{c}`" for c in CATEGORIES))
        parts = query_parts(compared, top_k, content_limit).orderBy("part", "pos", "query_id").toLocalIterator()
        row = next(parts, None)
        for i, (title, _, _) in enumerate(GROUPS):
            yield from block(f"## {title}")
            if row is None or row["part"] != i:
                yield from ("В этой группе нет запросов.", "")
            while row is not None and row["part"] == i:
                yield from row["lines"]
                row = next(parts, None)
        yield from block("## Итоговые наблюдения")
        for name in OPEN_SECTIONS:
            yield from block(f"### {name}", "TODO")

    return lines(), counts


def write_report(golden: DataFrame, lexical: DataFrame, dense: DataFrame, metadata_path: str | Path, output_root: str | Path, top_k: int, content_limit: int = 1_500) -> tuple[Path, dict[str, int]]:
    """``<root>/top_<k>/error_analysis.md`` and the number of queries in each category."""
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1, got {top_k}")
    if content_limit < 0:
        raise ValueError(f"content_limit must be non-negative, got {content_limit}")
    name = read_metadata(metadata_path).embedding_model.model_name
    lines, counts = report_lines(golden, evaluation.compare(lexical, dense), name, top_k, content_limit)
    path = Path(output_root) / f"top_{top_k}" / "error_analysis.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    blank = 0
    with path.open("w", encoding="utf-8", newline="\n") as file:
        for line in lines:
            # blank lines at the very end are left out
            if line.strip():
                file.write("\n" * blank + line + "\n")
                blank = 0
            else:
                blank += 1
    return path, counts
