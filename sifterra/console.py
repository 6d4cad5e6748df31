"""What the command line shows, as lines of text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

#: Fixed texts of the console's format: headline of a command, and what precedes an error's message.
HEADLINES = {
    "validate-golden": "Golden dataset is valid.",
    "lexical-evaluate": "Retrieval evaluation completed.",
    "dense-index": "Dense index built.",
    "dense-evaluate": "Dense retrieval evaluation completed.",
    "retrieval-analyze": "Retrieval analysis completed.",
    "retrieval-compare": "Retrieval comparison completed.",
    "retrieval-report": "Retrieval error report generated.",
}
FAILURES = {
    "index": "Indexing failed",
    "stats": "Statistics failed",
    "validate-golden": "Golden validation failed",
    "lexical-search": "Search failed",
    "lexical-evaluate": "Retrieval evaluation failed",
    "dense-index": "Dense indexing failed",
    "dense-search": "Dense search failed",
    "dense-evaluate": "Dense retrieval evaluation failed",
    "retrieval-analyze": "Retrieval analysis failed",
    "retrieval-compare": "Retrieval comparison failed",
    "retrieval-report": "Retrieval report failed",
    "retrieval-dump": "Retrieval analysis failed",
}
NO_HITS, NO_HEADING, CUT = "No matching chunks found.", "<no heading>", "..."
CATEGORY_LABELS = (("Dense-only hits", "dense_only_hits"), ("Lexical-only hits", "lexical_only_hits"), ("Both hit", "both_hit"), ("Both miss", "both_miss"))


def pairs(values: Mapping[str, object]) -> list[str]:
    return [f"{label}: {value}" for label, value in values.items()]


def section(path: Iterable[str]) -> str:
    return " > ".join(path) or NO_HEADING


def spread(label: str, figures: Mapping, name: str) -> list[str]:
    """Least, mean and most of a size."""
    return ["", f"{label}:", f"  Min: {figures[f'min_{name}']}", f"  Average: {figures[f'average_{name}']:.2f}", f"  Max: {figures[f'max_{name}']}"]


def ranked(title: str, chunks: list[Mapping]) -> list[str]:
    """A list of chunks by size; without any not even its title."""
    lines = ["", f"{title}:"] if chunks else []
    for place, c in enumerate(chunks, 1):
        lines += [f"{place}. {c['relative_path']}:{c['start_line']}-{c['end_line']}", f"   Section: {section(c['section_path'])}", f"   Size: {c['char_count']} chars, {c['line_count']} lines"]
    return lines


def statistics(figures: Mapping, max_chars: int, max_lines: int) -> list[str]:
    return [
        *pairs({"Documents": figures["document_count"], "Chunks": figures["chunk_count"]}), *spread("Characters", figures, "chars"), *spread("Lines", figures, "lines"), "",
        *pairs({"Chunks with code fence": figures["chunks_with_code_fence"], f"Chunks over {max_chars} chars": figures["chunks_over_char_limit"], f"Chunks over {max_lines} lines": figures["chunks_over_line_limit"]}),
        *ranked("Largest chunks", figures["largest"]), *ranked("Smallest chunks", figures["smallest"]),
    ]


def shown(content: str, limit: int) -> str:
    if limit == 0:
        return ""
    return content if len(content) <= limit else content[:limit].rstrip() + CUT


def hits(rows: list[Mapping], limit: int, with_lines: bool) -> list[str]:
    """Search results in order of rank, a blank line between them."""
    lines: list[str] = []
    for r in rows:
        place = [f"   Lines: {r['start_line']}-{r['end_line']}"] if with_lines else []
        text = "\n".join(f"     {line}" for line in shown(r["content"], limit).splitlines())
        lines += [""] if lines else []
        lines += [f"{r['rank']}. Score: {r['score']:.4f}", f"   Path: {r['relative_path']}", f"   Section: {section(r['section_path'])}", *place, f"   Chunk ID: {r['chunk_id']}", "   Content:", text]
    return lines or [NO_HITS]


def means(row: Mapping, top_k: int) -> list[str]:
    counts = {"Top-K": top_k, "Queries": row["query_count"], "Evaluated queries": row["evaluated_query_count"], "No-answer queries": row["no_answer_count"]}
    figures = {f"{label}@{top_k}": f"{row[name]:.4f}" for label, name in (("HitRate", "hit_rate_at_k"), ("Recall", "recall_at_k"), ("MRR", "mrr"), ("nDCG", "ndcg_at_k"))}
    return [*pairs(counts), "", *pairs(figures)]


def categories(counts: Mapping[str, int]) -> list[str]:
    return pairs({label: counts[name] for label, name in CATEGORY_LABELS})
