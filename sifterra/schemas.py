"""Schemas of the engine's tables."""

from __future__ import annotations




DOCUMENTS = "document_id string, source_name string, relative_path string, content string, content_hash string"
SECTIONS = "document_id string, section_ordinal int, section_path array<string>, content string, start_line int, content_start_line int, end_line int"
CHUNKS = (
    "chunk_id string, document_id string, source_name string, relative_path string, title string, section_path array<string>, content string, "
    "searchable_text string, chunk_index int, section_chunk_index int, start_line int, end_line int, content_hash string"
)
GOLDEN = "query_id string, query string, relevant_chunks array<struct<chunk_id: string, relative_path: string, section_path: array<string>, relevance: int>>, notes string"
RETRIEVED = "struct<chunk_id: string, rank: int, score: double, relevance: int, relative_path: string, section_path: array<string>, content: string>"
QUERY_EVAL = (
    f"query_id string, query string, relevant_chunk_ids array<string>, retrieved_chunks array<{RETRIEVED}>, "
    "first_relevant_rank int, hit_rate_at_k double, recall_at_k double, reciprocal_rank double, ndcg_at_k double"
)
DENSE = "chunk_pos long, chunk_id string, embedding array<float>"

CHUNK_FIELDS = [f.split()[0] for f in CHUNKS.replace("array<string>", "array").split(", ")]
