"""Explicit schemas of what passes between stages."""

from __future__ import annotations

REQUESTS = "request_id string, document_url string"
QUESTIONS = "request_id string, q_pos int, question string"
RAW = "path string, modificationTime timestamp, length bigint, content binary"
PARSED = "text string, tables array<array<array<string>>>, status string"
GRIDS = "doc_id bigint, table_idx int, row_idx int, cells array<string>"
CHUNKS = "doc_id bigint, chunk_index int, text string"
PAYLOAD = "struct<text:string,source_file:string,chunk_index:int>"
POINTS = f"id bigint, vector array<float>, payload {PAYLOAD}"
HITS = "request_id string, q_pos int, rank int, score double, point_id bigint, text string"
ANSWERS = "answers array<string>"
STATUSES = ("ok", "not_found", "too_large", "unsupported", "parse_error", "backend_missing", "no_chunks", "no_answers", "answer_count_mismatch")
