"""Schemas of the tables and files the engine reads and writes."""

from __future__ import annotations

#: Kinds of chunks and of code elements.
CHUNK_TYPES = ("text", "table", "image_heavy_page", "mixed", "code")
CODE_ELEMENTS = ("module", "class", "function", "method", "property", "constant", "import", "comment", "unknown")

METADATA = "source_file string, chunk_id int, page_number int, chunk_type string, text_length int, preview string"
PDF = (
    "total_pages int, num_tables int, num_images int, image_coverage_ratio double, table_content array<string>, is_vision_processed boolean, "
    "image_details array<struct<index: int, bbox: array<double>, area: double, width: double, height: double>>, "
    "bounding_boxes array<struct<bbox: array<double>, rows: int, cols: int>>"
)
CHUNKS_FILE = "content string, metadata string"
QUERIES_FILE = "queries array<struct<query_id: string, query_text: string>>"
JUDGEMENT = "struct<query_id: string, query_text: string, relevant_doc_ids: array<string>, metadata: map<string, string>>"
JUDGEMENTS_FILE = f"queries array<{JUDGEMENT}>"
HIT = "struct<id: bigint, score: double, content: string, source_file: string, page_number: int, chunk_type: string, preview: string>"
RESULTS_FILE = f"metadata map<string, string>, queries array<struct<query_id: string, query_text: string, results: array<{HIT}>>>"
