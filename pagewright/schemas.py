"""Schemas of the stage artifacts, composed from one another. All columns are nullable on disk."""

from __future__ import annotations

from pyspark.sql.types import StructType

BBOX = "struct<l: double, t: double, r: double, b: double>"
REGION = f"struct<id: bigint, category: string, bbox: {BBOX}, score: double, polygon: array<struct<x: double, y: double>>, reading_order: bigint, parent_id: bigint>"
CELL = "struct<text: string, r0: int, r1: int, c0: int, c1: int, row_span: int, col_span: int, column_header: boolean>"
TABLE = f"struct<cells: array<{CELL}>, num_rows: int, num_cols: int>"
ITEM = f"struct<ord: int, kind: string, label: string, text: string, level: int, bbox: {BBOX}, cells: array<{CELL}>, num_rows: int, num_cols: int>"
DOCUMENT = f"struct<name: string, page: struct<width: double, height: double>, items: array<{ITEM}>>"
OPCODES = "array<struct<tag: string, i1: int, i2: int, j1: int, j2: int>>"
TEXT_COMPARISON = (
    f"struct<similarity: double, opcodes: {OPCODES}, pred_tokens: array<string>, base_tokens: array<string>, common: bigint, removed: bigint, added: bigint, "
    f"pred_lines: array<string>, base_lines: array<string>, line_opcodes: {OPCODES}, inline_word_opcodes: map<string, {OPCODES}>, "
    "lines_added: bigint, lines_removed: bigint, lines_unchanged: bigint>"
)

_PAGES = "page_id string, file_id string, barcode string, sequence bigint, source_uri string, width bigint, height bigint, dpi bigint"
_COST = (
    "gpu_type string, provider string, cost_per_hour double, elapsed_seconds double, input_tokens bigint, output_tokens bigint, litellm_cost double, "
    "gpu_time_cost double, kv_cache_memory_bytes bigint, concurrent_requests bigint, region_concurrency bigint"
)
_RAW = "model string, output_format string, raw_payload string, tokens bigint, error string"
_FLAT = "text_similarity double, text_cer double, text_wer double, document_heading_count_delta bigint, document_table_count_delta bigint, document_picture_count_delta bigint, layout_iou_mean double"

_DDL = {
    "pages": f"{_PAGES}, extra_json string",
    "layout": f"{_PAGES}, detector string, detect_seconds double, detect_error string, extra_json string, regions_json string",
    "raw": f"{_PAGES}, {_RAW}, {_COST}, extra_json string",
    "train": f"{_PAGES}, {_RAW}, {_COST}, document_json string, markdown string, text string, reference_text string, {_FLAT}, extra_json string, reference_provenance_json string, metrics_json string, comparisons_json string",
    "volumes": "barcode string, title string, language string, year bigint, rights string, page_count bigint, source_uri string, creators_json string, extra_json string",
    "requests": "page_id string, model string, cost double, tokens_in bigint, tokens_out bigint, start_s double, end_s double",
}
#: Stage artifacts in the order in which a folder is searched for them.
STAGES = ("pages", "layout", "raw", "train")
#: Columns without which a row of an artifact means nothing.
REQUIRED = {"pages": ["page_id", "file_id"], "layout": ["page_id", "file_id"], "raw": ["page_id", "file_id", "model", "output_format", "raw_payload"], "train": ["page_id", "file_id", "model", "output_format", "raw_payload"], "volumes": ["barcode"]}
#: What makes two rows the same piece of work.
RESUME_KEYS = {"page": ["page_id"], "page_model": ["page_id", "model"], "off": []}


def ddl(name: str) -> str:
    """An artifact's columns as text, for where there is no session."""
    return _DDL[name]


def schema(name: str) -> StructType:
    """The StructType of an artifact."""
    return StructType.fromDDL(_DDL[name])
