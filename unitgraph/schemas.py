"""Explicit schemas of the tables that operators exchange."""

from __future__ import annotations

REPOS = "id bigint, name string, path string, scan_status string, created_at timestamp, scan_started_at timestamp, last_scanned_at timestamp"
FILE_HASHES = "repo_id bigint, file_path string, hash string, updated_at timestamp"
CODE_UNITS = (
    "repo_id bigint, file_path string, language string, unit_type string, qualified_name string, name string, signature string,"
    " start_line int, end_line int, body_text string, summary string, comment string, class_name string,"
    " param_names array<string>, param_types array<string>, return_type string, updated_at timestamp"
)
CALL_EDGES = "repo_id bigint, file_path string, caller string, callee string, call_line int"
REPORTS = "repo_id bigint, trigger_type string, changed_units array<string>, impact array<struct<qualified_name:string,depth:int>>, report_text string, created_at timestamp"
LLM_CACHE = "repo_id bigint, cache_key string, fingerprint string, llm_summary string, llm_tags array<string>, model string, status string, error string, hit_count bigint, updated_at timestamp"
VECTORS = "point_id string, repo_id bigint, collection string, language string, qualified_name string, vector array<float>"
CHANGED_FILES = "file_path string, language string, change_type string, diff_text string, line_ranges array<struct<r_start:int,r_end:int>>"
WATCH_EVENTS = "seq bigint, ts timestamp, path string, kind string"

#: What every extractor returns for each unit of a file, in file order.
UNIT = (
    "language string, unit_type string, qualified_name string, name string, class_name string, signature string,"
    " start_line int, end_line int, body_text string, calls array<struct<name:string,line:int>>, summary string, comment string,"
    " param_names array<string>, param_types array<string>, return_type string"
)
