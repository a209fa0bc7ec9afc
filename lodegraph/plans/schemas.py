"""The tables of a snapshot."""

from __future__ import annotations

from lodegraph.parse.frames import PARSED

VERSION = 3
_STATUS = "summary_status string, summary_model string, summary_prompt_ver string, summary_updated_at timestamp"
TABLES = {
    "files": f"file_id long, file_path string, language string, hash string, file_summary string, {_STATUS}, embedding_status string, embedding_model string, created_at timestamp, updated_at timestamp",
    "nodes": f"node_id long, file_id long, name string, kind string, signature string, start_line int, end_line int, is_exported boolean, summary string, {_STATUS}, source_code string, embedding_status string, embedding_model string, created_at timestamp, updated_at timestamp",
    "facts": PARSED,
    "edges": "source long, target long, kind string, weak boolean",
    "resources": "resource_id long, type string, source_path string, name string, content string, summary string, hash string",
    "resource_edges": "edge_id long, resource_id long, file_id long, kind string, similarity double, confidence double, link_type string",
    "file_vectors": "id long, embedding array<float>",
    "node_vectors": "id long, embedding array<float>",
    "resource_vectors": "id long, embedding array<float>",
}
NODE_KINDS = {"module", "function", "class", "type", "variable", "hook", "component", "method"}
EDGE_KINDS = {"imports", "calls", "refs", "extends", "implements"}
