"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import facts, pipeline, problems, structure

MODULES = [structure, facts, pipeline, problems]


#: Columns whose type the oracle's engine gives wider than the query has it.
CASTS = {
    "INT": {
        "split_lines": ["line_no"], "clean_cell_text": ["row_index", "column_index"], "clean_rows": ["row_index"], "split_headers": ["n_headers", "n_rows"], "table_row_ids": ["row_index"], "merge_prose_blocks": ["n_lines"], "join_lines": ["n_chars"],
        "parse_pairs": ["ord"], "reconstruct_tables": ["n_rows"], "structured_chunks": ["estimated_tokens"], "rank_evidence": ["rank"], "unit_vectors": ["d"], "keyword_score": ["score"], "top_contexts": ["score", "rank"], "half_context": ["n_chars"],
        "serialize_context": ["n_chars"], "centroids": ["d"], "line_bbox": ["page_number", "line_no"], "split_tables": ["n_rows"], "round_robin_budget": ["round", "position"],
    },
    "BIGINT": {"split_tables": ["n_tokens"], "structured_chunks": ["packed_tokens"], "evidence_chunks": ["estimated_tokens"], "round_robin_budget": ["so_far"]},
    "DOUBLE": {"line_bbox": ["x0", "y0", "x1", "y1"]},
}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for kind, by_query in CASTS.items() for c in by_query.get(name, []))
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS r" if casts else sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _typed(n, s) for m in MODULES for n, s in m.SQL.items()}
