"""Every registered query of the library's own operators, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import flows, graph, primitives, records, refine, regions, scalars, tables

MODULES = (regions, scalars, graph, tables, records, flows, refine, primitives)


#: Columns whose SQL type is given, so that both sides agree in it.
CASTS = {
    "regions_from_html": {"chars": "bigint"}, "doc_summary": {"n_tables": "bigint", "n_figures": "bigint"}, "empty_values": {"empty": "bigint"}, "hkg_summary": {"chars": "bigint"}, "overlap_tail": {"tail_chars": "int"},
    "extraction_batches_atomic": {"char_count": "bigint"}, "extraction_batches_shatter": {"chars": "bigint"}, "words_in_box": {"chars": "bigint"}, "anchor_words": {"n_anchors": "bigint"}, "table_route": {"n_anchors": "bigint"},
    "ruled_cells": {"col_no": "int"}, "corpus_success": {"n_success": "bigint", "n_failure": "bigint"}, "stream_graph_build": {"n_regions": "bigint"}, "structure_cells": {"row_no": "int", "col_no": "int"}, "extraction_status": {"n_ok": "bigint"},
    "scorecard": {"schema_validity_rate": "double", "non_empty_extraction_rate": "double", "grounded_reference_rate": "double", "required_total": "bigint", "required_missing_count": "bigint"},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    every = {name: sql for m in MODULES for name, sql in m.O.items()}
    for name, casts in CASTS.items():
        replaced = ", ".join(f"cast({c} as {t}) as {c}" for c, t in casts.items())
        every[name] = f"select * replace ({replaced}) from ({every[name]})"
    return every
