"""Figures of saved results: hand-made texts of each variant and what they give."""

import json

from quillgrid.sources import results

EMPTY = {"topology_source": "unknown", "main_table_id": "unknown", "main_table_row_count": 0, "avg_cells_per_item_row": 0.0, "has_qty_column": False, "final_semantic_breakdown": "", "missing_semantic_columns": "", "raw_token_count": 0}
TABLES = [{"table_id": "s", "rows": [{"row_id": "r"}], "columns": ["a"]}, {"table_id": "t", "source_engine": "grid", "rows": [{"row_id": "1", "row_role": "item_row"}, {"row_id": "2"}], "columns": ["a", "b"], "cells": [{"row_id": "1", "text": "x"}, {"row_id": "1", "text": " "}, {"row_id": "2", "text": "y"}]}]
CASES = [
    ({"metadata": {"blocks": [1, {"a": 2}], "structured_tables": TABLES, "metrics": {"row_validation": {"_x": {}, "n": 3, "t": {"total_rows": 9, "missing_semantic_columns": ["rate"], "row_diagnostics": [{"row_role": "item_row", "populated_count": 1}, {"row_role": "item_row", "cell_count": "4"}, {"populated_count": 7}]}}, "semantic_debug": {"final_column_semantics": {"t": {"c1": {"type": "QTY"}, "c2": "product", "_n": "amount", "c3": {"type": "Product"}}}}, "anchor_repair": {"enabled": True, "before_column_count": 2, "after_column_count": "8"}, "confidence_hierarchy": {"invoice_confidence": 0.81239}}}},
     {"main_table_id": "t", "main_table_row_count": 2, "main_table_column_count": 2, "avg_cells_per_item_row": 2.5, "one_cell_item_rows_count": 1, "topology_source": "grid", "final_semantic_breakdown": "product:2, qty:1", "has_qty_column": True, "has_amount_column": False, "missing_semantic_columns": "rate", "missing_semantic_columns_count": 1, "after_column_count": 8, "invoice_confidence": 0.812, "raw_token_count": 2, "table_count": 2, "anchor_repair_enabled": True}),
    ({"metadata": {"topology_source": "", "structured_tables": TABLES}}, {"main_table_id": "t", "avg_cells_per_item_row": 1.0, "one_cell_item_rows_count": 1, "table_count": 2, "topology_source": "grid"}),
    ({"metadata": {"metrics": {"topology_debug": {"main_tables": [{"table_id": "m", "row_count": 4, "column_count": 6}]}, "final_column_semantics": {"c": "amount"}, "instrumentation": {"quarantined_cell_count": 3}, "raw_token_count": "12"}}}, {"main_table_id": "m", "main_table_row_count": 4, "main_table_column_count": 6, "has_amount_column": True, "quarantined_cell_count": 3, "raw_token_count": 12}),
    ({}, EMPTY), ({"metadata": None}, EMPTY), (None, EMPTY), ("{broken", EMPTY), ([], EMPTY),
]


def test_figures_of_each_variant(spark):
    texts = [(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, (c, _) in enumerate(CASES)]
    out = results.topology_fields(spark.createDataFrame(texts, "file int, result string"))
    assert len(out.columns) == 23
    found = {r.file: r.asDict() for r in out.collect()}
    for i, (_, want) in enumerate(CASES):
        assert {k: found[i][k] for k in want} == want, i


def test_no_results(spark):
    assert results.topology_fields(spark.createDataFrame([], "file int, result string")).collect() == []
