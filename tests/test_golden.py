"""Golden cases of scalars, predicates and reports."""

import json
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import geometry, predicates, quantity, scalars, search
from quillgrid.operators import assign, audit, engine, finance, folds, report, score
from quillgrid.operators import rows as row_ops
from quillgrid.plans import audits
from quillgrid.sources import derived

QUANTITIES = [
    ("2.750+.250", "2.750", "0.250", True), ("4.50+.50", "4.50", "0.50", True), ("2+1", "2", "1", True), ("1*15", "0", "0", False), ("1*10", "0", "0", False), ("200ML", "0", "0", False), ("15GM", "0", "0", False),
    ("MIS", "0", "0", False), ("3*1*15", "45", "0", False), ("2 (1*10)", "20", "0", False), ("2", "2", "0", False), ("1.84", "1.84", "0", False), ("1*10 2", "2", "0", False), ("1-10 2", "2", "0", False), ("MIS 3", "3", "0", False),
    ("1:10= 2", "2", "0", False), ("2,750+,250", "2.750", "0.250", True), ("2.750 +.250", "2.750", "0.250", True), ("2.750+0.250", "2.750", "0.250", True), ("3×1×15", "45", "0", False), ("3x1x15", "45", "0", False),
]


def values(spark, rows, column, kind="string"):
    return [r.v for r in spark.createDataFrame([(x,) for x in rows], f"t {kind}").select(column(F.col("t")).alias("v")).collect()]


def test_quantities(spark):
    found = values(spark, [q for q, *_ in QUANTITIES], quantity.parsed)
    for (raw, billed, free, scheme), q in zip(QUANTITIES, found, strict=True):
        assert (raw, q.billed, q.free, q.scheme) == (raw, Decimal(billed), Decimal(free), scheme)
        assert q.total == q.billed + q.free


def test_odd_quantities(spark):
    found = values(spark, [None, "", "  ", "abc", "1,234,567", "2+", "(3)", "9" * 40], quantity.parsed)
    assert [q.method for q in found[:3]] == ["empty"] * 3 and found[3].rejected == "no_quantity_expression_found" and all(q.total is not None for q in found[:7])


def test_compound_quantities(spark):
    assert values(spark, ["2.750+.250", "3*1*15", "2 (1*10)", "1.84", "2", "hello"], quantity.is_compound) == [True, True, True, False, False, False]


def test_decimal_commas(spark):
    given = ["223,38", "345,09", "125,69", "1,234.50", "12,345", "1,23,456", None]
    assert values(spark, given, scalars.decimal_comma) == ["223.38", "345.09", "125.69", "1,234.50", "12,345", "1,23,456", None]


def test_numbers(spark):
    given = ["223,38", "12,345", "₹ 1,234.50", "1O5.5l", "2B.4", "1.234.50", "abc", "", None, "-5.00"]
    assert values(spark, given, scalars.to_decimal) == [Decimal(x) for x in ("223.38", "12345", "1234.5", "105.51", "28.4", "1234.5", "0", "0", "0", "-5")]
    assert values(spark, ["a 1,234 b 5.00 -2,50"], scalars.decimals_in) == [[Decimal("1.234"), Decimal("5"), Decimal("-2.5")]]
    assert values(spark, ["12.5034.00"], scalars.fused_decimals) == [[Decimal("12.5"), Decimal("34")]]


@pytest.mark.parametrize(("row", "formula"), [((2, 50, 100, 0), "qty_x_rate"), ((2, 50, 90, 0), "math_failed"), ((2, 50, 90, 10), "base_less_absolute_discount"), ((4, 50, 180, 10), "percentage_discount"), ((4, 50, 160, 10), "per_unit_rate_discount"), ((4, 50, 10, 10), "all_formulas_failed"), ((0, 5, 0, 0), "zero_amount")])
def test_row_formulas(spark, row, formula):
    q, r, a, d = (F.lit(Decimal(x)) for x in row)
    found = spark.range(1).select(scalars.row_formula(q, r, a, d).alias("f"), scalars.minor_formula(F.lit(row[0]), F.lit(row[1] * 100), F.lit(row[2] * 100), F.lit(row[3])).alias("m")).collect()[0]
    assert (found.f, found.m) == (formula, formula)


def test_errors(spark):
    cases = {"CUDA out of memory": ("TRANSIENT", "reduce_batch_size"), "request timeout": ("TRANSIENT", "retry_with_timeout"), "TSR returned zero cells": ("RECOVERABLE", "use_heuristic_tsr"), "token mapping failed": ("RECOVERABLE", "use_graph_fallback"), "Corrupted image": ("FATAL", "reject_image"), "boom": ("FATAL", "unknown_error")}
    found = values(spark, list(cases), predicates.error_class)
    assert [(e.type, e.action) for e in found] == list(cases.values()) and [e.retryable for e in found] == [True, True, False, False, False, False]


def test_coverage(spark):
    tokens = spark.createDataFrame([(1, i) for i in range(3)], "doc_id bigint, ord bigint")
    r = report.coverage(tokens, tokens.where("ord = 0")).collect()[0]
    assert (r.share, r.passed, r.mapped) == (3333, False, 1)
    assert assign.orphans(tokens, tokens.where("ord = 0")).count() == 2


def test_turns_undo_each_other(spark):
    for turn in (0, 90, 180, 270):
        x, y = geometry.quarter_turned(F.lit(30.0), F.lit(70.0), turn, F.lit(200.0), F.lit(500.0))
        back = geometry.quarter_back(x, y, turn, F.lit(200.0), F.lit(500.0))
        assert tuple(spark.range(1).select(*back).collect()[0]) == (30.0, 70.0)


def test_boxes_of_polygons(spark):
    found = values(spark, [[[1.0, 2.0], [5.0, 2.0], [5.0, 9.0], [1.0, 8.0]], [[1.0, 2.0]]], geometry.polygon_box, "array<array<double>>")
    assert [tuple(b) for b in found] == [(1.0, 5.0, 2.0, 9.0), (0.0, 0.0, 0.0, 0.0)]


def page(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(rng.randint(1, 40)):
        x, y = rng.randint(0, 600), rng.choice([10, 34, 58, 82]) + rng.randint(-4, 4)
        rows.append((1, i, x, x + rng.randint(10, 80), y, y + rng.randint(8, 16)))
    return pd.DataFrame(rows, columns=["doc_id", "ord", "min_x", "max_x", "min_y", "max_y"])


@pytest.mark.parametrize("seed", range(8))
def test_row_clusters_like_plain_loops(seed):
    frame = page(seed)
    rows = []
    for r in sorted(frame.itertuples(), key=lambda r: (r.min_y + r.max_y) / 2):
        for row in rows:
            cy, h = (sum(f(x) for x in row) / len(row) for f in (lambda x: (x.min_y + x.max_y) / 2, lambda x: x.max_y - x.min_y))
            common = min(cy + h / 2, r.max_y) - max(cy - h / 2, r.min_y)
            if common > 0 and common / min(h, r.max_y - r.min_y) > 0.4:
                row.append(r)
                break
        else:
            rows.append([r])
    expected = {x.ord: i for i, row in enumerate(rows) for x in row}
    found = folds.cluster_rows(frame.sample(frac=1, random_state=seed))
    assert dict(zip(found.ord, found.row_index, strict=True)) == expected
    moved = folds.cluster_rows(frame.assign(min_y=frame.min_y + 100, max_y=frame.max_y + 100))
    assert dict(zip(moved.ord, moved.row_index, strict=True)) == expected


def test_folds_on_small_inputs():
    bands = pd.DataFrame({"doc_id": 1, "start": [0, 10, 50, 300, 330], "stop": [40, 60, 70, 320, 360], "tokens": 10, "numbers": [0, 0, 0, 9, 9]})
    assert folds.spans(bands)[["start", "stop"]].values.tolist() == [[0, 70], [300, 360]]
    row = pd.DataFrame({"doc_id": 1, "start": [0, 60, 117, 173], "stop": [26, 88, 144, 200], "tokens": 1, "numbers": 0})
    # gaps 34, 29 and 29: only the first stands behind a span under 27 pixels, and costs 27.2
    assert folds.spans(row, most=3)[["start", "stop"]].values.tolist() == [[0, 88], [117, 144], [173, 200]]
    assert folds.stable_bands(bands)[["start", "stop"]].values.tolist() == [[0, 70], [300, 320], [330, 360]]
    columns = pd.DataFrame({"doc_id": 1, "col_no": [0, 1, 2], "min_x": [0, 90, 200], "max_x": [100, 190, 300], "filled": [2, 9, 4]})
    assert folds.stabilised_columns(columns).kept_col.tolist() == [1, 1, 2]
    anchors = pd.DataFrame({"doc_id": 1, "ord": range(4), "anchor_x": [10.0, 20.0, 60.0, 65.0]})
    assert folds.anchor_clusters(anchors).cluster.tolist() == [0, 0, 1, 1]
    rows = pd.DataFrame({"doc_id": 1, "row_no": [1, 2, 3], "min_x": [40, 50, 40], "min_y": [10, 26, 80], "max_y": [24, 40, 94], "numbers": [4, 0, 4], "priced": [True, False, True]})
    assert folds.multiline_merge(rows).merged_into.tolist() == [1, 1, 3]
    boxes = pd.DataFrame({"doc_id": 1, "min_x": [0, 102, 0, 5], "max_x": [100, 200, 90, 6], "min_y": [0, 1, 40, 80], "max_y": [20, 21, 60, 81]})
    assert len(folds.clean_boxes(boxes)) == 2
    assert folds.line_view(page(1))["line"].min() == 0
    pairs = pd.DataFrame({"doc_id": 1, "band": [0, 1, 2], "ids": [[1, 2], [2, 3], [4]]})
    assert folds.disjoint_pair(pairs).band.tolist() == [0, 2]


def test_documents_are_independent(spark):
    one, two = page(3), page(4).assign(doc_id=2)
    schema = "doc_id bigint, ord bigint, row_index bigint"
    both = folds.folded(spark.createDataFrame(pd.concat([one, two])), folds.cluster_rows, schema).toPandas()
    alone = folds.folded(spark.createDataFrame(two), folds.cluster_rows, schema).toPandas()
    key = ["ord", "row_index"]
    assert both[both.doc_id == 2][key].sort_values("ord").values.tolist() == alone[key].sort_values("ord").values.tolist()


def test_labels_and_reasons(spark):
    rows = spark.createDataFrame([(1, 1, ["SUB TOTAL", "100.00"]), (1, 2, ["SGST 2.50", "2.50"]), (1, 3, ["PHONE 12 GRAND TOTAL", "900.00"]), (1, 4, ["nothing"])], "doc_id bigint, row_no int, cells array<string>")
    found = {r.label: r for r in finance.label_candidates(rows).collect()}
    assert (found["parsed_subtotal"].strategy, found["sgst"].strategy) == ("right_cell", "right_cell_after_tax_rate") and set(found) == {"parsed_subtotal", "sgst", "parsed_grand_total"}
    reasons = {r.label: r.reason for r in finance.rejected(finance.label_candidates(rows), spark.createDataFrame([(1, Decimal(100))], "doc_id bigint, subtotal decimal(20,4)")).collect()}
    assert reasons == {"parsed_subtotal": None, "sgst": None, "parsed_grand_total": "metadata_polluted"}


def test_audit_words(spark):
    assert values(spark, ["P CODE", "RSN", "Qty", "GREES AMT", "xyz"], audit.header_role) == ["pcode", "hsn", "qty", "gross", None]
    assert values(spark, ["12.5.3", "200.1 200.3", "2+1", "5"], audit.suspicious) == [True, True, False, False]


def test_stability_is_a_product(spark):
    r = spark.range(1).select(score.row_stability({"mismatch": F.lit(2), "off": F.lit(True), "empty": F.lit(False)}).alias("s")).collect()[0]
    assert r.s == round(0.85**2 * 0.6, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, row_no int, ord bigint, col_no int, text string, min_x bigint, max_x bigint, min_y bigint, max_y bigint")
    assert row_ops.visual_rows(none).count() == 0 and assign.neighbours(none).count() == 0 and report.occupancy(none).count() == 0 and report.markdown(none).count() == 0


def test_invoices_need_no_row_or_column_numbers(spark):
    """Rows and columns come from texts and boxes: pages of another place, scale and set of columns, each cell back where it was written."""
    written = derived.tokens(spark, "/root/testdata/sf0.001").where("doc_id % 40 = 1 and (doc_id % 80 = 1 or col_no <> 3)")
    x, y = 1.3, 1.5
    moved = {c: (F.col(c) * (x if c.endswith("x") else y) + 211).cast("bigint") for c in ("min_x", "max_x", "min_y", "max_y")}
    pages = written.withColumns(moved).cache()
    bare = pages.select("doc_id", (F.col("ord") * 3 + 5).alias("ord"), "text", "min_x", "max_x", "min_y", "max_y")
    found = {(r.doc_id, (r.ord - 5) // 3): (r.cell_row, r.cell_col) for r in engine.heuristic(bare).owned.collect()}
    short = {r.doc_id for r in pages.select("doc_id").distinct().collect() if r.doc_id % 80 != 1}
    rows = pages.collect()
    right = sum(found.get((r.doc_id, r.ord)) == (r.row_no, r.col_no - (r.doc_id in short and r.col_no > 3)) for r in rows)
    assert short and right >= 0.98 * len(rows)
    judged = audits.invoices(bare).collect()
    assert len(judged) == len({r.doc_id for r in rows}) and {r.status for r in judged} == {"PASS"}


def first_of_key(data, key, left=4):
    if left < 0:
        return None
    if isinstance(data, dict) and key in data:
        return data[key]
    for value in data.values() if isinstance(data, dict) else data if isinstance(data, list) else ():
        found = first_of_key(value, key, left - 1)
        if found is not None:
            return found
    return None


def test_keys_are_found_at_any_depth_as_by_a_plain_walk(spark):
    """Random records with null and false values, texts that look like records, lists in lists, and depths beyond the bound."""
    rng = random.Random(3)

    def made(n):
        r = rng.random()
        if n == 0 or r < 0.2:
            return rng.choice([1, 0, "x", '{"k": 9}', None, True, False, "", 2.5])
        return {rng.choice("kzabc"): made(n - 1) for _ in range(rng.randint(0, 3))} if r < 0.7 else [made(n - 1) for _ in range(rng.randint(0, 3))]

    docs = [made(7) for _ in range(500)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, None), (-2, "{bad"), (-3, "")], "i int, j string")
    found = {r.i: r.v for r in rows.select("i", search.find_key(F.col("j"), "k").alias("v")).collect()}
    assert found[-1] is found[-2] is found[-3] is None
    for i, d in enumerate(docs):
        expected = first_of_key(d, "k")
        assert found[i] == expected if expected is None or isinstance(expected, str) else json.loads(found[i]) == expected, d
