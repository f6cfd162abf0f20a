"""Queries over page orientation, anchored items, financial cells and shapes of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, headers, orientation
from ..sources import derived, results
from .sql import with_lines, with_tokens


def page_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn that rows speak for, where the boxes agree with confidence; else none."""
    tokens = derived.tokens(spark, sf_dir)
    gate = evidence.applied_turn(evidence.box_turns(tokens)).select("doc_id", F.col("turn").alias("sure"))
    found = orientation.orientation(tokens).join(gate, "doc_id")
    return found.groupBy(F.when(F.col("turn") == F.col("sure"), F.col("turn")).otherwise(0).alias("turn")).agg(F.count("*").alias("n"))


def financial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orientation.financial_cells(derived.tokens(spark, sf_dir)).groupBy("col_no", "kind").agg(F.count("*").alias("n"))


def anchored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = derived.tokens(spark, sf_dir)
    rows = tokens.groupBy("doc_id", "row_no").agg(F.max(F.col("text").rlike(r"^\d{7,9}$") & (F.col("ord") % 3 != 0)).alias("anchor"), F.count("*").alias("n"))
    return orientation.anchored_rows(rows).groupBy("doc_id", "item").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))


def headed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orientation.whole_rows(derived.tokens(spark, sf_dir))
    return rows.select("doc_id", "row_no", F.col("columns")["AMOUNT"].alias("amount"), F.col("columns")["PRODUCT"].alias("product"), F.size("columns").cast("bigint").alias("n"))


def result_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of results written from events: each kind of event stands for a schema."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    body = F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"metadata":{"metrics":{"rows_math_passed":3,"parsed_grand_total":'), cents, F.lit("}}}"))).when(F.col("event_type") == "view", F.lit('{"reconstructed_rows":[1],"rows_math_failed":2}')).when(F.col("event_type") == "click", F.concat(F.lit('{"items":[],"grand_total":'), cents, F.lit("}"))).otherwise(F.col("props"))
    shaped = orientation.result_shape(events.select(body.alias("result")))
    return shaped.groupBy("shape").agg(F.count("*").alias("n"), F.sum("passed").cast("bigint").alias("passed"), F.sum("failed").cast("bigint").alias("failed"), F.sum(F.col("grand_total").cast("bigint")).alias("grand_total"))


def result_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a result for each order, which in turns tells of its rows by validation, by its tables, or by a report alone."""
    name = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    row = F.struct(F.col("ord").cast("string").alias("row_id"), F.when(F.col("ord") > 1, "item_row").otherwise("header_row").alias("row_role"), (F.col("qty") % 4).alias("populated_count"))
    docs = derived.lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
    lacks = F.when(F.col("n") % 2 == 1, F.array(F.lit("rate"), F.lit("amount"))).otherwise(F.array(F.lit("rate")))
    validated = F.struct(F.col("n").alias("total_rows"), lacks.alias("missing_semantic_columns"), F.col("rows").alias("row_diagnostics"))
    means = F.create_map(name, F.create_map(F.lit("c0"), F.lit("Product"), F.lit("c1"), F.lit("QTY"), F.lit("c2"), F.when(F.col("n") > 3, "expiry").otherwise("product")))
    checked = F.struct(F.create_map(name, validated).alias("row_validation"), means.alias("final_column_semantics"), F.struct((F.col("doc_id") % 5).cast("string").alias("quarantined_cell_count")).alias("instrumentation"))
    cells = F.transform("rows", lambda r: F.struct(r["row_id"].alias("row_id"), F.when(r["populated_count"] > 0, "x").otherwise(" ").alias("text")))
    table = F.struct(name.alias("table_id"), F.lit("grid").alias("source_engine"), F.col("rows").alias("rows"), F.array(F.lit("a"), F.lit("b")).alias("columns"), cells.alias("cells"))
    spare = F.struct(F.lit("spare").alias("table_id"), F.lit("none").alias("source_engine"), F.slice("rows", 1, 0).alias("rows"), F.array(F.lit("a")).alias("columns"), F.slice(cells, 1, 0).alias("cells"))
    report = F.struct(F.struct(F.array(F.struct(name.alias("table_id"), F.col("n").alias("row_count"), (F.col("n") + 1).alias("column_count"))).alias("main_tables")).alias("topology_debug"), (F.col("n") / 16).alias("invoice_confidence"))
    inner = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(checked.alias("metrics")))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.array(spare, table).alias("structured_tables")))).otherwise(F.to_json(F.struct(report.alias("metrics"))))
    return results.topology_fields(docs.select("doc_id", F.concat(F.lit('{"metadata":'), inner, F.lit("}")).alias("result")))


def header_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of columns in hundredths of a pixel, from headers every other word of which stands on a second line on odd pages."""
    second = F.when((F.col("row_no") == 0) & (F.col("doc_id") % 2 == 1) & (F.col("col_no") % 2 == 0), 12).otherwise(0)
    tokens = derived.tokens(spark, sf_dir).withColumn("min_y", F.col("min_y") + second).withColumn("max_y", F.col("max_y") + second)
    fine = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("bigint").alias(c)
    return headers.column_bands(headers.header_line(tokens)).select("doc_id", "band", fine("header_y"), fine("min_x"), fine("max_x"))


QUERIES = {f.__name__: f for f in (page_orientation, financial_cells, anchored_items, headed_rows, result_shapes, result_fields, header_bands)}
_HEADS = """heads AS (SELECT doc_id, ord, (min_x + max_x) / 2.0::DOUBLE AS x, (min_y + max_y) / 2.0::DOUBLE + CASE WHEN row_no = 0 AND doc_id % 2 = 1 AND col_no % 2 = 0 THEN 12 ELSE 0 END AS y, CASE text WHEN 'HSN' THEN 'hsn' WHEN 'QTY' THEN 'qty' WHEN 'DISC' THEN 'discount' WHEN 'CGST' THEN 'cgst' WHEN 'SGST' THEN 'sgst' END AS role FROM tokens WHERE text IN ('HSN', 'QTY', 'DISC', 'CGST', 'SGST')),
line AS (SELECT doc_id, round_even(y / 10, 0) * 10 AS bucket FROM heads GROUP BY doc_id, round_even(y / 10, 0) * 10 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sum(CASE WHEN role = 'hsn' THEN 2 ELSE 1 END) DESC, min(ord)) = 1),
near AS (SELECT doc_id, avg(y) AS header_y, avg(x) FILTER (role = 'hsn') AS hsn, avg(x) FILTER (role = 'qty') AS qty, avg(x) FILTER (role = 'discount') AS disc, coalesce(avg(x) FILTER (role = 'cgst'), 650) AS cgst, coalesce(avg(x) FILTER (role = 'sgst'), 680) AS sgst FROM heads JOIN line USING (doc_id) WHERE abs(y - bucket) <= 18 GROUP BY doc_id),
known AS (SELECT doc_id, header_y, coalesce(hsn, 286) AS hsn, coalesce(qty, 408) AS qty, coalesce(disc, 550) AS disc, cgst, sgst, lo, hi FROM near JOIN (SELECT doc_id, min(min_x) AS lo, max(max_x) AS hi FROM tokens GROUP BY doc_id) USING (doc_id)),
ends AS (SELECT doc_id, header_y, unnest([{'band': 'sl_no', 'a': greatest(lo, 78), 'b': 98::DOUBLE}, {'band': 'pcode', 'a': 92, 'b': 148}, {'band': 'description', 'a': 142, 'b': (198 + hsn) / 2 + 4}, {'band': 'hsn', 'a': (198 + hsn) / 2 + 5, 'b': (hsn + 321) / 2 + 5}, {'band': 'upc', 'a': (hsn + 321) / 2 + 5, 'b': 337.5}, {'band': 'mrp', 'a': 337.5, 'b': 382},
  {'band': 'qty', 'a': qty - 18, 'b': qty + 22}, {'band': 'gross', 'a': 423, 'b': 469}, {'band': 'discount', 'a': disc - 22, 'b': disc + 22}, {'band': 'taxable', 'a': 566, 'b': 612}, {'band': 'cgst', 'a': cgst - 24, 'b': cgst + 24}, {'band': 'sgst', 'a': sgst - 24, 'b': sgst + 24}, {'band': 'net_amt', 'a': greatest(hi - 62, sgst + 16), 'b': least(hi + 8, hi + 12)}]) AS e FROM known)"""

ORACLES = {
    "header_bands": with_tokens("SELECT doc_id, e.band AS band, CAST(floor(header_y * 100 + 0.5) AS BIGINT) AS header_y, CAST(floor(e.a::DOUBLE * 100 + 0.5) AS BIGINT) AS min_x, CAST(floor(e.b::DOUBLE * 100 + 0.5) AS BIGINT) AS max_x FROM ends", _HEADS),
    "result_fields": with_lines("""SELECT doc_id, CASE v WHEN 1 THEN 'grid' ELSE 'unknown' END AS topology_source, CASE v WHEN 2 THEN round(n / 16.0::DOUBLE, 3) ELSE 0.0::DOUBLE END AS invoice_confidence, 0::BIGINT AS raw_token_count, CASE v WHEN 1 THEN 2 ELSE 0 END::BIGINT AS table_count, 't' || doc_id AS main_table_id,
  n AS main_table_row_count, CASE v WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE n + 1 END::BIGINT AS main_table_column_count, CASE v WHEN 0 THEN round(filled::DOUBLE / counted, 2) WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_cells_per_item_row, CASE v WHEN 0 THEN few WHEN 1 THEN counted ELSE 0 END::BIGINT AS one_cell_item_rows_count,
  false AS anchor_repair_enabled, 0::BIGINT AS before_column_count, 0::BIGINT AS after_column_count, CASE WHEN v > 0 THEN '' WHEN n > 3 THEN 'expiry:1, product:1, qty:1' ELSE 'product:2, qty:1' END AS final_semantic_breakdown, v = 0 AS has_product_column, false AS has_batch_column, v = 0 AND n > 3 AS has_expiry_column, v = 0 AS has_qty_column, false AS has_rate_column, false AS has_amount_column,
  CASE v WHEN 0 THEN doc_id % 5 ELSE 0 END::BIGINT AS quarantined_cell_count, CASE WHEN v > 0 THEN 0 ELSE 1 + n % 2 END::BIGINT AS missing_semantic_columns_count, CASE WHEN v > 0 THEN '' WHEN n % 2 = 1 THEN 'rate,amount' ELSE 'rate' END AS missing_semantic_columns
FROM (SELECT doc_id, doc_id % 3 AS v, max(n) AS n, count(*) AS counted, sum(qty % 4) AS filled, count(*) FILTER (qty % 4 <= 1) AS few FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) WHERE ord > 1 OR n = 1 GROUP BY doc_id)"""),
    "page_orientation": with_tokens("SELECT 0 AS turn, count(DISTINCT doc_id) AS n FROM tokens"),
    "financial_cells": with_tokens("SELECT col_no, kind, count(*) AS n FROM tokens JOIN (VALUES ('totals', 'TOTAL|NET|PAYABLE'), ('taxes', 'GST|TAX|CESS'), ('discounts', 'DISC|LESS'), ('amounts', '\\d+\\.\\d{2}')) v(kind, p) ON regexp_matches(upper(text), p) GROUP BY col_no, kind"),
    "anchored_items": with_tokens("SELECT doc_id, item, count(*) AS rows, sum(n)::BIGINT AS tokens FROM (SELECT *, sum(anchor::INT) OVER (PARTITION BY doc_id ORDER BY row_no)::BIGINT AS item FROM (SELECT doc_id, row_no, max(regexp_matches(text, '^\\d{7,9}$') AND ord % 3 <> 0) AS anchor, count(*) AS n FROM tokens GROUP BY doc_id, row_no)) WHERE item > 0 GROUP BY doc_id, item"),
    "headed_rows": with_tokens("SELECT doc_id, row_no, max(text) FILTER (col_no = 7) AS amount, max(text) FILTER (col_no = 0) AS product, count(*) AS n FROM tokens WHERE row_no > 0 GROUP BY doc_id, row_no"),
    "result_shapes": "SELECT CASE event_type WHEN 'purchase' THEN 'runtime' WHEN 'view' THEN 'reconstructed' WHEN 'click' THEN 'extracted' ELSE 'unsupported' END AS shape, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN event_type = 'view' THEN 2 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN event_type IN ('purchase', 'click') THEN CAST(round(value * 100) AS BIGINT) END)::BIGINT AS grand_total FROM events GROUP BY 1",
}
