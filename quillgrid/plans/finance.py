"""Queries over row arithmetic, totals and taxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import finance
from ..sources import derived
from .sql import with_footers, with_lines


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with some amounts made wrong, so that checks fail too."""
    return derived.lines(spark, sf_dir).withColumn("amount", F.when(F.col("part") % 17 == 0, F.col("amount") + 5000).otherwise(F.col("amount")))


def row_math_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finance.row_math(_spoilt(spark, sf_dir))
    return rows.groupBy("formula", "passed").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount"))


def duplicate_amount_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finance.duplicates(derived.lines(spark, sf_dir), 100_000).where("same_amount > 1")
    return rows.select("doc_id", "ord", "amount", "same_amount")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finance.row_math(_spoilt(spark, sf_dir))
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.sum("amount").alias("subtotal"), F.sum(F.expr("(amount * tax + 50) div 100")).alias("tax"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as doc_id", "cast(round(o_totalprice * 100) as bigint) as grand")
    return docs.join(orders, "doc_id", "left")


def invoice_subtotal_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    none = F.lit(None).cast("bigint")
    values = docs.select("doc_id", F.col("subtotal").alias("parsed_subtotal"), none.alias("discount"), F.expr("tax div 2").alias("sgst"), F.expr("tax - tax div 2").alias("cgst"), none.alias("igst"), none.alias("cr_dr_note"), F.when(F.col("doc_id") % 4 == 0, F.col("subtotal") + F.col("tax") + F.col("doc_id") % 150).otherwise(F.col("grand")).alias("parsed_grand_total"), none.alias("roundoff"))
    return finance.reconciled(values).select("doc_id", "expected", "off", "status")


def subscore_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    t = docs.select("doc_id", "n_rows", "passed", "failed", F.col("grand").isNotNull().alias("found_total"), F.coalesce(F.abs(F.col("grand") - F.col("subtotal") - F.col("tax")) <= 100, F.lit(False)).alias("total_matches"), F.lit(True).alias("found_subtotal"), "tax", "subtotal", (F.col("n_rows") >= 2).alias("complete"))
    return finance.sub_scores(t).select("doc_id", "math", "totals", "gst", "structure", "completeness", "integrity", "status")


def gst_ratio_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    ratio = F.expr("100 * tax div greatest(subtotal, 1)")
    return docs.groupBy(ratio.alias("percent")).agg(F.count("*").alias("n"))


def _footer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footer rows as cells: label and value apart, in one cell, or behind a rate, by document."""
    feet = derived.footers(derived.lines(spark, sf_dir))
    value = derived.money(F.col("value"))
    way = F.col("doc_id") % 4
    cells = F.when(way == 0, F.array("label", value)).when(way == 1, F.array(F.concat("label", F.lit(" "), value))).when(way == 2, F.array(F.concat("label", F.lit(" 2.50")), value)).otherwise(F.array(F.lit("x"), "label", value))
    return feet.select("doc_id", "row_no", cells.alias("cells"))


def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = finance.best_by_label(finance.label_candidates(_footer_rows(spark, sf_dir)))
    return found.select("doc_id", "row_no", "label", F.floor(F.col("value") * 100).cast("bigint").alias("value"), "strategy", "ambiguity")


def rejected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = finance.label_candidates(_footer_rows(spark, sf_dir))
    sums = derived.lines(spark, sf_dir).groupBy("doc_id").agg((F.sum("amount") / 100).cast("decimal(20,4)").alias("subtotal"))
    return finance.rejected(found, sums).groupBy("label", "reason").agg(F.count("*").alias("n"))


def tax_pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = finance.label_candidates(_footer_rows(spark, sf_dir))
    shaken = found.withColumn("value", F.when((F.col("label") == "cgst") & (F.col("doc_id") % 5 == 0), F.col("value") + F.col("doc_id") % 3).otherwise(F.col("value")))
    pairs = finance.tax_pairs(shaken)
    return pairs.select("doc_id", "s_row", "c_row", F.floor(F.col("s") * 100).cast("bigint").alias("s"), F.floor(F.col("c") * 100).cast("bigint").alias("c"))


def grand_total_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = derived.footers(derived.lines(spark, sf_dir)).select("doc_id", "row_no", F.col("label").alias("text"), (106 + 24 * F.col("row_no")).cast("bigint").alias("center_y"))
    return finance.grand_total_rank(feet).select("doc_id", "row_no", F.col("words").cast("bigint").alias("words"), "score", "place")


#: How labels of totals may be misread, by the document (%).
MISREAD = (("O", "0"), ("TOTAL", "TOTL"), ("GRAND", "GRAN"), ("SUB", "NET"), ("GRAND TOTAL", "Bill Amnt"))


def weighted_total_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footer rows, some with misread labels, ranked by how much they look like the grand total."""
    feet = derived.footers(derived.lines(spark, sf_dir))
    label = F.col("label")
    for i, (old, new) in enumerate(MISREAD):
        label = F.when(F.col("doc_id") % 7 == i, F.replace(F.col("label"), F.lit(old), F.lit(new))).otherwise(label)
    cells = feet.select("doc_id", "row_no", label.alias("text"), (106 + 24 * F.col("row_no")).cast("bigint").alias("center_y"))
    return finance.weighted_total_rank(cells).select("doc_id", "row_no", "text", F.floor(F.col("words") * 1000 + 0.5).cast("bigint").alias("words"), "score", "place")


QUERIES = {f.__name__: f for f in (weighted_total_rank, row_math_audit, duplicate_amount_rows, invoice_subtotal_recon, subscore_rollup, gst_ratio_check, label_candidates, rejected_candidates, tax_pair_match, grand_total_rank)}

_SPOILT = "spoilt AS (SELECT * REPLACE (CASE WHEN part % 17 = 0 THEN amount + 5000 ELSE amount END AS amount) FROM lines)"
_MATH = """checked AS (SELECT *, CASE WHEN formula = 'zero_amount' THEN qty = 0 ELSE formula NOT IN ('math_failed', 'all_formulas_failed') END AS passed FROM (
  SELECT *, CASE WHEN amount = 0 THEN 'zero_amount' WHEN abs(qty * rate - amount) <= 100 THEN 'qty_x_rate' WHEN disc = 0 THEN 'math_failed' WHEN abs(qty * rate - 100 * disc - amount) <= 100 THEN 'base_less_absolute_discount'
    WHEN abs(qty * rate * (100 - disc) - 100 * amount) <= 10000 THEN 'percentage_discount' WHEN abs(qty * (rate - 100 * disc) - amount) <= 100 THEN 'per_unit_rate_discount' ELSE 'all_formulas_failed' END AS formula FROM spoilt))"""
_DOCS = """docs AS (SELECT d.*, grand FROM (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, sum(amount)::BIGINT AS subtotal, sum((amount * tax + 50) // 100)::BIGINT AS tax FROM checked GROUP BY doc_id) d
  LEFT JOIN (SELECT o_orderkey AS doc_id, CAST(round(o_totalprice * 100) AS BIGINT) AS grand FROM orders) USING (doc_id))"""
_ALL = f", {_SPOILT}, {_MATH}, {_DOCS} "
_SCORES = """SELECT doc_id, CASE WHEN n_rows = 0 THEN 50 WHEN passed + failed = 0 THEN 40 ELSE 100 * passed // (passed + failed) END AS math,
  CASE WHEN grand IS NOT NULL AND abs(grand - subtotal - tax) <= 100 THEN 100 WHEN grand IS NOT NULL THEN 40 ELSE 60 END AS totals, CASE WHEN tax * 10 > subtotal * 4 THEN 20 ELSE 100 END AS gst,
  CASE WHEN passed + failed = 0 THEN 60 WHEN failed > 0 THEN 75 ELSE 90 END AS structure, CASE WHEN n_rows >= 2 THEN 100 ELSE 0 END AS completeness FROM docs"""
_CELLS = """feet AS (SELECT doc_id, row_no, label, doc_id % 4 AS way, value, CASE label WHEN 'SUB TOTAL' THEN 'parsed_subtotal' WHEN 'GRAND TOTAL' THEN 'parsed_grand_total' ELSE lower(label) END AS kind FROM footers),
found AS (SELECT doc_id, row_no, kind AS label, value, CASE WHEN way = 1 THEN 'same_cell_after_label' WHEN way = 2 AND kind IN ('sgst', 'cgst') THEN 'right_cell_after_tax_rate' WHEN way = 2 THEN 'same_cell_after_label' ELSE 'right_cell' END AS strategy,
  CASE WHEN way = 2 AND kind NOT IN ('sgst', 'cgst') THEN 250 ELSE value END AS told FROM feet)"""

_FIRST, _SECOND = ("GRAND TOTAL", "NET AMOUNT", "NET PAYABLE", "TOTAL AMOUNT", "INVOICE TOTAL", "BILL AMOUNT"), ("NET VALUE", "TOTAL INVOICE", "FINAL AMOUNT", "TO PAY")


def _near(phrase: str) -> str:
    return f"floor(100 - 100 * levenshtein(label, '{phrase}')::DOUBLE / greatest(length(label), {len(phrase)}))"


ORACLES = {
    "row_math_audit": with_lines(f", {_SPOILT}, {_MATH} SELECT formula, passed, count(*) AS n_rows, sum(amount)::BIGINT AS amount FROM checked GROUP BY formula, passed"),
    "duplicate_amount_rows": with_lines("SELECT doc_id, ord, amount, same_amount FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, amount // 100000) AS same_amount FROM lines) WHERE same_amount > 1"),
    "invoice_subtotal_recon": with_lines(_ALL + """SELECT doc_id, CASE WHEN g IS NOT NULL THEN expected ELSE expected END AS expected, abs(expected - g) AS off, CASE WHEN g IS NULL THEN 'WARN' WHEN abs(expected - g) <= 100 THEN 'PASS' WHEN abs(expected - g) * 100 <= g THEN 'WARN' ELSE 'FAIL' END AS status
FROM (SELECT doc_id, subtotal + tax AS expected, CASE WHEN doc_id % 4 = 0 THEN subtotal + tax + doc_id % 150 ELSE grand END AS g FROM docs)"""),
    "subscore_rollup": with_lines(_ALL + f"SELECT *, CASE WHEN integrity >= 75 THEN 'PASS' WHEN integrity >= 50 THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT *, (30 * math + 25 * totals + 15 * gst + 20 * structure + 10 * completeness) // 100 AS integrity FROM ({_SCORES}))"),
    "gst_ratio_check": with_lines(_ALL + "SELECT 100 * tax // greatest(subtotal, 1) AS percent, count(*) AS n FROM docs GROUP BY 1"),
    "label_candidates": with_footers(f", {_CELLS} SELECT doc_id, row_no, label, told AS value, strategy, CAST(1 AS BIGINT) AS ambiguity FROM found"),
    "grand_total_rank": with_footers(f"""SELECT doc_id, row_no, CAST(words AS BIGINT) AS words, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_no) AS place FROM (SELECT *, CAST(floor(600 * words + 40000 * center_y::DOUBLE / greatest(span, 1)) AS BIGINT) AS score FROM (SELECT doc_id, row_no, label, 106 + 24 * row_no AS center_y, max(106 + 24 * row_no) OVER (PARTITION BY doc_id) AS span,
  CASE WHEN regexp_matches(label, '{"|".join(_FIRST)}') THEN 100 ELSE greatest({", ".join([_near(p) for p in _FIRST] + [f"floor({_near(p)} * 4 / 5)" for p in _SECOND])}) END AS words FROM footers) WHERE words >= 65 OR contains(label, 'TOTAL'))"""),
    "rejected_candidates": with_footers(f", {_CELLS} SELECT label, CASE WHEN label IN ('sgst', 'cgst') AND told * 5 > sub THEN 'implausible' WHEN label = 'parsed_grand_total' AND strategy <> 'same_cell_after_label' AND told * 10 < sub * 3 THEN 'implausible' END AS reason, count(*) AS n FROM found JOIN sums USING (doc_id) GROUP BY 1, 2"),
    "tax_pair_match": with_footers(f""", {_CELLS}, shaken AS (SELECT * REPLACE (CASE WHEN label = 'cgst' AND doc_id % 5 = 0 THEN told + 100 * (doc_id % 3) ELSE told END AS told) FROM found)
SELECT s.doc_id, s.row_no AS s_row, c.row_no AS c_row, s.told AS s, c.told AS c FROM shaken s JOIN shaken c ON s.doc_id = c.doc_id AND s.label = 'sgst' AND c.label = 'cgst' AND abs(s.told - c.told) <= 100"""),
}
