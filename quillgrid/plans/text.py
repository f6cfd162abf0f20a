"""Queries over texts: numbers, quantities, tokens, rows, errors, content keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, quantity, scalars
from ..sources import derived
from ..sources.staging import computed
from .sql import ROWS, with_lines, with_tokens


def decimal_comma_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = derived.tokens(spark, sf_dir).where("col_no = 7")
    return tokens.groupBy(scalars.decimal_comma(F.col("text")).alias("fixed")).agg(F.count("*").alias("n"))


def decimal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", scalars.decimals_in(F.col("text")).alias("v"))
    cents = F.transform("v", lambda x: F.floor(x * 10000).cast("bigint"))
    return docs.where(F.size("v") > 0).select("doc_id", F.size("v").cast("bigint").alias("n"), F.aggregate(cents, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def qty_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived.lines(spark, sf_dir).select("doc_id", "ord", quantity.parsed(derived.quantity_text(F.col("part"), F.col("qty"))).alias("q"))
    return lines.select("doc_id", "ord", *[F.col(f"q.{c}").cast("bigint").alias(c) for c in ("billed", "free", "total", "pack")], "q.scheme", "q.method")


def qty_parse_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qty_parse(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"), F.sum("billed").alias("billed"))


def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = derived.tokens(spark, sf_dir)
    flags = predicates.token_flags(F.col("text"))
    return tokens.groupBy("col_no").agg(*[F.count_if(v).alias(k) for k, v in flags.items()], F.count_if(predicates.is_number(F.col("text"))).alias("is_number"), F.count_if(predicates.is_numeric_like(F.col("text"))).alias("is_numeric_like"))


def feature_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = derived.tokens(spark, sf_dir)
    tokens, vote = computed(tokens, _vote=predicates.token_vote(F.col("text"))), F.col("_vote")
    anchor = predicates.anchor_x(vote, (F.col("min_x") + F.col("max_x")) / 2, F.col("max_x"))
    return tokens.select("col_no", F.coalesce(vote, F.lit("none")).alias("vote"), (2 * anchor).cast("bigint").alias("a")).groupBy("col_no", "vote").agg(F.count("*").alias("n"), F.sum("a").alias("anchors2"))


def row_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.visual_rows(spark, sf_dir)
    return rows.select("doc_id", "row_no", predicates.row_class(F.col("text")).alias("row_class"))


def with_roles(rows: DataFrame, up: str | None = None) -> DataFrame:
    """Add row_role to visual rows, each document being one table; also the upper-case text, where up names its column."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id")
    x = (F.col("min_x") - F.min("min_x").over(w)) / F.greatest(F.lit(1), F.max("max_x").over(w) - F.min("min_x").over(w))
    y = ((F.col("min_y") + F.col("max_y")) / 2 - F.min("min_y").over(w)) / F.greatest(F.lit(1), F.max("max_y").over(w) - F.min("min_y").over(w))
    placed = computed(rows, _up=F.upper("text")).withColumn("_x", x).withColumn("_y", y)
    roled = computed(placed, row_role=predicates.row_role(F.col("text"), F.col("n_tokens"), F.col("_x"), F.col("_y"), F.col("_up"))).drop("_x", "_y")
    return roled.withColumnRenamed("_up", up) if up else roled.drop("_up")


def row_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_roles(derived.visual_rows(spark, sf_dir))
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("row_role") == r).alias(r) for r in ("item_row", "header_row", "footer_summary_row", "tax_summary_row", "metadata_row", "unknown_row")])


#: Messages that stand for the events' kinds in error_classes.
MESSAGES = ("CUDA out of memory", "Connection timed out", "TSR returned 0 cells", "low OCR confidence", "Token mapping failed", "Semantic classification failed", "Corrupted image", "Validation failed", "something else")


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select(predicates.error_class(message).alias("c"))
    return events.groupBy("c.type", "c.action", "c.retryable").agg(F.count("*").alias("n"))


def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.concat(F.md5(F.coalesce("text", F.lit(""))), F.lit("_v1")).alias("content_key"))


QUERIES = {f.__name__: f for f in (decimal_comma_normalize, decimal_candidates, qty_parse, qty_parse_methods, token_flags, feature_votes, row_class, row_roles, error_classes, content_key)}

_QTY = """SELECT doc_id, ord, CASE part % 10 WHEN 1 THEN qty ELSE qty END AS billed, CASE part % 10 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS free, qty + CASE part % 10 WHEN 0 THEN 1 ELSE 0 END AS total,
  CASE part % 10 WHEN 1 THEN 10 END::BIGINT AS pack, part % 10 = 0 AS scheme, CASE part % 10 WHEN 0 THEN 'scheme_notation' WHEN 1 THEN 'qty_pack_fused_extracted' ELSE 'plain_numeric' END AS method FROM lines"""
_C = "regexp_replace(upper(text), '\\s+', '', 'g')"
_HEAD = "(?:S\\.?|SR\\.?|NO\\.?|QTY\\.?|QUANTITY|MFG\\.?|PRODUCT|PARTICULARS|DESCRIPTION|BATCH|EXP|EXPIRY|HSN|MRP|RATE|AMOUNT|VALUE|T\\.?D%?|DISC\\.?%?|GST%?|TAX%?|FREE|PACK|UOM|UNIT)"
_FOOT = "(?:TOTAL|GRAND|SUB\\s*TOTAL|NET\\s+AMT|NET\\s+AMOUNT|NET\\s+PAYABLE|DISCOUNT|ROUND\\s*OFF|ROUNDOFF|PAYABLE|CR/?DR|NOTE|BILL\\s+AMOUNT|RUPEES?\\b.*\\bONLY)"
ROW_CLASS = f"""CASE WHEN len(regexp_extract_all(up, '\\b{_HEAD}\\b')) >= 3 AND NOT foot THEN 'Column Header'
    WHEN contains(up, 'TOTAL') OR (contains(up, 'AMOUNT') AND foot) OR contains(up, 'TAX') OR (contains(up, 'GST') AND foot) THEN 'Totals'
    WHEN regexp_matches(up, '\\b(?:TABS?|CAPS?|INJ|MG|ML|TABLETS?|CAPSULES?|SYRUPS?|OINTS?|\\d+''S)\\b') OR (regexp_matches(up, '\\b\\d+\\.\\d{{2}}\\b') AND (regexp_matches(up, '\\b\\d{{4,8}}\\b') OR regexp_matches(up, '\\b\\d{{2}}[-/]\\d{{2,4}}\\b'))) THEN 'Medicine Table Row'
    WHEN regexp_matches(up, 'INVOICE|DATE|PARTY') THEN 'Header' ELSE 'Unknown' END"""
CLASSED = f"classed AS (SELECT *, {ROW_CLASS} AS row_class FROM (SELECT *, upper(text) AS up, regexp_matches(upper(text), '\\b{_FOOT}\\b') AS foot FROM visual))"
_R_FOOT = "\\b(?:SUB\\s*TOTAL|SUBTOTAL|GRAND\\s*TOTAL|TOTAL|ROUND\\s*OFF|ROUNDOFF|DISCOUNT|LESS\\s+TD|TRADE\\s+DISCOUNT|LESS\\s+TRADE\\s+DISCOUNT|CR\\s*/?\\s*DR|CR\\s+NOTE|DR\\s+NOTE|NET\\s*(?:AMT|AMOUNT|PAYABLE)?|AMOUNT\\s+IN\\s+WORDS)\\b|(?:\\b(?:RS\\.?|RUPEES|INR)\\b.*\\b(?:ONLY|PAISE)\\b)"
_R_TAX = "\\b(?:CGST|SGST|IGST|GST|CESS|TAXABLE|TAX)\\b"
_R_HEAD = "\\b(?:PRODUCT|ITEM|BATCH|EXP|HSN|MRP|RATE|QTY|AMOUNT|VALUE|T\\.?D%?)\\b"
_R_MARK = "\\b(?:TABS?|CAPS?|INJ|SYP|SYRUP|SUSP|DROPS?|CREAM|OINT|GEL|LOTION|SOLUTION|SOAP|ML|MG|GM|MCG|DT|XR|SR|MR)\\b"
# a batch is a word of 5 to 20 letters, digits and dashes with a letter and a digit: words are cut out and tested one by one
ROLED = f"""signs AS (SELECT *, upper(text) AS up, len(regexp_extract_all(text, '\\b\\d+[\\d,]*[.,]\\d{{2}}\\b')) AS money, len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS alpha,
    len(regexp_extract_all(upper(text), '{_R_HEAD}')) AS heads,
    (min_x - min(min_x) OVER d)::DOUBLE / greatest(1, max(max_x) OVER d - min(min_x) OVER d) AS xs, ((min_y + max_y) / 2.0 - min(min_y) OVER d) / greatest(1, max(max_y) OVER d - min(min_y) OVER d) AS ys
  FROM visual WINDOW d AS (PARTITION BY doc_id)),
evidence AS (SELECT *, (money >= 1)::INT + regexp_matches(up, '\\b\\d{{6,8}}\\b')::INT + regexp_matches(up, '\\b\\d{{1,2}}[/-]\\d{{2,4}}\\b')::INT
    + (len(list_filter(regexp_extract_all(up, '[A-Z0-9-]+'), lambda w: length(trim(w, '-')) BETWEEN 5 AND 20 AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '\\d'))) > 0)::INT
    + regexp_matches(up, '\\b\\d')::INT + regexp_matches(up, '{_R_TAX}')::INT AS n_signs FROM signs),
roled AS (SELECT *, CASE WHEN regexp_matches(up, '{_R_FOOT}') OR (money >= 2 AND n_tokens <= 4 AND NOT regexp_matches(up, '{_R_MARK}') AND alpha < 3 AND xs >= 0.45 AND ys >= 0.55) THEN 'footer_summary_row'
    WHEN alpha >= 2 AND money >= 1 AND n_signs >= 2 THEN 'item_row' WHEN heads >= 2 AND money = 0 AND n_tokens >= 3 THEN 'header_row' WHEN regexp_matches(up, '{_R_TAX}') THEN 'tax_summary_row'
    WHEN regexp_matches(up, '\\b(?:GSTIN|GST\\s+NO|INVOICE\\s+NO|D\\.?L\\.?\\s*NO|TRANSPORT|TERMS|CONDITIONS|ADDRESS|PHONE)\\b') AND money < 2 THEN 'metadata_row'
    WHEN money >= 1 AND alpha >= 1 THEN 'item_row' WHEN money >= 2 AND n_tokens >= 3 THEN 'item_row' ELSE 'unknown_row' END AS row_role FROM evidence)"""
_ERR = [("TRANSIENT", "reduce_batch_size", 0), ("TRANSIENT", "retry_with_timeout", 1), ("RECOVERABLE", "use_heuristic_tsr", 2), ("RECOVERABLE", "upscale_and_retry", 3), ("RECOVERABLE", "use_graph_fallback", 4), ("RECOVERABLE", "continue_with_unknown_semantics", 5), ("FATAL", "reject_image", 6), ("FATAL", "reject_image", 7), ("FATAL", "unknown_error", 8)]

#: Tokens with what they vote for.
VOTED = f"""SELECT *, CASE WHEN expiry THEN 'expiry' WHEN regexp_matches(c, '^[A-Z0-9-]{{5,16}}$') AND regexp_matches(c, '[A-Z]') AND regexp_matches(c, '\\d') THEN 'batch' WHEN regexp_matches(c, '^\\d{{6,8}}$') THEN 'hsn'
    WHEN regexp_matches(c, '^[₹$]?\\d[\\d,]*\\.\\d{{1,3}}%?$') THEN 'money' WHEN (regexp_matches(c, '^\\d+(?:[+*xX]\\d+|\\.\\d+)?$') AND length(c) <= 5) OR regexp_matches(c, '^\\d+$') THEN 'qty'
    WHEN round(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(text, '\\s', '', 'g'))), 4) > 0.55 THEN 'text' ELSE 'none' END AS vote
  FROM (SELECT *, {_C} AS c, regexp_matches({_C}, '^\\d{{1,2}}[/-]\\d{{2,4}}$') AS expiry FROM tokens)"""

ORACLES = {
    "decimal_comma_normalize": with_tokens("SELECT CASE WHEN NOT contains(text, '.') AND length(text) - length(replace(text, ',', '')) = 1 THEN regexp_replace(text, '\\b(\\d+),(\\d{2})\\b', '\\1.\\2', 'g') ELSE text END AS fixed, count(*) AS n FROM tokens WHERE col_no = 7 GROUP BY 1"),
    "decimal_candidates": """SELECT doc_id, len(v) AS n, CAST(list_sum(list_transform(v, lambda x: CAST(floor(CAST(x AS DECIMAL(20, 4)) * 10000) AS BIGINT))) AS BIGINT) AS total
FROM (SELECT doc_id, list_transform(list_transform(regexp_extract_all(text, '-?\\d[\\d,]*[.,]\\d{1,3}'), lambda m: CASE WHEN contains(m, '.') THEN replace(m, ',', '') ELSE replace(m, ',', '.') END),
        lambda s: replace(regexp_extract(s, '^(.*)\\.(\\d+)$', 1), '.', '') || '.' || regexp_extract(s, '^(.*)\\.(\\d+)$', 2)) AS v FROM documents) WHERE len(v) > 0""",
    "qty_parse": with_lines(_QTY),
    "qty_parse_methods": with_lines(f"SELECT method, count(*) AS n, sum(billed)::BIGINT AS billed FROM ({_QTY}) GROUP BY method"),
    "token_flags": with_tokens(f"""SELECT col_no, count(*) FILTER (regexp_matches(c, '^[₹$]?\\d[\\d,]*\\.\\d+%?$')) AS is_decimal, count(*) FILTER (regexp_matches(c, '^\\d{{1,2}}[/-]\\d{{2,4}}$')) AS is_date,
  count(*) FILTER (regexp_matches(c, '[A-Z]\\d|\\d[A-Z]')) AS is_batch, count(*) FILTER (regexp_matches(c, '^\\d{{6,8}}$')) AS is_hsn, count(*) FILTER (regexp_matches(text, '^(?:[\\d,]+\\.\\d{{2}}|\\d+)$')) AS is_number,
  count(*) FILTER (regexp_matches(k, '\\d+[\\d,]*\\.\\d+') OR (contains(k, '%') AND regexp_matches(k, '\\d')) OR regexp_matches(regexp_replace(k, '[,.]', '', 'g'), '^\\d+$')) AS is_numeric_like
FROM (SELECT *, {_C} AS c, regexp_replace(text, '[ ₹$]|RS', '', 'g') AS k FROM tokens) GROUP BY col_no"""),
    "feature_votes": with_tokens(f"""SELECT col_no, vote, count(*) AS n, sum(CASE WHEN vote IN ('money', 'qty') THEN 2 * max_x ELSE min_x + max_x END)::BIGINT AS anchors2
FROM ({VOTED}) GROUP BY col_no, vote"""),
    "row_class": with_tokens("SELECT doc_id, row_no, row_class FROM classed", ROWS, CLASSED),
    "row_roles": with_tokens("SELECT doc_id, " + ", ".join(f"count(*) FILTER (row_role = '{r}') AS {r}" for r in ("item_row", "header_row", "footer_summary_row", "tax_summary_row", "metadata_row", "unknown_row")) + " FROM roled GROUP BY doc_id", ROWS, ROLED),
    "error_classes": "SELECT type, action, type = 'TRANSIENT' AS retryable, count(*) AS n FROM events JOIN (VALUES " + ", ".join(f"('{t}', '{a}', {k})" for t, a, k in _ERR) + f") v(type, action, k) ON event_id % {len(MESSAGES)} = k WHERE event_type = 'error' GROUP BY type, action",
    "content_key": "SELECT doc_id, md5(coalesce(text, '')) || '_v1' AS content_key FROM documents",
}
