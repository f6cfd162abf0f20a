"""Queries over table engines: what they find from tokens alone, and what is repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates
from ..operators import claims, engine, pages
from ..sources import derived
from ..sources.staging import computed
from . import layout
from .sql import with_tokens


def table_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns, filled cells and owned tokens of each page that the heuristic engine finds."""
    paged = engine.found(derived.tokens(spark, sf_dir).select("doc_id", "ord", "text", "min_x", "max_x", "min_y", "max_y")).select("doc_id", "told")
    wide = F.get("told", F.lit(0))["n_columns"]
    filled = F.filter(F.transform("told", lambda t: t["cell_row"] * wide + t["cell_col"]), lambda c: c.isNotNull())
    t = computed(paged, n_rows=F.size(F.array_distinct(F.col("told")["row_no"])).cast("bigint"), n_columns=wide, filled=filled)
    return t.where(F.size("filled") > 0).select("doc_id", F.size("filled").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("filled")).cast("bigint").alias("n_filled"), "n_rows", "n_columns")


def graph_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and owned tokens of each page that the graph engine finds."""
    paged = pages.paged(derived.tokens(spark, sf_dir), "ord", *pages.BOX)
    told = paged.select("doc_id", pages.beside(pages.graph, pages.GRAPH, "tokens").alias("told"))
    return told.select("doc_id", F.size(F.array_distinct(F.col("told")["cell_row"])).cast("bigint").alias("n_rows"), F.size(F.array_compact(F.col("told")["cell_col"])).cast("bigint").alias("n_tokens"))


def graph_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item rows some of which have lost a product or an amount, or have a rate for a quantity, and what is left after repair."""
    t = derived.tokens(spark, sf_dir).where("row_no > 0")
    rows = t.groupBy("doc_id", "row_no").agg(*[F.max(F.when(F.col("col_no") == c, F.col("text"))).alias(k) for k, c in (("product", 0), ("quantity", 4), ("rate", 5), ("amount", 7))], F.transform(F.array_sort(F.collect_list(F.struct("min_x", "ord", "text"))), lambda x: x["text"]).alias("texts"))
    k = F.col("doc_id") + F.col("row_no")
    rows = rows.where("product is not null").withColumn("product", F.when(k % 5 != 0, F.col("product"))).withColumn("amount", F.when(k % 3 != 0, F.col("amount"))).withColumn("quantity", F.when(k % 7 == 0, F.col("rate")).otherwise(F.col("quantity")))
    return engine.refilled(rows).select("doc_id", "row_no", "product", "quantity", "amount")


def row_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each page have which structural stability."""
    t = derived.tokens(spark, sf_dir)
    rows = t.groupBy("doc_id", "row_no").agg(F.count("*").alias("tokens"), F.count_if(predicates.is_number(F.col("text"))).alias("numbers"), F.max(F.col("text").rlike(r"\d+\.\d{2}")).alias("priced"))
    return engine.integrity(rows).groupBy("doc_id", "stability").agg(F.count("*").alias("n"))


def claimed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row, column, claim and repair of every token of graph tables that have lost tokens: every thirteenth is in no row of the graph, every second of these lies off the page."""
    planted = (F.col("doc_id") + F.col("ord")) % 13 == 0
    away = F.when((F.col("doc_id") + F.col("ord")) % 26 == 0, 5000).otherwise(F.when(planted, 3).otherwise(0))
    t = derived.tokens(spark, sf_dir).drop("row_no", "col_no").withColumn("min_y", F.col("min_y") + away).withColumn("max_y", F.col("max_y") + away).withColumn("inside", ~planted)
    return claims.on_pages(t, tuple((i, a, b) for i, (_, _, a, b) in enumerate(derived.COLUMNS)))


QUERIES = {f.__name__: f for f in (table_engine, graph_engine, graph_repairs, row_integrity, claimed_tokens)}

_CLAIMED = f"""near_heads AS (SELECT t.doc_id, c, a, b, CASE WHEN abs(min_x + max_x - a - b) < 240 THEN CASE text WHEN 'PRODUCT' THEN 'product' WHEN 'QTY' THEN 'quantity' WHEN 'RATE' THEN 'rate' WHEN 'AMOUNT' THEN 'amount' WHEN 'DISC' THEN 'discount' ELSE 'other' END ELSE 'other' END AS said
  FROM tokens t CROSS JOIN cols WHERE row_no = 0 AND (doc_id + ord) % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY t.doc_id, c ORDER BY abs(min_x + max_x - a - b), ord) = 1),
meant AS (SELECT doc_id, c, a, b, CASE WHEN c = 7 AND NOT bool_or(said = 'amount') OVER d THEN 'amount' WHEN c = 0 AND NOT bool_or(said = 'product') OVER d THEN 'product' ELSE said END AS meaning FROM near_heads WINDOW d AS (PARTITION BY doc_id)),
firsts AS (SELECT doc_id, min(c) FILTER (meaning = 'product') AS pc, min(c) FILTER (meaning = 'amount') AS ac FROM meant GROUP BY doc_id),
kinds AS (SELECT *, {layout._NUMERIC} AS num, regexp_matches(upper(text), '[A-Z]') AND NOT regexp_matches(upper(text), '^\\d+[A-Z]+$') AS word, try_cast(regexp_replace(text, '[^\\d.]', '', 'g') AS DOUBLE) IN (0, 2.5, 5, 6, 9, 12, 14, 18, 28) AS tax
  FROM (SELECT *, regexp_replace(text, '[ ₹$]|RS', '', 'g') AS k FROM tokens WHERE (doc_id + ord) % 26 <> 0)),
tos AS (SELECT t.*, c, meaning FROM kinds t JOIN meant USING (doc_id) WHERE NOT (num AND coalesce(tax, false) AND meaning = 'quantity') AND NOT (NOT num AND word AND meaning IN ('quantity', 'rate', 'amount')) QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.ord ORDER BY abs(min_x + max_x - a - b), a) = 1),
moves AS (SELECT t.*, pc, ac, word AND NOT num AND NOT bool_or(meaning = 'product') OVER w AS moved FROM tos t JOIN firsts USING (doc_id) WINDOW w AS (PARTITION BY t.doc_id, row_no)),
moved AS (SELECT * EXCLUDE (c, meaning), CASE WHEN moved THEN pc ELSE c END AS c, CASE WHEN moved THEN 'product' ELSE meaning END AS meaning FROM moves),
emptied AS (SELECT *, meaning = 'quantity' AND NOT bool_or(meaning = 'product') OVER w AND bool_or(meaning = 'quantity' AND regexp_matches(text, '\\d+\\.\\d{{2}}')) OVER w AS gone FROM moved WINDOW w AS (PARTITION BY doc_id, row_no)),
rights AS (SELECT *, num AND NOT gone AND NOT coalesce(bool_or(meaning = 'amount' AND NOT gone) OVER (PARTITION BY doc_id, row_no), false) AND row_number() OVER (PARTITION BY doc_id, row_no, num AND NOT gone ORDER BY max_x DESC, ord) = 1 AS taken FROM emptied)"""

ORACLES = {
    "claimed_tokens": with_tokens("SELECT doc_id, ord, row_no::BIGINT AS row_no, CAST(CASE WHEN taken THEN ac WHEN gone THEN NULL ELSE c END AS INTEGER) AS col_no, CASE WHEN (doc_id + ord) % 13 = 0 THEN 'overlap' ELSE 'member' END AS claim, CASE WHEN taken THEN 'amount' WHEN gone THEN 'quantity' WHEN moved THEN 'product' ELSE 'none' END AS repair FROM rights", layout._COLS, _CLAIMED),
    "table_engine": with_tokens("SELECT doc_id, count(DISTINCT row_no) AS n_rows, count(DISTINCT col_no) AS n_columns, count(*) AS n_tokens, count(DISTINCT row_no * 8 + col_no) AS n_filled FROM tokens GROUP BY doc_id"),
    "graph_engine": with_tokens("SELECT doc_id, count(DISTINCT row_no) AS n_rows, count(*) AS n_tokens FROM tokens GROUP BY doc_id"),
    "graph_repairs": with_tokens("SELECT doc_id, row_no, max(text) FILTER (col_no = 0) AS product, CASE WHEN (doc_id + row_no) % 7 <> 0 THEN max(text) FILTER (col_no = 4) END AS quantity, max(text) FILTER (col_no = 7) AS amount FROM tokens WHERE row_no > 0 GROUP BY doc_id, row_no HAVING count(*) = 8"),
    "row_integrity": with_tokens("SELECT doc_id, least(100, CASE WHEN priced AND share > 0.1 AND share < 0.6 THEN 120 WHEN share > 0.7 AND NOT priced THEN 80 ELSE 100 END)::BIGINT AS stability, count(*) AS n FROM (SELECT doc_id, row_no, (count(*) FILTER (regexp_matches(text, '^(?:[\\d,]+\\.\\d{2}|\\d+)$')))::DOUBLE / count(*) AS share, bool_or(regexp_matches(text, '\\d+\\.\\d{2}')) AS priced FROM tokens GROUP BY doc_id, row_no) GROUP BY ALL"),
}
