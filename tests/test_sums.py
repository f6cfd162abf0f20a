"""Sums of footer rows that look like rates of tax when they are put together with what stands before them."""

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillgrid.operators import finance
from quillgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_a_sum_behind_a_rate_repeats_no_rates(spark):
    texts = {"SGST 2.50 2502.50": False, "SUB TOTAL 2.50 250250.33": False, "SGST 2.50 2.50 2.50": True, "SGST 2.502.50 2.50 12": True, "2 . 50 250 2,50": True, "CGST 250250250": True, "5.00 5.00 500 x": True, "CGST 5.00 500500.10": False, "2.50 5.00 12.00 18.00": True}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", finance.repeated_rates(F.col("text")).alias("found")).collect()
    assert {r.text: r.found for r in rows} == texts


def test_only_taxes_are_rejected_for_repeated_rates(spark):
    rows = [(1, 1, "parsed_subtotal", "SUB TOTAL 2.50 2.50 2.50"), (1, 2, "sgst", "SGST 2.50 2.50 2.50")]
    found = spark.createDataFrame([(d, r, k, "right_cell", t) for d, r, k, t in rows], "doc_id long, row_no int, label string, strategy string, row_text string").withColumn("value", F.lit("2.50").cast("decimal(20,4)"))
    sums = spark.createDataFrame([(1, 100)], "doc_id long, subtotal long")
    assert {r.label: r.reason for r in finance.rejected(found, sums).collect()} == {"parsed_subtotal": None, "sgst": "repeated_tax_rates"}


def test_rejected_candidates_of_sums_near_a_rate_are_those_of_the_sql(spark, tmp_path):
    """Documents whose subtotal is 250250.33 or whose half tax is 2502.50, behind a cell that ends in 2.50."""
    lines = pq.read_table(f"{SF}/lineitem.parquet")
    first = lines.slice(0, 2).to_pandas().assign(l_orderkey=[10**6 + 2, 10**6 + 6], l_quantity=1.0, l_extendedprice=[250250.33, 62562.5], l_discount=0.0, l_tax=[0.0, 0.08])
    table = lines.from_pandas(first, schema=lines.schema, preserve_index=False)
    pq.write_table(table, tmp_path / "lineitem.parquet")
    (tmp_path / "part.parquet").symlink_to(f"{SF}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    expected = con.sql(f"SELECT label, reason, n FROM ({catalogue.ORACLES['rejected_candidates']})").fetchall()
    found = catalogue.QUERIES["rejected_candidates"](spark, str(tmp_path)).select("label", "reason", "n").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str) and sum(r.n for r in found) == 8
