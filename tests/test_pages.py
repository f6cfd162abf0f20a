"""Visual rows, roles and regions of pages: their cost, and that the quicker patterns tell what the plain ones do."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import predicates
from quillgrid.operators import evidence
from quillgrid.plans import catalogue, tables
from quillgrid.sources import derived, staging

SF = "/root/testdata/sf0.001"
PARTS = ["TOTAL", "SUB", "GRAND", "round", "off", "TAB", "Inj", "CGST", "gst", "PRODUCT", "QTY", "RATE", "B00012", "01/97", "30040123", "12.50", "1,234.00", "12,50", "3", "5+1", "1*10", "ab", "abc", "RS.", "ONLY", "PHONE", "A-1", "2.5.0", "-", "\n", "é", "5."]


def texts(seed, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice([" ", " ", "", ".", "  "]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def plan(name, mode="simple"):
    return lambda spark: spark._jvm.PythonSQLUtils.explainString(catalogue.QUERIES[name](spark, SF)._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", ["region_kinds", "engine_confidence", "main_table_score", "table_route"])
def test_regions_are_neither_written_nor_made_by_functions_over_elements(spark, name, tmp_path, monkeypatch):
    """Text and box of a row came from eight functions over its cells, which Spark evaluates one by one."""
    monkeypatch.setattr(staging, "folder", lambda _: str(tmp_path))
    found = plan(name)(spark)
    assert "lambdafunction" not in found and not list(tmp_path.glob("staged-*"))


@pytest.mark.parametrize("name", ["region_kinds", "engine_confidence", "main_table_score", "table_route"])
def test_generated_methods_stay_short_enough_to_be_compiled(spark, name):
    """Java interprets methods of over 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan(name, "codegen")(spark))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, sizes)) < 8000


def test_rows_whose_texts_reach_over_others_are_read_from_the_left(spark, tmp_path, monkeypatch):
    """A rate so long that it begins left of the quantity, and totals that begin left of their label."""
    long = [F.lit(t) for t in ("P", "B", "E", "H", "7", "123456789012345.00", "1.00", "2.00")]
    real = derived._rows(spark, SF)
    rows = real.withColumn("texts", F.when(F.col("foot"), F.array(F.lit("T"), F.repeat(F.lit("9"), 40))).when(F.col("row_no") == 1, F.array(*long)).otherwise(F.col("texts")))
    monkeypatch.setattr(derived, "_rows", lambda *_: rows)
    found = derived.visual_rows(spark, SF)
    cells = found.select("doc_id", "row_no", "text", "n_tokens", "min_x", "max_x", "min_y", "max_y", F.explode("cells").alias("c"))
    ends = [f(f"c.{k}").alias(f"c_{k}") for k, f in {"min_x": F.min, "max_x": F.max, "min_y": F.min, "max_y": F.max}.items()]
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c.min_x", "c.ord", "c.text"))), lambda x: x["text"]), " ")
    whole = cells.groupBy("doc_id", "row_no", "text", "n_tokens", "min_x", "max_x", "min_y", "max_y").agg(words.alias("words"), F.count("*").alias("n"), *ends)
    same = (F.col("text") == F.col("words")) & (F.col("n_tokens") == F.col("n"))
    for k in ("min_x", "max_x", "min_y", "max_y"):
        same = same & (F.col(k) == F.col(f"c_{k}"))
    assert whole.where(~same).count() == 0 and found.where("text like 'P B E H 123456789012345.00 7 %'").count() > 0 and found.where("text like '9%T'").count() > 0


def plain_role(text, populated):
    """The role of a row at the upper left, by counts of every sign."""
    up = text.upper()
    sub = lambda p: re.sub(r"\(\?=\[?[^)]*?\]?\)(?=\\b|\(\?:\\b)", "", p)
    found = lambda p, t=up: len(re.findall(p, t, re.ASCII))
    money, alpha, heads = found(predicates.ROLE_MONEY, text), found("[A-Za-z]{3,}", text), found(sub(predicates.ROLE_HEAD))
    signs = (money >= 1) + sum(found(p) > 0 for p in (r"\b\d{6,8}\b", r"\b\d{1,2}[/-]\d{2,4}\b", predicates.ROLE_BATCH, sub(predicates.ROLE_QUANTITY), sub(predicates.ROLE_TAX)))
    if found(sub(predicates.ROLE_FOOT)):
        return "footer_summary_row"
    if alpha >= 2 and money >= 1 and signs >= 2:
        return "item_row"
    if heads >= 2 and money == 0 and populated >= 3:
        return "header_row"
    if found(sub(predicates.ROLE_TAX)):
        return "tax_summary_row"
    if found(sub(predicates.ROLE_METADATA)) and money < 2:
        return "metadata_row"
    return "item_row" if (money >= 1 and alpha >= 1) or (money >= 2 and populated >= 3) else "unknown_row"


def test_roles_are_those_of_plain_counts(spark):
    given = [(t.replace("é", "E"), i % 6) for i, t in enumerate(texts(1))]
    rows = spark.createDataFrame(given, "text string, populated int")
    got = rows.select(predicates.row_role(F.col("text"), F.col("populated"), F.lit(0.0), F.lit(0.0)).alias("r")).collect()
    want = [plain_role(*g) for g in given]
    assert [r.r for r in got] == want and len(set(want)) == 6


def test_batches_and_different_numbers_are_those_of_plain_lists(spark):
    given = [t.upper() for t in texts(2)]
    rows = spark.createDataFrame([(t,) for t in given], "up string").select("up", F.regexp_count("up", F.lit(tables.BATCH_WORDS)).alias("n"), F.col("up").rlike(tables.TWO_NUMBERS).alias("two")).collect()
    words = lambda t: [w for w in re.findall("[A-Z0-9-]+", t) if 5 <= len(w) <= 20 and re.search("[A-Z]", w) and re.search("[0-9]", w)]
    assert [r.n for r in rows] == [len(words(t)) for t in given]
    numbers = [len(set(re.findall(r"[0-9]+(?:\.[0-9]+)?", t))) >= 2 for t in given]
    assert all(n for r, n in zip(rows, numbers, strict=True) if r.two) and sum(r.two for r in rows) * 10 > sum(numbers) * 9


def test_main_regions_are_marked_among_all(spark):
    rows = spark.createDataFrame([(1, 0, 5, 9, 8), (1, 1, 5, 9, 8), (2, 0, 1, 2, 8), (2, 1, 4, 8, 2)], "doc_id long, table_id int, n_rows int, populated int, n_cols int")
    assert {(r.doc_id, r.table_id) for r in evidence.with_main(rows).collect() if r.main} == {(1, 0), (2, 1)} == {(r.doc_id, r.table_id) for r in evidence.main_region(rows).collect()}
