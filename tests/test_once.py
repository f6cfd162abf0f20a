"""Steps on tokens and totals whose texts are looked at once, and whose tables are read once."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import quantity, scalars
from quillgrid.operators import audit, finance, semantics
from quillgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "simple")


def scans(spark, name):
    """How often a query reads the order lines."""
    return plan(catalogue.QUERIES[name](spark, SF)).count("lineitem.parquet")


def test_a_quantity_is_cleaned_once(spark):
    """Each pattern of the grammar, and each use of what it found, cleaned the text anew."""
    frame = spark.createDataFrame([("2+1",)], "t string").select(quantity.is_compound(F.col("t")).alias("c"))
    assert plan(frame).count("regexp_replace") <= 5


def test_suspicious_cells_are_those_of_all_pairs_of_numbers(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["100", "100.4", "101", "250.75", "251", "7", "12", ".5", "x", "+1", "*10"]) + rng.choice(["", " ", ".", "/"]) for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(audit.suspicious(F.col("t")).alias("s"), quantity.is_compound(F.col("t")).alias("c")).collect()

    def odd(t):
        found = re.findall(r"\d+(?:\.\d+)?", t)
        values = [float(v) for v in found]
        close = any(a > 100 and b > 100 and a != b and abs(a - b) <= 0.5 for a in values for b in values)
        return len(found) >= 2 and (bool(re.search(r"\d+\.\d+\.\d+", t)) or close)

    want = [odd(t) and not r.c for t, r in zip(texts, got, strict=True)]
    assert [r.s for r in got] == want and 100 < sum(want) < 2900


def test_a_bands_numbers_are_read_once(spark):
    assert plan(catalogue.QUERIES["band_checks"](spark, SF)).count("try_cast(") <= 1


def test_plain_numbers_are_read_as_others(spark):
    """A number read directly is the one that repairing its text gives; a blank at its end keeps it from being plain."""
    texts = ["12.50", "12,50", "-3,25", "0", "007", "1.23456", "12,5", "1,234", "1,234.00", "1234.5678", "9" * 25, "9" * 25 + ",00", "12.50\n", "-", "1.", ".5", "12,50.00", "1O,50"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(scalars.to_decimal(F.col("t")).alias("a"), scalars.to_decimal(F.concat("t", F.lit(" "))).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and str(got[1].a) == "12.5000"


def test_taxes_are_paired_in_one_pass(spark):
    assert scans(spark, "tax_pair_match") == 1


def test_tax_pairs_are_the_best_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(d, r, rng.choice(["sgst", "cgst", "igst"]), rng.choice([100, 101, 102, 105])) for d in range(200) for r in range(rng.randint(1, 6))]
    rows += [(d, r, {"sgst": "cgst", "cgst": "sgst", "igst": "igst"}[k], v + rng.choice([0, 1])) for d, r, k, v in rows if d % 3 == 0]
    frame = spark.createDataFrame(rows, "doc_id long, row_no int, label string, v int").withColumn("value", F.col("v").cast("decimal(20,4)"))
    got = {r.doc_id: (r.s_row, int(r.s), r.c_row, int(r.c)) for r in finance.tax_pairs(frame).collect()}
    want = {}
    for d in range(200):
        s, c = ([(r, v) for e, r, k, v in rows if e == d and k == label] for label in ("sgst", "cgst"))
        best = min(((a != b, abs(x - y), a, b, x, y) for a, x in s for b, y in c if abs(x - y) <= 1), default=None)
        if best:
            want[d] = (best[2], best[4], best[3], best[5])
    assert got == want and len(want) > 50


def test_a_label_over_two_cells_is_none(spark):
    """The row as a whole may read GRAND TOTAL where none of its cells does."""
    rows = spark.createDataFrame([(1, 1, ["GRAND", "TOTAL", "5.00"]), (1, 2, ["NET AMOUNT 7.00"])], "doc_id long, row_no int, cells array<string>")
    assert [(r.row_no, r.label, float(r.value)) for r in finance.label_candidates(rows).collect()] == [(2, "parsed_grand_total", 7.0)]


def test_what_a_row_may_be_is_told_once(spark):
    assert plan(catalogue.QUERIES["row_drop_reasons"](spark, SF)).count("NET PAYABLE") <= 1


def test_reasons_are_those_of_patterns_without_first_letters(spark):
    rng = random.Random(7)
    words = ["TOTAL", "SUB TOTAL", "RUPEES", "AMT IN WORDS", "TERMS AND CONDITIONS", "INTEREST @ 2", "AUTH. SIGN", "PROP.", "A/C NO", "GST SUMMARY", "TAXABLE", "CGST", "SGST", "CGST RATE", "PRODUCT", "QTY", "TAB", "BATCH", "12.50", "GSTIN", "xx", "INVOICE", "SUBTOTAL", "PREAMOUNT"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(3000)]
    bare = lambda p: re.sub(r"\(\?=\[[A-Z]+\]\)", "", p)
    heads, feet = bare(audit.HEADER_WORDS), r"\bTOTAL\b|SUB TOTAL|ROUND OFF|NET PAYABLE"

    def reason(text, n):
        up = text.upper()
        has = lambda p: bool(re.search(p, up))
        item = n >= 3 and has("[A-Z]") and has(r"\d")
        hint = "footer" if has(feet) else "header" if len(re.findall(heads, up)) >= 2 else "item" if item else "metadata" if has("GSTIN|INVOICE|PHONE|ADDRESS") else "unknown"
        for name, pattern in audit.NOISE:
            if has(bare(pattern)) or (name == "gst_summary_tax_footer" and has("[CSI]GST RATE") and not has(heads)):
                return name
        product = has(audit.MEDICINE_WORDS) or any(w not in audit.COMMON_WORDS for w in re.findall(r"\b[A-Z]{3,}\b", up))
        evidence = has(r"\bB\.?\s*NO\b|BATCH|LOT|\bB/N\b|\bB\.N\b|\b\d{2}[/-]\d{2,4}\b|EXP|\b\d+\.\d{2}\b")
        return None if hint in ("item", "header") or has(heads) or (product and evidence) else f"row_type_hint_{hint}"

    frame = spark.createDataFrame([(t, len(t.split())) for t in texts], "t string, n int")
    got = [r.r for r in frame.select(audit.drop_reason(F.col("t"), audit.row_hint(F.col("t"), F.col("n"))).alias("r")).collect()]
    want = [reason(t, len(t.split())) for t in texts]
    assert got == want and len(set(want)) >= 8


def test_rows_are_rescued_in_one_pass(spark):
    assert scans(spark, "band_rescue") == 1


def test_rescued_rows_are_those_of_numbered_tokens(spark):
    rng = random.Random(9)
    tokens = [(d, k, rng.randint(0, 9), rng.randint(0, 9), o, rng.choice([f"{k}{o}", f"{k}{o}", None])) for d in range(80) for o, k in enumerate(rng.choices(audit.RESCUED, k=rng.randint(1, 30)))]
    got = audit.rescue(spark.createDataFrame(tokens, "doc_id long, kind string, min_y long, min_x long, ord long, text string")).collect()
    frame = pd.DataFrame(tokens, columns=["doc_id", "kind", "min_y", "min_x", "ord", "text"]).sort_values(["doc_id", "kind", "min_y", "min_x", "ord"])
    want = set()
    for d, page in frame.groupby("doc_id"):
        band = {k: page.text[page.kind == k].tolist() for k in audit.RESCUED}
        p, a = len(band["product"]), len(band["amount"])
        if p >= 3 and a >= 3 and abs(p - a) * 100 <= max(200, 35 * max(p, a)):
            sure = min(950, 480 + 55 * min(p, a) + (120 if abs(p - a) <= 1 else 60))
            for i in range(min(p, a)):
                row = [band[k][i] if i < len(band[k]) else None for k in audit.RESCUED]
                if row[0] is not None and row[1] is not None:
                    want.add((d, i + 1, *row, sure))
    assert {(r.doc_id, r.i, r.product, r.amount, r.quantity, r.rate, r.confidence) for r in got} == want and len(got) == len(want) > 50


@pytest.mark.parametrize("name, most", [("column_profile", 1), ("semantic_outliers", 2), ("stability_scores", 2), ("repair_evidence", 2)])
def test_cells_are_made_in_generated_code_and_read_few_times(spark, name, most):
    """Functions over elements of arrays are interpreted, and took half of the time; each further branch makes all cells anew."""
    assert scans(spark, name) <= most
    assert "lambda x" not in plan(catalogue.QUERIES["column_profile"](spark, SF))


def test_looks_of_cells_are_their_features(spark):
    rng = random.Random(13)
    parts = ["12", "5.", "₹9", ".50", "18%", "TAB ", "cap", "B-12", "/", "05/26", "300412", "+1", "x", "*10", "é", "GST", "DISC", " ", "\t", ",", "less", "2.5", "-", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(3000)] + [None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    names = list(semantics.features(F.col("text")))
    want = frame.select(*[v.alias(k) for k, v in semantics.features(F.col("text")).items()]).collect()
    got = semantics.looked(frame).select(*[f"f_{k}" for k in names], "text").collect()
    assert [tuple(r)[:-1] for r in got if r.text is not None] == [tuple(r) for r, t in zip(want, texts, strict=True) if t is not None]
