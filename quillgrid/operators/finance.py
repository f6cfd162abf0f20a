"""Row arithmetic, totals, taxes and scores of invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy
from ..functions.scalars import decimals_in, minor_formula
from ..sources.staging import computed

# Labels, words and rates as the results must have them.
#: Labels of footer rows by the value that they name.
LABELS = {
    "parsed_subtotal": r"(?i)\bSUB\s*TOTAL\b|\bSUBTOTAL\b", "discount": r"(?i)\bDISCOUNT\b|\bLESS\s+DIS|\bLESS\s+TD\b|\bTD\b|\bTRADE\s+DISCOUNT\b|\bLESS\s+TRADE\s+DISCOUNT\b",
    "sgst": r"(?i)\bSGST\b", "cgst": r"(?i)\bCGST\b", "igst": r"(?i)\bIGST\b", "roundoff": r"(?i)\bROUND\s*OFF\b|\bROUNDOFF\b",
    "cr_dr_note": r"(?i)\bCR\s*/?\s*DR\s+NOTE\b|\bCR\s+NOTE\b|\bDR\s+NOTE\b", "parsed_grand_total": r"(?i)\bGRAND\s+TOTAL\b|\bNET\s+(?:PAYABLE|AMOUNT|AMT)\b",
}
#: Words that make a footer row one of addresses and numbers; rates that aren't sums of tax.
METADATA = r"(?i)\b(?:PHONE|PH\.?\s*NO|GSTIN|GST\s+NO|DL\s+NO|D\.?L\.?\s*NO|LICEN[CS]E|EMAIL|E-?MAIL|IFSC|BANK|ADDRESS)\b"
RATES = ("2.5", "5.0", "12.0", "18.0", "28.0")
TAXES = ("sgst", "cgst", "igst")


def row_math(lines: DataFrame) -> DataFrame:
    """Add formula and passed to lines (qty, rate, amount, disc) in minor units."""
    f = minor_formula(F.col("qty"), F.col("rate"), F.col("amount"), F.col("disc"))
    return lines.withColumn("formula", f).withColumn("passed", F.when(F.col("formula") == "zero_amount", F.col("qty") == 0).otherwise(~F.col("formula").isin("math_failed", "all_formulas_failed")))


def duplicates(lines: DataFrame, unit: int = 1) -> DataFrame:
    """Add same_amount: how many rows of the document have the row's amount, in whole units."""
    return lines.withColumn("_a", F.expr(f"amount div {unit}")).withColumn("same_amount", F.count("*").over(Window.partitionBy("doc_id", "_a"))).drop("_a")


def is_rate(value: Column) -> Column:
    return F.round(F.abs(value), 1).cast("decimal(20,1)").isin(*[F.lit(r).cast("decimal(20,1)") for r in RATES])


def preferred(values: Column, label: Column) -> Column:
    """The first value; of a tax the first that isn't a rate, if there are several."""
    real = F.filter(values, lambda v: ~is_rate(v))
    return F.when(label.isin(*TAXES) & (F.size(values) > 1), F.coalesce(F.get(real, F.lit(0)), F.get(values, F.lit(0)))).otherwise(F.get(values, F.lit(0)))


def repeated_rates(text: Column) -> Column:
    """Whether a text repeats rates of tax, fused or as four numbers.

    Blanks may stand between whole rates; digits on both sides of one aren't put
    together, since a sum behind a rate (2.50 2502.50) repeats none.
    """
    whole = "|".join(rf"(?:(?:{a}\s*[.,]\s*{b}|(?<!\S){a}\s*{b}(?!\S))\s*){{3,}}|(?:{a}[.,]?{b}){{3,}}" for a, b in (("2", "50"), ("5", "00")))
    return text.rlike(whole) | (F.size(F.filter(decimals_in(text), is_rate)) >= 4)


def _first_with(pattern: str) -> Column:
    """The place of the first cell that matches, 0 if none does."""
    return F.array_position(F.transform("cells", lambda c: c.rlike(pattern)), True)


def label_candidates(rows: DataFrame) -> DataFrame:
    """Values that footer rows give for labels, from rows (doc_id, row_no, cells: array of texts by x).

    A value stands behind its label in the same cell, else in cells to the
    right. A row that holds both subtotal and grand total is one of the latter.
    """
    # cells are looked at one by one only for labels that the whole row has
    whole = computed(rows.select("doc_id", "row_no", "cells"), _whole=F.array_join("cells", "\n"))
    places = F.array(*[F.when(F.col("_whole").rlike(p), F.struct(F.lit(k).alias("label"), _first_with(p).alias("at"))) for k, p in LABELS.items()])
    both = Window.partitionBy("doc_id", "row_no")
    found = whole.select("doc_id", "row_no", "cells", F.inline(F.filter(places, lambda x: x["at"] > 0)))
    found = found.withColumn("ambiguity", F.count("*").over(both)).withColumn("_grand", F.max(F.col("label") == "parsed_grand_total").over(both)).where(~((F.col("label") == "parsed_subtotal") & F.col("_grand")))
    cell = F.get("cells", F.col("at").cast("int") - 1)
    tail = F.coalesce(*[F.when(F.col("label") == k, F.get(F.split(cell, p, 2), F.lit(1))) for k, p in LABELS.items()])
    found = computed(found, own=decimals_in(F.coalesce(tail, F.lit(""))), right=F.flatten(F.transform(F.slice("cells", F.col("at").cast("int") + 1, F.size("cells")), decimals_in)))
    rate_only = F.col("label").isin(*TAXES) & (F.size("right") > 0) & ((F.size("own") > 2) | ~F.exists("own", lambda v: ~is_rate(v)))
    found = found.withColumn("strategy", F.when((F.size("own") > 0) & rate_only, "right_cell_after_tax_rate").when(F.size("own") > 0, "same_cell_after_label").when(F.size("right") > 0, "right_cell"))
    value = F.when(F.col("strategy") == "same_cell_after_label", preferred(F.col("own"), F.col("label"))).when(F.col("strategy") == "right_cell", F.get("right", F.lit(0))).otherwise(preferred(F.col("right"), F.col("label")))
    return computed(found, value=value).where("value is not null").select("doc_id", "row_no", "label", "value", "strategy", "ambiguity", F.concat_ws(" ", "cells").alias("row_text"))


def rejected(candidates: DataFrame, subtotals: DataFrame) -> DataFrame:
    """Add reason to footer candidates that can't be what their label says; null for the others."""
    c = candidates.join(subtotals.select("doc_id", "subtotal"), "doc_id", "left")
    v, s = F.abs("value"), F.col("subtotal")
    known = s.isNotNull() & (s > 0)
    few = (F.col("label") == "parsed_grand_total") & (F.col("strategy") != "same_cell_after_label") & ((F.size(decimals_in(F.col("row_text"))) > 2) | (v < s * 3 / 10))
    return c.withColumn("reason", F.when(F.col("row_text").rlike(METADATA), "metadata_polluted").when(F.col("label").isin(*TAXES) & repeated_rates(F.col("row_text")), "repeated_tax_rates").when(known & (few | (F.col("label").isin(*TAXES) & (v * 5 > s)) | ((F.col("label") == "discount") & (v > s))), "implausible"))


def best_by_label(candidates: DataFrame) -> DataFrame:
    """One value for each label of a document: least ambiguous, then uppermost."""
    w = Window.partitionBy("doc_id", "label").orderBy("ambiguity", "row_no")
    return candidates.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def tax_pairs(candidates: DataFrame, tolerance: int = 1) -> DataFrame:
    """State and central tax of a document that agree within tolerance: same row first, then closest. A page's few taxes lie in two arrays."""
    of = lambda label: F.collect_list(F.when(F.col("label") == label, F.struct("row_no", "value")))
    taxes = candidates.where("label in ('sgst', 'cgst')").groupBy("doc_id").agg(of("sgst").alias("_s"), of("cgst").alias("_c"))
    off = lambda s, c: F.abs(s["value"] - c["value"])
    pair = lambda s, c: F.struct((s["row_no"] != c["row_no"]).alias("apart"), off(s, c).alias("off"), s["row_no"].alias("s_row"), c["row_no"].alias("c_row"), s["value"].alias("s"), c["value"].alias("c"))
    pairs = F.flatten(F.transform("_s", lambda s: F.transform(F.filter("_c", lambda c: off(s, c) <= tolerance), lambda c: pair(s, c))))
    return taxes.select("doc_id", F.array_min(pairs).alias("m")).where("m is not null").select("doc_id", "m.s_row", "m.s", "m.c_row", "m.c")


def reconciled(values: DataFrame) -> DataFrame:
    """Status of a document from its label values (a column for each label, in minor units, null if missing).

    What is due: subtotal less discount plus taxes, notes and rounding of
    either sign, whichever comes closer to the grand total.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = zero("parsed_subtotal") - zero("discount") + zero("sgst") + zero("cgst") + zero("igst")
    grand = F.col("parsed_grand_total")
    signs = F.array(*[base + a * zero("cr_dr_note") + b * zero("roundoff") for a in (1, -1) for b in (1, -1)])
    best = F.array_min(F.transform(signs, lambda e: F.struct(F.abs(e - grand).alias("d"), e.alias("e"))))
    d = best["d"]
    status = F.when(grand.isNull() | F.col("parsed_subtotal").isNull(), "WARN").when(d <= 100, "PASS").when(d * 100 <= grand, "WARN").otherwise("FAIL")
    return values.withColumn("expected", best["e"]).withColumn("off", d).withColumn("status", status)


def sub_scores(t: DataFrame) -> DataFrame:
    """Five sub-scores and their weighted sum, from n_rows, passed, failed, found_total, total_matches, found_subtotal, tax, subtotal, complete."""
    checked = F.col("passed") + F.col("failed")
    math = F.when(F.col("n_rows") == 0, 50).when(checked == 0, 40).otherwise(F.expr("100 * passed div (passed + failed)"))
    totals = F.when(F.col("found_total") & F.col("total_matches"), 100).when(F.col("found_total"), 40).when(F.col("found_subtotal"), 60).otherwise(10)
    tax = F.when(F.col("tax") * 10 > F.col("subtotal") * 4, 20).otherwise(100)
    structure = F.when(F.col("n_rows") == 0, 0).when(checked == 0, 60).when(F.col("failed") > 0, 75).otherwise(90)
    complete = F.when(F.col("complete"), 100).otherwise(0)
    t = t.withColumn("math", math).withColumn("totals", totals).withColumn("gst", tax).withColumn("structure", structure).withColumn("completeness", complete)
    t = t.withColumn("integrity", F.expr("(30 * math + 25 * totals + 15 * gst + 20 * structure + 10 * completeness) div 100"))
    return t.withColumn("status", F.when((F.col("integrity") >= 75) & (checked > 0), "PASS").when(F.col("integrity") >= 50, "WARN").otherwise("FAIL"))


def grand_total_rank(cells: DataFrame) -> DataFrame:
    """Cells that may hold the grand total, ranked by their words and how far down they are (score in thousandths).

    Exact phrases score 100; others by edit distance to the nearest phrase, as
    a share of the longer text, the second list at four fifths.
    """
    first, second = ("GRAND TOTAL", "NET AMOUNT", "NET PAYABLE", "TOTAL AMOUNT", "INVOICE TOTAL", "BILL AMOUNT"), ("NET VALUE", "TOTAL INVOICE", "FINAL AMOUNT", "TO PAY")
    text = F.upper(F.trim("text"))
    near = lambda p: F.floor(100 - 100 * F.levenshtein(text, F.lit(p)) / F.greatest(F.length(text), F.lit(len(p))))
    fuzzy = F.greatest(*map(near, first), *[F.floor(near(p) * 4 / 5) for p in second])
    words = F.when(text.rlike("|".join(first)), 100).otherwise(fuzzy)
    span = F.max("center_y").over(Window.partitionBy("doc_id"))
    rows = cells.withColumn("words", words).withColumn("span", span).where((F.col("words") >= 65) | F.contains(text, F.lit("TOTAL")))
    rows = rows.withColumn("score", F.floor(600 * F.col("words") + 400 * 100 * F.col("center_y") / F.greatest(F.col("span"), F.lit(1))).cast("bigint"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "row_no")))


# What heads a grand total, surely and perhaps; the weight of the second list and the least score.
SURE_TOTALS = ("GRAND TOTAL", "NET AMOUNT", "NET AMT", "NET PAYABLE", "BILL AMOUNT", "TOTAL AMT", "TOTAL PAYABLE", "PAYABLE AMOUNT", "INVOICE TOTAL", "GRAND TOTAL AMOUNT")
LIKELY_TOTALS = ("NET VALUE", "TOTAL INVOICE", "FINAL AMOUNT", "TO PAY")
SECOND, LEAST_WORDS = 0.8, 65


def total_words(texts: DataFrame) -> DataFrame:
    """(up, words): for each distinct upper-case text (up), how much it reads like the head of a grand total."""
    sure = F.col("up").rlike("|".join(SURE_TOTALS))
    return texts.select("up").distinct().withColumn("words", F.when(sure, 100.0).otherwise(F.greatest(*(w * fuzzy.best_weighted(F.col("up"), p) for w, p in ((1.0, SURE_TOTALS), (SECOND, LIKELY_TOTALS))))))


def weighted_total_rank(cells: DataFrame) -> DataFrame:
    """Cells that may hold the grand total by the weighted fuzzy ratio of their words and by how far down they are.

    Distinct texts are scored once and met again by their text; how many there
    are is known at run time only, which is where the way of the join is chosen.
    """
    cells = cells.withColumn("up", F.upper(F.trim(F.coalesce("text", F.lit("")))))
    span = F.max("center_y").over(Window.partitionBy("doc_id"))
    rows = cells.withColumn("span", span).join(total_words(cells), "up").where((F.col("words") >= LEAST_WORDS) | F.contains(F.col("up"), F.lit("TOTAL")))
    down = F.when(F.col("span") > 0, 100 * F.col("center_y") / F.col("span")).otherwise(50)
    rows = rows.withColumn("score", F.floor(1000 * (0.6 * F.col("words") + 0.4 * down) + 0.5).cast("bigint"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "row_no"))).drop("up", "span")
