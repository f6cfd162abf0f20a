"""Causes of failures, dropped rows, repaired tables and audits of who owns a token.

Word lists and patterns are fixed values that define the classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quantity
from ..functions.predicates import bound, count
from ..functions.scalars import lenient_number

#: Rows that are no part of a table, in the order in which they are tried; first letters leave most places of a text untried.
NOISE = (
    ("amount_in_words", r"(?=[ARW])(?:AMOUNT IN WORDS|AMT IN WORDS|RUPEES|WORDS ONLY)"),
    ("terms_conditions", r"(?=[TSJGID])(?:TERMS & CONDITIONS|TERMS AND CONDITIONS|SUBJECT TO|JURISDICTION|GOODS ONCE SOLD|INTEREST @|DELAYED PAYMENT)"),
    ("bank_signature", r"(?=[SABIFP])(?:SIGNATURE|AUTHORISED SIGN|AUTH\. SIGN|BANK DETAIL|IFSC CODE|A/C NO|ACCOUNT NO|FOR AUTHORISED|PROP\.|PARTNER)"),
    ("gst_summary_tax_footer", r"(?=[GT])(?:GST SUMMARY|TAX SUMMARY|TAXABLE VAL)|^(?=.*CGST)(?=.*SGST)(?=.*TAXABLE)"),
)
HEADER_WORDS = r"(?=[PIDBEHQMRA])\b(?:PRODUCT|ITEM|DESCRIPTION|PARTICULARS|BATCH|EXP|EXPIRY|HSN|QTY|QUANTITY|MRP|RATE|AMOUNT)\b"
MEDICINE_WORDS = r"\b(?:TAB|CAP|INJ|SUSP|SYR|TABLET|CAPSULE|MG|ML|GM|STRIP)\b"
COMMON_WORDS = ("THE", "AND", "FOR", "TOTAL", "GST", "CGST", "SGST", "IGST", "TAX", "NET", "GRAND", "SUB", "INVOICE", "DATE", "AMOUNT")
#: Header words with their usual misreadings, in the order in which they are tried.
HEADER_ROLES = (
    ("pcode", r"\bP\s*CODE\b|PCODE"), ("description", r"ITEM DESCRIPTION|^DESCRIPTION$|ITEM.*DESCRIPTION|DESCRIPTION.*ITEM"), ("hsn", r"\b[HR]SN"), ("upc", r"\bUPC"), ("mrp", "MRP"), ("qty", "QTY"),
    ("taxable", "TAXABLE"), ("net_amt", "NET AMT|NET AMOUNT"), ("gross", "GROSS|GREES"), ("discount", "DISC"), ("cgst", "CGST|COST|OSTN"), ("sgst", "SGST|SGET"),
)
NON_ITEM = r"TOTAL|SUBTOTAL|GRAND TOTAL|NET AMOUNT|NET PAYABLE|CGST|SGST|IGST|GST|ROUND OFF|CARRY FORWARD|PAGE|INVOICE TOTAL"


def drop_reason(text: Column, hint: Column, up: Column | None = None) -> Column:
    """Why a row of the token graph is left out of the table; null if it stays.

    hint is item, header, footer, metadata, tax or unknown. A row that isn't an
    item or a header stays for header words, or for a product with a batch, an
    expiry or a sum. up is the upper-case text, where a column holds it.
    """
    up = F.upper(F.coalesce(text, F.lit(""))) if up is None else up
    words = F.filter(F.regexp_extract_all(up, F.lit(r"\b[A-Z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(*COMMON_WORDS))
    product = up.rlike(MEDICINE_WORDS) | (F.size(words) > 0)
    evidence = up.rlike(r"\bB\.?\s*NO\b|BATCH|LOT|\bB/N\b|\bB\.N\b|\b\d{2}[/-]\d{2,4}\b|EXP|\b\d+\.\d{2}\b")
    head = up.rlike(HEADER_WORDS)
    rate_line = up.rlike(r"[CSI]GST RATE") & ~head
    out = F.when(hint.isin("item", "header") | head | (product & evidence), F.lit(None).cast("string")).otherwise(F.concat(F.lit("row_type_hint_"), hint))
    for reason, pattern in reversed(NOISE):
        hit = up.rlike(pattern)
        out = F.when(hit | rate_line if reason == "gst_summary_tax_footer" else hit, reason).otherwise(out)
    return out


def row_hint(text: Column, n_tokens: Column, up: Column | None = None) -> Column:
    """What a row of the token graph may be, by its words and its size. up is the upper-case text, where a column holds it."""
    up = F.upper(text) if up is None else up
    item = (n_tokens >= 3) & up.rlike("[A-Z]") & up.rlike(r"\d")
    return F.when(up.rlike(r"(?=[TSRN])(?:\bTOTAL\b|SUB TOTAL|ROUND OFF|NET PAYABLE)"), "footer").when(count(up, HEADER_WORDS) >= 2, "header").when(item, "item").when(up.rlike("GSTIN|INVOICE|PHONE|ADDRESS"), "metadata").otherwise("unknown")


def header_role(text: Column) -> Column:
    """The column that a header token names, null if none."""
    clean = F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]+", ""))
    out = F.lit(None).cast("string")
    for role, pattern in reversed(HEADER_ROLES):
        out = F.when(clean.rlike(pattern), role).otherwise(out)
    return out


def failure_cause(role: Column, product: Column, qty: Column, rate: Column, amount: Column, missing_amount: Column, mismatches: Column, parsed: Column | None = None) -> Column:
    """The first of eight causes for which an item row's arithmetic fails. parsed is the quantity's parse, where a column holds it already."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    letters = F.length(F.regexp_replace(text(qty), "[^A-Za-z]", ""))
    q = quantity.parsed(qty) if parsed is None else parsed
    r, a = lenient_number(rate), lenient_number(F.regexp_replace(amount, r"^(\d+),(\d{2})$", "$1.$2"))
    unread = ((q["rejected"].isNotNull()) & (text(qty) != "")) | (r.isNull() & (text(rate) != "")) | (a.isNull() & (text(amount) != ""))
    return (
        F.when(missing_amount | (text(amount) == ""), "amount column missing").when(text(product) == "", "product column missing").when(F.upper(text(product)).rlike(NON_ITEM) | (role != "item_row"), "row is not a true item row")
        .when((letters > 3) | ((letters > 0) & F.upper(text(qty)).rlike("QTY|QUANTITY|PRODUCT|ITEM|TOTAL|RATE")), "qty cell contains product/header/footer text")
        .when(text(amount).rlike(r"\d+\.\d+\.\d+") | text(rate).rlike(r"\d+\.\d+\.\d+"), "rate/amount columns merged").when(mismatches > 0, "cell assignment to wrong column").when(unread, "parser failure")
        .when(F.abs(q["billed"] * r - a) > 1, "GST/discount affecting calculation").otherwise("unknown")
    )


def confusion(product: Column, qty: Column, free: Column, rate: Column, gst: Column, amount: Column) -> Column:
    """The first of seven ways in which values stand in wrong columns."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    money = lambda c: F.coalesce(F.regexp_replace(c, r"\s", "").rlike(r"^[₹$]?\d[\d,]*\.\d{2}$"), F.lit(False))
    comma = lambda c: F.coalesce(c.rlike(r"\b\d+,\d{2}\b"), F.lit(False))
    g, a, r = lenient_number(gst), lenient_number(amount), lenient_number(rate)
    odd_rate = F.contains(F.coalesce(gst, F.lit("")), F.lit("+")) | F.coalesce(~g.isin(0.0, 2.5, 5.0, 6.0, 9.0, 12.0, 18.0, 28.0) & ((g == F.floor(g)) | (g > 28)), F.lit(False))
    return (
        F.when(comma(amount) | comma(rate) | comma(qty) | comma(free) | comma(gst), "amount decimal-comma normalization issue").when(money(qty), "qty received amount-like value").when(money(free), "free_qty received price-like value")
        .when(odd_rate, "GST received quantity/free quantity").when(F.coalesce(F.abs(a - r) <= 0.01, F.lit(False)), "amount received rate").when(F.coalesce(product.rlike(r"^[\s\d.,]+$"), F.lit(False)), "product received numeric-only value")
        .when(~has(qty) & has(rate) & has(amount), "quantity missing but rate/amount present").otherwise("unknown wrong-column pattern")
    )


def suspicious(text: Column) -> Column:
    """Whether a cell holds several numbers that don't belong together; compound quantities do."""
    values = lambda: F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double"))
    near = lambda values: F.exists(values, lambda a: (a > 100) & F.exists(values, lambda b: (b > 100) & (a != b) & (F.abs(a - b) <= 0.5)))
    # two numbers over 100 have three digits each, so that the others needn't be read
    close = text.rlike(r"\d{3}\d*+\D(?s:.*?)\d{3}") & bound(values(), near)
    return (text.rlike(r"\d++\.\d++\.\d") | close) & ~quantity.is_compound(text)


#: Kinds of tokens that make a rescued row.
RESCUED = ("product", "amount", "quantity", "rate")


def rescue(tokens: DataFrame) -> DataFrame:
    """Rows from a product band and an amount band where a page has no usable columns.

    tokens have kind product, amount, quantity or rate. Counts of products and
    amounts have to agree within the larger of 2 and 35 %, with three at least;
    the i-th product gets the i-th amount, quantity and rate. Confidence in thousandths.
    """
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("min_y", "min_x", "ord", "text")))
    pages = tokens.groupBy("doc_id").agg(*[of(k).alias(f"_{k}") for k in RESCUED])
    p, a = F.size("_product"), F.size("_amount")
    apart = F.abs(p - a)
    fits = (p >= 3) & (a >= 3) & (apart * 100 <= F.greatest(F.lit(200), 35 * F.greatest(p, a)))
    told = pages.where(fits).select("doc_id", *[F.sort_array(f"_{k}").alias(f"_{k}") for k in RESCUED], F.least(F.lit(950), 480 + 55 * F.least(p, a) + F.when(apart <= 1, 120).otherwise(60)).cast("bigint").alias("confidence"))
    # rows end with the shorter of the two bands
    rows = told.select("doc_id", "confidence", F.posexplode(F.arrays_zip(*[F.col(f"_{k}")["text"].alias(k) for k in RESCUED])).alias("at", "r"))
    return rows.select("doc_id", (F.col("at") + 1).alias("i"), *[f"r.{k}" for k in RESCUED], "confidence").where("product is not null and amount is not null")


def phase_repaired(rows: DataFrame, above: DataFrame) -> DataFrame:
    """Tables whose products slipped down a row: each row takes the product before it, the first the one above the table.

    rows (doc_id, row_no, center, product) of item rows; above (doc_id, text, center) are product-like texts over the
    table. Repaired where three rows or more stand in the table and the text lies within one and a half row steps.
    """
    w = Window.partitionBy("doc_id").orderBy("row_no")
    step = F.coalesce(F.min(F.col("gap")).over(Window.partitionBy("doc_id")), F.lit(0))
    rows = rows.withColumn("gap", F.lead("center").over(w) - F.col("center")).withColumn("step", step).withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("top", F.min("center").over(Window.partitionBy("doc_id")))
    tops = rows.groupBy("doc_id").agg(F.first("top").alias("top"), F.first("step").alias("step"), F.first("n").alias("n"))
    near = above.join(tops, "doc_id").where("n >= 3").where((F.col("center") < F.col("top")) & ((F.col("top") - F.col("center")) * 2 <= 3 * F.col("step")))
    lead = near.groupBy("doc_id").agg(F.max_by("text", "center").alias("lead"))
    joined = rows.join(lead, "doc_id", "left")
    before = F.coalesce(F.lag("product").over(w), F.col("lead"))
    return joined.withColumn("repaired", F.when(F.col("lead").isNotNull(), before).otherwise(F.col("product"))).drop("gap", "step", "n", "top")


def repair_trigger(tables: DataFrame) -> DataFrame:
    """Whether a table's columns have to be rebuilt from anchors: too few columns for its text, or meanings that are missing."""
    known = F.filter("meanings", lambda m: m != "unknown")
    missing = F.size(F.array_except(F.array(F.lit("quantity"), F.lit("rate"), F.lit("amount")), known)) > 0
    few = (F.col("n_cols") <= 2) & ((F.col("mean_length") >= 60) | (F.col("single_celled") * 2 >= F.col("item_rows")))
    return tables.withColumn("repair", few | ((F.col("strong_anchors") >= 4) & missing))


def ownership_audit(tokens: DataFrame, owned: DataFrame, rows: DataFrame) -> DataFrame:
    """Tokens whose own row is further from them than another: own and nearest row, and by how much (twice the pixels)."""
    return apart(tokens.join(owned.select("doc_id", "ord", "cell_row"), ["doc_id", "ord"]), rows)


def apart(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """ownership_audit() of tokens that have their cell_row beside them."""
    from .assign import beside

    held = beside(tokens.select("doc_id", "ord", "cell_row", (F.col("min_y") + F.col("max_y")).alias("_c2")), rows, "row_no", "min_y", "max_y")
    near = F.transform("_bands", lambda r: F.struct(F.abs(F.col("_c2") - r["min_y"] - r["max_y"]).alias("d2"), r["row_no"].alias("row")))
    found = held.select("doc_id", "ord", "cell_row", F.array_min(near).alias("_m"), F.filter(near, lambda r: r["row"] == F.col("cell_row")).alias("_own"))
    found = found.select("doc_id", "ord", "cell_row", F.col("_m.row").alias("nearest"), (F.get("_own", F.lit(0))["d2"] - F.col("_m.d2")).alias("apart2"))
    return found.where("apart2 >= 6")


def validated_invoices(invoices: DataFrame) -> DataFrame:
    """Arithmetic and totals of extracted invoices (doc_id, invoice as sources.documents.INVOICE)."""
    items = F.coalesce("invoice.items", F.array().cast(dict(invoices.select("invoice.items").dtypes)["items"]))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ok = F.filter(items, lambda x: F.abs(zero(x["qty"]) * zero(x["rate"]) - zero(x["discount"]) - zero(x["amount"])) <= 1)
    tax = zero(F.col("invoice.tax.total_tax"))
    subtotal = F.aggregate(items, F.lit(0.0), lambda a, x: a + zero(x["amount"]))
    rows = invoices.select("doc_id", F.size(items).alias("n_items"), F.size(ok).alias("passed"), subtotal.alias("derived"), (subtotal + tax).alias("expected"), F.col("invoice.grand_total").alias("told"))
    return rows.withColumn("total_matches", F.coalesce(F.abs(F.col("expected") - F.col("told")) <= 1, F.lit(False)))
