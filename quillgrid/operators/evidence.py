"""Evidence that rescue, repair and totals go by: words, rates, bands of numbers, and how whole a table looks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..functions.scalars import decimals_in
from . import assign, orientation
from .finance import METADATA, TAXES, repeated_rates
from .score import PRODUCT_MARKS

# Words and rates as the results must have them.
#: Headers and words of totals that a slipped product can't be.
NO_PRODUCT = ("PRODUCT", "PRODUCT NAME", "PACK", "BATCH", "HSN", "MRP", "RATE", "AMOUNT", "QTY", "SGST", "CGST", "GST", "DIS")
NO_PRODUCT_PARTS = ("TOTAL", "SUB TOTAL", "GRAND", "ROUND", "DISCOUNT", "BANK", "GSTIN")
UNITS = ("PCS", "TAB", "TABS", "CAP", "CAPS", "BOX", "STR", "STRIP", "ML", "GM", "NOS", "NO", "KG", "LTR")
FOOTER_WORDS = r"\b(?:SUB\s*TOTAL|GRAND\s*TOTAL|ROUND\s*OFF|DISCOUNT|SGST|CGST|IGST|NET\s+(?:PAYABLE|AMOUNT|AMT))\b"
HEADER_ONLY = r"^(?:PRODUCT|BATCH|EXP|HSN|QTY|RATE|DISC|MRP|AMOUNT)$"
#: Rates of tax, as each of four steps has them.
RATE_SETS = {
    "columns": (0.0, 2.5, 5.0, 6.0, 9.0, 12.0, 18.0, 28.0), "totals": (2.5, 5.0, 12.0, 18.0, 28.0),
    "graph": (0.0, 2.5, 5.0, 6.0, 9.0, 12.0, 14.0, 18.0, 28.0), "rescue": (2.5, 5.0, 6.0, 9.0, 12.0, 18.0, 28.0),
}
NEEDED = ("quantity", "rate", "amount")
#: Sets of known meanings that tell that columns were lost.
LOST = (("amount",), ("amount", "product"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]{2,}"), F.lit(0))


def slipped_product(text: Column) -> Column:
    """Whether a text over a table may be the product that slipped out of it."""
    up = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return up.rlike("[A-Z]") & ~up.isin(*NO_PRODUCT) & ~reduce(lambda a, b: a | b, [F.contains(up, F.lit(p)) for p in NO_PRODUCT_PARTS])


def rescued_product(text: Column) -> Column:
    """Whether a text has a product's mark, or words enough, and no words of heads, totals or addresses."""
    up, found = F.upper(F.trim(F.coalesce(text, F.lit("")))), words(text)
    letters = F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w))
    barred = up.rlike(HEADER_ONLY) | up.rlike(FOOTER_WORDS) | up.rlike(METADATA)
    return ~barred & (F.size(found) > 0) & (up.rlike(PRODUCT_MARKS) | ((F.size(found) >= 2) & (letters >= 8)))


def graph_product(text: Column) -> Column:
    """Whether a token has letters and isn't a unit or a number with one."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return up.rlike("[A-Z]") & ~up.isin(*UNITS) & ~up.rlike(r"^\d+[A-Z]+$")


def rate_like(text: Column, which: str) -> Column:
    """Whether a text is one of a step's rates; the graph also takes any percentage."""
    number = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
    found = F.coalesce(number.isin(*RATE_SETS[which]), F.lit(False))
    return found | F.contains(text, F.lit("%")) if which == "graph" else found


def summary_noise(text: Column) -> Column:
    """Whether a row with integrated tax is a summary of rates, whose numbers aren't the invoice's tax."""
    up = F.upper(F.coalesce(text, F.lit("")))
    labels, percents = F.regexp_count(up, F.lit(r"\b(?:SGST|CGST|IGST|GST)\b")), F.regexp_count(up, F.lit(r"\b\d+(?:[.,]\d+)?\s*%"))
    numbers = F.size(decimals_in(up))
    return F.contains(up, F.lit("IGST")) & up.rlike(r"\b(?:TAX|GST|RATE|SUMMARY|TAXABLE)\b") & (labels >= 3) & ((numbers >= 3) | (percents >= 2))


def tax_evidence(candidates: DataFrame) -> DataFrame:
    """Add clean and adjacent to label candidates: a tax whose own cell goes on with its value alone, or whose value stands beside it."""
    tax = F.col("label").isin(*TAXES)
    behind = F.regexp_extract("row_text", r"(?i)\b[SCI]GST\b(.*)$", 1)
    first = F.get(decimals_in(behind), F.lit(0))
    clean = tax & (F.col("strategy") == "same_cell_after_label") & ~behind.rlike(METADATA) & ~repeated_rates(behind) & F.coalesce(F.abs(first - F.col("value")) <= 1, F.lit(False))
    return candidates.withColumn("clean", clean).withColumn("adjacent", clean | (tax & F.col("strategy").isin("right_cell", "right_cell_after_tax_rate")))


def band_checks(values: DataFrame, key: list[str]) -> DataFrame:
    """What the numbers of a band look like, from rows (key, cents, right edge): amounts, repeated rates, and how even their edges are.

    spread_n2 is the population variance of the right edges times the square of their number, a whole number.
    """
    cents, right = F.col("cents"), F.col("right")
    rates = [int(r * 100) for r in RATE_SETS["rescue"]]
    found = values.where("cents is not null").groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(cents > 0).alias("positive"), F.count_if(cents >= 2000).alias("high"), F.sum(F.when(cents > 0, cents).otherwise(0)).alias("total"),
        F.count_if(cents.isin(*rates)).alias("rates"), (F.count("*") * F.sum(right * right) - F.sum(right) * F.sum(right)).cast("bigint").alias("spread_n2"),
    )
    amounts = (F.col("positive") >= 3) & (F.col("high") >= 3) & (F.col("total") >= 2500 * F.col("positive"))
    return found.select(*key, "n", "spread_n2", amounts.alias("amounts"), ((F.col("positive") >= 3) & (F.col("rates") * 100 >= 55 * F.col("positive"))).alias("repeated_rates"))


def footer_region(text: Column) -> Column:
    """Whether a region's text is that of totals: two such words at least, and under three marks of products."""
    up = F.upper(text)
    return (F.regexp_count(up, F.lit(FOOTER_WORDS)) >= 2) & (F.regexp_count(up, F.lit(PRODUCT_MARKS)) < 3)


def anchor_bands(anchors: DataFrame, by: str) -> DataFrame:
    """Bands of clustered anchors (doc_id, by, row_no, vote, min_x, max_x, anchor2): extent, support, votes, and whether anything but text votes."""
    votes = [F.count_if(F.col("vote") == v).alias(f"n_{v}") for v in ("expiry", "batch", "hsn", "money", "qty", "text")]
    bands = anchors.groupBy("doc_id", by).agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.sum("anchor2").alias("anchors2"), F.count_distinct("row_no").alias("support"), F.count("*").alias("tokens"), *votes)
    return bands.withColumn("useful", F.expr("n_expiry + n_batch + n_hsn + n_money + n_qty > 0"))


def repair_evidence(cells: DataFrame, meanings: DataFrame) -> DataFrame:
    """Whether a document's columns have to be rebuilt: meanings that lack or hint at lost ones, or too few columns for the text."""
    known = meanings.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("meaning") != "unknown", F.col("meaning")))).alias("known"), F.max(F.col("meaning") == "unknown").alias("unknown"))
    lacking = F.array_except(F.array(*map(F.lit, NEEDED)), "known")
    lost = reduce(lambda a, b: a | b, [F.col("known") == F.array(*map(F.lit, s)) for s in LOST]) | ((F.col("known") == F.array(F.lit("product"))) & F.col("unknown"))
    # one pass: cells of a row are counted first, then rows and columns of a document
    said = F.length(F.trim("text"))
    item = F.col("row_role") == "item_row"
    line = cells.where(said > 0).groupBy("doc_id", "row_no").agg(F.count("*").alias("n"), F.sum(said).alias("letters"), F.collect_set("col_no").alias("cols"), F.count_if(item).alias("own"))
    own = F.col("own") > 0
    shape = line.groupBy("doc_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("cols")))).cast("bigint").alias("n_cols"), F.sum("letters").alias("letters"), F.sum("n").alias("n"),
        F.when(F.max(own), F.count_if(own)).alias("items"), F.when(F.max(own), F.count_if(own & (F.col("own") <= 1))).alias("single"), F.sum(F.when(own, F.col("own"))).alias("cells"))
    t = shape.join(known, "doc_id", "left")
    few = (F.col("n_cols") <= 2) & ((F.col("letters") >= 60 * F.col("n")) | (F.col("single") * 2 >= F.col("items")))
    return t.select("doc_id", "n_cols", F.expr("10 * letters div n").alias("mean_length10"), "items", "single", F.expr("100 * cells div items").alias("cells_an_item100"), F.array_join(lacking, ",").alias("lacking"), (few | (F.size(lacking) > 0) | lost).alias("repair"))


def graph_confidence(rows: DataFrame, columns: DataFrame, tokens: DataFrame) -> DataFrame:
    """Confidence of a token graph in thousandths: item rows, how many of them each column reaches, connected tokens, and ends.

    rows (doc_id, hint), columns (doc_id, support), tokens (doc_id, isolated).
    """
    r = rows.groupBy("doc_id").agg(F.count_if(F.col("hint") == "item").alias("items"), F.max((F.col("hint") == "header").cast("int")).alias("head"), F.max((F.col("hint") == "footer").cast("int")).alias("foot"))
    c = columns.groupBy("doc_id").agg(F.sum("support").alias("support"), F.count("*").alias("n_cols"))
    t = tokens.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if("isolated").alias("alone"))
    return graph_score(r.join(c, "doc_id", "left").join(t, "doc_id"))


def graph_pages(rows: DataFrame) -> DataFrame:
    """graph_confidence() of rows that hold their columns (doc_id, hint, n_tokens, cols: a column number for each token), in one grouping."""
    item = F.col("hint") == "item"
    cols = F.when(item, F.array_distinct("cols"))
    t = rows.groupBy("doc_id").agg(
        F.count_if(item).alias("items"), F.max((F.col("hint") == "header").cast("int")).alias("head"), F.max((F.col("hint") == "footer").cast("int")).alias("foot"),
        F.sum(F.when(item, F.size(cols))).alias("support"), F.size(F.array_distinct(F.flatten(F.collect_list(cols)))).alias("n_cols"), F.sum("n_tokens").alias("nodes"), F.count_if(F.col("n_tokens") == 1).alias("alone"))
    return graph_score(t)


def graph_score(t: DataFrame) -> DataFrame:
    """graph_confidence() from a page's sums; support is null without item rows."""
    reach = F.coalesce(F.least(F.lit(1.0), F.col("support") / F.greatest(F.lit(1), F.col("n_cols") * F.col("items"))), F.lit(0.0))
    score = F.least(F.lit(1.0), F.col("items") / 8.0) * 0.3 + reach * 0.3 + (1.0 - F.col("alone") / F.col("nodes")) * 0.2 + (F.col("head") + F.col("foot")) * 0.1 + 0.1
    return t.select("doc_id", "items", F.floor(F.least(F.lit(1.0), score) * 1000 + 0.5).cast("bigint").alias("confidence"))


def engine_confidence(regions: DataFrame) -> DataFrame:
    """Mean confidence of a document's tables (score10, populated) in thousandths: from their scores, 0 without cells, half for one tiny table."""
    one = F.greatest(F.lit(0.0), F.least(F.lit(0.99), (F.col("score10") / 10.0 + 200.0) / 700.0))
    t = regions.withColumn("one", F.floor(one * 1000 + 0.5).cast("bigint")).groupBy("doc_id").agg(F.sum("one").alias("sum"), F.count("*").alias("tables"), F.sum("populated").alias("cells"))
    mean = F.when(F.col("cells") == 0, 0).when((F.col("tables") == 1) & (F.col("cells") < 3), F.expr("sum div 2")).otherwise(F.expr("sum div tables"))
    return t.select("doc_id", "tables", mean.cast("bigint").alias("confidence"))


def summary_rows(candidates: DataFrame) -> DataFrame:
    """How many rows of a document give totals, and how many taxes."""
    tax = F.col("label").isin(*TAXES)
    return candidates.groupBy("doc_id").agg(F.count_distinct(F.when(~tax, F.col("row_no"))).alias("footer_rows"), F.count_distinct(F.when(tax, F.col("row_no"))).alias("tax_rows"))


def main_region(regions: DataFrame) -> DataFrame:
    """The region of a document with most rows, then cells, then columns; the first on ties."""
    return with_main(regions).where("main").drop("main")


def with_main(regions: DataFrame) -> DataFrame:
    """Add main to regions: whether it is its document's main_region()."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n_rows"), F.desc("populated"), F.desc("n_cols"), "table_id")
    return regions.withColumn("main", F.row_number().over(w) == 1)


def best_band(tokens: DataFrame, bands: DataFrame, *keep: str) -> DataFrame:
    """The column band that overlaps a token most across, else the one whose center is nearest; the first on ties. keep names further columns of the tokens."""

    def rank(b: Column) -> Column:
        common = F.greatest(F.lit(0), F.least("max_x", b["max_x"]) - F.greatest("min_x", b["min_x"]))
        apart = F.abs(F.col("min_x") + F.col("max_x") - b["min_x"] - b["max_x"])
        return F.struct((-common).alias("c"), F.when(common > 0, 0).otherwise(apart).alias("d"), b["col_no"].alias("band"))

    held = assign.beside(tokens.select("doc_id", "ord", *dict.fromkeys(("min_x", "max_x", *keep))), bands, "col_no", "min_x", "max_x")
    best = held.select("doc_id", "ord", *keep, F.array_min(F.transform("_bands", rank)).alias("m"))
    return best.select("doc_id", "ord", *keep, "m.band", (-F.col("m.c")).alias("common"))


def row_ids(rows: DataFrame) -> DataFrame:
    """Ids of each row (ids, in order) united with those of the row after it, without repeats, in order; and how many of them are known."""
    w = Window.partitionBy("doc_id").orderBy("row_no")
    return rows.withColumn("united", F.array_sort(F.array_distinct(F.concat("ids", F.coalesce(F.lead("ids").over(w), F.filter("ids", lambda x: F.lit(False)))))))


def box_turn(boxes: DataFrame) -> DataFrame:
    """Score of each turn of a page in ten-thousandths: boxes that lie (wider than 1.3 heights) and reading that goes down.

    boxes (doc_id, turn, ord, box); the page's height at a turn is that of its lowest box.
    """
    page = Window.partitionBy("doc_id", "turn")
    first = F.row_number().over(page.orderBy("ord")) <= F.floor(F.count("*").over(page) / 2)
    b = boxes.withColumn("first", first).withColumn("c2", F.col("min_y") + F.col("max_y")).withColumn("lies", (F.col("max_x") - F.col("min_x")) * 10 > 13 * (F.col("max_y") - F.col("min_y")))
    t = b.groupBy("doc_id", "turn").agg(F.count("*").alias("n"), F.count_if("lies").alias("lie"), F.count_if("first").alias("k"), F.sum(F.when(F.col("first"), F.col("c2"))).alias("up"), F.sum(F.when(~F.col("first"), F.col("c2"))).alias("down"), F.greatest(F.lit(1), F.max("max_y")).alias("high"))
    return turn_score(t)


def turn_score(t: DataFrame) -> DataFrame:
    """Score of turns from their sums: n tokens, k of them first, those that lie, doubled centers (up: of the first), and the page's height."""
    flow = F.when(F.col("n") >= 4, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + (F.col("down") / (F.col("n") - F.col("k")) - F.col("up") / F.col("k")) / 2.0 / F.col("high")))).otherwise(0.5)
    return t.select("doc_id", "turn", F.floor((0.75 * (F.col("lie") / F.col("n")) + 0.25 * flow) * 10000 + 0.5).cast("bigint").alias("score"))


def box_turns(tokens: DataFrame) -> DataFrame:
    """box_turn() of every turn of pages as they lie: sums of one row a token, where a row for each turn would have to be sorted."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    page = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = tokens.select("doc_id", *geometry.box(), (F.row_number().over(w) <= F.floor(F.count("*").over(page) / 2)).alias("first"), F.max("max_x").over(page).alias("_w"), F.max("max_y").over(page).alias("_h"))
    sums = [F.count("*").alias("n"), F.count_if("first").alias("k")]
    for t in orientation.TURNS:
        b = orientation.turned_box(geometry.box(), t, F.col("_w"), F.col("_h"))
        lies, c2 = (b["max_x"] - b["min_x"]) * 10 > 13 * (b["max_y"] - b["min_y"]), b["min_y"] + b["max_y"]
        sums += [F.count_if(lies).alias(f"lie{t}"), F.sum(F.when(F.col("first"), c2)).alias(f"up{t}"), F.sum(F.when(~F.col("first"), c2)).alias(f"down{t}"), F.max(b["max_y"]).alias(f"high{t}")]
    pages = held.groupBy("doc_id").agg(*sums)
    turns = F.array(*[F.struct(F.lit(t).alias("turn"), *[F.col(f"{k}{t}").alias(k) for k in ("lie", "up", "down", "high")]) for t in orientation.TURNS])
    return turn_score(pages.select("doc_id", "n", "k", F.inline(turns)).withColumn("high", F.greatest(F.lit(1), F.col("high"))))


def applied_turn(scores: DataFrame) -> DataFrame:
    """The turn to apply to each page: the best (the first on ties), where it scores over 0.70 and 0.10 over the upright page."""
    best = scores.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("turn").alias("turn"))).alias("m"), F.max(F.when(F.col("turn") == 0, F.col("score"))).alias("upright"))
    score = -F.col("m.s")
    return best.select("doc_id", F.when((score > 7000) & (score > F.col("upright") + 1000), F.col("m.turn")).otherwise(0).alias("turn"), score.alias("score"))
