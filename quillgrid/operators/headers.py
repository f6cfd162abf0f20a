"""The header line of a page by a vote of its words, and the bands of columns that it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import bound
from ..sources.staging import computed

# Words of heads in the order in which they are tried, heads that count twice, the vote's steps, and centers where no head tells.
ROLES = (
    ("pcode", r"\bP\s*CODE\b|PCODE"), ("description", r"ITEM DESCRIPTION|^DESCRIPTION$|ITEM.*DESCRIPTION|DESCRIPTION.*ITEM"), ("hsn", r"(?:^| )(?:HSN|RSN)"), ("upc", r"(?:^| )UPC"), ("mrp", "MRP"), ("qty", "QTY"),
    ("taxable", "TAXABLE"), ("net_amt", "NET AMT|NET AMOUNT"), ("gross", "GROSS|GREES"), ("discount", "DISC"), ("cgst", "CGST|COST|OSTN"), ("sgst", "SGST|SGET"),
)
DOUBLE = ("pcode", "description", "hsn", "net_amt")
STEP, NEAR, FROM_EDGE = 10, 18, 32
CENTERS = {"pcode": 120, "description": 198, "hsn": 286, "upc": 321, "mrp": 344, "qty": 408, "gross": 445, "discount": 550, "taxable": 588, "cgst": 650, "sgst": 680}
#: Reach to the left and right of a center, for bands that don't end halfway to the next.
REACH = {"qty": (18, 22), "gross": (22, 24), "discount": (22, 22), "taxable": (22, 24), "cgst": (24, 24), "sgst": (24, 24)}


def header_role(text: Column) -> Column:
    """Which column a token heads; null if none."""
    clean = F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9 ]+", ""))
    return bound(clean, lambda c: F.when(c.rlike("[A-Z]"), F.coalesce(*[F.when(c.rlike(p), name) for name, p in ROLES])))  # no role is without letters


def header_line(tokens: DataFrame) -> DataFrame:
    """(doc_id, header_y, one center a role, page_min, page_max) of each page.

    Heads vote for the height that they stand at, in steps; the first height
    with most votes wins, and heads near it are the header, of which a line may
    be two. A page without heads has its topmost token's height.
    """
    x, y = ((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xy")
    t = computed(tokens.select("doc_id", "ord", "min_x", "max_x", x.alias("cx"), y.alias("cy"), "text"), role=header_role(F.col("text")))
    bucket = F.bround(F.col("cy") / STEP) * STEP
    hit = F.when(F.col("role").isNotNull(), F.struct("ord", "role", "cx", "cy", bucket.alias("bucket"), F.when(F.col("role").isin(*DOUBLE), 2).otherwise(1).alias("votes")))
    # a page's heads are few: they vote within one array, so that its tokens are grouped once
    pages = t.groupBy("doc_id").agg(F.collect_list(hit).alias("hits"), F.min("cy").alias("_top"), F.min("min_x").alias("page_min"), F.max("max_x").alias("page_max"))
    own = lambda b: F.filter("hits", lambda h: h["bucket"] == b)
    sums = lambda hs: F.aggregate(hs, F.lit(0), lambda a, h: a + h["votes"])
    votes = F.transform(F.array_distinct(F.transform("hits", lambda h: h["bucket"])), lambda b: F.struct((-sums(own(b))).alias("votes"), F.array_min(F.transform(own(b), lambda h: h["ord"])).alias("first"), b.alias("bucket")))
    pages = computed(pages, best=F.array_min(votes)["bucket"])
    pages = computed(pages, near=F.filter("hits", lambda h: F.abs(h["cy"] - F.col("best")) <= NEAR))
    mean = lambda hs, c: F.when(F.size(hs) > 0, F.aggregate(hs, F.lit(0.0), lambda a, h: a + h[c]) / F.size(hs))
    headed = lambda r: F.filter("near", lambda h: h["role"] == r)
    centers = [mean(headed(r), "cx").alias(r) for r, _ in ROLES]
    return pages.select("doc_id", "page_min", "page_max", F.coalesce(mean(F.col("near"), "cy"), "_top").alias("header_y"), *centers)


def column_bands(lines: DataFrame) -> DataFrame:
    """(doc_id, header_y, band, min_x, max_x): bands of thirteen columns from the centers of header_line(), with fixed centers for heads that are missing."""
    c = {r: F.coalesce(F.col(r), F.lit(float(CENTERS[r]))) if r in CENTERS else F.coalesce(F.col(r), F.col("page_max") - FROM_EDGE) for r, _ in ROLES}
    half = lambda a, b: (c[a] + c[b]) / 2
    ends = {
        "sl_no": (F.greatest(F.col("page_min"), c["pcode"] - 42), c["pcode"] - 22), "pcode": (c["pcode"] - 28, F.least(c["pcode"] + 28, half("pcode", "description") - 2)),
        "description": (F.greatest(c["pcode"] + 22, half("pcode", "description") - 18), half("description", "hsn") + 4), "hsn": (half("description", "hsn") + 5, half("hsn", "upc") + 5), "upc": (half("hsn", "upc") + 5, half("upc", "mrp") + 5), "mrp": (half("upc", "mrp") + 5, c["mrp"] + 38),
        **{r: (c[r] - a, c[r] + b) for r, (a, b) in REACH.items()}, "net_amt": (F.greatest(c["net_amt"] - 30, c["sgst"] + 16), F.least(F.col("page_max") + 8, c["net_amt"] + 44)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("band"), a.cast("double").alias("min_x"), b.cast("double").alias("max_x")) for n, (a, b) in ends.items()])
    return lines.select("doc_id", "header_y", F.explode(rows).alias("b")).select("doc_id", "header_y", "b.*")
