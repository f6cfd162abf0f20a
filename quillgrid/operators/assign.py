"""Joins of tokens with rows, cells, neighbours and columns. Every join has the document as its key."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.predicates import is_numeric_like
from ..sources.staging import computed
from . import placing
from .folds import folded

KEY = ["doc_id", "ord"]


def beside(tokens: DataFrame, bands: DataFrame, *columns: str) -> DataFrame:
    """Tokens with the bands of their document in one array (_bands).

    A page's bands are few. A pair for each token and band would have to be
    sorted by token; so every token stays one row, as it is dealt.
    """
    return tokens.join(bands.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("_bands")), "doc_id")


def cell_grid(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """A cell for each row and column of a document: the overlap of their bands."""
    r = rows.select("doc_id", "row_no", F.col("min_y"), F.col("max_y"))
    return r.join(columns.select("doc_id", "col_no", "min_x", "max_x"), "doc_id")


def token_rows(tokens: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The row with the largest vertical overlap of each token, over least; the first on ties."""
    r = rows.select("doc_id", F.col("row_no").alias("row"), F.col("min_y").alias("r_min"), F.col("max_y").alias("r_max"))
    t = g.box()
    pairs = tokens.join(r, "doc_id").withColumn("share", g.row_overlap(t, F.col("r_min"), F.col("r_max"))).where(F.col("share") > least)
    w = Window.partitionBy(*KEY).orderBy(F.desc("share"), "row")
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "r_min", "r_max")


#: Which cells a token was held against, by tier.
TIERS = ("row_scoped", "neighbor_row", "global_fallback")


def page(tokens: DataFrame, rows: DataFrame, cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens, rows and cells as rows of one frame, which celled() takes; keep names further columns of the tokens (whole numbers)."""
    box = [F.col(c) for c in placing.BOX]
    zero = [F.lit(0).cast("bigint").alias(c) for c in placing.BOX[:2]]
    kind = lambda k: F.lit(k).alias("kind")
    own = tokens.select("doc_id", kind(placing.TOKEN), F.col("ord").cast("bigint").alias("ord"), is_numeric_like(F.col("text")).cast("bigint").alias("no"), *box, *keep)
    of_cells = cells.select("doc_id", kind(placing.CELL), F.col("row_no").cast("bigint").alias("ord"), F.col("col_no").cast("bigint").alias("no"), *box)
    of_rows = rows.select("doc_id", kind(placing.ROW), F.col("row_no").cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("no"), *zero, "min_y", "max_y")
    return own.unionByName(of_cells, allowMissingColumns=True).unionByName(of_rows, allowMissingColumns=True).fillna(0, list(keep) or ["no"])


def celled(pages: DataFrame, gap: float = 0.12, keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Every token of the pages with its cell, its score and strategy; null where it has none.

    A cell is a candidate if it holds enough of the token's area, a number more
    than a text; the best one counts unless the second is within gap. A token
    looks in its row, else in a row beside it, else anywhere in its document.
    """
    more = "".join(f", {k} bigint" for k in keep)
    found = folded(pages, partial(placing.celled, gap=gap, keep=keep), f"doc_id bigint, ord bigint, cell_row bigint, cell_col bigint, score double, tier int{more}", dealt=dealt)
    has, name = F.col("tier") >= 0, F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    return found.select(*KEY, *[F.when(has, F.col(c)).alias(c) for c in ("cell_row", "cell_col", "score")], F.when(has, name).alias("strategy"), *keep)


def token_cells(tokens: DataFrame, rows: DataFrame, cells: DataFrame, gap: float = 0.12) -> DataFrame:
    """The cell of each token that has one, by celled(); row and column numbers as the cells have them."""
    kinds = dict(cells.dtypes)
    found = celled(page(tokens, rows, cells), gap).where("cell_row is not null")
    return found.select(*KEY, F.col("cell_row").cast(kinds["row_no"]).alias("cell_row"), F.col("cell_col").cast(kinds["col_no"]).alias("cell_col"), "score", "strategy")


def neighbours(tokens: DataFrame, dealt: bool = False) -> DataFrame:
    """The nearest token of each token to the left, right, top and bottom.

    Left and right need a quarter of the height in common, top and bottom a
    fifth of the width. Tokens walk away from their place until they meet one.
    """
    kinds = dict(tokens.dtypes)
    found = folded(tokens.select(*KEY, *placing.BOX), placing.nearest, f"doc_id bigint, ord {kinds['ord']}, side int, other {kinds['ord']}, distance2 {kinds['min_x']}", dealt=dealt)
    return found.select(*KEY, F.element_at(F.array(*map(F.lit, placing.SIDES)), F.col("side") + 1).alias("dir"), "other", "distance2")


def orphans(tokens: DataFrame, owned: DataFrame) -> DataFrame:
    """Tokens without a cell."""
    return tokens.join(owned.select(*KEY), KEY, "left_anti")


def first_owner(tokens: DataFrame, owned: DataFrame) -> DataFrame:
    """Each token with the first cell that claims it, if any."""
    w = Window.partitionBy(*KEY).orderBy("cell_row", "cell_col")
    return tokens.join(owned.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"), KEY, "left")


def first_band(tokens: DataFrame, bands: DataFrame) -> DataFrame:
    """Each token with the first band (cell_row) of its document that it reaches into; null if there is none."""
    held = beside(tokens, bands, "row_no", "min_y", "max_y")
    inside = F.filter("_bands", lambda b: (F.col("max_y") > b["min_y"]) & (F.col("min_y") < b["max_y"]))
    return held.withColumn("cell_row", F.array_min(F.transform(inside, lambda b: b["row_no"]))).drop("_bands")


def nearest_row(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """The row whose center is nearest to each token's center; the first on ties."""
    near = F.transform("_bands", lambda r: F.struct(F.abs(F.col("_c2") - r["min_y"] - r["max_y"]).alias("d2"), r["row_no"].alias("row")))
    held = beside(tokens.select(*KEY, (F.col("min_y") + F.col("max_y")).alias("_c2")), rows, "row_no", "min_y", "max_y")
    return held.select(*KEY, F.array_min(near).alias("m")).select(*KEY, F.col("m.row").alias("row"), F.col("m.d2").alias("distance2"))


def nearest_column(tokens: DataFrame, columns: DataFrame, within: int | None = None) -> DataFrame:
    """The column whose center is nearest to each token's center, within some pixels; numbers that look like a tax rate don't go to quantities."""
    rate = F.regexp_replace("text", "[%\\s]", "").isin("2.5", "2.50", "5", "5.0", "5.00", "12", "12.0", "12.00", "18", "18.0", "18.00", "28", "28.0", "28.00")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= 3
    bare = tokens.select(*KEY, (F.col("min_x") + F.col("max_x")).alias("_c2"), rate.alias("_rate"), letters.alias("_letters"))
    held = beside(bare, columns, "col_no", "semantic", "min_x", "max_x")
    barred = lambda c: (F.col("_rate") & (c["semantic"] == "quantity")) | (F.col("_letters") & c["semantic"].isin("quantity", "rate", "amount"))
    d2 = lambda c: F.abs(F.col("_c2") - c["min_x"] - c["max_x"])
    fits = lambda c: ~barred(c) if within is None else ~barred(c) & (d2(c) < 2 * within)
    near = F.transform(F.filter("_bands", fits), lambda c: F.struct(d2(c).alias("d2"), c["col_no"].alias("near_col")))
    found = computed(held, m=F.array_min(near)).where("m is not null")
    return found.select(*KEY, F.col("m.near_col").alias("col_no"), F.col("m.d2").alias("distance2"))


def inside_boxes(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """Tokens whose center lies in a box of their document."""
    b = boxes.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in ("min_x", "max_x", "min_y", "max_y")])
    x2, y2 = F.col("min_x") + F.col("max_x"), F.col("min_y") + F.col("max_y")
    on = (F.col("doc_id") == F.col("b_doc")) & (x2 >= 2 * F.col("b_min_x")) & (x2 <= 2 * F.col("b_max_x")) & (y2 >= 2 * F.col("b_min_y")) & (y2 <= 2 * F.col("b_max_y"))
    return tokens.join(b.withColumnRenamed("doc_id", "b_doc"), on, "left_semi")


def zipped(left: DataFrame, right: DataFrame, order: str = "ord") -> DataFrame:
    """The i-th row of left with the i-th of right, within a document; rows without a partner stay."""
    w = Window.partitionBy("doc_id").orderBy(order)
    a = left.select("doc_id", F.row_number().over(w).alias("i"), F.col("text").alias("left_text"))
    b = right.select("doc_id", F.row_number().over(w).alias("i"), F.col("text").alias("right_text"))
    return a.join(b, ["doc_id", "i"], "full")


def shifted(rows: DataFrame, value: str, order: str = "row_no") -> DataFrame:
    """Each row with the value of the row before it, which repairs texts that slipped by a row."""
    return rows.withColumn(f"{value}_before", F.lag(value).over(Window.partitionBy("doc_id").orderBy(order)))
