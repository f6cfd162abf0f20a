"""Visual rows: grouping tokens, runs of one class, merging, ranges, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import computed


def joined_text(order: list[str], text: str = "text") -> Column:
    """Texts of a group in an order, joined by blanks."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(*order, text)))[text], " ")


def box_union() -> list[Column]:
    return [F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y")]


def visual_rows(tokens: DataFrame) -> DataFrame:
    """One row of text and box for each (doc_id, row_no)."""
    return tokens.groupBy("doc_id", "row_no").agg(joined_text(["min_x", "ord"]).alias("text"), F.count("*").alias("n_tokens"), *box_union())


def segments(rows: DataFrame, key: str = "doc_id", order: str = "row_no", label: str = "row_class") -> DataFrame:
    """Add segment: the number of the run of equal labels that a row belongs to, from 0."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("_s", starts).withColumn("segment", F.sum("_s").over(w)).drop("_s")


def legacy_merge(rows: DataFrame, price: str = r"\b\d+\.\d{2}\b") -> DataFrame:
    """Add merged_into: the medicine row before it that an unknown row without a price joins, else its own."""
    w = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    loose = (F.col("row_class") == "Unknown") & ~F.col("text").rlike(price)
    rows = rows.withColumn("_loose", loose)
    last = F.last(F.when(~F.col("_loose"), F.struct("row_no", "row_class")), ignorenulls=True).over(w)
    rows = rows.withColumn("_last", last)
    joins = F.col("_loose") & (F.col("_last.row_class") == "Medicine Table Row")
    return rows.withColumn("merged_into", F.when(joins, F.col("_last.row_no")).otherwise(F.col("row_no"))).drop("_loose", "_last")


def item_ranges(anchors: DataFrame, stop: str = "stop_y") -> DataFrame:
    """Add start and end of each item's band between anchors (doc_id, row_no, anchor_y, stop_y)."""
    w = Window.partitionBy("doc_id").orderBy("anchor_y", "row_no")
    first = F.row_number().over(w) == 1
    after = F.lead("anchor_y").over(w)
    start = F.when(first, F.col("anchor_y") - 5).otherwise(F.col("anchor_y") - 2)
    end = F.when(after.isNotNull(), after - 2).otherwise(F.least(F.col(stop) - 2, F.col("anchor_y") + 36))
    return anchors.withColumn("start", start).withColumn("end", end)


def in_bands(tokens: DataFrame, ranges: DataFrame, bands: list[tuple[str, float, float]], pad: float = 1.5) -> DataFrame:
    """Tokens within an item's range, with the first band in order that holds their center."""
    cx = F.col("_cx")
    band = F.coalesce(*[F.when((cx >= a - pad) & (cx <= b + pad), name) for name, a, b in bands])
    from .assign import beside

    placed = computed(tokens, _cx=(F.col("min_x") + F.col("max_x")) / 2, _cy=(F.col("min_y") + F.col("max_y")) / 2)
    placed = computed(placed, band=band).where("band is not null").drop("_cx")
    held = beside(placed, ranges, "row_no", "start", "end")
    items = F.transform(F.filter("_bands", lambda r: (F.col("_cy") >= r["start"]) & (F.col("_cy") < r["end"])), lambda r: r["row_no"])
    return held.withColumn("item", F.explode(items)).drop("_bands", "_cy")


def reading_order(tokens: DataFrame) -> DataFrame:
    """Text of each document in reading order: lines of six pixels, from the left."""
    line = F.rint(F.col("min_y") / 6).cast("bigint")
    return tokens.withColumn("_line", line).groupBy("doc_id").agg(joined_text(["_line", "min_x", "ord"]).alias("text"))


def baseline_lines(tokens: DataFrame) -> DataFrame:
    """Add line_no: a new line begins where the rounded baseline jumps by more than one."""
    w = Window.partitionBy("doc_id").orderBy("_base", "min_x", "ord")
    tokens = tokens.withColumn("_base", F.rint("max_y").cast("bigint"))
    jump = (F.col("_base") - F.lag("_base").over(w) > 1).cast("int")
    return tokens.withColumn("_j", F.coalesce(jump, F.lit(0))).withColumn("line_no", F.sum("_j").over(w)).drop("_j", "_base")


def inverted(tokens: DataFrame) -> DataFrame:
    """Documents whose second half of tokens, in input order, lies above the first; five tokens at least."""
    w = Window.partitionBy("doc_id")
    ranked = tokens.withColumn("_r", F.row_number().over(w.orderBy("ord"))).withColumn("_n", F.count("*").over(w))
    first = F.expr("_r <= _n div 2")
    sums = ranked.groupBy("doc_id").agg(F.max("_n").alias("n"), F.avg(F.when(first, F.col("min_y") + F.col("max_y"))).alias("a"), F.avg(F.when(~first, F.col("min_y") + F.col("max_y"))).alias("b"))
    return sums.select("doc_id", ((F.col("n") >= 5) & (F.col("b") / 2 < F.col("a") / 2 - 10)).alias("inverted"))


def median_interval(rows: DataFrame) -> DataFrame:
    """The upper median of distances between neighbouring row centers."""
    w = Window.partitionBy("doc_id").orderBy("center", "row_no")
    gaps = rows.withColumn("gap", F.lead("center").over(w) - F.col("center")).where("gap is not null")
    return gaps.groupBy("doc_id").agg(F.array_sort(F.collect_list("gap")).alias("g")).select("doc_id", F.expr("element_at(g, cast(size(g) div 2 as int) + 1)").alias("interval"))


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def multiline_stability(text: Column, price: str = r"\b\d+\.\d{2}\b") -> Column:
    """How stable a merged row looks: no text, digits without a price, or both letters and a price."""
    digits, letters = F.length(F.regexp_replace(text, r"\D", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(F.trim(text) == "", 0.3).when((digits > letters) & ~text.rlike(price), 0.8).when((letters > 0) & (digits > 0), 1.0).otherwise(1.0)


def neighbour_overlap(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Ids that a row shares with the row before and after it."""
    w = Window.partitionBy("doc_id").orderBy("row_no")
    shared = lambda other: F.size(F.array_intersect(ids, F.coalesce(other, F.array().cast(dict(rows.dtypes)[ids]))))
    return rows.withColumn("shared_before", shared(F.lag(ids).over(w))).withColumn("shared_after", shared(F.lead(ids).over(w)))
