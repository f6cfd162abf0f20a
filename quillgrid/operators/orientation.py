"""Which way up a page is, by how its boxes line up and by what its rows say; and item rows from anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import Box, box, quarter_turned
from ..functions.predicates import row_class
from ..sources.staging import computed

TURNS = (0, 90, 180, 270)


def turned_box(box: Box, turn: int, width: Column, height: Column) -> dict[str, Column]:
    """The box that a turn of a page of some width and height gives."""
    (ax, ay), (bx, by) = (quarter_turned(x, y, turn, width, height) for x, y in ((box[0], box[2]), (box[1], box[3])))
    return {"min_x": F.least(ax, bx), "max_x": F.greatest(ax, bx), "min_y": F.least(ay, by), "max_y": F.greatest(ay, by)}


def turned(tokens: DataFrame) -> DataFrame:
    """Tokens of a page in each of four turns, with the box that each turn gives."""
    w = Window.partitionBy("doc_id")
    tokens = tokens.withColumn("_w", F.max("max_x").over(w)).withColumn("_h", F.max("max_y").over(w))
    boxes = [F.struct(F.lit(t).alias("turn"), *[c.alias(k) for k, c in turned_box(box(), t, F.col("_w"), F.col("_h")).items()]) for t in TURNS]
    return tokens.select("doc_id", "ord", "text", F.explode(F.array(*boxes)).alias("b")).select("doc_id", "ord", "text", "b.*")


def orientation(tokens: DataFrame, tall: int = 24) -> DataFrame:
    """The turn whose rows hold most medicine rows, then most rows of two tokens or more; the first on ties.

    A page's tokens lie in one array, which each turn sorts into lines: tokens
    aren't multiplied by turns, nor sorted by lines, as rows of the plan.
    """
    pages = tokens.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "text", "min_x", "max_x", "min_y", "max_y")).alias("tokens"), F.max("max_x").alias("w"), F.max("max_y").alias("h"))

    def lined(turn: int) -> Column:
        def placed(x: Column) -> Column:
            b = turned_box(tuple(x[k] for k in ("min_x", "max_x", "min_y", "max_y")), turn, F.col("w"), F.col("h"))
            return F.struct(F.floor((b["min_y"] + b["max_y"]) / (2 * tall)).alias("line"), b["min_x"].alias("min_x"), x["ord"].alias("ord"), x["text"].alias("text"))

        return F.struct(F.lit(turn).alias("turn"), F.array_sort(F.transform("tokens", placed)).alias("tokens"))

    turns = pages.select("doc_id", F.explode(F.array(*map(lined, TURNS))).alias("t")).select("doc_id", "t.*")
    each = turns.select("doc_id", "turn", "tokens", F.explode(F.array_distinct(F.transform("tokens", lambda x: x["line"]))).alias("line"))
    held = computed(each, held=F.transform(F.filter("tokens", lambda x: x["line"] == F.col("line")), lambda x: x["text"]))
    rows = computed(held.select("doc_id", "turn", "held"), n=F.size("held"), text=F.array_join("held", " "))
    score = F.sum(F.when(row_class(F.col("text")) == "Medicine Table Row", 100).otherwise(0) + F.when(F.col("n") >= 2, 5).otherwise(0))
    ranked = rows.groupBy("doc_id", "turn").agg(score.alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "turn")
    return ranked.withColumn("place", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w)).where("place = 1").drop("place")


def financial_cells(cells: DataFrame) -> DataFrame:
    """Cells that may matter to totals, by kind of their words."""
    up = F.upper("text")
    kinds = F.array(F.when(up.rlike("TOTAL|NET|PAYABLE"), "totals"), F.when(up.rlike("GST|TAX|CESS"), "taxes"), F.when(up.rlike("DISC|LESS"), "discounts"), F.when(up.rlike(r"\d+\.\d{2}"), "amounts"))
    return cells.select("doc_id", "row_no", "col_no", "text", F.explode(F.array_compact(kinds)).alias("kind"))


def anchored_rows(rows: DataFrame) -> DataFrame:
    """Item number of each row: an anchor row begins an item, and rows without an anchor go on with it."""
    w = Window.partitionBy("doc_id").orderBy("row_no")
    return rows.withColumn("item", F.sum(F.col("anchor").cast("int")).over(w)).where("item > 0")


def whole_rows(cells: DataFrame) -> DataFrame:
    """Rows of a table as maps from the first row's texts to theirs; a column without a head goes by its number."""
    rows = cells.where("row_no >= 0").groupBy("doc_id", "row_no").agg(F.collect_list(F.struct("col_no", "text")).alias("_cells"))
    rows = rows.withColumn("_heads", F.max(F.when(F.col("row_no") == 0, F.col("_cells"))).over(Window.partitionBy("doc_id"))).where("row_no > 0")
    heads = lambda c: F.transform(F.filter("_heads", lambda h: h["col_no"] == c["col_no"]), lambda h: h["text"])
    number = lambda c: F.concat(F.lit("col_"), c["col_no"].cast("string"))
    named = lambda c, found: F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(number(c))), lambda h: F.struct(F.coalesce(h, number(c)).alias("head"), c["text"].alias("text")))
    entries = F.flatten(F.transform("_cells", lambda c: named(c, F.coalesce(heads(c), F.array().cast("array<string>")))))
    return rows.select("doc_id", "row_no", F.map_from_entries(F.array_sort(entries)).alias("columns"))


def result_shape(raw: DataFrame, json: str = "result") -> DataFrame:
    """Which of four shapes a result has, by precedence, with the figures that all of them give."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(json, p) for p in paths])
    shape = F.when(at("$.metadata.metrics").isNotNull(), "runtime").when(at("$.metadata.reconstructed_rows", "$.reconstructed_rows").isNotNull(), "reconstructed").when(at("$.items", "$.invoice.items").isNotNull(), "extracted").otherwise("unsupported")
    number = lambda *paths: F.coalesce(at(*paths).try_cast("double"), F.lit(0.0))
    return raw.withColumn("shape", shape).withColumn("passed", number("$.metadata.metrics.rows_math_passed", "$.rows_math_passed")).withColumn("failed", number("$.metadata.metrics.rows_math_failed", "$.rows_math_failed")).withColumn("grand_total", at("$.metadata.metrics.parsed_grand_total", "$.grand_total", "$.invoice.grand_total").try_cast("double"))
