"""Twenty-three figures of saved results of whatever variant, from one schema and one parse of each text.

What a variant writes under names of its own (tables, columns) is read as maps
of JSON texts, which keep the order of the text; a value of another kind than
expected counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED = "map<string,string>"
_TABLE = "struct<table_id:string,source_engine:string,row_count:string,column_count:string,rows:array<struct<row_id:string,row_role:string>>,columns:array<string>,cells:array<struct<row_id:string,text:string>>,current_reconstructed_cells:array<struct<row_id:string,text:string>>>"
_METRICS = (
    f"struct<row_validation:{NAMED},financial_reconciliation:{NAMED},semantic_debug:struct<final_column_semantics:{NAMED},quarantined_cell_count:string>,final_column_semantics:{NAMED},column_semantic_cache:{NAMED},"
    f"anchor_repair:struct<enabled:boolean,before_column_count:string,after_column_count:string>,topology_debug:struct<main_tables:array<{_TABLE}>>,topology_source:string,tsr_status:struct<topology_source:string>,"
    "confidence_hierarchy:struct<invoice_confidence:string>,invoice_confidence:string,raw_token_count:string,table_count:string,quarantined_cell_count:string,instrumentation:struct<quarantined_cell_count:string>>"
)
RESULT = f"struct<metadata:struct<blocks:array<string>,structured_tables:array<{_TABLE}>,topology_source:string,invoice_confidence:string,metrics:{_METRICS}>>"
_VALIDATED = "struct<total_rows:string,missing_semantic_columns:array<string>,row_diagnostics:array<struct<row_role:string,populated_count:string,cell_count:string>>>"


def _objects(named: Column) -> Column:
    """Entries of a map whose values are objects, in the order of the text."""
    return F.filter(F.map_entries(named), lambda e: e["value"].startswith("{"))


def _types(named: Column) -> Column:
    """The meanings that a map of columns gives, by their type or as plain words; names with _ are none."""
    told = F.transform(F.filter(F.map_entries(named), lambda e: ~e["key"].startswith("_")), lambda e: F.when(e["value"].startswith("{"), F.get_json_object(e["value"], "$.type")).when(~e["value"].startswith("["), e["value"]))
    return F.transform(F.filter(told, lambda t: t.isNotNull()), F.lower)


def _semantics(named: Column, table: Column) -> Column:
    """The table's meanings, else those that stand in the map itself, else those of its first table that has any; null if none."""
    own = F.try_element_at(named, table)
    some = lambda c: F.when(F.size(c) > 0, c)
    inner = lambda text: _types(F.from_json(text, NAMED))
    each = F.filter(F.transform(_objects(named), lambda e: inner(e["value"])), lambda t: F.size(t) > 0)
    return F.when(own.startswith("{"), some(inner(own))).otherwise(F.coalesce(some(_types(named)), F.get(each, F.lit(0))))


def _largest(tables: Column) -> Column:
    """The first table with most rows, then cells, then columns."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    keyed = F.transform(tables, lambda t, i: F.struct(F.greatest(count(t["rows"]), F.lit(0)).alias("r"), F.greatest(count(t["cells"]), F.lit(0)).alias("c"), F.greatest(count(t["columns"]), F.lit(0)).alias("k"), (-i).alias("i"), t.alias("t")))
    return F.array_max(F.transform(keyed, lambda x: F.struct(x["r"], x["c"], x["k"], x["i"])))["i"] * -1


def topology_fields(results: DataFrame, json: str = "result") -> DataFrame:
    """Replace the JSON text of each result by the figures of its main table and of how it was found.

    The main table is the first that row validation, then reconciliation, then
    meanings of columns, then the topology's report name; else the largest. A
    text that can't be parsed gives the figures of an empty result.
    """
    at = lambda p: F.col(f"_r.metadata.{p}")
    whole = lambda *cs: F.coalesce(*[c.try_cast("double").try_cast("bigint") for c in cs], F.lit(0))
    m = "metrics."
    t = results.withColumn("_r", F.from_json(json, RESULT))
    maps = [at(m + "row_validation"), at(m + "financial_reconciliation")]
    metas = [at(m + "semantic_debug.final_column_semantics"), at(m + "final_column_semantics"), at(m + "column_semantic_cache")]
    named = [F.get(F.filter(_objects(c), lambda e: ~e["key"].startswith("_") & (e["key"] != skip)), F.lit(0))["key"] for cs, skip in ((maps, "invoice_level"), (metas, "")) for c in cs]
    tables, reports = at("structured_tables"), at(m + "topology_debug.main_tables")
    first = lambda xs: F.get(xs, F.lit(0))
    biggest = F.get(tables, _largest(tables).cast("int"))
    t = t.withColumn("main_table_id", F.coalesce(*named, F.nullif(first(reports)["table_id"], F.lit("")), biggest["table_id"]))
    mine = lambda xs: first(F.filter(xs, lambda x: x["table_id"] == F.col("main_table_id")))
    t = t.withColumn("_t", F.coalesce(mine(tables), biggest, mine(reports), first(reports)))
    report = F.when(F.col("main_table_id").isNull(), first(reports)).otherwise(mine(reports))
    own = F.try_element_at(maps[0], F.col("main_table_id"))
    t = t.withColumn("_v", F.from_json(F.coalesce(F.when(own.startswith("{"), own), first(_objects(maps[0]))["value"]), _VALIDATED))
    t = t.withColumn("_types", F.coalesce(*[_semantics(c, F.col("main_table_id")) for c in metas], F.array().cast("array<string>")))

    roles = lambda xs: F.when(F.exists(xs, lambda x: F.coalesce(x["row_role"] == "item_row", F.lit(False))), F.filter(xs, lambda x: x["row_role"] == "item_row")).otherwise(xs)
    told = F.filter(F.transform(roles(F.col("_v.row_diagnostics")), lambda d: whole(d["populated_count"], d["cell_count"])), lambda n: n >= 0)
    cells = F.coalesce(F.when(F.size("_t.cells") > 0, F.col("_t.cells")), F.col("_t.current_reconstructed_cells"), F.array().cast("array<struct<row_id:string,text:string>>"))
    held = lambda row, full: F.size(F.filter(cells, lambda c: c["row_id"].eqNullSafe(row) & (F.lit(True) if not full else F.trim(F.coalesce(c["text"], F.lit(""))) != "")))
    found = F.transform(roles(F.col("_t.rows")), lambda r: F.when(held(r["row_id"], True) > 0, held(r["row_id"], True)).otherwise(held(r["row_id"], False)).cast("bigint"))
    counts = F.coalesce(F.when(F.size(told) > 0, told), found, F.array().cast("array<bigint>"))
    t = t.withColumn("_counts", counts)
    mean = F.when(F.size("_counts") > 0, F.round(F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size("_counts"), 2)).otherwise(0.0)
    size = lambda c: F.when(F.size(c) > 0, F.size(c)).cast("bigint")
    sure = [F.nullif(c.try_cast("double"), F.lit(0.0)) for c in (at("invoice_confidence"), at(m + "confidence_hierarchy.invoice_confidence"), at(m + "invoice_confidence"))]
    kinds = F.array_sort(F.array_distinct("_types"))
    word = lambda *ws: F.exists("_types", lambda x: x.isin(*ws))
    named_source = [F.nullif(c, F.lit("")) for c in (at("topology_source"), at(m + "topology_source"), at(m + "tsr_status.topology_source"), F.col("_t.source_engine"))]
    out = {
        "topology_source": F.coalesce(*named_source, F.lit("unknown")), "invoice_confidence": F.round(F.coalesce(*sure, F.lit(0.0)), 3),
        "raw_token_count": whole(at(m + "raw_token_count"), size(at("blocks"))), "table_count": whole(at(m + "table_count"), size(tables)), "main_table_id": F.coalesce(F.nullif("main_table_id", F.lit("")), F.lit("unknown")),
        "main_table_row_count": whole(size(F.col("_t.rows")), report["row_count"], F.col("_v.total_rows")), "main_table_column_count": whole(size(F.col("_t.columns")), report["column_count"]),
        "avg_cells_per_item_row": mean, "one_cell_item_rows_count": F.size(F.filter("_counts", lambda n: n <= 1)).cast("bigint"),
        "anchor_repair_enabled": F.coalesce(at(m + "anchor_repair.enabled"), F.lit(False)), "before_column_count": whole(at(m + "anchor_repair.before_column_count")), "after_column_count": whole(at(m + "anchor_repair.after_column_count")),
        "final_semantic_breakdown": F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit(":"), F.size(F.filter("_types", lambda x: x == k)).cast("string"))), ", "),
        **{f"has_{c}_column": word(*ws) for c, ws in (("product", ("product",)), ("batch", ("batch",)), ("expiry", ("expiry",)), ("qty", ("quantity", "qty", "free_quantity")), ("rate", ("rate",)), ("amount", ("amount",)))},
        "quarantined_cell_count": whole(at(m + "semantic_debug.quarantined_cell_count"), at(m + "quarantined_cell_count"), at(m + "instrumentation.quarantined_cell_count")),
        "missing_semantic_columns_count": F.coalesce(size(F.col("_v.missing_semantic_columns")), F.lit(0)).cast("bigint"), "missing_semantic_columns": F.array_join(F.coalesce("_v.missing_semantic_columns", F.array().cast("array<string>")), ","),
    }
    return t.select(*[c for c in results.columns if c != json], *[v.alias(k) for k, v in out.items()])
