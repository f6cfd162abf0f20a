"""Search for a key in JSON texts of any shape, as one column expression without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

NODE = "array<struct<path:array<int>,raw:string,kind:string>>"
HIT = "array<struct<path:array<int>,raw:string>>"


def _kind(value: Column) -> Column:
    """object, array, null or other of a variant."""
    schema = F.schema_of_variant(value)
    return F.when(value.isNull() | F.is_variant_null(value), "null").when(F.startswith(schema, F.lit("OBJECT")), "object").when(F.startswith(schema, F.lit("ARRAY")), "array").otherwise("other")


def _entries(raw: Column) -> Column:
    """Keys, texts and kinds of an object's values, in the order of the text."""
    texts, values = F.from_json(raw, "map<string,string>"), F.from_json(raw, "map<string,variant>")
    return F.transform(F.map_keys(texts), lambda k: F.struct(k.alias("key"), texts[k].alias("raw"), _kind(values[k]).alias("kind")))


def _items(raw: Column) -> Column:
    texts, values = F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>")
    return F.transform(texts, lambda t, i: F.struct(F.lit("").alias("key"), t.alias("raw"), _kind(F.get(values, i)).alias("kind")))


def find_key(json: Column, key: str, depth: int = 4) -> Column:
    """The value of a key in a JSON text, as text: that of the outermost object, else the first below in order.

    An object that has the key is searched no further, and where its value is
    null nothing comes from it. Objects and arrays down to `depth` levels below
    the outermost count. Null for no find, and for what is no JSON.
    """
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), json.alias("raw"), _kind(F.try_parse_json(json)).alias("kind"))).cast(NODE)

    def opened(node: Column) -> Column:
        none = F.array().cast("array<struct<key:string,raw:string,kind:string>>")
        inside = F.when(node["kind"] == "object", _entries(node["raw"])).when(node["kind"] == "array", _items(node["raw"])).otherwise(none)
        return F.struct(node["path"].alias("path"), (node["kind"] == "object").alias("named"), F.coalesce(inside, none).alias("inside"))

    def own(node: Column) -> Column:
        return F.filter(node["inside"], lambda e: node["named"] & (e["key"] == key))

    def walk(nodes: Column, left: int) -> Column:
        def level(found: Column) -> Column:
            hits = F.flatten(F.transform(found, lambda n: F.transform(F.filter(own(n), lambda e: e["kind"] != "null"), lambda e: F.struct(n["path"].alias("path"), e["raw"].alias("raw"))))).cast(HIT)
            if not left:
                return hits
            rest = F.filter(found, lambda n: F.size(own(n)) == 0)
            deeper = F.flatten(F.transform(rest, lambda n: F.filter(F.transform(n["inside"], lambda e, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), e["raw"].alias("raw"), e["kind"].alias("kind"))), lambda c: c["kind"].isin("object", "array")))).cast(NODE)
            return F.concat(hits, let(deeper, lambda d: walk(d, left - 1)))

        return let(F.transform(nodes, opened), level)

    return F.array_min(walk(root, depth))["raw"]
