"""Sources and sinks: recognised pages as JSON, audit reports as Markdown, images, JSONL samples, priors.

Readers give DataFrames with fixed schemas; what can't be read becomes a row
with an error, not a failed job. Recognition of images and extraction by a
language model are outside: recognise() and extract() take the client.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK = "struct<id:string,text:string,polygon:array<array<double>>,confidence:double>"
PAGE = f"text string, blocks array<{BLOCK}>, metadata struct<text:string,blocks:array<{BLOCK}>>, _corrupt_record string"
#: What a language model returns for an invoice.
INVOICE = "metadata map<string,string>, items array<struct<product_name:string,batch:string,expiry:string,qty:double,rate:double,amount:double,discount:double,hsn_code:string>>, subtotal double, tax struct<cgst:double,sgst:double,igst:double,total_tax:double>, grand_total double"
#: Limits of an image: bytes, shorter and longer side, shape.
MAX_BYTES, MIN_SIDE, MAX_SIDE, MIN_ASPECT, MAX_ASPECT = 20 * 1024 * 1024, 256, 4096, 0.5, 2.0


def pages(spark: SparkSession, path: str, version: str | None = None, skip: tuple[str, ...] = ("debug_output.json",)) -> DataFrame:
    """Recognised pages of a directory of JSON files: doc_id (the file's name), text, blocks, error.

    Text and blocks may stand at the top or in metadata. With a version only
    files of that version are read.
    """
    pattern = "*.json" if version is None else f"*_v{version}.json"
    raw = spark.read.schema(PAGE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", pattern).json(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = raw.select(F.regexp_replace(name, r"\.json$", "").alias("doc_id"), name.alias("_n"), F.coalesce("text", "metadata.text").alias("text"), F.coalesce("blocks", "metadata.blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"), F.col("_corrupt_record").alias("error"))
    return rows.where(~F.col("_n").isin(*skip)).drop("_n")


def save_pages(rows: DataFrame, path: str, version: str) -> None:
    """Write pages, one folder for each version, so that a reader prunes by it."""
    rows.withColumn("pipeline_version", F.lit(version)).write.mode("append").partitionBy("pipeline_version").parquet(path)


def content_key(content: F.Column, version: str) -> F.Column:
    return F.concat(F.md5(content), F.lit(f"_v{version}"))


def uncached(images: DataFrame, cache: DataFrame) -> DataFrame:
    """Images whose key isn't in the cache."""
    return images.join(cache.select("doc_id"), "doc_id", "left_anti")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their kind by their first bytes and their size; error where they can't be taken."""
    raw = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg")
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("int")
    rows = raw.withColumn("kind", kind).withColumn("width", F.when(F.col("kind") == "png", number(17, 4))).withColumn("height", F.when(F.col("kind") == "png", number(21, 4)))
    error = F.when(F.col("length") > MAX_BYTES, "too_large").when(F.col("kind").isNull(), "unsupported image")
    return rows.withColumn("error", error).withColumn("doc_id", F.md5("content"))


def image_report(rows: DataFrame) -> DataFrame:
    """Errors, warnings and a score of images with width, height, grayscale and dpi."""
    side_ok = (F.least("width", "height") >= MIN_SIDE) & (F.greatest("width", "height") <= MAX_SIDE)
    aspect = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    aspect_ok = (aspect >= MIN_ASPECT) & (aspect <= MAX_ASPECT)
    errors = F.array_compact(F.array(F.when(~side_ok, "size_out_of_range"), F.when(~aspect_ok, "aspect_out_of_range")))
    warnings = F.array_compact(F.array(F.when(F.col("grayscale"), "grayscale"), F.when(F.coalesce("dpi", F.lit(0)) < 150, "low_or_unknown_dpi")))
    rows = rows.withColumn("errors", errors).withColumn("warnings", warnings)
    base = F.when(F.size("errors") > 0, 0.35).otherwise(1.0)
    return rows.withColumn("valid", F.size("errors") == 0).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - 0.1 * F.size("warnings"))), 2))


def recognise(rows: DataFrame, model: Callable[[bytes], dict]) -> DataFrame:
    """Pages from images by a recognition model, loaded once in each worker; an exception becomes the row's error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    page = model(bytes(content))
                    out.append((doc, page.get("text"), page.get("blocks") or [], None))
                except Exception as e:  # the model's own errors are data here
                    out.append((doc, None, [], str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "blocks", "error"])

    return rows.select("doc_id", "content").mapInPandas(run, f"doc_id string, text string, blocks array<{BLOCK}>, error string")


def extract(rows: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """Invoices from Markdown by a language model's JSON; empty Markdown isn't sent, and what doesn't parse has an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "json": [client(m) if m and m.strip() else None for m in frame["markdown"]]})

    answers = rows.select("doc_id", "markdown").mapInPandas(run, "doc_id string, json string")
    parsed = answers.withColumn("invoice", F.from_json("json", INVOICE))
    return parsed.withColumn("error", F.when(F.col("json").isNotNull() & F.col("invoice.grand_total").isNull() & (F.size(F.coalesce("invoice.items", F.array().cast("array<struct<product_name:string,batch:string,expiry:string,qty:double,rate:double,amount:double,discount:double,hsn_code:string>>"))) == 0), "schema_mismatch")).drop("json")


def tokens(rows: DataFrame) -> DataFrame:
    """One row for each block of pages: ids filled by place, cleaned text, box."""
    from ..functions.geometry import clean_text, polygon_box

    t = rows.select("doc_id", F.posexplode("blocks").alias("ord", "b"))
    t = t.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.coalesce("b.id", F.concat(F.lit("block_"), F.col("ord").cast("string"))).alias("token_id"), clean_text(F.col("b.text")).alias("text"), F.coalesce("b.confidence", F.lit(1.0)).alias("confidence"), polygon_box(F.coalesce("b.polygon", F.array().cast("array<array<double>>"))).alias("g"))
    return t.select("doc_id", "ord", "token_id", "text", "confidence", "g.*")


def audit_records(spark: SparkSession, path: str) -> DataFrame:
    """Failure records of Markdown audits: a heading for each, then "- **name**: value" lines."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^#{2,4}\s+")).alias("no", "part")).where("no > 0")
    names, values = (F.regexp_extract_all("part", F.lit(r"(?m)^\s*[-*]\s*\**([^:*]+?)\**\s*:\s*\**\s*(.*?)\s*$"), F.lit(i)) for i in (1, 2))
    fields = F.map_from_entries(F.array_distinct(F.zip_with(F.transform(names, lambda n: F.lower(F.replace(n, F.lit(" "), F.lit("_")))), values, lambda n, v: F.struct(n.alias("key"), v.alias("value")))))
    return text.select("file", "no", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), fields.alias("fields"))


def latest(priors: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Priors with changes put in: the last row of each key counts."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return priors.unionByName(changes, allowMissingColumns=True).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def nested(json: F.Column, paths: tuple[str, ...]) -> F.Column:
    """The first of several places in a JSON text that holds something."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths])


def save_reports(reports: DataFrame, path: str, text: str = "markdown") -> None:
    """Write one Markdown text a row, each a file's worth of lines, several documents a file."""
    reports.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def save_diagnostics(rows: DataFrame, path: str, kind: str) -> None:
    """Write diagnostic rows (coverage, assignments, item rows) as JSON lines, a folder for each kind."""
    rows.write.mode("overwrite").json(f"{path}/kind={kind}")


#: What a saved result tells of a row whose arithmetic failed.
FAILED_ROW = T.StructType([T.StructField("cause", T.StringType()), T.StructField("row_id", T.StringType()), T.StructField("cells", T.MapType(T.StringType(), T.StringType())), T.StructField("mapped_block_ids", T.ArrayType(T.StringType()))])
BENCHMARK = T.StructType([T.StructField("metadata", T.StructType([T.StructField("topology_source", T.StringType()), T.StructField("failures", T.ArrayType(FAILED_ROW))]))])


def benchmark_failures(spark: SparkSession, path: str, cause: str = "wrong column") -> DataFrame:
    """Failures of one cause in saved results (JSON files), each once: file, topology, row_id, texts by meaning and block ids."""
    raw = spark.read.schema(BENCHMARK).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = raw.select("file", F.coalesce("metadata.topology_source", F.lit("unknown")).alias("topology"), F.explode("metadata.failures").alias("f"))
    found = rows.where(F.contains(F.lower("f.cause"), F.lit(cause)))
    once = found.withColumn("_json", F.to_json("f")).dropDuplicates(["file", "_json"])
    names = ("product", "quantity", "free_quantity", "rate", "mrp", "gst", "amount")
    return once.select("file", "topology", "f.row_id", *[F.col("f.cells")[n].alias(n) for n in names], F.coalesce("f.mapped_block_ids", F.array().cast("array<string>")).alias("block_ids"))
