"""Packing of documents into sequences by cutting-stock column generation.

A document's ids are cut at multiples of the sequence length; what remains is
an item. Item lengths, rounded up to QUANTUM, form a histogram. A linear
program over patterns (multisets of lengths that fit one sequence) covers it:
the simplex method starts from patterns of one length each, a knapsack dynamic
program prices new columns, and it ends when no pattern pays. Patterns are
rounded down and assigned to the items, which are ranked within their length.
The few items that rounding leaves form one stream that is cut into full
sequences; its tail is cut into powers of two, so that it needs no padding.

Defined results: a null or empty text is the end id alone; repeated rows are
packed as rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut_lineage, table, tune
from .tokens import word_ids

LENGTH = 2048
QUANTUM = 8
END_ID = 1
#: Items that are ranked together.
RANKED = 20_000


def knapsack(values: np.ndarray, room: int) -> np.ndarray:
    """How often each size 1..len(values) is taken for the largest sum of values within room."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        sizes = min(c, len(values))
        gain = best[c - sizes : c][::-1] + values[:sizes]  # size 1 first
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    taken, c = np.zeros(len(values), np.int64), room
    while c:
        if last[c]:
            taken[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return taken


def patterns(demand: dict[int, int], room: int, rounds: int = 20_000) -> list[tuple[int, dict[int, int]]]:
    """(count, {size: times}) of patterns that cover at most the demand, rounded down from the program's optimum."""
    sizes = sorted(k for k, n in demand.items() if n)
    if not sizes:
        return []
    m = len(sizes)
    d = np.array([demand[k] for k in sizes], float)
    columns = np.diag([room // k for k in sizes]).astype(float)
    inverse = np.diag([1 / (room // k) for k in sizes])
    x = inverse @ d
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        values = np.zeros(max(sizes))
        values[np.array(sizes) - 1] = np.maximum(duals, 0)
        new = knapsack(values, room)[np.array(sizes) - 1].astype(float)
        if new @ duals <= 1 + 1e-7:
            break
        step = inverse @ new
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = new
        x = np.maximum(inverse @ d, 0)
    left, found = d.astype(np.int64), []
    for p in np.argsort(-x, kind="stable"):
        column = columns[:, p].astype(np.int64)
        times = min([int(x[p] + 1e-6), *(int(left[i] // column[i]) for i in np.flatnonzero(column))])
        if times > 0:
            left -= times * column
            found.append((times, {sizes[i]: int(column[i]) for i in np.flatnonzero(column)}))
    return found


def _tokenized(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(path).all, END_ID.to_bytes(4, "little")
        for batch in batches:
            counts, crcs = [], []
            for raw in encode([t or "" for t in batch.column("text").to_pylist()]):
                raw += end
                counts.append(len(raw) // 4)
                crcs.append([zlib.crc32(raw[a : a + 4 * LENGTH]) for a in range(0, len(raw), 4 * LENGTH)])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("h"), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["rid", "doc_id", "h", "n", "crcs"])

    return run


def _pieces_again(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(path).ids, END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text, cuts in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                raw = encode(text or "") + end
                rows += [(doc, c["start"], c["length"], zlib.crc32(raw[4 * c["start"] : 4 * (c["start"] + c["length"])]), len(raw) // 4, c["sequence_id"], c["offset"]) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=COLUMNS)

    return run


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def ranked(items: DataFrame, n: int) -> DataFrame:
    """rank of each item within its size, from 0, by rid within hash buckets of bounded size."""
    items = items.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-n // RANKED)))))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("size", "bucket").agg(F.count("*").alias("c")).select("size", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("size", "bucket").orderBy("rid")
    return items.join(offsets, ["size", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1).drop("bucket", "first")


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    tokens = cut_lineage(docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_tokenized(path), "rid bigint, doc_id bigint, h bigint, n bigint, crcs array<bigint>"))
    items = tokens.withColumn("rest", F.col("n") % LENGTH).where("rest > 0").withColumn("size", F.ceil(F.col("rest") / QUANTUM).cast("int"))
    demand = {r["size"]: r["c"] for r in items.groupBy("size").agg(F.count("*").alias("c")).collect()}  # LENGTH / QUANTUM rows at most
    rows, taken, sequences = [], dict.fromkeys(demand, 0), 0
    for times, pattern in patterns(demand, LENGTH // QUANTUM):
        for size, per in pattern.items():
            rows.append((size, taken[size], taken[size] + times * per, sequences, per))
            taken[size] += times * per
        sequences += times
    plan = spark.createDataFrame(rows, "size int, low bigint, high bigint, first_sequence bigint, per bigint")
    used = spark.createDataFrame(list(taken.items()) or [(0, 0)], "size int, used bigint")  # a row for each size at most
    numbered = cut_lineage(ranked(items.select("rid", "doc_id", "h", "n", "rest", "size", F.element_at("crcs", -1).alias("crc")), sum(demand.values())).join(F.broadcast(used), "size"))

    placed = numbered.where("rank < used").join(F.broadcast(plan), "size").where("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.expr("first_sequence + (rank - low) div per"))
    above = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("rest").over(above), F.lit(0)).alias("offset"))

    streamed, count = _stream(docs, numbered.where("rank >= used"), sequences, path)
    return placed.unionByName(streamed).unionByName(_full(tokens, sequences + count))


def _full(tokens: DataFrame, first: int) -> DataFrame:
    """Pieces that fill a sequence each, numbered from first by input partition and place in it."""
    full = tokens.where(F.col("n") >= LENGTH).select("rid", "doc_id", "n", "crcs", F.shiftright("rid", 33).alias("part"), F.expr(f"n div {LENGTH}").alias("k"))
    parts = full.groupBy("part").agg(F.sum("k").alias("c"))  # a row for each input partition
    earlier = parts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("own", F.coalesce(F.sum("k").over(own), F.lit(0))).join(earlier, "part")
    pieces = full.select("doc_id", "n", "k", "base", "own", F.posexplode("crcs").alias("i", "crc")).where("i < k")
    return pieces.select("doc_id", (F.col("i") * F.lit(LENGTH)).cast("bigint").alias("start"), F.lit(LENGTH).cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(first) + F.col("base") + F.col("own") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def _stream(docs: DataFrame, left: DataFrame, first: int, path: str) -> tuple[DataFrame, int]:
    """Pieces of the items that no pattern took, and how many sequences they fill.

    Rounding leaves less than one sequence for each pattern of the basis, and
    the basis has LENGTH / QUANTUM patterns at most, so there are fewer than
    (LENGTH / QUANTUM) ** 2 such items, however large the input.
    """
    spark = docs.sparkSession
    before = Window.orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = cut_lineage(left.withColumn("at", F.coalesce(F.sum("rest").over(before), F.lit(0))))
    total = left.agg(F.sum("rest").alias("t")).collect()[0]["t"] or 0
    whole, tail = divmod(total, LENGTH)
    bins, at = [], whole * LENGTH
    for bit in reversed(range(LENGTH.bit_length())):
        if tail >> bit & 1:
            bins.append((at, at + (1 << bit), whole + len(bins)))
            at += 1 << bit
    bin_type = "array<struct<low:bigint,high:bigint,no:bigint>>"
    tails = F.from_json(F.lit("[" + ",".join(f'{{"low":{a},"high":{b},"no":{c}}}' for a, b, c in bins) + "]"), bin_type)
    cut = left.withColumn("j", F.explode(F.expr(f"sequence(at div {LENGTH}, (at + rest - 1) div {LENGTH})")))
    own = F.array(F.struct((F.col("j") * LENGTH).alias("low"), ((F.col("j") + 1) * LENGTH).alias("high"), F.col("j").alias("no")))
    cut = cut.withColumn("bin", F.explode(F.when(F.col("j") < whole, own).otherwise(tails)))
    cut = cut.withColumn("low", F.greatest("at", "bin.low")).withColumn("high", F.least(F.col("at") + F.col("rest"), F.col("bin.high"))).where("low < high")
    cuts = cut.select("doc_id", "h", F.struct((F.col("n") - F.col("rest") + F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("low")).alias("length"), (F.lit(first) + F.col("bin.no")).alias("sequence_id"), (F.col("low") - F.col("bin.low")).alias("offset")).alias("cut"))
    wanted = cuts.groupBy("doc_id", "h").agg(F.collect_list("cut").alias("cuts")).withColumnRenamed("doc_id", "_d").withColumnRenamed("h", "_h")
    texts = docs.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "cuts")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in COLUMNS])
    return texts.mapInArrow(_pieces_again(path), schema), whole + len(bins)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the documents in their sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)
