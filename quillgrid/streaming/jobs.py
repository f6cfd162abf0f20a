"""Streams of recognised pages: each once, through the same transforms, with priors and samples kept beside.

Pages are independent, so a stream runs the batch transforms on each
micro-batch. Keys seen are state of the stream; other state that outlives a
batch lives in Parquet under the batch's number, which makes a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.documents import PAGE, latest


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON pages of a directory, each file once."""
    raw = spark.readStream.schema(PAGE).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.json$", "").alias("doc_id"), F.coalesce("text", "metadata.text").alias("text"), F.coalesce("blocks", "metadata.blocks").alias("blocks"))


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """What Parquet files under a path hold; None where there are none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run(pages: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, minutes: int | None = None) -> StreamingQuery:
    """Write transform(page batch) to out, one folder for each batch; a batch that runs again replaces its own.

    Pages whose doc_id has come before are passed over: keys seen are kept as
    state, so that a batch costs what it holds, however much went before.
    State lies with the checkpoint, which belongs to out; a batch that runs
    again starts from the state before it. With minutes, a key is forgotten
    after so long (pages need seen_at); without, state grows by a key a page,
    for which spark.sql.streaming.stateStore.providerClass should name RocksDB.
    """
    fresh = pages.dropDuplicates(["doc_id"]) if minutes is None else first_seen(pages, minutes)

    def batch(rows: DataFrame, number: int) -> None:
        transform(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen(pages: DataFrame, minutes: int = 60) -> DataFrame:
    """Pages whose key hasn't come within some minutes; needs a time column seen_at."""
    return pages.withWatermark("seen_at", f"{minutes} minutes").dropDuplicatesWithinWatermark(["doc_id"])


def event_windows(events: DataFrame, late: str = "10 minutes", wide: str = "1 hour") -> DataFrame:
    """Counts and sums of events by kind and time window, closed once later events are past."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", wide).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.floor(F.sum(F.round(F.col("value") * 100))).cast("bigint").alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def learn_priors(tokens: DataFrame, priors: str, checkpoint: str, prior: Callable[[DataFrame], DataFrame], key: str = "vendor", every: int = 20) -> StreamingQuery:
    """Add the priors that each batch shows as changes, and merge them into a new base every so many batches; current_priors() reads both."""

    def batch(rows: DataFrame, number: int) -> None:
        prior(rows).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{priors}/changes/from={number}")
        if number % every == every - 1:
            merge_priors(rows.sparkSession, priors, key)

    return tokens.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merges(spark: SparkSession, priors: str) -> list[int]:
    """The last batches of the newest two bases that are whole, newest first."""
    found = stored(spark, f"{priors}/merged", "upto bigint")
    return [] if found is None else [r.upto for r in found.distinct().orderBy(F.desc("upto")).limit(2).collect()]


def current_priors(spark: SparkSession, priors: str, key: str = "vendor") -> DataFrame | None:
    """One row a key, that of the last batch which showed it; None before the first batch.

    A base counts once its number stands in the list of merges, which is
    written after it; until then the base before it and its changes are read.
    """
    merges = _merges(spark, priors)
    changes = stored(spark, f"{priors}/changes")
    if changes is None:
        return stored(spark, f"{priors}/base/upto={merges[0]}") if merges else None
    changes = (changes.where(F.col("from") > merges[0]) if merges else changes).drop("from")
    return latest(spark.read.parquet(f"{priors}/base/upto={merges[0]}") if merges else changes.limit(0), changes, key, "batch")


def merge_priors(spark: SparkSession, priors: str, key: str = "vendor", files: int = 8) -> None:
    """Write a new base, in files by key, from the last one and the changes since; readers go on with the old one until it is listed.

    What only the base before the last one was made of is removed, so that
    readers that have begun on the last one can end.
    """
    merges, changes = _merges(spark, priors), stored(spark, f"{priors}/changes")
    last = None if changes is None else changes.agg(F.max("from")).collect()[0][0]
    if last is None or (merges and last <= merges[0]):
        return
    current_priors(spark, priors, key).repartition(files, key).write.mode("overwrite").parquet(f"{priors}/base/upto={last}")
    spark.createDataFrame([(last,)], "upto bigint").coalesce(1).write.mode("append").parquet(f"{priors}/merged")
    if merges:
        old = [r["from"] for r in changes.where(F.col("from") <= merges[0]).select("from").distinct().collect()]  # a number for each batch of one merge
        for path in [f"{priors}/changes/from={n}" for n in old] + [f"{priors}/base/upto={n}" for n in merges[1:]]:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def predicted_confidence(features: DataFrame) -> DataFrame:
    """Chance that a token's cell is right, by how it was assigned, where no model has been trained."""
    known = F.when(F.col("strategy") == "row_scoped", 1.0).when(F.col("strategy") == "neighbor_row", 0.85).otherwise(0.5)
    return features.withColumn("confidence", known)


def trained(samples: DataFrame, columns: list[str], label: str = "is_correct", least: int = 100, gate: float = 0.85):
    """A random forest on samples, held against a fifth that it hasn't seen; None below least rows or the gate's F1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if samples.count() < least:
        return None
    held = F.pmod(F.xxhash64(*columns), F.lit(5)) == 0
    forest = RandomForestClassifier(labelCol=label, featuresCol="_v", numTrees=50, maxDepth=8, seed=42)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_v"), forest]).fit(samples.where(~held))
    hit, said = (F.col("prediction") == 1) & (F.col(label) == 1), F.col("prediction") == 1
    r = model.transform(samples.where(held)).agg(F.count_if(hit).alias("hit"), F.count_if(said).alias("said"), F.count_if(F.col(label) == 1).alias("there")).collect()[0]
    f1 = 2 * r["hit"] / max(1, r["said"] + r["there"])
    return model if f1 >= gate else None


def learn(samples: DataFrame, buffer: str, model: str, checkpoint: str, columns: list[str], label: str = "is_correct", least: int = 100) -> StreamingQuery:
    """Add each batch of samples to a buffer and train on all of it; a model that passes the gate replaces the one that is saved.

    A batch that runs again replaces its own samples, so that the buffer can be replayed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{buffer}/from={number}")
        found = trained(stored(rows.sparkSession, buffer), columns, label, least)
        if found is not None:
            found.write().overwrite().save(model)

    return samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(features: DataFrame, model: str) -> DataFrame:
    """Chance that a token's cell is right, by the saved model, else by predicted_confidence()."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    try:
        found = PipelineModel.load(model)
    except Exception as e:  # the loader's error depends on the file system
        if "not exist" not in str(e) and "No such file" not in str(e):
            raise
        return predicted_confidence(features)
    said = found.transform(features).withColumn("confidence", vector_to_array("probability")[1])
    return said.select(*features.columns, "confidence")
