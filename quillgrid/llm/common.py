"""What the operators of this subpackage share: inputs, checkpoints and skew-safe look-ups."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: Rows of a few numbers each that may be broadcast, once they are counted.
BROADCAST_ROWS = 1_000_000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches short enough for long texts. The setting is the session's, and lasts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table by a path that only Spark opens."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it from there.

    Only where spark.checkpoint.dir is unset (tests on one machine) is a
    temporary folder used instead.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, for passes that read some of its columns or rows."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{where}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df for a join: broadcast if it has at most so many rows, else left to a shuffle. df must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(df: DataFrame, key: str, share: int = 200) -> DataFrame:
    """Keys that hold over 1/share of the rows: fewer than share keys, whatever the size of df."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.count()
    return counts.where(F.col("_n") * share > F.lit(total)).select(key)


def lookup(big: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join big with small, one row per key at most, without a hot task.

    hot comes from hot_keys(), so what is broadcast here has fewer rows than
    its share parameter. All other keys are joined by a shuffle. A null key
    finds nothing.
    """
    few = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = big.join(few, key, "left")
    hot_small = small.join(F.broadcast(hot), key, "left_semi")
    warm = marked.where("_hot").drop("_hot").join(F.broadcast(hot_small), key, "left")
    rest = marked.where("_hot is null").drop("_hot").join(small, key, "left")
    return rest.unionByName(warm)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
