"""Intermediate tables, written once so that later steps of a plan read them instead of deriving them anew."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; a temporary one only where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    return where or os.path.join(tempfile.gettempdir(), "quillgrid")


def written(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read from there: plans stay small, columns are pruned, sizes are known."""
    path = os.path.join(folder(frame.sparkSession), f"staged-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with more columns, each computed once a row.

    They come out of a generator, through which the optimizer carries no
    expression: filters and later columns read them instead of repeating them.
    """
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
