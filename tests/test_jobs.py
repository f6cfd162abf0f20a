"""State that outlives a batch: keys seen, and priors with their merges."""

import os

from pyspark.sql import functions as F

from quillgrid.sources import documents
from quillgrid.streaming import jobs

SCHEMA = "vendor string, y bigint, batch bigint"


def change(spark, path, number, rows):
    spark.createDataFrame([(v, y, number) for v, y in rows], SCHEMA).write.parquet(f"{path}/changes/from={number}")


def now(spark, path):
    return sorted((r.vendor, r.y) for r in jobs.current_priors(spark, path).collect())


def test_readers_see_one_row_a_vendor_before_during_and_after_merges(spark, tmp_path):
    path = str(tmp_path / "priors")
    assert jobs.current_priors(spark, path) is None
    jobs.merge_priors(spark, path)  # nothing to merge
    change(spark, path, 0, [("a", 1), ("b", 2)])
    change(spark, path, 1, [("a", 3)])
    assert now(spark, path) == [("a", 3), ("b", 2)]
    jobs.merge_priors(spark, path)
    assert now(spark, path) == [("a", 3), ("b", 2)]
    change(spark, path, 2, [("c", 4), ("b", 5)])
    assert now(spark, path) == [("a", 3), ("b", 5), ("c", 4)]
    begun = jobs.current_priors(spark, path)
    # a merge that was stopped before its base was listed changes nothing, and the next one replaces its base
    spark.createDataFrame([("z", 9, 2)], SCHEMA).write.parquet(f"{path}/base/upto=2")
    assert now(spark, path) == [("a", 3), ("b", 5), ("c", 4)]
    jobs.merge_priors(spark, path)
    assert now(spark, path) == [("a", 3), ("b", 5), ("c", 4)]
    assert sorted((r.vendor, r.y) for r in begun.collect()) == [("a", 3), ("b", 5), ("c", 4)]  # a reader that had begun can end
    jobs.merge_priors(spark, path)  # nothing new
    change(spark, path, 3, [("a", None)])
    jobs.merge_priors(spark, path)
    assert now(spark, path) == [("a", None), ("b", 5), ("c", 4)]
    assert sorted(os.listdir(f"{path}/changes")) == ["from=3"] and sorted(n for n in os.listdir(f"{path}/base")) == ["upto=2", "upto=3"]


def test_priors_of_a_stream_are_merged_as_it_goes(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("source", "priors", "state"))
    for i in range(5):
        spark.createDataFrame([("a", i), (f"v{i}", i)], "vendor string, y bigint").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("vendor string, y bigint").parquet(source)
        jobs.learn_priors(stream, path, state, lambda d: d.groupBy("vendor").agg(F.max("y").alias("y")), every=2).awaitTermination()
    assert now(spark, path) == [("a", 4), *[(f"v{i}", i) for i in range(5)]]
    assert jobs._merges(spark, path) == [3, 1]


def test_keys_seen_are_state_and_outlive_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    schema = "doc_id string, text string"
    for rows in ([("a", "1"), ("a", "1"), ("b", "2")], [("b", "3"), ("c", "4"), (None, "5")], [(None, "6"), ("a", "7")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.run(spark.readStream.schema(schema).parquet(source), lambda d: d, out, state).awaitTermination()
    found = spark.read.parquet(out)
    assert sorted((r.doc_id or "", r.text, r.batch) for r in found.collect()) == [("", "5", 1), ("a", "1", 0), ("b", "2", 0), ("c", "4", 1)]
    assert found.where("batch = 2").count() == 0
    again = documents.uncached(spark.createDataFrame([("a", "8"), ("d", "9")], schema), found)
    assert [r.doc_id for r in again.collect()] == ["d"]


def test_keys_are_forgotten_after_some_minutes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    schema = "doc_id string, seen string"
    for rows in ([("a", "2024-01-01 00:00:00")], [("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 03:00:00")], [("c", "2024-01-01 06:00:00")], [("a", "2024-01-01 06:01:00")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("seen_at", F.to_timestamp("seen"))
        jobs.run(stream, lambda d: d, out, state, minutes=30).awaitTermination()
    assert sorted((r.doc_id, r.seen[11:16]) for r in spark.read.parquet(out).collect()) == [("a", "00:00"), ("a", "06:01"), ("b", "03:00"), ("c", "06:00")]
