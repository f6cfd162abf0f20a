"""Files in, files out, streams."""

import json

import pandas as pd
from pyspark.sql import functions as F

from quillgrid.operators import audit
from quillgrid.sources import documents
from quillgrid.streaming import jobs

BLOCK = {"id": None, "text": "<b>Item</b>  A", "polygon": [[1, 2], [5, 2], [5, 9], [1, 9]], "confidence": None}


def write(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_pages_of_json_files(spark, tmp_path):
    write(tmp_path, "a_v1.json", {"text": "t", "blocks": [BLOCK]})
    write(tmp_path, "b_v1.json", {"metadata": {"text": "m", "blocks": [BLOCK | {"id": "x"}]}})
    write(tmp_path, "c_v2.json", {"text": "new"})
    write(tmp_path, "broken_v1.json", "{no json")
    write(tmp_path, "debug_output.json", {"text": "skip"})
    rows = {r.doc_id: r for r in documents.pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a_v1", "b_v1", "c_v2", "broken_v1"} and rows["b_v1"].text == "m" and rows["broken_v1"].error is not None and rows["c_v2"].blocks == []
    assert {r.doc_id for r in documents.pages(spark, str(tmp_path), "2").collect()} == {"c_v2"}
    tokens = {r.doc_id: r for r in documents.tokens(documents.pages(spark, str(tmp_path))).collect()}
    assert (tokens["a_v1"].token_id, tokens["a_v1"].text, tokens["a_v1"].max_y, tokens["b_v1"].token_id) == ("block_0", "Item A", 9.0, "x")
    documents.save_pages(documents.pages(spark, str(tmp_path), "1").drop("error"), str(tmp_path / "saved"), "1")
    assert spark.read.parquet(str(tmp_path / "saved")).where("pipeline_version = 1").count() == 3


def test_streams_take_each_page_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    write(source, "a.json", {"text": "t", "blocks": [BLOCK]})
    for expected in (1, 1, 2):
        jobs.run(jobs.page_stream(spark, str(source)), lambda d: d.select("doc_id", F.length("text").alias("n")), out, state).awaitTermination()
        assert spark.read.parquet(out).select("doc_id").distinct().count() == spark.read.parquet(out).count() == expected
        write(source, "b.json", {"text": "uu", "blocks": []}) if expected == 1 and not (source / "b.json").exists() and (tmp_path / "again").exists() else (tmp_path / "again").touch()


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    jobs.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from w").collect()[0][0] == events.count()


def test_models_and_clients_are_given(spark):
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b""))], "doc_id string, content binary")
    pages = {r.doc_id: r for r in documents.recognise(rows, lambda b: {"text": str(1 // len(b)), "blocks": []}).collect()}
    assert pages["a"].text == "1" and "zero" in pages["b"].error
    answer = json.dumps({"items": [{"product_name": "p", "qty": 2, "rate": 5, "amount": 10}], "tax": {"total_tax": 1}, "grand_total": 11})
    asked = spark.createDataFrame([("a", "| x |"), ("b", ""), ("c", "bad")], "doc_id string, markdown string")
    found = documents.extract(asked, lambda m: answer if m != "bad" else "not json")
    assert {r.doc_id: r.error for r in found.collect()} == {"a": None, "b": None, "c": "schema_mismatch"}
    checked = {r.doc_id: r for r in audit.validated_invoices(found).collect()}
    assert (checked["a"].n_items, checked["a"].passed, checked["a"].total_matches) == (1, 1, True) and not checked["b"].total_matches


def test_images_audits_and_priors(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (300).to_bytes(4, "big") + (400).to_bytes(4, "big"))
    (tmp_path / "j.png").write_bytes(b"none")
    rows = documents.images(spark, f"{tmp_path}/*.png")
    assert {(r.width, r.height, r.error) for r in rows.collect()} == {(300, 400, None), (None, None, "unsupported image")}
    judged = documents.image_report(rows.where("error is null").withColumns({"grayscale": F.lit(True), "dpi": F.lit(None).cast("int")})).collect()[0]
    assert judged.valid and judged.score == 0.8 and len(judged.warnings) == 2
    (tmp_path / "a.md").write_text("# Audit\n\n### Failure 1\n- **Cause**: wrong column\n- Qty text: 12.50\n\n### Failure 2\n- Cause: none\n")
    found = [r.fields for r in documents.audit_records(spark, str(tmp_path / "a.md")).orderBy("no").collect()]
    assert found == [{"cause": "wrong column", "qty_text": "12.50"}, {"cause": "none"}]
    old, new = (spark.createDataFrame(pd.DataFrame(r)) for r in ({"k": ["a", "b"], "v": [1, 2], "n": [1, 1]}, {"k": ["b"], "v": [3], "n": [2]}))
    assert {r.k: r.v for r in documents.latest(old, new, "k", "n").collect()} == {"a": 1, "b": 3}


def test_learner_gate(spark):
    samples = spark.range(400).selectExpr("cast(id % 20 as double) as a", "cast(id % 7 as double) as b", "cast(id % 20 >= 10 as double) as is_correct")
    assert jobs.trained(samples.limit(50), ["a", "b"]) is None
    assert jobs.trained(samples, ["a", "b"]) is not None
    assert [r.confidence for r in jobs.predicted_confidence(spark.createDataFrame([("row_scoped",), ("neighbor_row",), ("x",)], "strategy string")).collect()] == [1.0, 0.85, 0.5]


def test_pages_of_earlier_batches_are_passed_over(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for name, text in (("a", "first"), ("b", "second")):
        write(source, f"{name}.json", {"text": text})
        stream = jobs.page_stream(spark, str(source)).withColumn("doc_id", F.lit("same"))
        jobs.run(stream, lambda d: d.select("doc_id", "text"), out, state).awaitTermination()
    assert [r.text for r in spark.read.parquet(out).collect()] == ["first"]


def test_a_learner_keeps_samples_and_model(spark, tmp_path):
    source, buffer, model, state = (str(tmp_path / x) for x in ("in", "buffer", "model", "state"))
    features = spark.createDataFrame([(15.0, 1.0, "x"), (2.0, 1.0, "row_scoped")], "a double, b double, strategy string")
    assert [r.confidence for r in jobs.scored(features, model).collect()] == [0.5, 1.0]
    samples = spark.range(400).selectExpr("cast(id % 20 as double) as a", "cast(id % 7 as double) as b", "cast(id % 20 >= 10 as double) as is_correct")
    for n in (60, 340):
        samples.limit(n).coalesce(1).write.mode("append").parquet(source)
        jobs.learn(spark.readStream.schema(samples.schema).parquet(source), buffer, model, state, ["a", "b"]).awaitTermination()
    assert jobs.stored(spark, buffer).count() == 400 and jobs.stored(spark, str(tmp_path / "none")) is None
    good, bad = (r.confidence for r in jobs.scored(features, model).orderBy("strategy", ascending=False).collect())
    assert good > 0.8 > 0.2 > bad


def test_reports_and_failures_of_files(spark, tmp_path):
    failed = {"cause": "cell assignment to Wrong Column", "row_id": "r1", "cells": {"product": "p", "rate": "5.00"}, "mapped_block_ids": ["b1"]}
    write(tmp_path, "r.json", {"metadata": {"topology_source": "graph", "failures": [failed, failed, {"cause": "other"}]}})
    write(tmp_path, "s.json", {"text": "no failures"})
    (found,) = documents.benchmark_failures(spark, f"{tmp_path}/*.json").collect()
    assert (found.file, found.topology, found.row_id, found.product, found.rate, found.mrp, found.block_ids) == ("r.json", "graph", "r1", "p", "5.00", None, ["b1"])
    documents.save_reports(spark.createDataFrame([("# A\n| x |",)], "markdown string"), str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["# A", "| x |"]
    documents.save_diagnostics(spark.createDataFrame([(1, True)], "doc_id int, passed boolean"), str(tmp_path / "json"), "coverage")
    assert spark.read.json(str(tmp_path / "json")).where("kind = 'coverage' and passed").count() == 1
