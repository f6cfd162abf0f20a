"""Steps that take whole pages in arrays: what they tell is what the tables of rows, columns, cells and claims tell, without a table that is written or dealt anew."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import assign, claims, engine, evidence, folds, pages, placing, rebuild, report
from quillgrid.plans import catalogue
from quillgrid.sources import staging

from .test_scale import SF, documents, exchanges


@pytest.mark.parametrize("name", ["table_engine", "claimed_tokens", "anchor_rebuild", "anchor_rebuild_report"])
def test_pages_take_one_shuffle_and_nothing_is_written(spark, name, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "folder", lambda _: str(tmp_path))
    assert exchanges(catalogue.QUERIES[name](spark, SF)) <= 1
    assert not list(tmp_path.glob("staged-*"))


@pytest.mark.parametrize("seed", range(2))
def test_the_engine_finds_on_whole_pages_what_its_steps_find(spark, seed):
    rng = random.Random(seed)
    frame = documents(seed, 25)[["doc_id", "ord", *placing.BOX]].assign(text=lambda f: [rng.choice(["12.50", "TAB A", "7", "3 4", "x9", "1,000.00"]) for _ in f.index])
    tokens = spark.createDataFrame(frame).cache()
    rows = tokens.join(folds.folded(tokens, folds.cluster_rows, "doc_id bigint, ord bigint, row_index bigint").withColumnRenamed("row_index", "row_no"), ["doc_id", "ord"]).cache()
    texts = rows.groupBy("doc_id", "row_no").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"), *[f(c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_y"))])
    rows = rows.join(engine.merged(texts), ["doc_id", "row_no"]).drop("row_no").withColumnRenamed("merged_into", "row_no").cache()
    columns = engine.projected_columns(rows).cache()
    own = engine.bands(rows)
    want = assign.token_cells(tokens, own, assign.cell_grid(own, columns))
    as_set = lambda f, *c: {tuple(r) for r in f.select(*c).collect()}
    found = engine.each(engine.found(tokens), "ord").cache()
    assert as_set(found, "doc_id", "ord", "row_no") == as_set(rows, "doc_id", "ord", "row_no")
    assert as_set(engine.heuristic(tokens).owned, "doc_id", "ord", "cell_row", "cell_col", "score", "strategy") == as_set(want, "doc_id", "ord", "cell_row", "cell_col", "score", "strategy")
    assert as_set(found, "doc_id", "n_columns") == as_set(columns.groupBy("doc_id").count(), "doc_id", "count")


def test_claims_of_whole_pages_are_those_of_the_joins(spark):
    rng = random.Random(4)
    texts = ["12.50", "5", "18", "TAB", "CROCIN", "QTY", "RATE", "AMOUNT", "PRODUCT", "DISC", "9%", "3PCS", "7.25", "CGST"]
    frame = documents(4, 40)[["doc_id", "ord", *placing.BOX]].assign(text=lambda f: [rng.choice(texts) for _ in f.index], inside=lambda f: f.ord % 5 > 0)
    frame.loc[len(frame)] = {"doc_id": 99, "ord": 1, "min_x": 490, "max_x": 520, "min_y": 0, "max_y": 14, "text": "QTY", "inside": True}
    frame.loc[len(frame)] = {"doc_id": 99, "ord": 2, "min_x": 490, "max_x": 520, "min_y": 100, "max_y": 114, "text": "12.50", "inside": True}  # a price for a quantity
    boxes = ((0, 40, 252), (1, 260, 392), (2, 480, 532), (3, 540, 612), (4, 700, 792))
    t = folds.told(spark.createDataFrame(frame), folds.graph_rows, {"graph_row": "row_no"}, where="inside").cache()
    placed = t.where("row_no is not null")
    bands = engine.bands(placed)
    top = placed.join(bands.groupBy("doc_id").agg(F.min("min_y").alias("y")), "doc_id").join(bands.withColumnRenamed("min_y", "y"), ["doc_id", "row_no", "y"], "left_semi")
    alone = top.groupBy("doc_id").agg(F.count_distinct("row_no").alias("n")).where("n = 1")  # of rows that begin alike either may be the top
    columns = t.select("doc_id").distinct().join(spark.createDataFrame(boxes, "col_no int, min_x bigint, max_x bigint"))
    want = claims.assigned(claims.listed(t.drop("inside"), bands), claims.meant_columns(columns, top)).select("doc_id", "ord", "row_no", "col_no", "claim", F.coalesce("repair", F.lit("none")).alias("repair"))
    got = claims.on_pages(spark.createDataFrame(frame), boxes)
    as_set = lambda f: {tuple(r) for r in f.select("doc_id", "ord", "row_no", "col_no", "claim", "repair").join(alone, "doc_id", "left_semi").collect()}
    found = as_set(got)
    assert found == as_set(want) and {r[5] for r in found} == {"none", "product", "quantity", "amount"} and {r[4] for r in found} == {"member", "overlap"}


@pytest.mark.parametrize("seed", range(3))
def test_a_grid_of_rows_and_columns_gives_the_cells_of_all_pairs(seed):
    rng = np.random.default_rng(seed)
    tokens = documents(seed, 30).assign(number=lambda f: rng.random(len(f)) < 0.5)
    grid = lambda lo, step, n: [(d, k, lo + step * k, lo + step * k + rng.integers(5, 2 * step)) for d in range(30) for k in range(rng.integers(0, n))]
    rows, columns = pd.DataFrame(grid(0, 24, 9), columns=["page", "row_no", "min_y", "max_y"]), pd.DataFrame(grid(0, 90, 9), columns=["page", "col_no", "min_x", "max_x"])
    got = pages.gridded(tokens.rename(columns={"doc_id": "page"}), rows.sample(frac=1, random_state=seed).sort_values("page"), columns)
    cells = rows.merge(columns, on="page").rename(columns={"page": "doc_id", "row_no": "ord", "col_no": "no"}).assign(kind=placing.CELL)
    bands = rows.rename(columns={"page": "doc_id", "row_no": "ord"}).assign(kind=placing.ROW, no=0, min_x=0, max_x=0)
    all_ = pd.concat([tokens.assign(kind=placing.TOKEN, no=tokens.number.astype(int)), cells, bands], ignore_index=True).sort_values("doc_id", kind="stable").reset_index(drop=True)
    want = placing.celled(all_)
    for name in ("cell_row", "cell_col", "score", "tier"):
        has = want["tier"].to_numpy() >= 0
        assert np.array_equal(np.asarray(got[name])[has], want[name].to_numpy()[has]) and np.array_equal(got["tier"] >= 0, has)


def test_runs_are_those_of_the_steps_of_coverage(spark):
    frame = documents(7, 20)
    page, x0, x1 = (frame[c].to_numpy() for c in ("doc_id", "min_x", "max_x"))
    want = report.occupied_runs(spark.createDataFrame(frame[["doc_id", "min_x", "max_x"]]), 3).collect()
    got = pages._runs(page, x0, x1, 3)
    assert sorted(zip(*map(np.ndarray.tolist, got), strict=True)) == sorted((r.doc_id, r.start, r.stop) for r in want)


@pytest.mark.parametrize("name, most", [("invoice_pipeline", 1), ("topology_arbitration", 5), ("contested_items", 5)])
def test_tables_of_whole_chains_are_written_few_times(spark, name, most, tmp_path, monkeypatch):
    """Each table that is written and read again is dealt anew, which filled the disk."""
    monkeypatch.setattr(staging, "folder", lambda _: str(tmp_path))
    assert catalogue.QUERIES[name](spark, SF).columns
    assert len(list(tmp_path.glob("staged-*"))) <= most


def test_columns_of_whole_pages_are_rebuilt_as_by_the_joins(spark):
    rng = random.Random(11)
    texts = [["12.50", "7.25", " 9.00"], ["5", "3+1"], ["B12345", "C99-81X"], ["05/26"], ["300412"], ["CROCIN 10'S TAB", "PARACETAMOL SYRUP 60ML", "x"], ["", "  "]]
    rows = []
    for doc in range(90):
        lefts, kinds = [40 + 110 * k for k in range(6)], rng.choices(range(5), k=5)
        for r in range(rng.randint(1, 7)):
            for k, x in enumerate(lefts):
                if rng.random() < 0.85:
                    at = x + rng.randint(-4, 4)
                    col = (k, 0, k // 3, k // 2)[doc % 4]
                    rows.append((doc, 8 * r + k, r, col, rng.random() < 0.8, rng.choice(texts[5 if k == 0 else kinds[k - 1] if rng.random() < 0.9 else 6]), at, at + rng.randint(20, 60), 24 * r, 24 * r + 14))
    table = spark.createDataFrame(rows, "doc_id bigint, ord bigint, row_no int, col_no int, item boolean, text string, min_x bigint, max_x bigint, min_y bigint, max_y bigint").cache()
    lacking = table.groupBy("doc_id").agg(F.count_distinct("col_no").alias("n")).where("n = 2")
    want, report_ = rebuild.rebuilt(table, lacking)
    told = rebuild.on_pages(table, F.size(F.array_distinct(F.col("tokens")["col_no"])) == 2).cache()
    got = {(r.doc_id, o, t.new_col) for r in told.collect() for o, t in zip(r.ords, r.told, strict=True)}
    assert got == {(r.doc_id, r.ord, r.new_col) for r in want.collect()}
    reports = {(r.doc_id, pages.REASONS[r.told[0].reason], r.told[0].rebuilt, r.told[0].before, r.told[0].after, r.told[0].split) for r in told.collect()}
    assert reports == {(r.doc_id, r.reason, r.rebuilt, r.before, r.after, r.split) for r in report_.collect()}
    assert len({r[1] for r in reports}) >= 3 and {r[2] for r in reports} == {True, False}


@pytest.mark.parametrize("name, most", [("graph_engine", 1), ("orphan_tokens", 2), ("token_coverage", 1), ("best_bands", 2)])
def test_no_cell_or_band_is_a_row_of_the_plan(spark, name, most, tmp_path, monkeypatch):
    """A token's candidates were exploded, or looked at by functions over elements of arrays, which are interpreted."""
    monkeypatch.setattr(staging, "folder", lambda _: str(tmp_path))
    frame = catalogue.QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert exchanges(frame) <= most and not list(tmp_path.glob("staged-*"))
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan and "array_min" not in plan


def test_bands_and_graphs_of_whole_pages_are_those_of_the_joins(spark):
    frame = documents(21, 40)[["doc_id", "ord", *placing.BOX]].assign(text="x")
    tokens = spark.createDataFrame(frame).cache()
    as_set = lambda f: {tuple(r) for r in f.collect()}
    want = as_set(engine.graph(tokens).owned.select("doc_id", "ord", "cell_row", "cell_col"))
    told = pages.graph(frame.rename(columns={"doc_id": "page"}))
    assert set(zip(frame.doc_id, frame.ord, told["cell_row"].tolist(), told["cell_col"].tolist(), strict=True)) == want
    bands = pd.DataFrame([(d, k, 80 * k + d, 80 * k + 60 + d) for d in range(40) for k in range(d % 7 + 1)], columns=["doc_id", "col_no", "min_x", "max_x"])
    want = as_set(evidence.best_band(tokens, spark.createDataFrame(bands)))
    told = pages.best_bands(frame.rename(columns={"doc_id": "page"}), bands.rename(columns={"doc_id": "page"}).sample(frac=1, random_state=1).sort_values("page"))
    assert set(zip(frame.doc_id, frame.ord, told["band"].tolist(), told["common"].tolist(), strict=True)) == want
