"""Steps whose cost has to keep in proportion to the input: what they shuffle and write, and that many documents at once give what each gives alone."""

from functools import partial

import numpy as np
import pandas as pd
import pytest

from quillgrid.operators import evidence, folds
from quillgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def exchanges(frame):
    """Shuffles of a plan before it runs; one that is used twice counts twice."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def documents(seed, n=60):
    rng = np.random.default_rng(seed)
    frames = []
    for doc in range(n):
        size = int(rng.choice([1, 2, 3, 12, 40, 90]))
        x, y = rng.integers(0, 700, size), rng.integers(0, 40 * int(rng.integers(1, 12)), size)
        frame = pd.DataFrame({"doc_id": doc, "ord": rng.permutation(size), "min_x": x, "max_x": x + rng.integers(0, 90, size), "min_y": y, "max_y": y + rng.integers(0, 30, size)})
        frames.append(frame.assign(anchor_x=(frame.min_x + frame.max_x) / 2, row_no=frame.ord * 2, numbers=rng.integers(0, 3, size), priced=rng.random(size) < 0.3))
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("step", [folds.cluster_rows, folds.graph_rows, folds.graph_columns, folds.anchor_clusters, folds.multiline_merge, folds.horizontal_bands, partial(folds.horizontal_bands, near=85.0)])
@pytest.mark.parametrize("seed", range(3))
def test_many_documents_at_once_give_what_each_gives_alone(step, seed):
    frame = documents(seed)
    alone = pd.concat([step(f) for _, f in frame.groupby("doc_id")])
    assert sorted(step(frame).itertuples(index=False, name=None)) == sorted(alone.itertuples(index=False, name=None))


@pytest.mark.parametrize("name, most", [("row_clusters", 3), ("graph_rows", 3), ("graph_columns", 3), ("anchor_clusters", 3), ("multiline_merge", 2)])
def test_folds_take_the_tokens_as_they_are_dealt(spark, name, most):
    """One shuffle by product, one by document and one of the sums; small tables of products are broadcast."""
    assert exchanges(catalogue.QUERIES[name](spark, SF)) <= most - 1


@pytest.mark.parametrize("name, most", [("column_profile", 1), ("semantic_ranking", 1)])
def test_cells_are_neither_written_nor_dealt_anew(spark, name, most, tmp_path, monkeypatch):
    from quillgrid.plans import tables

    def never(frame):
        raise AssertionError("written")

    monkeypatch.setattr(tables, "written", never)
    assert exchanges(catalogue.QUERIES[name](spark, SF)) <= most


@pytest.mark.parametrize("name", ["nearest_row_asof", "best_bands"])
def test_tokens_meet_their_documents_bands_without_a_row_for_each_pair(spark, name):
    """Pairs of tokens and bands that are grouped by token have to be sorted, and spill."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate(key=" in line and ", ord#" in line.split("]")[0] for line in plan.splitlines())


def test_heads_vote_in_one_grouping_of_the_tokens(spark):
    assert exchanges(catalogue.QUERIES["header_bands"](spark, SF)) <= 1


@pytest.mark.parametrize("name, most", [("graph_engine", 2), ("claimed_tokens", 1), ("anchor_rebuild", 1), ("anchor_rebuild_report", 1), ("band_rescue_pages", 5)])
def test_what_folds_tell_of_tokens_is_not_joined_back(spark, name, most, tmp_path, monkeypatch):
    """Every table that is written and read again costs a pass over the tokens."""
    from quillgrid.sources import staging

    monkeypatch.setattr(staging, "folder", lambda _: str(tmp_path))
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(list(tmp_path.glob("staged-*"))) <= most
    assert not any("Join" in line and ", ord#" in line for line in plan.splitlines())


@pytest.mark.parametrize("seed", range(2))
def test_told_keeps_rows_and_leaves_others_null(spark, seed):
    frame = documents(seed, 12).assign(inside=lambda f: f.ord % 3 > 0, text=lambda f: f.ord.astype(str))
    got = folds.told(spark.createDataFrame(frame), folds.graph_rows, {"graph_row": "line"}, where="inside").toPandas()
    want = frame.merge(folds.graph_rows(frame[frame.inside].reset_index(drop=True)), on=["doc_id", "ord"], how="left")
    assert len(got) == len(frame) and list(got.columns) == [*frame.columns, "line"]
    as_rows = lambda f, c: {(d, o, t, None if pd.isna(r) else int(r)) for d, o, t, r in f[["doc_id", "ord", "text", c]].itertuples(index=False)}
    assert as_rows(got, "line") == as_rows(want, "graph_row")


def test_graph_table_takes_columns_from_fuller_rows():
    frame = documents(5)
    rows, table = folds.graph_rows(frame), folds.graph_table(frame)
    size = rows.groupby(["doc_id", "graph_row"])["ord"].transform("size")
    full = 2 * size >= size.groupby(rows.doc_id).transform("max")
    want = folds.graph_columns(frame.merge(rows[full], on=["doc_id", "ord"]))
    of = lambda f: set(f[["doc_id", "ord", "graph_col"]].itertuples(index=False, name=None))
    assert of(table[table.graph_col >= 0]) == of(want) and (table.graph_row == rows.graph_row).all()


def test_a_graphs_confidence_takes_one_grouping_of_its_rows(spark):
    assert exchanges(catalogue.QUERIES["graph_confidence"](spark, SF)) <= 1
    got = evidence.graph_pages(spark.createDataFrame([(1, "item", 3, [0, 1, 1]), (1, "item", 1, [1]), (1, "footer", 1, [7]), (2, "unknown", 2, [0, 5])], "doc_id bigint, hint string, n_tokens bigint, cols array<int>"))
    rows = spark.createDataFrame([(1, "item"), (1, "item"), (1, "footer"), (2, "unknown")], "doc_id bigint, hint string")
    want = evidence.graph_confidence(rows, spark.createDataFrame([(1, 1), (1, 2)], "doc_id bigint, support bigint"), spark.createDataFrame([(1, False)] * 3 + [(1, True)] * 2 + [(2, False)] * 2, "doc_id bigint, isolated boolean"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_many_pages_are_those_of_each(seed):
    frame = documents(seed)
    alone = pd.concat([folds.line_view(f) for _, f in frame.groupby("doc_id")])
    assert sorted(folds.line_view(frame).itertuples(index=False, name=None)) == sorted(alone.itertuples(index=False, name=None))
