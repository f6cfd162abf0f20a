"""Tokens that meet cells and neighbours in batches: against plain loops, many pages at once, and without shuffles by token."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest

from quillgrid.operators import assign, evidence, orientation, placing
from quillgrid.plans import catalogue, layout
from quillgrid.sources import derived

SF = "/root/testdata/sf0.001"


def exchanges(frame):
    return sum("Exchange hashpartitioning" in line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines())


def pages(seed, n=40):
    rng = np.random.default_rng(seed)
    made = []
    for doc in range(n):
        size, rows, cols = (int(rng.integers(a, b)) for a, b in ((1, 50), (0, 6), (1, 4)))
        x, y = rng.integers(0, 200, size), rng.integers(0, 120, size)
        tokens = pd.DataFrame({"doc_id": doc, "kind": 0, "ord": rng.permutation(size), "no": rng.integers(0, 2, size), "min_x": x, "max_x": x + rng.integers(0, 70, size), "min_y": y, "max_y": y + rng.integers(0, 25, size)})
        tops = rng.integers(0, 110, rows)
        bands = pd.DataFrame({"doc_id": doc, "kind": 2, "ord": np.arange(rows) * 3, "no": 0, "min_x": 0, "max_x": 0, "min_y": tops, "max_y": tops + rng.integers(0, 40, rows)})
        grid = pd.DataFrame([(doc, 1, r * 3, c, c * 60, c * 60 + 70, t, t + int(rng.integers(5, 45))) for r, t in enumerate(tops.tolist()) for c in range(cols) if rng.random() < 0.9], columns=tokens.columns)
        made.append(pd.concat([tokens, grid, bands]).sample(frac=1, random_state=seed))
    return pd.concat(made, ignore_index=True).astype("int64")


def half_up(x):
    return float(Decimal(repr(float(x))).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def plain_cells(frame, gap=0.12):
    for doc, page in frame.groupby("doc_id"):
        rows, cells = page[page.kind == 2].sort_values("ord"), page[page.kind == 1]
        seq = {r: i for i, r in enumerate(rows.ord)}
        for t in page[page.kind == 0].itertuples():
            shares = [(-max(0, min(t.max_y, r.max_y) - max(t.min_y, r.min_y)) / max(1, t.max_y - t.min_y), r.ord) for r in rows.itertuples()]
            share, own = min([s for s in shares if -s[0] > 0.1], default=(0, None))
            pad, found = (1.5 if t.no else 3.0), []
            for c in cells.itertuples():
                w, h = max(0.0, min(t.max_x, c.max_x + pad) - max(t.min_x, c.min_x - pad)), max(0.0, min(t.max_y, c.max_y + pad) - max(t.min_y, c.min_y - pad))
                area = (t.max_x - t.min_x) * (t.max_y - t.min_y)
                inside = w * h / area if area > 0 else 0.0
                if inside >= (0.55 if t.no else 0.30):
                    across = (abs(t.max_x - c.max_x) if t.no else abs((t.min_x + t.max_x) / 2 - (c.min_x + c.max_x) / 2)) / max(5, c.max_x - c.min_x)
                    down = abs((t.min_y + t.max_y) / 2 - (c.min_y + c.max_y) / 2) / max(5, c.max_y - c.min_y)
                    off = None if own is None else abs(seq[c.ord] - seq[own])
                    found.append((-half_up(inside * 0.55 + max(0.0, 1 - across) * 0.35 + max(0.0, 1 - down) * 0.10), c.ord, c.no, off))
            result = (doc, t.ord, 0, 0, 0.0, -1)
            for tier, fit in enumerate((lambda o: o == 0 and -share > 0.3, lambda o: o == 1, lambda o: True)):
                order = sorted(f[:3] for f in found if fit(f[3]))
                if order and (len(order) == 1 or order[1][0] - order[0][0] >= gap):
                    result = (doc, t.ord, order[0][1], order[0][2], -order[0][0], tier)
                    break
            yield result


@pytest.mark.parametrize("seed", range(6))
def test_cells_are_those_of_a_plain_loop(seed):
    frame = pages(seed)
    assert sorted(placing.celled(frame).itertuples(index=False, name=None)) == sorted(plain_cells(frame))


@pytest.mark.parametrize("seed", range(6))
def test_neighbours_are_those_of_a_plain_loop(seed):
    frame = pages(seed)
    frame, expected = frame[frame.kind == 0].reset_index(drop=True), set()
    for doc, page in frame.groupby("doc_id"):
        for a in page.itertuples():
            best = {}
            for b in page.itertuples():
                for axis, low, least, back, on in (("y", 0, 0.25, 0, 1), ("x", 0, 0.20, 2, 3)):
                    a0, a1, b0, b1 = (getattr(t, f"{m}_{axis}") for t in (a, b) for m in ("min", "max"))
                    other = "x" if axis == "y" else "y"
                    d = sum(getattr(b, f"{m}_{other}") - getattr(a, f"{m}_{other}") for m in ("min", "max"))
                    if a.ord != b.ord and d != 0 and max(low, min(a1, b1) - max(a0, b0)) / max(1, min(a1 - a0, b1 - b0)) >= least:
                        side = back if d < 0 else on
                        best[side] = min(best.get(side, (10**9, 0)), (abs(d), b.ord))
            expected |= {(doc, a.ord, side, other, d) for side, (d, other) in best.items()}
    found = list(placing.nearest(frame).itertuples(index=False, name=None))
    assert len(found) == len(set(found)) and set(found) == expected


def test_rounding_is_half_up_of_the_written_number():
    x = np.array([0.12345, 0.00005, 0.99995, 0.5, 0.123449999999, 0.12355, 1.00005, 0.0])
    assert placing._rounded(x).tolist() == [half_up(v) for v in x]


def test_a_page_in_one_pass_is_that_of_its_tokens_rows_and_cells(spark):
    tokens = derived.tokens(spark, SF)
    parts = assign.celled(assign.page(tokens, layout.row_bands(tokens), layout.cells(spark, tokens), keep=("row_no",)), keep=("row_no",))
    once = layout._celled(derived.tokens(spark, SF, first=True), keep=("row_no",))
    assert parts.exceptAll(once).isEmpty() and once.exceptAll(parts).isEmpty() and not once.isEmpty()
    few = assign.token_cells(tokens, layout.row_bands(tokens).where("row_no < 0"), layout.cells(spark, tokens).where("row_no < 0"))
    assert few.isEmpty()


@pytest.mark.parametrize("name, most", [("token_cell_assign", 1), ("orphan_tokens", 2), ("token_coverage", 2), ("nearest_neighbours", 2)])
def test_pages_are_dealt_once_and_not_written(spark, name, most, monkeypatch):
    """One shuffle of the lines by document, and one of the sums."""
    from quillgrid.sources import staging

    monkeypatch.setattr(staging, "written", lambda frame: pytest.fail("written"))
    monkeypatch.setattr(layout, "written", lambda frame: pytest.fail("written"), raising=False)
    assert exchanges(catalogue.QUERIES[name](spark, SF)) <= most


@pytest.mark.parametrize("name", ["first_owners", "headed_rows", "ownership_audit", "page_turns", "page_orientation"])
def test_tokens_are_neither_written_nor_dealt_or_sorted_anew(spark, name, monkeypatch):
    """No shuffle by document and place, and no window or list for each turn of a token."""
    monkeypatch.setattr("quillgrid.plans.evidence.written", lambda frame: pytest.fail("written"))
    lines = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Exchange hashpartitioning(doc_id" in line and any(f"{c}#" in line for c in ("ord", "row_no", "col_no", "cell_row")) for line in lines)
    assert not any("Window [" in line and "turn#" in line.split("windowspecdefinition")[-1] and "ord#" in line for line in lines)
    assert not any("collect_list" in line and "turn#" in line.split("functions")[0] for line in lines)


def test_all_turns_at_once_score_as_each_turn_does(spark):
    tokens = derived.tokens(spark, SF)
    each, once = evidence.box_turn(orientation.turned(tokens)), evidence.box_turns(tokens)
    assert each.exceptAll(once).isEmpty() and once.exceptAll(each).isEmpty() and not once.isEmpty()


def test_rows_under_heads_that_lack_or_double(spark):
    cells = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "B"), (1, 0, 1, "C"), (1, 1, 0, "x"), (1, 1, 1, "y"), (1, 1, 5, "z"), (2, 1, 0, "q"), (3, 0, 0, "H")], "doc_id long, row_no int, col_no int, text string")
    found = {(r.doc_id, r.row_no): r.columns for r in orientation.whole_rows(cells).collect()}
    assert found == {(1, 1): {"A": "x", "B": "y", "C": "y", "col_5": "z"}, (2, 1): {"col_0": "q"}}


def test_nearest_column_and_first_band_of_odd_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "2.50", 10, 20, 0, 9), (1, 1, "abc", 100, 120, 30, 39), (1, 2, "7", 900, 910, 500, 509)], "doc_id long, ord long, text string, min_x long, max_x long, min_y long, max_y long")
    columns = spark.createDataFrame([(1, 0, "quantity", 10, 20), (1, 1, "product", 30, 60), (1, 2, "amount", 100, 120)], "doc_id long, col_no int, semantic string, min_x long, max_x long")
    assert {(r.ord, r.col_no, r.distance2) for r in assign.nearest_column(tokens, columns, 120).collect()} == {(0, 1, 60), (1, 1, 130)}
    bands = spark.createDataFrame([(1, 4, 20, 35), (1, 3, 5, 31)], "doc_id long, row_no int, min_y long, max_y long")
    assert {(r.ord, r.cell_row) for r in assign.first_band(tokens, bands).collect()} == {(0, 3), (1, 3), (2, None)}
