"""Steps whose decisions depend on earlier ones, folded over each document's tokens or rows in order.

Each function takes a pandas frame of one document's rows, or of many documents'
where it is marked as many(); folded() applies it to every document through one
shuffle by doc_id at most. A document is a page of some hundred tokens, which
bounds a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window


#: What most steps use of a token, beside its document and place.
BOX = ("min_x", "max_x", "min_y", "max_y")


def many(step: Callable) -> Callable:
    """Marks a step that takes the rows of any number of documents at once; each document's rows lie together."""
    step.many = True
    return step


def folded(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, key: str = "doc_id", dealt: bool = False) -> DataFrame:
    """step applied to the rows of each key.

    Rows are dealt and sorted by key and go to Python many documents at a time.
    Steps marked as many() take such a batch whole; for others each document is
    a slice of it. The shuffle keeps the session's number of partitions, since
    the work per byte is large. Rows that are dealt already, as those of
    derived.tokens() are, aren't shuffled again: a window by key asks for no
    more than they have.
    """
    whole = getattr(getattr(step, "func", step), "many", False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            bounds = _bounds(frame[key])[:-1].tolist()
            if len(bounds) > 1:
                done = [frame.iloc[: bounds[-1]]] if whole else [frame.iloc[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
                yield pd.concat([step(f) for f in done], ignore_index=True)
            rest = frame.iloc[bounds[-1] :]
        if rest is not None and len(rest):
            yield step(rest)

    if dealt:
        return rows.withColumn("_size", F.count("*").over(Window.partitionBy(key))).mapInPandas(run, schema)
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return spread.sortWithinPartitions(key).mapInPandas(run, schema)


def told(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], names: dict[str, str], uses: tuple[str, ...] = BOX, where: str | None = None, key: str = "doc_id", dealt: bool = False) -> DataFrame:
    """rows with what a step tells of each beside it (names: the step's column to its new name), as whole numbers; null for -1.

    Rows go through the step's task whole, so that nothing is joined back by
    token. The step sees the columns that it uses, and where names a boolean
    column only rows that have it; the others get nulls.
    """
    kept = list(rows.columns)
    schema = StructType([*rows.schema.fields, *[StructField(name, LongType()) for name in names.values()]])
    whole = getattr(getattr(step, "func", step), "many", False)

    @many
    def beside(frame: pd.DataFrame) -> pd.DataFrame:
        at = np.flatnonzero(frame[where].to_numpy(bool)) if where else np.arange(len(frame))
        out = {name: np.full(len(frame), -1, np.int64) for name in names.values()}
        if len(at):
            part = frame.iloc[at][[key, "ord", *uses]].reset_index(drop=True)
            bounds = _bounds(part[key]).tolist()
            found = step(part) if whole else pd.concat([step(part.iloc[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)], ignore_index=True)
            own, other = _sorted(part, key, part["ord"].to_numpy()), _sorted(found, key, found["ord"].to_numpy())
            for told_as, name in names.items():
                out[name][at[own]] = found[told_as].to_numpy()[other]
        return frame[kept].assign(**out)

    marked = folded(rows, beside, schema, key, dealt)
    return marked.select(*kept, *[F.when(F.col(n) >= 0, F.col(n)).alias(n) for n in names.values()])


def _bounds(keys: pd.Series) -> np.ndarray:
    """Where each key's rows begin, and the end of the last."""
    values = keys.to_numpy()
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _sorted(frame: pd.DataFrame, key: str, *by: np.ndarray) -> np.ndarray:
    """Places of the rows by key as they lie, then by the values given."""
    bounds = _bounds(frame[key])
    return np.lexsort((*by[::-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))


def _mid(frame: pd.DataFrame, axis: str) -> np.ndarray:
    return (frame[f"min_{axis}"].to_numpy(float) + frame[f"max_{axis}"].to_numpy(float)) / 2


def _numbered(frame: pd.DataFrame, places: list[list[int]], name: str) -> pd.DataFrame:
    out = np.full(len(frame), -1, np.int64)
    for i, members in enumerate(places):
        out[members] = i
    return frame[["doc_id", "ord"]].assign(**{name: out})


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """The documents by falling size, and for each step the number of those that go on with the places of their next rows."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, falling = bounds[:-1][order], -sizes[order]
    return order, ((n, starts[:n] + k) for k in range(-falling[0]) for n in [np.searchsorted(falling, -k)])


def _first_fit(columns: list[np.ndarray], bounds: np.ndarray, fits: Callable[..., np.ndarray]) -> np.ndarray:
    """Number of the first group of its document that each row fits, else of a new one; rows come in order.

    fits(docs, values, means) holds rows of several documents against the
    running means of all groups of theirs. All documents take their k-th row in
    one step, so that a step costs a few array operations for a whole batch.
    """
    order, steps = _steps(bounds)
    sums, count = [np.zeros((len(order), 8)) for _ in columns], np.zeros((len(order), 8))
    used, out = np.zeros(len(order), np.int64), np.empty(len(columns[0]), np.int64)
    for n, at in steps:
        g = int(used[:n].max())
        if g == count.shape[1]:
            sums, count = [np.pad(x, ((0, 0), (0, g))) for x in sums], np.pad(count, ((0, 0), (0, g)))
        members = np.maximum(count[:n, :g], 1)
        fit = (count[:n, :g] > 0) & fits(order[:n], [c[at][:, None] for c in columns], [x[:n, :g] / members for x in sums])
        found = fit.any(axis=1)
        place = np.where(found, fit.argmax(axis=1), used[:n]) if g else used[:n].copy()
        doc = np.arange(n)
        for x, c in zip(sums, columns, strict=True):
            x[doc, place] += c[at]
        count[doc, place] += 1
        used[:n] += ~found
        out[at] = place
    return out


def _grouped(frame: pd.DataFrame, key: str, name: str, order: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    out = np.empty(len(frame), np.int64)
    out[order] = places
    return frame[[key, "ord"]].assign(**{name: out})


def _upper_median(frame: pd.DataFrame, key: str, values: np.ndarray) -> np.ndarray:
    bounds = _bounds(frame[key])
    return values[_sorted(frame, key, values)][bounds[:-1] + np.diff(bounds) // 2]


def _in_order(frame: pd.DataFrame, key: str) -> pd.DataFrame:
    return frame.iloc[_sorted(frame, key, frame["ord"].to_numpy())].reset_index(drop=True)


def _near_means(frame: pd.DataFrame, key: str, name: str, values: np.ndarray, near: np.ndarray) -> pd.DataFrame:
    """Groups by the first running mean within near (one a document), in order of value."""
    order = _sorted(frame, key, values)
    return _grouped(frame, key, name, order, _first_fit([values[order]], _bounds(frame[key]), lambda docs, v, mean: np.abs(v[0] - mean[0]) <= near[docs][:, None]))


@many
def cluster_rows(frame: pd.DataFrame, key: str = "doc_id") -> pd.DataFrame:
    """First row, from the top, whose mean band overlaps a token by over 40 % of the smaller height."""
    frame = _in_order(frame, key)
    cy, h = _mid(frame, "y"), (frame["max_y"] - frame["min_y"]).to_numpy(float)
    order = _sorted(frame, key, cy)

    def fits(docs: np.ndarray, values: list[np.ndarray], means: list[np.ndarray]) -> np.ndarray:
        (y, tall), (mean_y, mean_h) = values, means
        common = np.minimum(mean_y + mean_h / 2, y + tall / 2) - np.maximum(mean_y - mean_h / 2, y - tall / 2)
        least = np.minimum(tall, mean_h)
        return (common > 0) & (least > 0) & (common / np.where(least > 0, least, 1) > 0.4)

    return _grouped(frame, key, "row_index", order, _first_fit([cy[order], h[order]], _bounds(frame[key]), fits))


@many
def graph_rows(frame: pd.DataFrame, key: str = "doc_id") -> pd.DataFrame:
    """First running mean within max(8, 0.65 of the upper-median height)."""
    frame = _in_order(frame, key)
    heights = _upper_median(frame, key, (frame["max_y"] - frame["min_y"]).to_numpy(float))
    return _near_means(frame, key, "graph_row", _mid(frame, "y"), np.maximum(8.0, 0.65 * heights))


@many
def graph_columns(frame: pd.DataFrame, key: str = "doc_id") -> pd.DataFrame:
    """The same across, within max(20, 0.7 of the upper-median width)."""
    frame = _in_order(frame, key)
    widths = _upper_median(frame, key, (frame["max_x"] - frame["min_x"]).to_numpy(float))
    return _near_means(frame, key, "graph_col", _mid(frame, "x"), np.maximum(20.0, 0.7 * widths))


@many
def graph_table(frame: pd.DataFrame, key: str = "doc_id") -> pd.DataFrame:
    """graph_rows(), and graph_columns() of the tokens in rows that hold at least half as many as the fullest of their document; -1 for others."""
    frame = _in_order(frame, key)
    rows = graph_rows(frame, key)
    bounds, no = _bounds(frame[key]), rows["graph_row"].to_numpy()
    page = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    row = page * (no.max() + 1) + no
    size = np.bincount(row)[row]
    full = 2 * size >= np.maximum.reduceat(size, bounds[:-1])[page]
    columns = np.full(len(frame), -1, np.int64)
    columns[full] = graph_columns(frame[full].reset_index(drop=True), key)["graph_col"].to_numpy()
    return rows.assign(graph_col=columns)


@many
def horizontal_bands(frame: pd.DataFrame, near: float = 16.0, key: str = "doc_id") -> pd.DataFrame:
    frame = _in_order(frame, key)
    return _near_means(frame, key, "band", _mid(frame, "y"), np.full(len(_bounds(frame[key])) - 1, near))


@many
def anchor_clusters(frame: pd.DataFrame, near: float = 24.0, key: str = "doc_id") -> pd.DataFrame:
    """Anchors by place, each against the last cluster's running mean alone."""
    frame = frame.iloc[_sorted(frame, key, frame["anchor_x"].to_numpy(float), frame["ord"].to_numpy())].reset_index(drop=True)
    x = frame["anchor_x"].to_numpy(float)
    order, steps = _steps(_bounds(frame[key]))
    number, total, count = np.full(len(order), -1), np.zeros(len(order)), np.zeros(len(order))
    out = np.empty(len(frame), np.int64)
    for n, at in steps:
        joins = (count[:n] > 0) & (np.abs(x[at] - total[:n] / np.maximum(count[:n], 1)) < near)
        number[:n] += ~joins
        total[:n], count[:n] = np.where(joins, total[:n] + x[at], x[at]), np.where(joins, count[:n] + 1, 1)
        out[at] = number[:n]
    return frame[[key, "ord"]].assign(cluster=out)


@many
def multiline_merge(frame: pd.DataFrame, key: str = "doc_id") -> pd.DataFrame:
    """Fold continuation rows into the row before: close below, indented or very close, and without strong numbers."""
    frame = frame.iloc[_sorted(frame, key, frame["row_no"].to_numpy())].reset_index(drop=True)
    row, left, top, bottom = (frame[c].to_numpy(np.int64) for c in ("row_no", "min_x", "min_y", "max_y"))
    strong = (frame["numbers"].to_numpy() >= 2) | frame["priced"].to_numpy(bool)
    order, steps = _steps(_bounds(frame[key]))
    active, min_x, max_y = (np.zeros(len(order), np.int64) for _ in range(3))
    begun, into = np.zeros(len(order), bool), np.empty(len(frame), np.int64)
    for n, at in steps:
        gap, indent = top[at] - max_y[:n], left[at] - min_x[:n]
        joins = begun[:n] & ~strong[at] & (gap <= 22) & (((indent >= -10) & (indent <= 100)) | (gap <= 15))
        active[:n] = np.where(joins, active[:n], row[at])
        max_y[:n], min_x[:n] = np.where(joins, np.maximum(max_y[:n], bottom[at]), bottom[at]), np.where(joins, np.minimum(min_x[:n], left[at]), left[at])
        begun[:n], into[at] = True, active[:n]
    return frame[[key, "row_no"]].assign(merged_into=into)


def spans(frame: pd.DataFrame, close: float = 12, numeric_close: float = 40, least: float = 18, most: int = 22) -> pd.DataFrame:
    """Column spans of a document's runs (start, stop, tokens, numbers), at most so many.

    Runs join where they are close, or a little further apart and both mostly
    numbers; narrow ones then go. While there are too many the cheapest gap
    goes, and one behind a narrow span costs less.
    """
    out: list[list[float]] = []
    for run in frame.sort_values("start", kind="stable")[["start", "stop", "tokens", "numbers"]].itertuples(index=False):
        last, gap = (out[-1], run.start - out[-1][1]) if out else (None, 0)
        if last and (gap < close or gap < numeric_close and last[3] > 0.6 * last[2] and run.numbers > 0.6 * run.tokens):
            out[-1] = [min(last[0], run.start), max(last[1], run.stop), last[2] + run.tokens, last[3] + run.numbers]
        else:
            out.append(list(run))
    out = [s for s in out if s[1] - s[0] >= least]
    while len(out) > most:
        cost = [(b[0] - a[1]) * (0.8 if a[1] - a[0] < 1.5 * least else 1.0) for a, b in zip(out, out[1:], strict=False)]
        k = cost.index(min(cost))
        out[k : k + 2] = [[min(out[k][0], out[k + 1][0]), max(out[k][1], out[k + 1][1]), out[k][2] + out[k + 1][2], out[k][3] + out[k + 1][3]]]
    doc = frame["doc_id"].iloc[0]
    return pd.DataFrame([(doc, i, int(s[0]), int(s[1])) for i, s in enumerate(out)], columns=["doc_id", "span_no", "start", "stop"])


def table_columns(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns of a table's tokens (row_no, ord, box, start of the occupied run): the runs, split where most rows have several tokens in one."""
    runs: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for start, row, a, _, b in sorted(zip(*(frame[c].tolist() for c in ("start", "row_no", "min_x", "ord", "max_x")), strict=True)):
        runs.setdefault(start, {}).setdefault(row, []).append((a, b))
    boxes: list[list[int]] = []
    for rows in runs.values():
        sizes = Counter(map(len, rows.values()))
        k = max(n for n, c in sizes.items() if c == max(sizes.values()))  # so many tokens most rows have, the more on ties
        whole = [x for x in rows.values() if len(x) == k]
        boxes += [[min(x[i][0] for x in whole), max(x[i][1] for x in whole)] for i in range(k)]
    for a, b in zip(boxes, boxes[1:], strict=False):
        a[1] = max(a[0] + 1, min(a[1], b[0] - 1))  # a text may run into the next column
    doc = frame["doc_id"].iloc[0]
    return pd.DataFrame([(doc, i, a, b) for i, (a, b) in enumerate(boxes)], columns=["doc_id", "col_no", "min_x", "max_x"])


def stable_bands(frame: pd.DataFrame, share: float = 0.35) -> pd.DataFrame:
    """Bands joined where they overlap by over a share of the shorter, the joined band growing."""
    out: list[list[float]] = []
    for a, b in frame.sort_values(["start", "stop"])[["start", "stop"]].itertuples(index=False):
        if out and (min(b, out[-1][1]) - max(a, out[-1][0])) / max(1.0, min(b - a, out[-1][1] - out[-1][0])) > share:
            out[-1] = [min(a, out[-1][0]), max(b, out[-1][1])]
        else:
            out.append([a, b])
    doc = frame["doc_id"].iloc[0]
    return pd.DataFrame([(doc, i, int(a), int(b)) for i, (a, b) in enumerate(out)], columns=["doc_id", "band_no", "start", "stop"])


def stabilised_columns(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns (col_no, min_x, max_x, filled) merged into the fuller neighbour where they overlap or are phantoms."""
    frame = frame.sort_values("min_x").reset_index(drop=True)
    width = float((frame["max_x"] - frame["min_x"]).median())
    keep: list[dict] = []
    into = {}
    for r in frame.itertuples():
        if keep:
            last = keep[-1]
            common, gap = last["max_x"] - r.min_x, r.min_x - last["max_x"]
            phantom = min(r.max_x - r.min_x, last["max_x"] - last["min_x"]) < 0.28 * width and gap < 8
            if common > 5 or phantom:
                fuller = r.col_no if r.filled > last["filled"] else last["col_no"]
                for c, t in into.items():
                    if t == last["col_no"]:
                        into[c] = fuller
                into[r.col_no] = fuller
                keep[-1] = {"col_no": fuller, "min_x": min(last["min_x"], r.min_x), "max_x": max(last["max_x"], r.max_x), "filled": last["filled"] + r.filled}
                continue
        into[r.col_no] = r.col_no
        keep.append({"col_no": r.col_no, "min_x": r.min_x, "max_x": r.max_x, "filled": r.filled})
    return frame[["doc_id", "col_no"]].assign(kept_col=[into[c] for c in frame["col_no"]])


def clean_boxes(frame: pd.DataFrame) -> pd.DataFrame:
    """Boxes without specks, fragments side by side joined; box_no numbers what is left."""
    frame = frame.sort_values(["min_y", "min_x"], kind="stable").reset_index(drop=True)
    w, h = (frame["max_x"] - frame["min_x"]).to_numpy(float), (frame["max_y"] - frame["min_y"]).to_numpy(float)
    mw, mh = float(np.median(w)), float(np.median(h))
    boxes = [list(map(float, x)) for x in frame.loc[(w >= 0.15 * mw) & (h >= 0.15 * mh), ["min_x", "max_x", "min_y", "max_y"]].to_numpy()]
    out: list[list[float]] = []
    for b in boxes:
        for o in out:
            tall = min(o[3], b[3]) - max(o[2], b[2])
            gap = max(o[0], b[0]) - min(o[1], b[1])
            if tall > 0.7 * min(o[3] - o[2], b[3] - b[2]) and 0 <= gap < min(0.25 * mw, 0.18 * max(o[1] - o[0], b[1] - b[0])):
                o[:] = [min(o[0], b[0]), max(o[1], b[1]), min(o[2], b[2]), max(o[3], b[3])]
                break
        else:
            out.append(b)
    doc = frame["doc_id"].iloc[0]
    return pd.DataFrame([(doc, i, *map(int, b)) for i, b in enumerate(out)], columns=["doc_id", "box_no", "min_x", "max_x", "min_y", "max_y"])


@many
def line_view(frame: pd.DataFrame, near: float = 8.0, key: str = "doc_id") -> pd.DataFrame:
    """A new line begins where a center leaves the running median by max(near, 0.75 of the median height).

    Centers come in order, so that a line's median stands in its middle.
    """
    frame = _in_order(frame, key)
    bounds, heights = _bounds(frame[key]), (frame["max_y"] - frame["min_y"]).to_numpy(float)
    heights = heights[_sorted(frame, key, heights)]
    last = np.diff(bounds) - 1
    limit = np.maximum(near, 0.75 * (heights[bounds[:-1] + last // 2] + heights[bounds[:-1] + (last + 1) // 2]) / 2)
    cy = _mid(frame, "y")
    place = _sorted(frame, key, cy)
    cy = cy[place]
    order, steps = _steps(bounds)
    limit, start, number, out = limit[order], bounds[:-1][order].copy(), np.full(len(order), -1), np.empty(len(frame), np.int64)
    for n, at in steps:
        s, e = start[:n], np.maximum(at - 1, start[:n])
        new = (at == s) | (np.abs(cy[at] - (cy[(s + e) // 2] + cy[(s + e + 1) // 2]) / 2) > limit[:n])
        number[:n] += new
        start[:n] = np.where(new, at, s)
        out[at] = number[:n]
    return _grouped(frame, key, "line", place, out)


def disjoint_pair(frame: pd.DataFrame) -> pd.DataFrame:
    """The first two bands, in order, that share no token."""
    frame = frame.sort_values("band").reset_index(drop=True)
    taken: list[int] = []
    used: set = set()
    for r in frame.itertuples():
        ids = set(r.ids)
        if not ids & used:
            taken.append(r.Index)
            used |= ids
        if len(taken) == 2:
            break
    return frame.loc[taken, ["doc_id", "band"]]
