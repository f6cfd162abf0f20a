"""Boxes, overlaps and angles as column expressions. A box is given by a prefix of its four columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """min_x, max_x, min_y, max_y of the columns with a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("min_x", "max_x", "min_y", "max_y"))


def polygon_box(polygon: Column) -> Column:
    """The box around an array of points (arrays of two); all zero if there are fewer than three."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    real = F.size(polygon) >= 3
    names = {"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)}
    return F.struct(*[F.when(real, v).otherwise(0.0).alias(k) for k, v in names.items()])


def clean_text(text: Column) -> Column:
    """Text without markup, white space joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_max, b_max) - F.greatest(a_min, b_min))


def overlap_share(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Overlap over the smaller length, lengths of one at least."""
    return overlap(a_min, a_max, b_min, b_max) / F.greatest(F.lit(1), F.least(a_max - a_min, b_max - b_min))


def inside_share(token: Box, cell: Box, pad: float) -> Column:
    """Share of a token's area inside a padded cell."""
    w = F.greatest(F.lit(0.0), F.least(token[1], cell[1] + pad) - F.greatest(token[0], cell[0] - pad))
    h = F.greatest(F.lit(0.0), F.least(token[3], cell[3] + pad) - F.greatest(token[2], cell[2] - pad))
    area = (token[1] - token[0]) * (token[3] - token[2])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def row_overlap(token: Box, row_min: Column, row_max: Column) -> Column:
    """Vertical overlap of a token and a row, over the token's height."""
    return overlap(token[2], token[3], row_min, row_max) / F.greatest(F.lit(1), token[3] - token[2])


def fit_score(token: Box, cell: Box, share: Column, numeric: Column) -> Column:
    """How well a token fits a cell: area, then right edge (numbers) or center, then height. 4 decimals."""
    width, height = F.greatest(F.lit(5), cell[1] - cell[0]), F.greatest(F.lit(5), cell[3] - cell[2])
    center = F.abs((token[0] + token[1]) / 2 - (cell[0] + cell[1]) / 2)
    across = F.when(numeric, F.abs(token[1] - cell[1])).otherwise(center) / width
    down = F.abs((token[2] + token[3]) / 2 - (cell[2] + cell[3]) / 2) / height
    return F.round(share * 0.55 + F.greatest(F.lit(0.0), 1 - across) * 0.35 + F.greatest(F.lit(0.0), 1 - down) * 0.10, 4)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def rotated(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> tuple[Column, Column]:
    """A point turned about a center by minus the angle, which levels a page of that skew."""
    c, s = F.cos(-angle), F.sin(-angle)
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def quarter_turned(x: Column, y: Column, turn: int, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a page turned clockwise by 0, 90, 180 or 270 degrees."""
    return {0: (x, y), 90: (height - y, x), 180: (width - x, height - y), 270: (y, width - x)}[turn % 360]


def quarter_back(x: Column, y: Column, turn: int, width: Column, height: Column) -> tuple[Column, Column]:
    """Undoes quarter_turned(); width and height are those of the page before it."""
    return {0: (x, y), 90: (y, height - x), 180: (width - x, height - y), 270: (width - y, x)}[turn % 360]


def mapped(x: Column, y: Column, matrix: tuple[tuple[float, ...], ...]) -> tuple[Column, Column]:
    """A point through a 3 by 3 matrix of homogeneous coordinates."""
    a, b, c = ((r[0] * x + r[1] * y + r[2]) for r in matrix)
    w = F.when(F.abs(c) > 1e-12, c).otherwise(1.0)
    return a / w, b / w


def skew(angles: Column) -> Column:
    """The median angle of top edges, zero below 0.01 radians or beyond a quarter turn's half."""
    found = F.median(angles)
    return F.when(F.abs(found) >= 0.01, F.greatest(F.lit(-math.pi / 4), F.least(F.lit(math.pi / 4), found))).otherwise(0.0)
