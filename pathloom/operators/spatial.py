"""Joins by distance and containment, planned as equi-joins on grid cells.

The left rows fall into one cell, the right rows are repeated over the cells that they may match from, so a pair meets
in exactly one cell and needs no deduplication. Cells are as wide as the search distance, so work follows the number
of neighbours, not the product of the tables.

Sizes are estimated before rows are repeated over cells, so the side that looks small may be too large to broadcast through
the driver: these joins sort and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{suffix}") for c in df.columns))


def squared(*pairs: tuple[Column, Column]) -> Column:
    total = None
    for a, b in pairs:
        term = (a - b) * (a - b)
        total = term if total is None else total + term
    return total


def distance_join(left: DataFrame, right: DataFrame, distance: float, axes: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at most `distance` apart over the axes (cells over the first two), equal in keys.

    Columns get the suffixes _a and _b; d is the distance."""
    size = distance if distance > 0 else 1.0
    a = renamed(left, "a").withColumn("__i", _cell(F.col("x_a"), size)).withColumn("__j", _cell(F.col("y_a"), size))
    near = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    b = renamed(right, "b").withColumn("__di", F.explode(near)).withColumn("__dj", F.explode(near))
    b = b.withColumn("__i", _cell(F.col("x_b"), size) + F.col("__di")).withColumn("__j", _cell(F.col("y_b"), size) + F.col("__dj")).drop("__di", "__dj")
    b = b.select(*(F.col(c) for c in b.columns if not c.startswith("__")), F.col("__i").alias("__k"), F.col("__j").alias("__l"))
    on = (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l"))
    for key in keys:
        on = on & (F.col(f"{key}_a") == F.col(f"{key}_b"))
    d = F.sqrt(squared(*((F.col(f"{x}_a"), F.col(f"{x}_b")) for x in axes)))
    return a.join(b.hint("merge"), on).withColumn("d", d).filter(F.col("d") <= distance).drop("__i", "__j", "__k", "__l")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, how: str = "inner", condition: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points (x, y) joined with the boxes (min_x, min_y, max_x, max_y; closed) that hold them, over cells of `size`, equal in keys."""
    p = points.withColumn("__i", _cell(F.col("x"), size)).withColumn("__j", _cell(F.col("y"), size))
    span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo), size), _cell(F.col(hi), size)))
    # a margin makes the smallest boxes valid ranges
    b = boxes.filter((F.col("max_x") >= F.col("min_x")) & (F.col("max_y") >= F.col("min_y")))
    b = b.withColumn("__k", span("min_x", "max_x")).withColumn("__l", span("min_y", "max_y")).withColumnsRenamed({k: f"__{k}" for k in keys})
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    on = (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l")) & inside
    for key in keys:
        on = on & (F.col(key) == F.col(f"__{key}"))
    if condition is not None:
        on = on & condition
    return p.join(b.hint("merge"), on, how).drop("__i", "__j", "__k", "__l", *(f"__{k}" for k in keys))


def points_in_circles(points: DataFrame, circles: DataFrame) -> DataFrame:
    """Points (x, y) joined with the circles (cx, cy, r; closed) that hold them.

    A circle lies in one cell of its own size, a power of two that r does not exceed, so however many there are none is repeated; points are
    repeated over the nine cells around them of each size that occurs."""
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("r") * (1 + 1e-9), F.lit(1e-6)))))  # on the safe side of rounding
    held = circles.filter("r >= 0").withColumn("__size", size)
    sizes = F.broadcast(held.select(F.col("__size").alias("__s")).distinct())  # a row for each power of two
    near = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    at = lambda v, by: F.floor(F.col(v) / F.col(by)).cast("long")
    p = points.join(sizes).withColumn("__di", near).withColumn("__dj", near)
    p = p.select(*points.columns, "__s", (at("x", "__s") + F.col("__di")).alias("__k"), (at("y", "__s") + F.col("__dj")).alias("__l"))
    held = held.withColumn("__i", at("cx", "__size")).withColumn("__j", at("cy", "__size"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    on = (F.col("__size") == F.col("__s")) & (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l")) & (F.sqrt(dx * dx + dy * dy) <= F.col("r"))
    return held.hint("merge").join(p, on).select(*points.columns, *circles.columns)  # circles stream by, the points of a cell are held


def first_box(points: DataFrame, boxes: DataFrame, size: float, key: tuple[str, ...], order: str, value: str, condition: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """key and value of the first box (by order) that holds each point; null where none does."""
    held = points_in_boxes(points, boxes, size, "left", condition, keys)
    return held.groupBy(*key).agg(F.min_by(value, order).alias(value))
