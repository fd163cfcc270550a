"""Shortest ways on grids that no task can hold: tiles that tell their neighbours what has become shorter.

A tile of SIDE x SIDE cells keeps, for each source, the distances of its cells and of the ring of cells around it. In a
round every tile that has news lowers its ring by them, goes on from there with the bucket queue of search.py, and sends the
cells on its edge that became shorter to the (up to eight) tiles whose ring they lie in. When no tile has news all
distances are final, and equal to those of one search over the whole grid. Each round is a reliable checkpoint; a round's
work is that of the tiles with news, a task holds one tile of one source."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators import search
from pathloom.operators.scene import cut

#: Cells along a tile's side, a multiple of 64: a tile's distances take some 2 MB.
SIDE = 512


@contextmanager
def few_rows(df: DataFrame, rows: int = 16):
    """For jobs that run inside: rows that hold tiles go to Python few at a time. The session's setting comes back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, rows)
    try:
        yield
    finally:
        conf.set(key, before)


def floor_tiles(floor: DataFrame, side: int) -> DataFrame:
    """scene_id, ti, tj, rows (i, block_j, bits within the tile) of floor cells (scene_id, i, j)."""
    at = floor.select("scene_id", F.floor(F.col("i") / side).cast("int").alias("ti"), F.floor(F.col("j") / side).cast("int").alias("tj"), "i", "j")
    at = at.withColumn("i", F.col("i") - F.col("ti") * side).withColumn("j", F.col("j") - F.col("tj") * side)
    bit = F.expr("shiftleft(1L, cast(pmod(j, 64) AS int))")
    rows = at.groupBy("scene_id", "ti", "tj", "i", F.floor(F.col("j") / 64).cast("int").alias("block_j")).agg(F.bit_or(bit).alias("bits"))
    return rows.groupBy("scene_id", "ti", "tj").agg(F.collect_list(F.struct("i", "block_j", "bits")).alias("rows"))


_NEWS = pa.list_(pa.struct([("ti", pa.int32()), ("tj", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("d", pa.int64())]))
_KEY = ["scene_id", "si", "sj", "ti", "tj"]


def _advanced(side: int, most: int | None):
    """A step of tiles with news (places in the tile, -1 and side on its ring): their distances and what they tell others."""
    width = side + 4  # the ring, and walls around it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["held"] is None:
                    spread = row["rows"]
                    floor = search.unpacked(*(np.array([r[c] for r in spread], np.int64) for c in ("i", "block_j", "bits")), (side, side))
                    held = search.padded(np.pad(floor[:side, :side], 1))
                else:
                    held = np.frombuffer(row["held"], np.int64).reshape(1, width, width).copy()
                i, j, d = (np.array([n[c] for n in row["news"]], np.int64) for c in "ijd")
                place = (i + 2) * width + j + 2
                ring = (i < 0) | (j < 0) | (i == side) | (j == side)
                flat = held.reshape(-1)
                better = np.where(ring, (flat[place] < 0) | (d < flat[place]), (flat[place] > d))
                place, d, ring = place[better], d[better], ring[better]
                flat[place] = d
                lowered = search.settle(held, place, most)
                changed = np.unique(np.r_[place[~ring], lowered])
                a, b = changed // width - 2, changed % width - 2
                own = (a >= 0) & (b >= 0) & (a < side) & (b < side)
                a, b, d, news = a[own], b[own], flat[changed[own]], []
                for di, dj in search.NEAR:
                    seen = (a == (0 if di < 0 else side - 1) if di else a >= 0) & (b == (0 if dj < 0 else side - 1) if dj else b >= 0)
                    news += [{"ti": row["ti"] + di, "tj": row["tj"] + dj, "i": int(x) - di * side, "j": int(y) - dj * side, "d": int(z)} for x, y, z in zip(a[seen], b[seen], d[seen])]
                columns = [pa.array([row[k]], t) for k, t in zip(_KEY, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([held.tobytes()]), pa.array([news], _NEWS)], [*_KEY, "held", "tell"])

    return run


def spread(floor: DataFrame, sources: DataFrame, most: int | None = None, side: int | None = None) -> DataFrame:
    """Tiles (scene_id, si, sj, ti, tj, held) of the distances from each source cell (scene_id, si, sj) over floor cells; held: distances of the tile, a ring around it and walls, row by row."""
    side = side or SIDE
    tiles = cut(floor_tiles(floor, side))
    begun = sources.distinct().join(floor.select("scene_id", F.col("i").alias("si"), F.col("j").alias("sj")), ["scene_id", "si", "sj"], "left_semi")
    ti, tj = (F.floor(F.col(c) / side).cast("int") for c in ("si", "sj"))
    seed = F.struct((F.col("si") - ti * side).alias("i"), (F.col("sj") - tj * side).alias("j"), F.lit(0).cast("long").alias("d"))
    news = begun.select("scene_id", "si", "sj", ti.alias("ti"), tj.alias("tj"), F.array(seed).alias("news"))
    state = cut(news.select(*_KEY, F.lit(None).cast("binary").alias("held")).limit(0))
    while True:
        active = news.join(state, _KEY, "left").join(tiles, ["scene_id", "ti", "tj"]).select(*_KEY, F.when(F.col("held").isNull(), F.col("rows")).alias("rows"), "held", "news")
        schema = "scene_id long, si int, sj int, ti int, tj int, held binary, tell array<struct<ti:int,tj:int,i:int,j:int,d:long>>"
        with few_rows(floor):
            moved = cut(active.mapInArrow(_advanced(side, most), schema))
        if moved.isEmpty():
            return state
        state = cut(state.join(moved.select(_KEY), _KEY, "left_anti").unionByName(moved.select(*_KEY, "held")))
        told = moved.select("scene_id", "si", "sj", F.explode("tell").alias("t"))
        news = told.groupBy("scene_id", "si", "sj", F.col("t.ti").alias("ti"), F.col("t.tj").alias("tj")).agg(F.collect_list(F.struct("t.i", "t.j", "t.d")).alias("news"))


def lengths(state: DataFrame, questions: DataFrame, side: int | None = None) -> DataFrame:
    """questions (scene_id, i1, j1, i2, j2 and more) with steps, the units from (i1, j1) to (i2, j2); no row where there is no way."""
    side = side or SIDE
    ti, tj = F.floor(F.col("i2") / side).cast("int"), F.floor(F.col("j2") / side).cast("int")
    asked = questions.withColumn("ti", ti).withColumn("tj", tj)
    at = ((F.col("i2") - F.col("ti") * side + 2) * (side + 4) + F.col("j2") - F.col("tj") * side + 2) * 8
    digits = F.concat(*(F.hex(F.expr(f"substring(held, at + {k}, 1)")) for k in range(8, 0, -1)))  # the highest of the eight bytes comes last
    found = asked.join(state.withColumnRenamed("si", "i1").withColumnRenamed("sj", "j1"), ["scene_id", "i1", "j1", "ti", "tj"]).withColumn("at", at.cast("int"))
    found = found.withColumn("steps", F.conv(digits, 16, -10).cast("long"))
    return found.filter((F.col("steps") >= 0) & (F.col("steps") < int(search.FAR))).select(*questions.columns, "steps")


def ways(state: DataFrame, questions: DataFrame, side: int | None = None, key: tuple[str, ...] = ("q",)) -> DataFrame:
    """scene_id, key and path (cells) of questions (scene_id, key, i1, j1, i2, j2) that have a way: walked back from tile to tile, one a round."""
    side = side or SIDE
    key = ["scene_id", *key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = np.frombuffer(row["held"], np.int64).reshape(side + 4, side + 4)
                low = row["ti"] * side - 2, row["tj"] * side - 2
                at, cells = (row["i"] - low[0], row["j"] - low[1]), []
                while at is not None and all(2 <= x < side + 2 for x in at):
                    cells.append({"i": at[0] + low[0], "j": at[1] + low[1]})
                    at = search.step_back(held, *at)
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in (*key, "i1", "j1")}, "cells": cells, "i": at and at[0] + low[0], "j": at and at[1] + low[1]}], schema)

    cell = pa.struct([("i", pa.int32()), ("j", pa.int32())])
    schema = pa.schema([*((k, pa.int64()) for k in key), ("i1", pa.int32()), ("j1", pa.int32()), ("cells", pa.list_(cell)), ("i", pa.int32()), ("j", pa.int32())])
    held = state.withColumnRenamed("si", "i1").withColumnRenamed("sj", "j1")
    open_ = lengths(state, questions, side).select(*key, "i1", "j1", F.col("i2").alias("i"), F.col("j2").alias("j"))
    parts, turn = None, 0
    while True:
        at = open_.withColumn("ti", F.floor(F.col("i") / side).cast("int")).withColumn("tj", F.floor(F.col("j") / side).cast("int"))
        at = at.join(held, ["scene_id", "i1", "j1", "ti", "tj"]).select(*key, "i1", "j1", "i", "j", "ti", "tj", "held")
        with few_rows(state):
            walked = cut(at.mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", i1 int, j1 int, cells array<struct<i:int,j:int>>, i int, j int"))
        part = walked.select(*key, F.lit(turn).alias("turn"), "cells")
        parts = part if parts is None else parts.unionByName(part)
        open_ = walked.filter("i is not null").select(*key, "i1", "j1", "i", "j")
        if open_.isEmpty():
            listed = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("turn", "cells"))).alias("p"))
            return listed.select(*key, F.reverse(F.flatten(F.transform("p", lambda x: x["cells"]))).alias("path"))
        turn += 1
