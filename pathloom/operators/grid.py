"""Occupancy grids as tables of cells (scene_id, i, j, state): building, components, lines of sight and shortest paths.

Every scene has a grid of its own (bounds: scene_id, low_x, low_y, nx, ny), and every join carries the scene. Marking,
sight and queries of cells are joins and aggregations; components hold one scene in a task, as scenes are independent, and
those of scenes over LARGE_CELLS cells run as distributed rounds. Shortest paths: search.py and tiles.py."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators import search, tiles
from pathloom.operators.scene import cut, in_tasks

FLOOR, OBSTACLE, VOID = 0, 1, 2
#: Floor cells of a scene whose components one task may find (some hundred MB); larger scenes go by rounds.
LARGE_CELLS = 4_000_000


def index(value: Column, low: Column, resolution: float, n: Column) -> Column:
    """The cell along one axis, clipped into the grid."""
    return F.least(F.greatest(((value - low) / resolution).cast("int"), F.lit(0)), n - 1)


def spans(boxes: DataFrame, bounds: DataFrame, resolution: float, grow: float) -> DataFrame:
    """Runs of cells (scene_id, i, j0, j1) of each box grown by `grow` on all sides, its end cells included; nothing for a box that is empty then."""
    b = boxes.select("scene_id", *((F.col(n) + (grow if n.startswith("max") else -grow)).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")))
    b = b.filter("max_x > min_x and max_y > min_y").join(bounds.hint("merge"), "scene_id")
    end = lambda m, a: index(F.col(f"{m}_{a}"), F.col(f"low_{a}"), resolution, F.col(f"n{a}"))
    return b.select("scene_id", F.explode(F.sequence(end("min", "x"), end("max", "x"))).alias("i"), end("min", "y").alias("j0"), end("max", "y").alias("j1"))


def build(bounds: DataFrame, rooms: DataFrame, obstacles: DataFrame, resolution: float, wall_margin: float = 0.15, inflation: float = 0.25) -> DataFrame:
    """Cells with state: obstacles win over floors, floors over void. rooms and obstacles are boxes of scenes.

    Boxes become runs of cells, and runs meet their row of the grid (scene_id, i): what is shuffled and sorted follows the rows, and cells
    are made last. Of runs that begin at one cell the longest stays, so a row holds at most two runs a cell. Rows are dealt to as many tasks as
    the session shuffles to, as their few bytes do not show how many cells come of them."""
    parts = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = spans(rooms, bounds, resolution, -wall_margin).withColumn("mark", F.lit(FLOOR)).unionByName(spans(obstacles, bounds, resolution, inflation).withColumn("mark", F.lit(OBSTACLE)))
    longest = marks.repartition(parts, "scene_id", "i").groupBy("scene_id", "i", "mark", "j0").agg(F.max("j1").alias("j1"))
    runs = longest.groupBy("scene_id", "i").agg(*(F.collect_list(F.when(F.col("mark") == mark, F.struct("j0", "j1"))).alias(name) for name, mark in (("floors", FLOOR), ("blocks", OBSTACLE))))
    rows = bounds.select("scene_id", "ny", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i")).repartition(parts, "scene_id", "i")
    cells = rows.join(runs.hint("merge"), ["scene_id", "i"], "left").select("scene_id", "i", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"), "floors", "blocks")
    held = lambda name: F.coalesce(F.exists(name, lambda r: F.col("j").between(r["j0"], r["j1"])), F.lit(False))
    return cells.select("scene_id", "i", "j", F.when(held("blocks"), OBSTACLE).when(held("floors"), FLOOR).otherwise(VOID).alias("state"))


def components(grid: DataFrame) -> DataFrame:
    """scene_id, i, j, label of floor cells: 4-neighbour components, numbered from 0 in row-major order of their first cell.

    Cells are packed before they are stored or shuffled, 64 in a number, and made again with their labels."""
    held = cut(search.packed(grid.filter(F.col("state") == FLOOR).select("scene_id", "i", "j")))
    large = held.groupBy("scene_id").agg(F.sum(F.bit_count("bits")).alias("n")).filter(F.col("n") > LARGE_CELLS).select("scene_id")
    if large.isEmpty():
        return _scene_components(held)
    large = cut(large)
    wide = held.join(large, "scene_id", "left_semi").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter("shiftright(bits, k) & 1 = 1")
    by_rounds = _round_components(wide.select("scene_id", "i", (F.col("block_j") * 64 + F.col("k")).alias("j")))
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy("root")) - 1
    numbered = by_rounds.join(by_rounds.select("scene_id", "root").distinct().withColumn("label", number), ["scene_id", "root"]).select("scene_id", "i", "j", "label")
    return _scene_components(held.join(large, "scene_id", "left_anti")).unionByName(numbered)


def _scene_components(held: DataFrame) -> DataFrame:
    """components() of packed scenes that a task can hold. Dealt to as many tasks as the session shuffles to, as packed rows do not show how many cells come of them."""

    def run(rows: pa.Table) -> pa.Table:
        i, block_j, bits = (rows[c].to_numpy() for c in ("i", "block_j", "bits"))
        floor = np.pad(search.unpacked(i, block_j, bits, (0, 0)), 1)  # a border of non-floor
        width, at = floor.shape[1], np.flatnonzero(floor)
        flat = np.where(floor.ravel(), np.arange(floor.size), floor.size)
        while True:
            low = np.minimum.reduce([flat[at], flat[at - 1], flat[at + 1], flat[at - width], flat[at + width]])
            low = flat[low]  # the root of the least neighbour
            if (low == flat[at]).all():
                break
            flat[at] = low
        label = np.unique(flat[at], return_inverse=True)[1]
        scene = np.full(len(at), rows["scene_id"][0].as_py(), np.int64)
        return pa.table({"scene_id": scene, "i": (at // width - 1).astype(np.int32), "j": (at % width - 1).astype(np.int32), "label": label.astype(np.int32)})

    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(parts, "scene_id").groupBy("scene_id").applyInArrow(run, "scene_id long, i int, j int, label int")


def _round_components(floor: DataFrame) -> DataFrame:
    """Least-label rounds with pointer jumping, each cut by a reliable checkpoint."""
    floor = cut(floor.withColumn("v", F.col("i").cast("long") * (1 << 31) + F.col("j")))
    near = F.explode(F.array(*(F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    edges = floor.select("scene_id", F.col("v").alias("a"), near.alias("n")).select("scene_id", "a", "n.i", "n.j")
    edges = cut(edges.join(floor, ["scene_id", "i", "j"]).select("scene_id", "a", F.col("v").alias("b")))
    labels = cut(floor.select("scene_id", "v", F.col("v").alias("label")))
    while True:
        low = edges.join(labels.select("scene_id", F.col("v").alias("b"), F.col("label").alias("other")), ["scene_id", "b"]).groupBy("scene_id", F.col("a").alias("v")).agg(F.min("other").alias("other"))
        lower = labels.join(low, ["scene_id", "v"], "left").select("scene_id", "v", F.col("label").alias("before"), F.least("label", "other").alias("label"))
        jump = lower.select("scene_id", F.col("v").alias("label"), F.col("label").alias("next"))
        labels = cut(lower.join(jump, ["scene_id", "label"]).select("scene_id", "v", "before", F.col("next").alias("label")))
        if labels.filter("label <> before").isEmpty():
            return labels.join(floor, ["scene_id", "v"]).select("scene_id", "i", "j", F.col("label").alias("root"))
        labels = labels.select("scene_id", "v", "label")


def bresenham(i1: Column, j1: Column, i2: Column, j2: Column) -> Column:
    """array<struct<i,j>> of the integer line between two cells, both ends included, as one fold over the steps."""
    di, dj = F.abs(i2 - i1), F.abs(j2 - j1)
    si, sj = F.when(i2 >= i1, 1).otherwise(-1), F.when(j2 >= j1, 1).otherwise(-1)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    start = F.struct(i1.cast("int").alias("i"), j1.cast("int").alias("j"), (di - dj).cast("int").alias("err"), F.array(cell(i1, j1)).alias("line"))

    def step(s: Column, _: Column) -> Column:
        e2 = s["err"] * 2
        on_i, on_j = e2 > -dj, e2 < di
        i, j = s["i"] + F.when(on_i, si).otherwise(0), s["j"] + F.when(on_j, sj).otherwise(0)
        err = s["err"] - F.when(on_i, dj).otherwise(0) + F.when(on_j, di).otherwise(0)
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), err.cast("int").alias("err"), F.concat(s["line"], F.array(cell(i, j))).alias("line"))

    steps = F.slice(F.sequence(F.lit(0), F.greatest(di, dj)), F.lit(2), F.greatest(di, dj).cast("int"))
    return F.aggregate(steps, start, step)["line"]


def sight(pairs: DataFrame, grid: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of pairs (scene_id, key, i1, j1, i2, j2): scene_id, key and clear, whether every cell of the line is floor."""
    line = pairs.select("scene_id", *key, F.explode(bresenham(F.col("i1"), F.col("j1"), F.col("i2"), F.col("j2"))).alias("c")).select("scene_id", *key, "c.i", "c.j")
    seen = line.hint("merge").join(grid.hint("merge"), ["scene_id", "i", "j"], "left")  # a line has far more cells than its pair's size shows
    return seen.groupBy("scene_id", *key).agg(F.bool_and(F.coalesce(F.col("state") == FLOOR, F.lit(False))).alias("clear"))


def _by_size(floor: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """scene_id and cells of the scenes that a task can hold, and of the larger ones (None if there are none)."""
    size = cut(search.sizes(floor))
    large = size.filter(F.col("cells") > search.HELD_DISTANCES)
    return size.filter(F.col("cells") <= search.HELD_DISTANCES), None if large.isEmpty() else large


def _searched(dealt: DataFrame, floor: DataFrame, blocks: DataFrame):
    """The rows of each scene and block with the packed floor of the scene, once for each of its blocks, as groups."""
    held = search.packed(floor).join(blocks, "scene_id")
    held = held.select(F.col("scene_id").alias("f_scene"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("f_block"), "i", "block_j", "bits")
    return in_tasks(dealt, "scene_id", "block").groupBy("scene_id", "block").cogroup(in_tasks(held, "f_scene", "f_block").groupBy("f_scene", "f_block"))


def _shape(*ends: np.ndarray) -> tuple[int, int]:
    return tuple(max(int(e[:, k].max(initial=0)) for e in ends) + 1 for k in (0, 1))


def grid_paths(questions: DataFrame, labelled: DataFrame, resolution: float, with_path: bool = False, most: float | None = None, key: tuple[str, ...] = ("q",)) -> DataFrame:
    """scene_id, key, distance (and path) between cells of a scene: questions (scene_id, key, i1, j1, i2, j2), labelled (of components()).

    key: whole-number columns that name a question within its scene.
    Shortest ways over 8 neighbours between floor cells of one 4-neighbour component (two floors that touch at a
    corner only do not reach each other); no row where the target is not reached, or not within `most` metres. A task holds a
    scene's floor and a block of its sources; scenes that no task can hold are searched by tiles, with the same result."""
    limit = None if most is None else int(most / resolution * search.STRAIGHT)
    label = labelled.select("scene_id", "i", "j", "label")
    at = lambda k: label.select("scene_id", F.col("i").alias(f"i{k}"), F.col("j").alias(f"j{k}"), F.col("label").alias(f"label{k}"))
    asked = questions.select("scene_id", *key, "i1", "j1", "i2", "j2").join(at(1).hint("merge"), ["scene_id", "i1", "j1"]).join(at(2).hint("merge"), ["scene_id", "i2", "j2"]).filter("label1 = label2")
    asked = cut(asked.select("scene_id", *(F.col(k).cast("long").alias(k) for k in key), "i1", "j1", "i2", "j2"))
    scenes = cut(asked.select("scene_id").distinct())  # a semi join alone would send every question's scene
    floor = label.join(scenes, "scene_id", "left_semi").select("scene_id", "i", "j")
    small, large = _by_size(floor)

    cell = pa.struct([("i", pa.int32()), ("j", pa.int32())])
    schema = pa.schema([*((k, pa.int64()) for k in ("scene_id", *key)), ("distance", pa.float64()), *[("path", pa.list_(cell))] * with_path])

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not asked.num_rows or not table.num_rows:
            return schema.empty_table()
        one, two = (np.stack([asked[f"{a}{k}"].to_numpy() for a in "ij"], axis=1) for k in (1, 2))
        floor = search.unpacked(*(table[c].to_numpy() for c in ("i", "block_j", "bits")), _shape(one, two))
        sources, number = np.unique(one, axis=0, return_inverse=True)
        number, block, rows = number.ravel(), max(1, search.HELD_DISTANCES // floor.size), []
        for start in range(0, len(sources), block):
            found = search.distances(floor, sources[start : start + block], limit)
            own = np.flatnonzero((number >= start) & (number < start + block))
            steps = found[number[own] - start, two[own, 0], two[own, 1]]
            own, steps = own[steps >= 0], steps[steps >= 0]
            columns = [*(pa.array(asked[k].to_numpy()[own]) for k in ("scene_id", *key)), pa.array(steps / search.STRAIGHT * resolution)]
            if with_path:
                ends, i, j = search.all_walked(found, number[own] - start, two[own])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], fields=list(cell))))
            rows.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(rows)

    out = "scene_id long, " + "".join(f"{k} long, " for k in key) + "distance double" + (", path array<struct<i:int,j:int>>" if with_path else "")
    sources = asked.groupBy("scene_id").agg(F.count_distinct("i1", "j1").alias("sources")).join(small, "scene_id")
    blocks = sources.select("scene_id", search.blocks(F.col("cells"), F.col("sources")).alias("blocks"))
    dealt = asked.join(blocks.hint("merge"), "scene_id").withColumn("block", F.pmod(F.xxhash64("i1", "j1"), "blocks")).drop("blocks")
    found = _searched(dealt, floor, blocks).applyInArrow(run, out)
    if large is None:
        return found
    rest, wide = asked.join(large, "scene_id", "left_semi"), floor.join(large, "scene_id", "left_semi")
    held = tiles.spread(wide, rest.select("scene_id", F.col("i1").alias("si"), F.col("j1").alias("sj")), limit)
    further = tiles.lengths(held, rest).select("scene_id", *key, (F.col("steps") / search.STRAIGHT * resolution).alias("distance"))
    return found.unionByName(further.join(tiles.ways(held, rest, key=key), ["scene_id", *key]) if with_path else further)


def nearest_pairs(ends: DataFrame, labelled: DataFrame, resolution: float) -> DataFrame:
    """scene_id, from_id, to_id, pt_from, pt_to, length: the shortest way between any point of each `from` and any of each `to`.

    ends: scene_id, role ('from', 'to' or 'both'), id, pt, i, j. As in grid_paths; of equal ways the least points are taken,
    no row where no point reaches any. A task holds a scene's floor, all `to` and a block of its `from`."""
    out = "scene_id long, from_id long, to_id long, pt_from int, pt_to int, length double"
    names = [part.split()[0] for part in out.split(", ")]
    ends = cut(ends.select("scene_id", "role", "id", "pt", "i", "j").join(labelled.select("scene_id", "i", "j", "label").hint("merge"), ["scene_id", "i", "j"]))
    floor = labelled.select("scene_id", "i", "j").join(cut(ends.select("scene_id").distinct()), "scene_id", "left_semi")
    small, large = _by_size(floor)
    a, b = (ends.filter(F.col("role").isin(role, "both")).drop("role") for role in ("from", "to"))

    def grouped(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each its cells, points and labels, padded with -1."""
        rows = rows.sort_values(["id", "pt"])
        ids, number, counts = np.unique(rows["id"], return_inverse=True, return_counts=True)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        held = np.full((len(ids), counts.max(), 4), -1)
        held[number, place] = rows[["i", "j", "pt", "label"]].to_numpy()
        return ids, held[:, :, :2], held[:, :, 2], held[:, :, 3]

    def run(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        one, two = asked[asked["from"]], asked[~asked["from"]]
        if not len(one) or not len(two) or not len(table):
            return pd.DataFrame([], columns=names)
        ids_a, cells_a, points_a, labels_a = grouped(one)
        ids_b, cells_b, points_b, labels_b = grouped(two)
        floor = search.unpacked(*(table[c].to_numpy() for c in ("i", "block_j", "bits")), _shape(cells_a.reshape(-1, 2), cells_b.reshape(-1, 2)))
        far, width, flat_b, rows = np.iinfo(np.int64).max, cells_a.shape[1], cells_b.reshape(-1, 2), []
        for at in range(0, len(ids_a), block := max(1, search.HELD_DISTANCES // (floor.size * width))):
            part, label = cells_a[at : at + block].reshape(-1, 2), labels_a[at : at + block].ravel()
            real = label >= 0
            steps = np.full((len(part), len(flat_b)), far)
            sources, number = np.unique(part[real], axis=0, return_inverse=True)
            found = search.distances(floor, sources)[number.ravel()][:, flat_b[:, 0], flat_b[:, 1]]
            steps[real] = np.where((label[real][:, None] == labels_b.ravel()) & (found >= 0), found, far)
            steps = steps.reshape(-1, width, len(ids_b), cells_b.shape[1]).transpose(0, 2, 1, 3).reshape(-1, len(ids_b), width * cells_b.shape[1])
            best = steps.argmin(axis=2)  # the first of equal ones: least points
            least = np.take_along_axis(steps, best[:, :, None], 2)[:, :, 0]
            x, y = np.nonzero(least < far)
            first, second = best[x, y] // cells_b.shape[1], best[x, y] % cells_b.shape[1]
            rows.append(pd.DataFrame({
                "scene_id": asked["scene_id"].iloc[0], "from_id": ids_a[at + x], "to_id": ids_b[y], "pt_from": points_a[at + x, first], "pt_to": points_b[y, second],
                "length": least[x, y] / search.STRAIGHT * resolution,
            }))
        return pd.concat(rows)

    sources = a.groupBy("scene_id").agg(F.count(F.lit(1)).alias("sources")).join(small, "scene_id")
    blocks = sources.select("scene_id", search.blocks(F.col("cells"), F.col("sources")).alias("blocks"))
    block = F.when(F.col("from"), F.array(F.pmod(F.xxhash64("id"), "blocks"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    both = a.withColumn("from", F.lit(True)).unionByName(b.withColumn("from", F.lit(False))).join(blocks.hint("merge"), "scene_id")
    dealt = both.withColumn("block", F.explode(block)).drop("blocks")
    found = _searched(dealt, floor, blocks).applyInPandas(run, out)
    if large is None:
        return found
    one, two = (t.join(large, "scene_id", "left_semi").select("scene_id", "label", *(F.col(c).alias(f"{c}{k}") for c in ("id", "pt", "i", "j"))) for k, t in ((1, a), (2, b)))
    held = tiles.spread(floor.join(large, "scene_id", "left_semi"), one.select("scene_id", F.col("i1").alias("si"), F.col("j1").alias("sj")))
    best = tiles.lengths(held, one.join(two, ["scene_id", "label"])).groupBy("scene_id", F.col("id1").alias("from_id"), F.col("id2").alias("to_id")).agg(F.min(F.struct("steps", "pt1", "pt2")).alias("m"))
    return found.unionByName(best.select("scene_id", "from_id", "to_id", F.col("m.pt1").alias("pt_from"), F.col("m.pt2").alias("pt_to"), (F.col("m.steps") / search.STRAIGHT * resolution).alias("length")))


def nearest_floor(points: DataFrame, grid: DataFrame, budget: int) -> DataFrame:
    """scene_id, key, fi, fj, d: the nearest floor cell of points (scene_id, key, i, j) in steps along the axes, at most `budget`.

    Ties go to the least cell. Both sides meet in squares as wide as the budget; the points are repeated over the squares around them, as floors have far more cells."""
    around = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    square = lambda n: F.floor(F.col(n) / budget)
    a = points.select("scene_id", "key", "i", "j").withColumn("a", F.explode(around)).withColumn("b", F.explode(around))
    a = a.select("scene_id", "key", "i", "j", (square("i") + F.col("a")).alias("a"), (square("j") + F.col("b")).alias("b"))
    floor = grid.filter(F.col("state") == FLOOR).select("scene_id", F.col("i").alias("fi"), F.col("j").alias("fj"), square("i").alias("a"), square("j").alias("b"))
    d = F.abs(F.col("i") - F.col("fi")) + F.abs(F.col("j") - F.col("fj"))
    near = a.hint("merge").join(floor, ["scene_id", "a", "b"]).withColumn("d", d).filter(F.col("d") <= budget)
    best = near.groupBy("scene_id", "key").agg(F.min(F.struct("d", "fi", "fj")).alias("m"))
    return best.select("scene_id", "key", "m.fi", "m.fj", "m.d")
