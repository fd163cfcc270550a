"""Order-dependent folds and seeded samplers. Whether a row is taken depends on those taken before: acceptance by distance
runs in rounds over tiles of a scene, the others have one scene in a task (scenes run side by side). State is a hash of cells,
so a step looks at its neighbours only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators import search, spline
from pathloom.operators.scene import cut, in_tasks


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which another key begins; null is a key."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        new |= np.diff(table[key].combine_chunks().dictionary_encode("encode").indices.to_numpy()) != 0
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where their groups begin and the last ends, of batches sorted by keys: many small groups take one hand-over."""
    held: list[pa.Table] = []  # rows of the last group so far, which may go on

    def done(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        return table, np.r_[0, changes(table, keys), table.num_rows]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        last = int(max(changes(table, keys), default=0))
        if held and (last or any(held[-1][key][-1] != table[key][0] for key in keys)):
            yield done(pa.concat_tables([*held, table.slice(0, last)]))
            held = [table.slice(last)]
            continue
        if last:
            yield done(table.slice(0, last))
        held.append(table.slice(last))
    if held:
        yield done(pa.concat_tables(held))


def by_groups(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df as whole_groups() takes it: rows equal in keys in one of as many tasks as the session shuffles to, sorted by keys and order.

    Dealt by a hash of the keys: Spark leaves out a repartition by the keys themselves where a join has just dealt its rows by them, and then may
    change that join for one that deals nothing."""
    return in_tasks(df.withColumn("_group", F.xxhash64(*keys)), "_group").drop("_group").sortWithinPartitions(*keys, *order)


class Spread:
    """Accepted points in square cells as wide as the largest distance asked for."""

    def __init__(self, width: float):
        self.width, self.cells = max(width, 1e-9), {}

    def far(self, point: tuple, distance: float) -> bool:
        """No accepted point is nearer than distance."""
        home = [math.floor(c / self.width) for c in point[:2]]
        for i in range(home[0] - 1, home[0] + 2):
            for j in range(home[1] - 1, home[1] + 2):
                for other in self.cells.get((i, j), ()):
                    if math.sqrt(sum((a - b) * (a - b) for a, b in zip(point, other))) < distance:
                        return False
        return True

    def add(self, point: tuple) -> None:
        self.cells.setdefault(tuple(math.floor(c / self.width) for c in point[:2]), []).append(point)


#: Width of a tile of the parallel acceptance, in the largest distance that is asked for.
TILE = 64


def greedy(points: DataFrame, key: str, order: str, axes: tuple[str, ...] = ("x", "y"), tile: float | None = None) -> DataFrame:
    """Rows taken in order if they are at least their own `least` from all taken before; same columns, the result of one pass in order.

    In rounds over square tiles (of the first two axes, `tile` wide, from the least values of the scene, so that a scene as wide as a tile lies
    in one): a tile goes through its open rows in order and decides each
    whose earlier neighbours, those of the tiles around included, are all decided; others wait for the next round. The first
    open row of a scene is always decided, and a scene in one tile takes one round. Rows equal in order must not be near each
    other; of rows that repeat one is taken."""
    base = cut(points.withColumn("_at", F.monotonically_increasing_id()))
    widest = base.agg(F.max("least")).first()[0]
    side = tile or (TILE * widest if widest and widest > 0 else 1.0)
    place = [F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(axes)]
    work = base.select("_at", F.col(key).alias("k"), F.col(order).alias("o"), *place, F.col("least").cast("double").alias("least"))
    low = work.groupBy("k").agg(F.min("p0").alias("low0"), F.min("p1").alias("low1"))
    work = work.join(low, "k").select("*", *((F.col(f"p{k}") - F.col(f"low{k}")).alias(f"q{k}") for k in (0, 1))).drop("low0", "low1")
    a, b = (F.floor(F.col(f"q{k}") / side).alias(n) for k, n in enumerate("ab"))
    work = cut(work.select("*", a, b, F.lit(None).cast("boolean").alias("taken")))
    names = ["_at", "k", "o", *(f"p{k}" for k in range(len(axes))), "least", "a", "b"]
    reach = widest and widest * (1 + 1e-9)  # on the safe side of rounding

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches, ["k", "a", "b"]):
            ats, owns, takens, leasts, *points = (rows[n].to_pylist() for n in ("_at", "own", "taken", "least", *(f"p{k}" for k in range(len(axes)))))
            found, now = [], []
            for first, end in zip(ends[:-1], ends[1:]):
                held, waiting = Spread(widest), Spread(widest)
                for k in range(first, end):
                    point, taken = tuple(p[k] for p in points), takens[k]
                    if owns[k] and taken is None:
                        taken = False if not held.far(point, leasts[k]) else True if waiting.far(point, leasts[k]) else None
                        found.append(ats[k])
                        now.append(taken)
                    if taken is None:
                        waiting.add(point)
                    elif taken:
                        held.add(point)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(now, pa.bool_())], ["_at", "now"])

    while True:
        live = work.filter("taken is null or taken")
        near = [((da, db), _beside("q0", "a", da, side, reach) & _beside("q1", "b", db, side, reach)) for da in (-1, 0, 1) for db in (-1, 0, 1) if da or db]
        moves = F.filter(F.array(*(F.when(is_near, F.struct(F.lit(da).alias("da"), F.lit(db).alias("db"))) for (da, db), is_near in near)), lambda m: m.isNotNull())
        ring = live.withColumn("m", F.explode(moves)).withColumn("a", F.col("a") + F.col("m.da")).withColumn("b", F.col("b") + F.col("m.db"))
        both = live.select(*names, F.col("taken"), F.lit(True).alias("own")).unionByName(ring.select(*names, "taken", F.lit(False).alias("own")))
        open_ = work.filter("taken is null").select("k", "a", "b").distinct()
        judged = by_groups(both.join(open_, ["k", "a", "b"], "left_semi"), ["k", "a", "b"], ["o", "_at"]).mapInArrow(run, "_at long, now boolean")
        work = cut(work.join(judged, "_at", "left").withColumn("taken", F.coalesce("taken", "now")).drop("now"))
        if work.filter("taken is null").isEmpty():
            return base.join(work.filter("taken").select("_at"), "_at", "left_semi").drop("_at")


def _beside(place: str, tile: str, move: int, side: float, widest: float) -> Column:
    """Whether a point of a tile may matter to the next tile along one axis."""
    if not move:
        return F.lit(True)
    return F.col(place) - F.col(tile) * side <= widest if move < 0 else (F.col(tile) + 1) * side - F.col(place) <= widest


def darts(boxes: DataFrame, key: str, distance: float, count: int, tries: int = 30, seed: int = 42, kind: str = "long") -> DataFrame:
    """Poisson-disk points in the box (min_x ..) of each key: the generator starts anew for every box, so nothing is shuffled."""

    def run(parts):
        for rows in parts:
            out = []
            for name, *corners in zip(*(rows[c] for c in (key, "min_x", "min_y", "max_x", "max_y"))):
                low, high = np.array(corners[:2]), np.array(corners[2:])
                held, n = Spread(distance), 0
                for point in low + (high - low) * np.random.default_rng(seed).random((count * tries, 2)):
                    if n == count:
                        break
                    if held.far(tuple(point), distance):
                        held.add(tuple(point))
                        out.append((name, n, *point))
                        n += 1
            yield pd.DataFrame(out, columns=[key, "pt", "x", "y"])

    return boxes.select(key, "min_x", "min_y", "max_x", "max_y").mapInPandas(run, f"{key} {kind}, pt long, x double, y double")


def weighted_cells(cells: DataFrame, key: str, distance: float, count: int | None, seed: int, tries: int | None = 60) -> DataFrame:
    """Cells (key, i, j, x, y, weight) drawn by weight, kept if far enough from those kept; tries None: each cell once.

    count None: as many as the group's column `most` says. A group must fit in a task; the many groups of a task are handed over together."""

    def chosen(n: int, xy: list[tuple], weight: np.ndarray | None, wanted: int) -> list[int]:
        rng = np.random.default_rng(seed)
        if weight is None:
            order = rng.permutation(n)
        else:
            weight = np.maximum(weight, 1e-8)
            order = rng.choice(n, wanted * tries, p=weight / weight.sum())
        held, taken = Spread(distance), []
        for k in order.tolist():
            if len(taken) == wanted:
                break
            if held.far(xy[k], distance):
                held.add(xy[k])
                taken.append(k)
        return taken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches, [key]):
            xy = list(zip(rows["x"].to_pylist(), rows["y"].to_pylist()))
            weight, most = None if tries is None else rows["weight"].to_numpy(), None if count is not None else rows["most"].to_numpy()
            taken = [a + k for a, b in zip(ends[:-1], ends[1:]) for k in chosen(b - a, xy[a:b], None if weight is None else weight[a:b], count if most is None else int(most[a]))]
            yield from rows.take(pa.array(taken, pa.int64())).to_batches()

    return by_groups(cells, [key], ["i", "j"]).mapInArrow(run, cells.schema)


def novelty(candidates: DataFrame, keys: list[str], order: list[str], least: float, free: int = 5) -> DataFrame:
    """Per group in order of score (descending, then order): the first `free` rows, then those of whose marks a share of
    `least` or more is uncovered, up to the row's own target; columns score, marks and target are read."""

    def run(rows: pa.Table) -> pa.Table:
        by = pc.sort_indices(rows, sort_keys=[("score", "descending"), *((k, "ascending") for k in order)]).to_pylist()
        lists = rows["marks"].combine_chunks()
        starts, marks, targets = lists.offsets.to_pylist(), lists.values.to_pylist(), rows["target"].to_pylist()
        covered, taken, most = set(), [], max(targets, default=0)
        for k in by:
            if len(taken) >= most:
                break
            if len(taken) < targets[k]:
                own = set(marks[starts[k] : starts[k + 1]])
                new = len(own - covered) / len(own) if own else 0.0
                if len(taken) < free or new >= least:
                    taken.append(k)
                    covered |= own
        return rows.take(pa.array(taken, pa.int64()))

    return candidates.groupBy(*keys).applyInArrow(run, candidates.schema)


#: Steps of the walks' generator: draws are whole numbers under MODULUS from seed, scene, walk and step.
WALK, STEP, SCENE, MULTIPLIER, MODULUS = 7919, 6007, 104729, 48271, 2**31 - 1


def random_cells(floor: DataFrame, bounds: DataFrame, resolution: float, count: int, tries: int, least: float, seed: int) -> DataFrame:
    """scene_id, start, i, j, x, y: of `count` starts of each scene those at least `least` from all taken before, in order. A start is the first of
    `tries` draws from the whole grid that hits a cell of floor (scene_id, i, j); draws are whole numbers from seed, scene, start and try.

    bounds: scene_id, low_x, low_y, nx, ny. A task looks cells up in the packed floor of a scene, 64 cells in a number, and does not unpack it."""
    names = ["scene_id", "start", "i", "j", "x", "y"]

    def drawn(rows: pa.Table) -> list[tuple]:
        scene, low_x, low_y, nx, ny = (rows[c][0].as_py() for c in ("scene_id", "low_x", "low_y", "nx", "ny"))
        width = -(-ny // 64)
        place, bits = rows["i"].to_numpy().astype(np.int64) * width + rows["block_j"].to_numpy(), rows["bits"].to_numpy()
        hits, open_, begun = [], np.arange(count), 0
        for end in sorted({min(8, tries), min(40, tries), tries}):  # most starts hit a floor by their first tries; the others go on
            k = (open_[:, None] * WALK + np.arange(begun, end) * STEP + scene * SCENE + seed) * MULTIPLIER % MODULUS % (nx * ny)
            i, j = k // ny, k % ny
            at = np.minimum(np.searchsorted(place, i * width + j // 64), len(place) - 1)
            hit = (place[at] == i * width + j // 64) & (bits[at] >> (j % 64) & 1 == 1)
            first, found = hit.argmax(axis=1), hit.any(axis=1)
            own = np.flatnonzero(found)
            hits += zip(open_[own].tolist(), i[own, first[own]].tolist(), j[own, first[own]].tolist())
            open_, begun = open_[~found], end
        held, taken = Spread(least), []
        for start, i, j in sorted(hits):
            point = low_x + (i + 0.5) * resolution, low_y + (j + 0.5) * resolution
            if held.far(point, least):
                held.add(point)
                taken.append((scene, start, i, j, *point))
        return taken

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches, ["scene_id"]):
            taken = [t for a, b in zip(ends[:-1], ends[1:]) for t in drawn(rows.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in taken], kind) for k, kind in enumerate(kinds)], names)

    held = search.packed(floor.select("scene_id", "i", "j")).join(bounds.hint("merge"), "scene_id")
    return by_groups(held, ["scene_id"], ["i", "block_j"]).mapInArrow(run, "scene_id long, start long, i int, j int, x double, y double")


def walks(edges: DataFrame, rooms: DataFrame, seed: int, per_waypoint: int = 2, steps: int = 30) -> DataFrame:
    """Random walks over a scene's graph: never straight back; visited waypoints weigh 0.1, new rooms 3, others 1.

    Walks of fewer than 3 waypoints are left out. edges: scene_id, i, j; rooms: scene_id, idx, room (or null)."""

    def run(graph: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        if not len(names):
            return pd.DataFrame({"scene_id": [], "walk": [], "path": []})
        scene = int(names["room_scene"].iloc[0])
        room = dict(zip(names["idx"], names["room"]))
        near = {i: g.sort_values("j")["j"].tolist() for i, g in graph.groupby("i")}
        every, out = sorted(room), []
        for number in range(per_waypoint * len(every)):
            path = [every[(number * WALK + scene * SCENE + seed) % len(every)]]
            seen = {room[path[0]]}
            while len(path) <= steps:
                options = [j for j in near.get(path[-1], ()) if len(path) < 2 or j != path[-2]]
                if not options:
                    break
                weight = np.cumsum([1 if j in path else 30 if room[j] is not None and room[j] not in seen else 10 for j in options])
                drawn = (number * WALK + (len(path) - 1) * STEP + scene * SCENE + seed) * MULTIPLIER % MODULUS
                path.append(options[int(np.argmax(weight * MODULUS > drawn * int(weight[-1])))])
                seen.add(room[path[-1]])
            if len(path) >= 3:
                out.append((scene, number, path))
        return pd.DataFrame(out, columns=["scene_id", "walk", "path"])

    named = rooms.select("idx", "room", F.col("scene_id").alias("room_scene"))
    return in_tasks(edges, "scene_id").groupBy("scene_id").cogroup(in_tasks(named, "room_scene").groupBy("room_scene")).applyInPandas(run, "scene_id long, walk long, path array<long>")


def smooth(points: DataFrame, key: str = "path_id", order: str = "seq", bound: float = 0.2) -> DataFrame:
    """Each polyline (x, y, z in order) on the smoothest cubic spline whose squared distances from its vertices sum to bound (spline.py).

    As many rows as before. Polylines of fewer than 4 distinct vertices or with non-finite values stay as they are. Polylines are dealt to as
    many tasks as the session shuffles to (their bytes do not show the work); a task smooths those of an Arrow batch side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_groups(batches, [key]):
            xyz = np.stack([table[a].cast(pa.float64()).to_numpy() for a in "xyz"], axis=1)
            out = np.concatenate(spline.curves([xyz[a:b] for a, b in zip(ends[:-1], ends[1:])], bound))
            for k, a in enumerate("xyz"):
                table = table.set_column(table.schema.get_field_index(a), table.schema.field(a), pa.array(out[:, k], table.schema.field(a).type, from_pandas=True))
            yield from table.to_batches()

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(parts, key).sortWithinPartitions(F.asc_nulls_last(key), F.asc_nulls_last(order)).mapInArrow(run, points.schema)
