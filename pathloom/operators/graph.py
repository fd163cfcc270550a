"""Waypoint graphs: edges, all shortest paths, candidates and their scores. Every table carries its scene."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.scene import in_tasks
from pathloom.operators.spatial import distance_join


def edges(points: DataFrame, distance: float, axes: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs i < j at most `distance` apart and equal in keys (keys, i, j, d), by cells."""
    pairs = distance_join(points, points, distance, axes, keys).filter("idx_a < idx_b")
    return pairs.select(*(F.col(f"{k}_a").alias(k) for k in keys), F.col("idx_a").alias("i"), F.col("idx_b").alias("j"), "d")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each row and its mirror; the pairs are read once."""
    turned = F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    rest = [n for n in pairs.columns if n not in ("i", "j")]
    return pairs.select(*rest, turned.alias("e")).select(*(F.col(f"e.{n}") if n in ("i", "j") else F.col(n) for n in pairs.columns))


#: A length is a whole number of these units (a metre has 2^30), one at least: sums are exact, so equal ways are equal in any order.
UNITS = 1 << 30
FAR = np.int64(1) << 62
#: Pairs of waypoints that a task answers, and sums (sources times edges) that it holds at once.
HELD_PAIRS, HELD_SUMS = 1_000_000, 1_000_000


def all_pairs(points: DataFrame, web: DataFrame, paths: bool = True, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Shortest paths between all waypoints of a scene that are connected: scene_id, i, j, dist, pred (null where i = j) and path (vertices from i to j).

    points: scene_id, idx; web: scene_id, i, j, d in both directions. Of equal ways that over the least last vertices is taken: pred is the least
    vertex before j on any shortest path. A task holds the edges of one scene and a block of its sources, of held_pairs pairs, so
    results do not depend on how a scene is cut; no path is carried while distances are searched."""
    size = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).select("scene_id", F.least("n", F.ceil(F.col("n") * F.col("n") / held_pairs)).alias("blocks"))
    sources = points.select("scene_id", "idx").join(size.hint("merge"), "scene_id").select("scene_id", F.pmod(F.xxhash64("idx"), "blocks").alias("block"), "idx")
    units = F.greatest(F.lit(1).cast("long"), F.round(F.col("d") * UNITS).cast("long")).alias("w")
    edges = web.filter("i <> j").join(size, "scene_id").select(F.col("scene_id").alias("e_scene"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("e_block"), "i", "j", units)
    fields = [("scene_id", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("dist", pa.float64()), ("pred", pa.int64())] + [("path", pa.list_(pa.int64()))] * paths

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        schema, parts = pa.schema(fields), []
        if own.num_rows:
            scene, ids = own["scene_id"][0].as_py(), np.unique(own["idx"].to_numpy())
            graph = Edges(ids, *(near[c].to_numpy() for c in "ijw"))
            for at in range(0, len(ids), graph.step):
                a, b, dist, pred, steps = graph.ways(ids[at : at + graph.step], paths)
                columns = [pa.array(np.full(len(a), scene)), pa.array(a), pa.array(b), pa.array(dist / UNITS), pa.array(pred, mask=a == b)]
                parts.append(pa.Table.from_arrays(columns + ([steps] if paths else []), schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    kinds = "scene_id long, i long, j long, dist double, pred long" + ", path array<long>" * paths
    return in_tasks(sources, "scene_id", "block").groupBy("scene_id", "block").cogroup(in_tasks(edges, "e_scene", "e_block").groupBy("e_scene", "e_block")).applyInArrow(run, kinds)


class Edges:
    """The edges of one scene, sorted by where they lead."""

    def __init__(self, ids: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        self.names = np.unique(np.r_[ids, i, j])
        a, b = np.searchsorted(self.names, i), np.searchsorted(self.names, j)
        order = np.argsort(b, kind="stable")
        self.a, self.b, self.w = a[order], b[order], w[order].astype(np.int64)
        self.ends, self.starts = np.unique(self.b, return_index=True)
        self.step = max(1, HELD_SUMS // max(len(self.w), len(self.names)))  # sources searched at once

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """Units from each source to each vertex: all sources are relaxed together, those that change no more are left alone."""
        dist = np.full((len(sources), len(self.names)), FAR)
        dist[np.arange(len(sources)), sources] = 0
        open_, ends = np.arange(len(sources)) if len(self.w) else np.empty(0, int), self.ends[None, :]
        while len(open_):
            before = dist[open_[:, None], ends]
            after = np.minimum(before, np.minimum.reduceat(dist[open_][:, self.a] + self.w, self.starts, axis=1))
            dist[open_[:, None], ends] = after
            open_ = open_[(after < before).any(axis=1)]
        return dist

    def ways(self, ids: np.ndarray, paths: bool) -> tuple:
        """Source, target, units, the vertex before the target, and the path (or None) of each connected pair."""
        sources = np.searchsorted(self.names, ids)
        dist = self.distances(sources)
        pred = np.full(dist.shape, -1)
        if len(self.w):
            last = np.where((dist[:, self.a] + self.w == dist[:, self.b]) & (dist[:, self.b] < FAR), self.a, len(self.names))
            least = np.minimum.reduceat(last, self.starts, axis=1)
            pred[:, self.ends] = np.where(least < len(self.names), least, -1)
        s, t = np.nonzero(dist < FAR)
        steps = None
        if paths:
            back, at = [], t
            while (at >= 0).any():
                back.append(at)
                at = np.where(at >= 0, pred[s, at], -1)  # a source has none before it
            ways = np.stack(back[::-1], axis=1) if back else np.empty((0, 0), int)
            held = ways >= 0
            steps = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held.sum(axis=1))], pa.int32()), pa.array(self.names[ways[held]]))
        return ids[s], self.names[t], dist[s, t], self.names[pred[s, t]], steps


def measured(paths: DataFrame, waypoints: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """paths (scene_id, key, path) with rooms (distinct, in order of the path, none for waypoints without one) and n_objects.

    waypoints: scene_id, idx, type, room."""
    named = waypoints.select("scene_id", F.col("idx").alias("at"), "type", "room")
    at = paths.select("scene_id", *key, F.posexplode("path").alias("k", "at")).join(named.hint("merge"), ["scene_id", "at"])
    listed = at.groupBy("scene_id", *key).agg(
        F.array_sort(F.collect_list(F.when(F.col("room").isNotNull(), F.struct("k", "room")))).alias("r"), F.count_if(F.col("type").startswith("object:")).alias("n_objects"))
    rooms = listed.select("scene_id", *key, F.array_distinct(F.transform("r", lambda x: x["room"])).alias("rooms"), "n_objects")
    return paths.join(rooms.hint("merge"), ["scene_id", *key])


#: Vertices (paths times their longest) that a task takes into arrays at once.
HELD_VERTICES = 1_000_000


def lines(paths: DataFrame, rooms: DataFrame, resolution: float, step: float, height: float, key: tuple[str, ...]) -> DataFrame:
    """paths (scene_id, block, key, path: cells) as polylines at a height: scene_id, key, distance (their length), line (k, x, y, z: points at equal
    steps of about `step`, both ends kept, each found in its own segment) and n_rooms (rooms that are the first to hold one of the points).

    rooms: scene_id, block, room_id, box (min_x .. max_z, with its tolerance in height), low_x, low_y, repeated for each block. A task holds the rooms
    and the paths of a scene's block."""
    point = pa.struct([("k", pa.int64()), *((a, pa.float64()) for a in "xyz")])
    schema = pa.schema([*((k, pa.int64()) for k in ("scene_id", *key)), ("distance", pa.float64()), ("line", pa.list_(point)), ("n_rooms", pa.int64())])

    def resampled(cells: np.ndarray, count: np.ndarray) -> tuple:
        """Length of each polyline, and path, k, x and y of all points. cells: path, vertex, axis (padded); count: vertices of each."""
        real = np.arange(cells.shape[1]) < count[:, None]
        d = np.zeros(cells.shape[:2])
        gap = np.diff(cells, axis=1)
        d[:, 1:] = np.where(real[:, 1:], np.sqrt(gap[:, :, 0] * gap[:, :, 0] + gap[:, :, 1] * gap[:, :, 1]), 0.0)
        c1 = np.cumsum(d, axis=1)
        total = c1[:, -1]
        n = np.maximum(1.0, np.rint(total / step))
        each = np.where(total > 0, total / n, 1.0)[:, None]
        first, end = np.ceil((c1 - d) / each).astype(np.int64), np.minimum(np.ceil(c1 / each).astype(np.int64), n.astype(np.int64)[:, None])
        held = np.where(d > 0, np.maximum(end - first, 0), 0)
        path, vertex = (np.repeat(v.ravel(), held.ravel()) for v in np.indices(held.shape))
        k = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held.ravel(), held.ravel()) + first[path, vertex]
        share = ((k * each[path, 0] - (c1 - d)[path, vertex]) / d[path, vertex])[:, None]
        before = cells[path, vertex - 1]
        xy = before + share * (cells[path, vertex] - before)
        last = np.arange(len(cells))
        path, k, xy = np.r_[path, last], np.r_[k, n.astype(np.int64)], np.r_[xy, cells[last, count - 1]]
        order = np.lexsort((k, path))
        return total, path[order], k[order], xy[order]

    def in_rooms(xy: np.ndarray, held: dict) -> np.ndarray:
        """The number of the first room (in order) that holds each point, -1 for none."""
        found = np.full(len(xy), -1)
        for r in range(len(held["room_id"]) - 1, -1, -1):
            if held["min_z"][r] <= height <= held["max_z"][r]:
                inside = (xy[:, 0] >= held["min_x"][r]) & (xy[:, 0] <= held["max_x"][r]) & (xy[:, 1] >= held["min_y"][r]) & (xy[:, 1] <= held["max_y"][r])
                found[inside] = r
        return found

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        parts = []
        near = near.sort_by("room_id")
        held = {c: near[c].to_numpy() for c in ("room_id", "min_x", "min_y", "max_x", "max_y", "min_z", "max_z", "low_x", "low_y")}
        at = own["path"].combine_chunks()
        ends, low = at.offsets.to_numpy().astype(np.int64), np.array([held["low_x"][0], held["low_y"][0]]) if near.num_rows else np.zeros(2)
        flat = np.stack([at.values.field(a).to_numpy() for a in "ij"], axis=1)
        count = np.diff(ends)
        block = max(1, HELD_VERTICES // max(1, int(count.max(initial=1))))
        for a in range(0, own.num_rows, block):
            size = count[a : a + block]
            vertex = np.minimum(np.arange(size.max()), size[:, None] - 1)
            total, path, k, xy = resampled(low + (flat[ends[a : a + block][: len(size), None] + vertex] + 0.5) * resolution, size)
            room = in_rooms(xy, held)
            pairs = np.unique(np.stack([path[room >= 0], room[room >= 0]]), axis=1)[0]
            line = pa.StructArray.from_arrays([pa.array(k), pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(np.full(len(k), height))], fields=list(point))
            offsets = np.r_[0, np.cumsum(np.bincount(path, minlength=len(size)))]
            columns = [*(own[c].slice(a, block).combine_chunks() for c in ("scene_id", *key)), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), line), pa.array(np.bincount(pairs, minlength=len(size)))]
            parts.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    kinds = "scene_id long, " + "".join(f"{k} long, " for k in key) + "distance double, line array<struct<k:long,x:double,y:double,z:double>>, n_rooms long"
    renamed = rooms.withColumnsRenamed({"scene_id": "r_scene", "block": "r_block"})
    return in_tasks(paths, "scene_id", "block").groupBy("scene_id", "block").cogroup(in_tasks(renamed, "r_scene", "r_block").groupBy("r_scene", "r_block")).applyInArrow(run, kinds)


def scale(rooms: Column) -> Column:
    return F.when(rooms <= 1, "short").when(rooms <= 3, "medium").otherwise("long")


def graph_score(length: Column, rooms: Column, objects: Column, distance: Column) -> Column:
    return length + 3.0 * rooms + 2.0 * objects + 0.1 * distance


def region_score(vertices: Column, rooms: Column, distance: Column) -> Column:
    return vertices + 3.0 * rooms + 0.1 * distance + 5.0
