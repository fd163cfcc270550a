"""Operators over scene states: containment, access, boxes, goal points and goal regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import tags as T
from pathloom.functions import vocab


def resolve_rooms(relations: DataFrame) -> DataFrame:
    """id and room of every object that reaches a room over its parents (id, parent, parent_is_room).

    Pointer doubling: each round joins the open rows with the hops found so far, so a chain of n parents takes log n
    rounds. A round that finds no further room is the last one: what is still open is on a cycle or below a dangling
    parent. Each round is cut by a reliable checkpoint."""
    edges, found = cut(relations.select("id", "parent", F.col("parent_is_room").alias("done"))), -1
    while (now := edges.filter("done").count()) > found:
        found = now
        hop = edges.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.col("done").alias("next_done"))
        step = edges.filter("not done").join(hop, "parent")
        moved = step.select("id", F.col("next").alias("parent"), F.col("next_done").alias("done"))
        edges = cut(edges.filter("done").unionByName(moved))
    return edges.filter("done").select("id", F.col("parent").alias("room"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a reliable checkpoint in the session's shared folder. Only a session on one machine may have none set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints/pathloom")
    return df.checkpoint(eager=True)


def in_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in as many tasks as the session shuffles to: rows whose few bytes do not show the work would be put into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def merged_boxes(prims: DataFrame, key: str) -> DataFrame:
    """Component-wise box over the prims of each owner."""
    return prims.groupBy(key).agg(*(F.min(c).alias(c) for c in ("x0", "y0", "z0")), *(F.max(c).alias(c) for c in ("x1", "y1", "z1")))


def room_prims(rooms: DataFrame, prims: DataFrame) -> DataFrame:
    """Valid prim paths of each room (id, obj), with the number of their suffix."""
    suffixes = F.posexplode(F.array(*(F.lit(s) for s in vocab.ROOM_SUFFIXES)))
    paths = rooms.select("id", T.prim_name(F.col("obj")).alias("name"), suffixes.alias("suffix_ord", "suffix"))
    return paths.select("id", "suffix_ord", F.concat(F.lit("/World/"), "name", "suffix").alias("prim_path")).join(prims, "prim_path")


def collected_rooms(rooms: DataFrame, prims: DataFrame, least_area: float = 0.5) -> DataFrame:
    """Boxes of rooms (id, obj, type) with prims and an XY area of at least least_area."""
    boxes = merged_boxes(room_prims(rooms, prims), "id")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return rooms.select("id", "type").join(boxes.withColumn("area", area).filter(F.col("area") >= least_area), "id").withColumn("floor_z", F.col("z0"))


def region_catalog(rooms: DataFrame, objects: DataFrame, wall_margin: float = 0.3, object_radius: float = 1.5) -> DataFrame:
    """Goal regions: a rectangle per room, the rooms of each type together, and a circle per labelled object.

    rooms: id, type, box; objects: id, sem, tx, ty. One row per part of a region."""
    rect = [(F.col("x0") + wall_margin).alias("min_x"), (F.col("y0") + wall_margin).alias("min_y"), (F.col("x1") - wall_margin).alias("max_x"), (F.col("y1") - wall_margin).alias("max_y")]
    nothing = [F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "r")]
    kind = F.coalesce("type", F.lit("unknown"))
    one = rooms.select(F.concat(F.lit("room:"), kind, F.lit("/"), "id").alias("label"), F.lit("rect").alias("kind"), F.lit(0).alias("part_no"), *nothing, *rect)
    number = F.row_number().over(Window.partitionBy(kind).orderBy("id")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy(kind))
    typed = rooms.select(F.concat(F.lit("rooms:"), kind).alias("label"), F.when(size > 1, "composite").otherwise("rect").alias("kind"), number.alias("part_no"), *nothing, *rect)
    label = T.first_not_of(F.col("sem"), vocab.META_SKIP)
    fit = objects.filter(~T.any_of(F.col("sem"), vocab.SKIP_SEMANTICS)).withColumn("label", label).filter("label is not null and tx is not null")
    none = [F.lit(None).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    circle = fit.select(F.concat(F.lit("object:"), "label", F.lit("/"), "id").alias("label"), F.lit("circle").alias("kind"), F.lit(0).alias("part_no"), F.col("tx").alias("cx"), F.col("ty").alias("cy"), F.lit(object_radius).alias("r"), *none)
    return one.unionByName(typed).unionByName(circle)


def small(sem: Column, volume: Column) -> Column:
    return T.any_of(sem, vocab.SMALL_OBJECT_FUNCTIONS) | (volume < 0.125)


def goal_kind(sem: Column, volume: Column) -> Column:
    """How an object's goal points are made; order matters."""
    return F.when(small(sem, volume), "center").when(F.array_contains(sem, "furniture"), "around").when(F.array_contains(sem, "wall-decoration"), "wall")


def wall_points(objects: DataFrame, offset: float = 0.1, step: float = 0.1) -> DataFrame:
    """Points before a decoration on a wall: id, pt, x, y, z.

    objects: id, centroid (cx, cy, cz), half extents (h array), axes (array of three axes), room centroid (rx, ry, rz)."""
    h, axes = F.col("h"), F.col("axes")
    short = F.array_position(h, F.array_min(h)).cast("int")
    longest = F.array_position(h, F.array_max(h)).cast("int")
    upright = F.element_at(F.element_at(axes, longest), 3) > 0.9
    long = F.when(upright, F.lit(6) - short - longest).otherwise(longest)
    prepared = objects.withColumn("s", short).withColumn("l", long).withColumn("sa", F.element_at(axes, F.col("s"))).withColumn("la", F.element_at(axes, F.col("l"))).withColumn("half", F.element_at(h, F.col("l")))
    away = sum(((F.col(f"c{a}") - F.col(f"r{a}")) * F.element_at("sa", k) for k, a in enumerate("xyz", 1)), F.lit(0.0))
    sign = F.when(away > 0, -1.0).otherwise(1.0)
    count = F.ceil(2 * F.col("half") / step).cast("int")
    numbered = prepared.withColumn("sign", sign).withColumn("pt", F.explode(F.sequence(F.lit(0), count)))
    along = F.when(F.col("pt") == 0, 0.0).otherwise(-F.col("half") + (F.col("pt") - 1) * step)
    place = lambda a, k: F.col(f"c{a}") + offset * F.col("sign") * F.element_at("sa", k) + along * F.element_at("la", k)
    return numbered.select("id", "pt", *(place(a, k).alias(a) for k, a in enumerate("xyz", 1)))


def ring_candidates(objects: DataFrame, standoff: float = 0.6, angles: int = 16, rings: int = 4) -> DataFrame:
    """Candidate floor positions around objects (scene_id, id, cx, cy, half): scene_id, id, ring, angle, x, y."""
    around = objects.withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(rings - 1)))).withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    radius = F.col("half") + standoff * (F.col("ring") + 1)
    turn = F.col("angle") * F.lit(2 * math.pi / angles)
    return around.select("scene_id", "id", "ring", "angle", (F.col("cx") + radius * F.cos(turn)).alias("x"), (F.col("cy") + radius * F.sin(turn)).alias("y"))


def first_prims(states: DataFrame, prims: DataFrame) -> DataFrame:
    """The first valid prim of each state (id, obj, state_type) and its box as centre, three axes and half extents; none without prims.

    Rooms have a prim for each suffix, in the order of the suffixes; all else has one."""
    suffixes = F.when(F.col("state_type") == "room", F.array(*(F.lit(s) for s in vocab.ROOM_SUFFIXES))).otherwise(F.array(F.lit("")))
    paths = states.select("id", T.prim_name(F.col("obj")).alias("name"), F.posexplode(suffixes).alias("suffix_ord", "suffix"))
    held = paths.select("id", "suffix_ord", F.concat(F.lit("/World/"), "name", "suffix").alias("prim_path")).join(prims, "prim_path")
    first = held.groupBy("id").agg(F.min_by(F.struct("prim_path", "x0", "y0", "z0", "x1", "y1", "z1"), "suffix_ord").alias("p"))
    centre = [((F.col(f"p.{a}0") + F.col(f"p.{a}1")) / 2.0).alias(f"c{a}") for a in "xyz"]
    half = F.array(*((F.col(f"p.{a}1") - F.col(f"p.{a}0")) / 2.0 for a in "xyz"))
    axes = F.array(*(F.array(*(F.lit(float(k == m)) for m in range(3))) for k in range(3)))
    return first.select("id", "p.prim_path", *centre, axes.alias("axes"), half.alias("h"))
