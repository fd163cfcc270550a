"""Goal regions from descriptions: JSON trees of circles, rectangles, polygons, waypoint sets and composites of these.

A description is read as VARIANT and taken apart level by level, a round for each level of nesting, into one row for each
leaf with its place in the tree. A composite is the union of its parts, so what a tree holds, its area (overlaps count
twice), its box and its nearest boundary point follow from its leaves: any, sum, least and greatest, and the nearest, the first of
equal ones in the order of the tree. Points meet only leaves whose box they lie in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geometry as G
from pathloom.operators.scene import cut
from pathloom.operators.spatial import points_in_boxes

TYPES = ("circle", "rect", "polygon", "composite", "waypoint_set")
BOX = ("min_x", "min_y", "max_x", "max_y")


def leaves(descriptions: DataFrame) -> DataFrame:
    """scene_id, id, node (places from the root down), type and the leaf's own columns of descriptions (scene_id, id, description).

    An unknown or missing type is an error, at any depth; a composite without children has no leaf."""
    level = descriptions.select("scene_id", "id", F.array(F.lit(0)).alias("node"), F.parse_json("description").alias("v"))
    found = None
    while True:
        kind = F.try_variant_get("v", "$.type", "string")
        unknown = F.raise_error(F.concat(F.lit("unknown region type: "), F.coalesce(kind, F.lit("none"))))
        level = cut(level.withColumn("type", F.when(kind.isin(*TYPES), kind).otherwise(unknown)))
        plain = level.filter("type <> 'composite'")
        found = plain if found is None else found.unionByName(plain)
        inner = level.filter("type = 'composite'").select("scene_id", "id", "node", F.posexplode(F.variant_get("v", "$.children", "array<variant>")).alias("k", "v"))
        if inner.isEmpty():
            break
        level = inner.select("scene_id", "id", F.concat("node", F.array("k")).alias("node"), "v")
    of = lambda path, kind="double": F.variant_get("v", path, kind)
    corners = F.transform(of("$.vertices", "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return found.select(
        "scene_id", "id", "node", "type", of("$.center[0]").alias("cx"), of("$.center[1]").alias("cy"), of("$.radius").alias("r"),
        *(of(f"$.{end}_xy[{k}]").alias(f"{end}_{a}") for end in ("min", "max") for k, a in enumerate("xy")), corners.alias("vertices"), of("$.indices", "array<bigint>").alias("indices"),
        F.lit(None).cast("array<struct<k:int,x:double,y:double>>").alias("centres"),
    )


def bind(held: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Leaves whose waypoint sets know the places (centres) of their indices; waypoints: scene_id, idx, x, y. An index without a waypoint is an error."""
    wanted = held.filter("type = 'waypoint_set'").select("scene_id", "id", "node", F.posexplode("indices").alias("k", "idx"))
    at = wanted.join(waypoints.select("scene_id", "idx", "x", "y"), ["scene_id", "idx"], "left")
    x = F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("no waypoint "), F.col("idx").cast("string")))).otherwise(F.col("x"))
    centres = at.groupBy("scene_id", "id", "node").agg(F.array_sort(F.collect_list(F.struct(F.col("k"), x.alias("x"), F.col("y")))).alias("centres"))
    return held.drop("centres").join(centres, ["scene_id", "id", "node"], "left")


def _by_type(circle, rect, polygon, waypoint_set) -> Column:
    kind = F.col("type")
    return F.when(kind == "circle", circle).when(kind == "rect", rect).when(kind == "polygon", polygon).otherwise(waypoint_set)


def _ends(pick, values: str, axis: str) -> Column:
    return pick(F.transform(values, lambda p: p[axis]))


def measured(held: DataFrame) -> DataFrame:
    """Leaves with area and box (min_x, min_y, max_x, max_y); the box of an unbound waypoint set is a point at the origin."""
    c, r = F.col, F.col("r")
    area = _by_type(math.pi * r * r, G.rect_area(*(c(b) for b in BOX)), G.polygon_area(c("vertices")), F.size("indices") * math.pi * r * r)
    box = []
    for end, pick, way in (("min", F.array_min, -1), ("max", F.array_max, 1)):
        for a in "xy":
            bound = F.coalesce(_ends(pick, "centres", a) + way * r, F.lit(0.0))
            box.append(_by_type(c(f"c{a}") + way * r, c(f"{end}_{a}"), _ends(pick, "vertices", a), bound).alias(f"{end}_{a}"))
    return held.select(*(n for n in held.columns if n not in BOX), area.alias("area"), *box)


def metrics(held: DataFrame) -> DataFrame:
    """scene_id, id, area and box of each region."""
    least, most = ([f(b).alias(b) for b in BOX if b.startswith(n)] for f, n in ((F.min, "min"), (F.max, "max")))
    return measured(held).groupBy("scene_id", "id").agg(F.sum("area").alias("area"), *least, *most)


def _holds(x: Column, y: Column) -> Column:
    c = F.col
    unbound = F.raise_error(F.lit("a waypoint set is not bound to waypoints"))
    near = F.exists("centres", lambda p: G.circle_contains(x, y, p["x"], p["y"], c("r")))
    return _by_type(G.circle_contains(x, y, c("cx"), c("cy"), c("r")), G.rect_contains(x, y, *(c(b) for b in BOX)), G.polygon_contains(x, y, c("vertices")), F.when(c("centres").isNull(), unbound).otherwise(near))


def members(points: DataFrame, held: DataFrame, width: float = 2.0) -> DataFrame:
    """scene_id, idx, id: points (scene_id, idx, x, y) in the regions of their scene; cells of `width` bring points and leaves together."""
    bound = measured(held)
    unbound = F.raise_error(F.lit("a waypoint set is not bound to waypoints"))
    bound = bound.withColumn("min_x", F.when((F.col("type") == "waypoint_set") & F.col("centres").isNull(), unbound).otherwise(F.col("min_x")))
    met = points_in_boxes(points.select("scene_id", "idx", "x", "y"), bound, width, keys=("scene_id",))
    return met.filter(_holds(F.col("x"), F.col("y"))).select("scene_id", "idx", "id").distinct()


def _nearest(x: Column, y: Column) -> Column:
    """Struct of x and y of a leaf's boundary point; of an unbound waypoint set the point itself."""
    c, place = F.col, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))
    n = F.size("vertices")

    def edge(i: Column) -> Column:
        a, b = F.get("vertices", i), F.get("vertices", (i + 1) % n)
        qx, qy = G.segment_nearest(x, y, a["x"], a["y"], b["x"], b["y"])
        return F.struct(((x - qx) * (x - qx) + (y - qy) * (y - qy)).alias("d"), i.alias("i"), qx.alias("x"), qy.alias("y"))

    polygon = F.array_min(F.transform(F.sequence(F.lit(0), n - 1), edge))
    centre = F.array_min(F.transform("centres", lambda p: F.struct(G.norm(x - p["x"], y - p["y"]).alias("d"), p["k"].alias("k"), p["x"].alias("x"), p["y"].alias("y"))))
    circle = place(G.circle_nearest(x, y, centre["x"], centre["y"], c("r")))
    return _by_type(
        place(G.circle_nearest(x, y, c("cx"), c("cy"), c("r"))), place(G.rect_nearest(x, y, *(c(b) for b in BOX))), F.struct(polygon["x"].alias("x"), polygon["y"].alias("y")),
        F.when(c("centres").isNull(), F.struct(x.alias("x"), y.alias("y"))).otherwise(circle),
    )


def boundaries(points: DataFrame, held: DataFrame) -> DataFrame:
    """scene_id, idx, id, bx, by, distance: the nearest boundary point of each region of a point's scene, and its distance, negative inside.

    Every point has every region of its scene, so the result has as many rows; nothing else does."""
    x, y = F.col("x"), F.col("y")
    met = points.select("scene_id", "idx", "x", "y").join(measured(held), "scene_id").withColumn("b", _nearest(x, y)).withColumn("inside", _holds(x, y))
    d = G.norm(x - F.col("b.x"), y - F.col("b.y"))
    best = met.groupBy("scene_id", "idx", "id").agg(F.min(F.struct(d.alias("d"), F.col("node"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))).alias("m"), F.bool_or("inside").alias("inside"))
    return best.select("scene_id", "idx", "id", "m.bx", "m.by", F.when(F.col("inside"), -F.col("m.d")).otherwise(F.col("m.d")).alias("distance"))
