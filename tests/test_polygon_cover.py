"""Covers of polygons: points in them as by all pairs, few tests, no nested loops."""

import math
import random

from pyspark.sql import functions as F

from pathloom.functions import geometry as G
from pathloom.operators import polygon_cover


def star(rng, corners, size):
    cx, cy = rng.uniform(-8, 8), rng.uniform(-8, 8)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(cx + size * rng.uniform(0.3, 1) * math.cos(t), cy + size * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]


def frames(spark):
    rng = random.Random(6)
    shapes = [(s, k, star(rng, rng.choice([3, 4, 9, 30]), rng.choice([0.2, 1.5, 6]))) for s in (1, 2) for k in range(20)]
    shapes += [(1, 50, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (1, 51, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]), (2, 52, [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)])]
    points = [(s, k, rng.uniform(-10, 10), rng.uniform(-10, 10)) for s in (1, 2, 3) for k in range(400)]
    points += [(s, 1000 + 25 * a + b, float(a), float(b)) for s in (1, 2) for a in range(-2, 7) for b in range(-2, 7)]  # on corners, edges and cell borders
    polygons = spark.createDataFrame([(s, k, [{"x": x, "y": y} for x, y in v]) for s, k, v in shapes], "scene_id long, id long, vertices array<struct<x:double,y:double>>")
    return spark.createDataFrame(points, "scene_id long, idx long, x double, y double"), polygons


def test_points_in_polygons_equal_all_pairs(spark):
    points, polygons = frames(spark)
    pairs = points.join(polygons, "scene_id").filter(G.polygon_contains(F.col("x"), F.col("y"), F.col("vertices"))).select("scene_id", "idx", "id")
    want = sorted(map(tuple, pairs.collect()))
    for size, depth in ((2.0, 3), (16.0, 2), (1.0, 0)):
        found = polygon_cover.members(points, polygons, size, depth, ("scene_id",))
        assert sorted((r.scene_id, r.idx, r.id) for r in found.collect()) == want and len(want) > 300
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert polygon_cover.members(points, polygons.limit(0), keys=("scene_id",)).count() == 0


def test_inner_cells_need_no_test(spark):
    """Of a large square nearly all area lies in whole cells, and their number follows the outline."""
    square = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ((0.1, 0.1), (63.9, 0.1), (63.9, 63.9), (0.1, 63.9))])], "id long, vertices array<struct<x:double,y:double>>")
    cells = polygon_cover.cover(square, 64.0, 5).collect()
    inner = sum((64.0 / 2**c.level) ** 2 for c in cells if c.whole)
    assert len([c for c in cells if not c.whole]) == 4 * 31 and inner == (64 - 4) ** 2
