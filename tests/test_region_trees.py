"""Region descriptions of all five types, nested, against a plain evaluation; errors of unknown types and unbound sets."""

import json
import math
import random

import pytest

from pathloom.operators import region_trees as R

UNIT = {"type": "rect", "min_xy": [0, 0], "max_xy": [2, 1]}
RING = {"type": "circle", "center": [1.5, 0.5], "radius": 1}
ELL = {"type": "polygon", "vertices": [[-1, -1], [2, -1], [2, 0], [0, 0], [0, 2], [-1, 2]]}
SET = {"type": "waypoint_set", "indices": [3, 1], "radius": 0.75}
DEEP = {"type": "composite", "children": [RING, {"type": "composite", "children": [ELL, {"type": "composite", "children": [SET, UNIT]}]}]}
PLACES = {1: (4.0, 4.0), 2: (0.0, 0.0), 3: (-3.0, 1.0)}


def flat(d):
    return [x for child in d["children"] for x in flat(child)] if d["type"] == "composite" else [d]


def holds(d, x, y):
    if d["type"] == "circle":
        return math.dist((x, y), d["center"]) <= d["radius"]
    if d["type"] == "rect":
        return all(a <= v <= b for v, a, b in zip((x, y), d["min_xy"], d["max_xy"]))
    if d["type"] == "waypoint_set":
        return any(math.dist((x, y), PLACES[k]) <= d["radius"] for k in d["indices"])
    inside, v = False, d["vertices"]
    for (xi, yi), (xj, yj) in zip(v, [v[-1], *v]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            inside = not inside
    return inside


def boundary(d, x, y):
    def round_(cx, cy, r):
        n = math.dist((x, y), (cx, cy))
        return (cx + (x - cx) / n * r, cy + (y - cy) / n * r) if n > 1e-9 else (cx + r, cy)

    if d["type"] == "circle":
        return round_(*d["center"], d["radius"])
    if d["type"] == "waypoint_set":
        return round_(*min((PLACES[k] for k in d["indices"]), key=lambda p: math.dist((x, y), p)), d["radius"])
    v = d["vertices"] if d["type"] == "polygon" else [(a, b) for a, b in ((0, 0), (2, 0), (2, 1), (0, 1))]
    spots = []
    for (ax, ay), (bx, by) in zip(v, [*v[1:], v[0]]):
        t = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)
        t = min(1, max(0, t))
        spots.append((ax + t * (bx - ax), ay + t * (by - ay)))
    return min(spots, key=lambda s: math.dist(s, (x, y)))


@pytest.fixture(scope="module")
def held(spark):
    rows = [(7, k, json.dumps(d)) for k, d in enumerate((RING, UNIT, ELL, SET, DEEP, {"type": "composite", "children": []}))]
    places = spark.createDataFrame([(7, k, *p) for k, p in PLACES.items()], "scene_id long, idx long, x double, y double")
    return R.bind(R.leaves(spark.createDataFrame(rows, "scene_id long, id long, description string")), places).cache()


def test_leaves_and_metrics(held):
    kinds = sorted((r.id, tuple(r.node), r.type) for r in held.collect() if r.id >= 3)
    assert kinds == [(3, (0,), "waypoint_set"), (4, (0, 0), "circle"), (4, (0, 1, 0), "polygon"), (4, (0, 1, 1, 0), "waypoint_set"), (4, (0, 1, 1, 1), "rect")]
    got = {r.id: r for r in R.metrics(held).collect()}
    assert set(got) == {0, 1, 2, 3, 4}  # an empty composite has nothing to measure
    sizes = {0: math.pi, 1: 2.0, 2: 5.0, 3: 2 * math.pi * 0.75**2}
    assert all(got[k].area == pytest.approx(a) for k, a in sizes.items()) and got[4].area == pytest.approx(sum(sizes.values()))
    assert tuple(got[3])[3:] == (-3.75, 0.25, 4.75, 4.75) and tuple(got[4])[3:] == (-3.75, -1.0, 4.75, 4.75)


def test_points_in_and_near_trees(spark, held):
    rng = random.Random(1)
    points = [(7, k, rng.uniform(-5, 6), rng.uniform(-4, 6)) for k in range(150)] + [(7, 200, 4.0, 4.0), (7, 201, 1.5, 0.5), (8, 300, 0.0, 0.0)]
    frame = spark.createDataFrame(points, "scene_id long, idx long, x double, y double")
    shapes = {0: RING, 1: UNIT, 2: ELL, 3: SET, 4: DEEP}
    want = {(idx, k) for s, idx, x, y in points if s == 7 for k, d in shapes.items() if any(holds(leaf, x, y) for leaf in flat(d))}
    assert {(r.idx, r.id) for r in R.members(frame, held).collect()} == want
    rows = R.boundaries(frame, held).collect()
    assert len(rows) == 152 * 5
    for r in rows:
        x, y = next((x, y) for _, idx, x, y in points if idx == r.idx)
        best = min(math.dist(boundary(leaf, x, y), (x, y)) for leaf in flat(shapes[r.id]))
        assert abs(r.distance) == pytest.approx(best) and (r.distance < 0 or best == 0) == ((r.idx, r.id) in want)
        assert math.dist((r.bx, r.by), (x, y)) == pytest.approx(best)


def test_errors(spark):
    def of(d):
        return R.leaves(spark.createDataFrame([(7, 1, json.dumps(d))], "scene_id long, id long, description string"))

    for bad in ({"type": "star"}, {}, {"type": "composite", "children": [RING, {"type": "composite", "children": [{"type": "blob"}]}]}):
        with pytest.raises(Exception, match="unknown region type"):
            of(bad).collect()
    point = spark.createDataFrame([(7, 1, 0.0, 0.0)], "scene_id long, idx long, x double, y double")
    with pytest.raises(Exception, match="not bound"):
        R.members(point, of(SET)).collect()
    with pytest.raises(Exception, match="not bound"):
        R.boundaries(point, of(SET)).collect()
    with pytest.raises(Exception, match="no waypoint 3"):
        R.bind(of(SET), spark.createDataFrame([(7, 1, 0.0, 0.0)], "scene_id long, idx long, x double, y double")).collect()
    assert tuple(R.metrics(of(SET)).first())[3:] == (0.0, 0.0, 0.0, 0.0)
