"""Hand-computed cases and properties of the scene and path operators."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import tags as T
from pathloom.operators import folds, graph, grid, regions, search, spline, tiles
from pathloom.operators.scene import resolve_rooms
from pathloom.operators.spatial import distance_join, points_in_boxes
from pathloom.plans import path_queries, scene_queries
from pathloom.plans.path_queries import resampled
from pathloom.sources import scene, sinks

DOCUMENT = """{"objs": {
 "kitchen_0/0": {"active": true, "tags": ["Semantics(room)", "Semantics(kitchen)"]},
 "door_1": {"active": 1, "tags": ["Semantics(cutter)", "Semantics(door)"], "relations": [{"target_name": "kitchen_0/0", "relation": {"relation_type": "CutFrom"}}, {"target_name": "b", "relation": {"relation_type": "CutFrom"}}]},
 "table_1": {"active": true, "obj": "a-b/c.d(e).meshed", "tags": ["Semantics(object)", "Semantics(furniture)", "-Semantics(door)", " oops "], "relations": [{"target_name": "x", "relation": {"relation_type": "Touching"}}, {"target_name": "kitchen_0/0", "relation": {"relation_type": "StableAgainst", "margin": 0.5}}]},
 "lamp_off": {"active": false, "tags": ["Semantics(object)"]}, "none": {"tags": []}}}"""


def test_scan(spark):
    docs = spark.createDataFrame([("s", DOCUMENT), ("t", "{}"), ("u", None), ("v", "not json")], "scene_id string, value string")
    rows = {r.id: r for r in scene.scan_states(docs).collect()}
    assert list(rows) == ["kitchen_0/0", "door_1", "table_1"]
    assert [r.state_type for r in rows.values()] == ["room", "cutter", "object"] and rows["table_1"].sem == ["object", "furniture", "-door"]
    named = scene.scan_states(docs).select("id", scene.parent_id(F.col("relations")).alias("p"), T.prim_name(F.col("obj")).alias("n"), T.prim_base(F.col("obj")).alias("b"))
    table = {r.id: r for r in named.collect()}["table_1"]
    assert (table.p, table.n, table.b) == ("kitchen_0/0", "a_b_c_d_e_", "a_b_c_d(e)")
    kinds = {(r.src_id, r.rel_ord): r for r in scene.relation_rows(scene.scan_states(docs)).collect()}
    assert kinds["table_1", 1].margin == 0.5 and kinds["table_1", 0].margin is None and kinds["door_1", 1].target_name == "b"


def test_state_path(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert scene.resolve_state_path(str(tmp_path / "a" / "b")) is None
    (tmp_path / "solve_state.json").write_text("{}")
    assert scene.resolve_state_path(str(tmp_path / "a")) == str(tmp_path / "solve_state.json")


def test_rooms_end_on_cycles_and_dangling_parents(spark):
    chain = [(i, i - 1, False) for i in range(2, 40)] + [(1, 7, True), (50, 51, False), (51, 50, False), (60, 99, False), (61, 60, False), (70, 70, False)]
    got = {r.id: r.room for r in resolve_rooms(spark.createDataFrame(chain, "id long, parent long, parent_is_room boolean")).collect()}
    assert got == {i: 7 for i in range(1, 40)}


def test_joins_against_all_pairs(spark):
    rng = random.Random(5)
    p = [(k, rng.uniform(-3, 3), rng.uniform(-3, 3)) for k in range(120)] + [(200, 0.0, 0.0), (201, 1.0, 0.0), (202, -1.0, 0.0)]
    frame = spark.createDataFrame(p, "idx long, x double, y double")
    got = sorted((r.idx_a, r.idx_b) for r in distance_join(frame, frame, 1.0).collect())
    assert got == sorted((a[0], b[0]) for a in p for b in p if math.dist(a[1:], b[1:]) <= 1.0)
    boxes = [(k, x, y, x + rng.uniform(0, 2), y + rng.uniform(0, 2)) for k, x, y in p[:30]]
    found = points_in_boxes(frame, spark.createDataFrame(boxes, "id long, min_x double, min_y double, max_x double, max_y double"), 0.7)
    assert sorted((r.idx, r.id) for r in found.collect()) == sorted((k, b[0]) for k, x, y in p for b in boxes if b[1] <= x <= b[3] and b[2] <= y <= b[4])


ROWS = ["..#...", ".##.#.", "#..##.", "...#.."]


def floor_of(spark, scenes=(0, 5)):
    cells = [(s, i, j, 0 if x == "." else 1) for s in scenes for i, line in enumerate(ROWS) for j, x in enumerate(line)]
    return spark.createDataFrame(cells, "scene_id long, i int, j int, state int")


@pytest.mark.parametrize("large", [10**6, 3])
def test_components(spark, monkeypatch, large):
    """In one task a scene, and by rounds (every scene counts as large)."""
    monkeypatch.setattr(grid, "LARGE_CELLS", large)
    for s in (0, 5):
        label = {(r.i, r.j): r.label for r in grid.components(floor_of(spark)).filter(f"scene_id = {s}").collect()}
        assert label[0, 0] == label[1, 0] == label[0, 1] == 0 and label[0, 3] == label[3, 5] == 1 and label[3, 0] == label[2, 1] == 2
        assert len(label) == sum(r.count(".") for r in ROWS) and set(label.values()) == {0, 1, 2}


@pytest.mark.parametrize(("held", "side"), [(10**6, 512), (30, 512), (1, 3)])
def test_grid_paths_against_dijkstra(spark, monkeypatch, held, side):
    """In one block, in many, and by tiles (every scene counts as large)."""
    monkeypatch.setattr(search, "HELD_DISTANCES", held)
    monkeypatch.setattr(tiles, "SIDE", side)
    frame = floor_of(spark)
    labelled = grid.components(frame)
    label = {(r.i, r.j): r.label for r in labelled.filter("scene_id = 5").collect()}
    every = sorted(label)
    ask = spark.createDataFrame([(5, a * 100 + b, *every[a], *every[b]) for a in range(len(every)) for b in range(len(every))], "scene_id long, q long, i1 int, j1 int, i2 int, j2 int")
    got = {r.q: r for r in grid.grid_paths(ask, labelled, 2.0, with_path=True).collect()}

    def plain(source):
        best, queue = {source: 0.0}, [(0.0, source)]
        while queue:
            d, at = heapq.heappop(queue)
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    to = (at[0] + di, at[1] + dj)
                    if to in label and d + math.hypot(di, dj) < best.get(to, math.inf) - 1e-12:
                        best[to] = d + math.hypot(di, dj)
                        heapq.heappush(queue, (best[to], to))
        return best

    for a, source in enumerate(every):
        best = plain(source)
        for b, goal in enumerate(every):
            if label[source] != label[goal]:
                assert a * 100 + b not in got  # also where two floors touch at a corner: (1, 0) and (2, 1)
                continue
            r = got[a * 100 + b]
            assert r.distance == pytest.approx(2 * best[goal])
            path = [(p.i, p.j) for p in r.path]
            assert path[0] == source and path[-1] == goal and all(p in label for p in path)
            assert sum(math.dist(p, q) for p, q in zip(path, path[1:])) * 2 == pytest.approx(r.distance)
            assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(path, path[1:]))
    assert label[1, 0] != label[2, 1]
    near = {r.q for r in grid.grid_paths(ask, labelled, 2.0, most=4.0).collect()}
    assert near == {q for q, r in got.items() if r.distance <= 4.0}
    empty = grid.grid_paths(ask.filter("false"), labelled, 1.0)
    assert empty.count() == 0


def test_nearest_pairs(spark, monkeypatch):
    labelled = grid.components(floor_of(spark))
    ends = [(5, "both", 1, 0, 0, 0), (5, "both", 1, 1, 0, 1), (5, "both", 2, 0, 0, 5), (5, "both", 2, 1, 1, 0), (5, "both", 3, 0, 3, 0), (5, "both", 4, 0, 0, 2)]
    frame = spark.createDataFrame(ends, "scene_id long, role string, id long, pt int, i int, j int")
    for held, side in ((10**6, 512), (30, 512), (1, 4)):
        monkeypatch.setattr(search, "HELD_DISTANCES", held)
        monkeypatch.setattr(tiles, "SIDE", side)
        got = {(r.from_id, r.to_id): (r.pt_from, r.pt_to, r.length) for r in grid.nearest_pairs(frame, labelled, 1.0).collect()}
        assert got == {(1, 1): (0, 0, 0.0), (2, 2): (0, 0, 0.0), (3, 3): (0, 0, 0.0), (1, 2): (0, 1, 1.0), (2, 1): (1, 0, 1.0)}


def plain_ways(n, step):
    """Whole-number distances and least predecessors by relaxing every edge until nothing changes."""
    units = {e: max(1, round(d * graph.UNITS)) for e, d in step.items()}
    out = {}
    for i in range(n):
        dist = {i: 0}
        while True:
            better = {b: dist[a] + w for (a, b), w in units.items() if a in dist and dist[a] + w < dist.get(b, math.inf)}
            if not better:
                break
            for b in better:
                dist[b] = min(dist[a] + w for (a, k), w in units.items() if k == b and a in dist)
        for j in dist:
            pred, path = {}, [j]
            while path[-1] != i:
                path.append(min(a for (a, b), w in units.items() if b == path[-1] and a in dist and dist[a] + w == dist[b]))
            out[i, j] = (dist[j] / graph.UNITS, path[1] if i != j else None, path[::-1])
    return out


@pytest.mark.parametrize("held", [10**6, 5])
def test_all_pairs_against_plain_relaxing(spark, monkeypatch, held):
    """A unit grid (many equal ways), random points, points at one place, and waypoints without edges; in one block and in many."""
    monkeypatch.setattr(graph, "HELD_SUMS", held)
    rng = np.random.default_rng(3)
    scenes = {1: [(k // 4, k % 4) for k in range(16)], 2: rng.uniform(0, 5, (18, 2)).tolist(), 3: [(0, 0), (0, 0), (0, 0), (1, 0)], 4: [(0, 0), (9, 9)]}
    steps = {s: {(i, j): float(math.dist(p, q)) for i, p in enumerate(xy) for j, q in enumerate(xy) if i != j and math.dist(p, q) < 1.3} for s, xy in scenes.items()}
    points = spark.createDataFrame([(s, i) for s, xy in scenes.items() for i in range(len(xy))], "scene_id long, idx long")
    web = spark.createDataFrame([(s, i, j, d) for s, step in steps.items() for (i, j), d in step.items()], "scene_id long, i long, j long, d double")
    rows = graph.all_pairs(points, web, held_pairs=held).collect()
    got = {(r.scene_id, r.i, r.j): (r.dist, r.pred, r.path) for r in rows}
    assert len(got) == len(rows) and got == {(s, *e): w for s, xy in scenes.items() for e, w in plain_ways(len(xy), steps[s]).items()}
    short = {(r.scene_id, r.i, r.j): (r.dist, r.pred) for r in graph.all_pairs(points, web, paths=False, held_pairs=held).collect()}
    assert short == {k: v[:2] for k, v in got.items()}


def test_all_pairs_of_nothing(spark):
    assert graph.all_pairs(spark.createDataFrame([], "scene_id long, idx long"), spark.createDataFrame([], "scene_id long, i long, j long, d double")).count() == 0


@pytest.mark.parametrize(("axes", "tile"), [(("x", "y"), None), (("x", "y", "z"), 9.0)])
def test_greedy_in_rounds_equals_one_pass(spark, axes, tile):
    """Random and path-like order, distances of their own, points on tile borders, repeated points; one tile and many."""
    rng = np.random.default_rng(11)
    rows = [(1, k, *rng.uniform(-6, 6, 3).tolist(), float(rng.choice([0.4, 0.7, 1.2]))) for k in range(300)]
    rows += [(2, k, k * 0.13, math.sin(k / 9), 0.0, 0.5) for k in range(200)] + [(3, k, 2.6 * (k % 3), 1.3 * (k % 4), 0.0, 1.3) for k in range(40)] + [(4, 0, 0.0, 0.0, 0.0, 0.0), (4, 1, 0.0, 0.0, 0.0, 0.0)]
    want = set()
    for scene in (1, 2, 3, 4):
        held = []
        for _, k, *xyz, least in (r for r in rows if r[0] == scene):
            if all(math.dist(xyz[: len(axes)], o) >= least for o in held):
                held.append(xyz[: len(axes)])
                want.add((scene, k))
    frame = spark.createDataFrame(rows, "scene_id long, idx long, x double, y double, z double, least double").repartition(5)
    got = folds.greedy(frame, "scene_id", "idx", axes, tile)
    assert got.columns == frame.columns and sorted((r.scene_id, r.idx) for r in got.collect()) == sorted(want)
    assert folds.greedy(frame.limit(0), "scene_id", "idx").count() == 0


def test_walks(spark):
    links = [(1, a, b) for a in range(6) for b in range(6) if abs(a - b) in (1, 2)]
    rooms = [(1, k, None if k == 3 else f"room_{k // 2}") for k in range(7)]
    frames = spark.createDataFrame(links, "scene_id long, i long, j long"), spark.createDataFrame(rooms, "scene_id long, idx long, room string")
    got = folds.walks(*frames, 42).collect()
    assert got == folds.walks(*frames, 42).collect() and 0 < len(got) <= 14
    for r in got:
        assert 3 <= len(r.path) <= 31 and all((1, a, b) in links for a, b in zip(r.path, r.path[1:]))
        assert all(a != b for a, b in zip(r.path, r.path[2:]))  # never straight back


def test_samplers_keep_their_rules(spark):
    """Distance, place and number of what the seeded samplers without SQL return."""
    sf = "/root/testdata/sf0.001"
    queries = path_queries.QUERIES
    far = lambda rows, key, least: all(math.dist((a.x, a.y), (b.x, b.y)) >= least - 1e-9 for k, a in enumerate(rows) for b in rows[:k] if key(a) == key(b))
    for name in ("sample_poisson_grid", "sample_in_rect"):
        rows = queries[name](spark, sf).collect()
        assert rows and far(rows, lambda r: r.scene_id, 1.0)
        assert rows == queries[name](spark, sf).collect()
    assert all(-6 <= r.x <= 6 and -6 <= r.y <= 6 for r in rows)
    free = {(r.scene_id, r.i, r.j) for r in path_queries.Q.grid(spark, sf).filter("state = 0").collect()}
    assert all((r.scene_id, r.i, r.j) in free for r in rows)
    placed = queries["place_waypoints"](spark, sf).collect()
    kinds = {r.kind for r in placed}
    assert kinds == {0, 1, 2} and far([r for r in placed if r.kind == 0], lambda r: r.scene_id, 1.5) and far(placed, lambda r: r.scene_id, 0.9)
    drawn = queries["random_points"](spark, sf).collect()
    assert {(r.room, r.draw) for r in drawn} == {(k, n) for k in {r.room for r in drawn} for n in range(100)}
    chosen = queries["sample_paths"](spark, sf).collect()
    assert len({r.path_id for r in chosen}) == len(chosen) <= 20 and chosen == queries["sample_paths"](spark, sf).collect()
    ways = queries["sample_vln_paths_gr"](spark, sf).collect()
    classes = {}
    for r in ways:
        assert r.scale == ("short" if r.n_rooms <= 1 else "medium" if r.n_rooms <= 3 else "long") and (not r.backwards or r.n_points >= 4)
        if not r.backwards:
            classes[r.scene_id, r.scale] = classes.get((r.scene_id, r.scale), 0) + 1
    assert all(n <= {"short": 30, "medium": 40, "long": 20}[k] for (_, k), n in classes.items())
    goals = scene_queries.QUERIES["object_nav_points"](spark, sf).collect()
    around = [r for r in goals if r.goal_kind == "around"]
    assert {r.goal_kind for r in goals} >= {"center", "around"} and far(around, lambda r: r.id, 0.2) and all(r.z == 0.02 and r.pt < 8 for r in around)


def test_regions():
    assert regions.deserialize({"type": "circle", "cx": 1, "cy": 2, "radius": 3}) == regions.Circle(1, 2, 3)
    with pytest.raises(ValueError):
        regions.deserialize({"type": "star"})
    with pytest.raises(TypeError):
        regions.GoalRegion()


def test_region_columns(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.9, 0.2), (2, 3.0, 0.0)], "idx long, x double, y double")
    for r, inside, distance in ((regions.Circle(0, 0, 1), {0, 1}, 2.0), (regions.Rect(-1, -1, 1, 1), {0, 1}, 2.0)):
        assert {x.idx for x in r.members(p).collect()} == inside
        rows = {x.idx: x for x in p.select("idx", r.distance_to(F.col("x"), F.col("y")).alias("d"), r.area().alias("a")).collect()}
        assert rows[2].d == pytest.approx(distance) and rows[0].d == pytest.approx(-1.0) and rows[0].a == pytest.approx(math.pi if r.__class__ is regions.Circle else 4.0)


def test_sensors(spark, tmp_path):
    plan = spark.createDataFrame([(p, f, 0.5 * f) for p in range(4) for f in range(3)], "path_id long, frame long, x double")
    config = sinks.CaptureConfig(rgb_mode=True, depth_mode=True, max_capture_paths=2)
    for _ in range(2):  # overwrites
        sinks.capture(plan, str(tmp_path), config)
    rows = spark.read.json(str(tmp_path / "camera")).collect()
    assert len(rows) == 2 * 3 * 2 and {r.file for r in rows if r.mode == "depth"} == {"depth_0.npy", "depth_1.npy", "depth_2.npy"}
    assert sinks.chosen_paths(plan, sinks.CaptureConfig()).count() == 12 and sinks.Camera(sinks.CaptureConfig()).frames(plan).count() == 0


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(DOCUMENT)
    (tmp_path / "two.json").write_text('{"objs": {}}')
    rows = scene.scan_states(scene.read_documents(spark, str(tmp_path))).collect()
    assert [r.id for r in rows] == ["kitchen_0/0", "door_1", "table_1"] and rows[0].scene_id.endswith("one.json")


def test_frames_count_before_they_drop(spark):
    """Three vertices, two of them equal, give one frame; two vertices none; longer paths are smoothed."""
    rows = [(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0), (1, 3, 1.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (2, 2, 1.0, 0.0, 0.0)]
    rows += [(3, k, float(k), float(k % 2), 0.0) for k in range(12)]
    t = spark.createDataFrame(rows, "path_id long, seq long, x double, y double, z double")
    frames = path_queries.planned_frames(t).orderBy("path_id", "frame").collect()
    assert [(r.path_id, r.frame) for r in frames] == [(1, 0)] + [(3, k) for k in range(11)]
    assert (frames[0].x, frames[0].tx, frames[0].z, frames[0].tz) == (0.0, 1.0, 1.5, 1.5)
    want = spline.curve(np.array([r[2:] for r in rows if r[0] == 3]))
    assert np.allclose([(r.x, r.y) for r in frames[1:]], want[:-1, :2]) and not np.allclose(want, [r[2:] for r in rows if r[0] == 3])


def test_folds(spark):
    rng = random.Random(2)
    p = [(s, k, rng.uniform(0, 4), rng.uniform(0, 4), 0.7) for s in range(3) for k in range(80)]
    kept = folds.greedy(spark.createDataFrame(p, "scene_id long, idx long, x double, y double, least double"), "scene_id", "idx").collect()
    for s in range(3):
        xy = [(r.x, r.y) for r in kept if r.scene_id == s]
        assert all(math.dist(a, b) >= 0.7 for k, a in enumerate(xy) for b in xy[:k])
        assert all(any(math.dist(a[2:4], b) < 0.7 for b in xy) for a in p if a[0] == s)
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 2.0, 2.0)], "room_id long, min_x double, min_y double, max_x double, max_y double")
    got = folds.darts(boxes, "room_id", 0.4, 8).collect()
    one, two = ([(r.x, r.y) for r in got if r.room_id == k] for k in (1, 2))
    assert one == two and one[0] == tuple(np.random.default_rng(42).uniform([0, 0], [2, 2]))
    c = spark.createDataFrame([(0, k, 9.0 - k, [k, k + 1], 6) for k in range(9)], "scene_id long, k int, score double, marks array<int>, target int")
    assert folds.novelty(c, ["scene_id"], ["k"], 0.9, free=2).count() == 5 and folds.novelty(c, ["scene_id"], ["k"], 0.5, free=2).count() == 6


def test_polylines(spark):
    line = [(1, k, float(k * k % 7), float(k), 0.0) for k in range(1, 12)] + [(2, 1, 0.0, 0.0, 0.0), (2, 2, 0.0, 0.0, 0.0), (3, 1, 5.0, 5.0, 5.0)]
    t = spark.createDataFrame(line, "path_id long, seq long, x double, y double, z double")
    r = sorted((x.k, x.x, x.y) for x in resampled(t, 1.0).filter("path_id = 1").collect())
    assert [k for k, _, _ in r] == list(range(len(r))) and r[0][1:] == line[0][2:4] and r[-1][1:] == line[10][2:4]
    s = sorted((x.seq, x.x, x.y) for x in folds.smooth(t).filter("path_id = 1").collect())
    assert len(s) == 11 and s[0][1:] == line[0][2:4] and s[-1][1:] == line[10][2:4] and s != [x[1:4] for x in line[:11]]
    assert folds.smooth(t).filter("path_id > 1").count() == 3


def test_writers(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a: b"), (1, "c: d"), (2, "e: f")], "path_id long, line string")
    for _ in range(2):
        scene.write_lines(lines, str(tmp_path / "meta"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "meta")).collect()) == ["a: b", "c: d", "e: f"]
    scene.write_documents(lines, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 3


def test_fallback_connectivity_reaches_as_far_as_its_threshold(spark):
    """Every pair in sight and at most 5 apart in space, those more than 3 apart on the floor included."""
    sf, q = "/root/testdata/sf0.001", path_queries.Q
    free = {(r.scene_id, r.i, r.j) for r in q.grid(spark, sf).filter("state = 0").collect()}
    points = path_queries.view(spark, sf, "v_waypoints").join(q.in_cells(spark, sf), ["scene_id", "idx"]).collect()
    near = [(a, b) for a in points for b in points if a.scene_id == b.scene_id and a.idx < b.idx and math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) <= 5]
    lines = spark.createDataFrame([(a.scene_id, a.idx, b.idx, a.i, a.j, b.i, b.j) for a, b in near], "s long, a long, b long, i1 int, j1 int, i2 int, j2 int")
    seen = lines.select("s", "a", "b", grid.bresenham(*(F.col(n) for n in ("i1", "j1", "i2", "j2"))).alias("line")).collect()
    want = {p for r in seen if all((r.s, cell.i, cell.j) in free for cell in r.line) for p in ((r.a, r.b), (r.b, r.a))}
    at = {r.idx: (r.x, r.y) for r in points}
    assert any(math.dist(at[a], at[b]) > 3 for a, b in want)
    found = [(r.i, r.j) for r in path_queries.J.fallback_connectivity(spark, sf).collect()]
    assert len(found) == len(set(found)) and set(found) == want
