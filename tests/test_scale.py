"""What joins, rounds and grids must keep when tables are large: no side that repeats its rows goes through the driver, few rounds, even tasks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.operators import folds, graph, grid, polygon_cover, spatial
from pathloom.operators.spatial import distance_join, points_in_boxes
from pathloom.plans import geometry_queries, graph_queries, grid_queries, join_queries, path_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_cell_joins_broadcast_no_repeated_rows(spark, how, tmp_path):
    spark.createDataFrame([(0, k, k * 0.7 % 5, k * 1.3 % 5) for k in range(40)], "scene_id long, idx long, x double, y double").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))  # a small file: Spark takes it for small however often its rows are repeated
    boxes = p.select("scene_id", (F.col("x") - 1).alias("min_x"), (F.col("x") + 1).alias("max_x"), (F.col("y") - 1).alias("min_y"), (F.col("y") + 1).alias("max_y"))
    near, held = distance_join(p, p, 1.0, keys=("scene_id",)), points_in_boxes(p, boxes, 1.0, how, keys=("scene_id",))
    assert "Broadcast" not in plan(near) and "Broadcast" not in plan(held)
    assert near.count() == sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1 for a in p.collect() for b in p.collect())


def test_starts_are_first_hits(spark, monkeypatch):
    """The first of all tries that hits a floor, however tries are dealt to rounds; a scene of one floor cell needs late ones."""
    bounds = spark.createDataFrame([(0, 0.0, 0.0, 9, 7), (5, 0.0, 0.0, 8, 8)], "scene_id long, low_x double, low_y double, nx int, ny int")
    floor = {0: {(4, 3)}, 5: {(i, j) for i in range(8) for j in range(8) if (i + j) % 3}}
    rows = [(s, i, j, 0) for s, own in floor.items() for i, j in own]
    monkeypatch.setattr(join_queries.Q, "bounds", lambda *_: bounds)
    monkeypatch.setattr(join_queries.Q, "grid", lambda *_: spark.createDataFrame(rows, "scene_id long, i int, j int, state int"))
    want = set()
    for s, nx, ny in ((0, 9, 7), (5, 8, 8)):
        for start in range(12):
            for t in range(200):
                k = (start * folds.WALK + t * folds.STEP + s * folds.SCENE + 42) * folds.MULTIPLIER % folds.MODULUS % (nx * ny)
                if (k // ny, k % ny) in floor[s]:
                    want.add((s, start, k // ny, k % ny))
                    break
    assert {(r.scene_id, r.start, r.i, r.j) for r in join_queries.starts(spark, "", count=12, least=0.0).collect()} == want


def counted(monkeypatch, module) -> list[int]:
    """Rows of each table that the module cuts from now on."""
    rows, own = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (out := own(df), rows.append(out.count()))[0])
    return rows


def test_scene_around_the_origin_takes_one_round(spark, monkeypatch):
    """Tiles begin at a scene's least values: a path that crosses both axes again and again lies in one tile."""
    rng = random.Random(4)
    p = [(s, k, rng.uniform(-3, 3), rng.uniform(-3, 3), 0.6) for s in range(2) for k in range(60)]
    cuts = counted(monkeypatch, folds)
    kept = {(r.scene_id, r.idx) for r in folds.greedy(spark.createDataFrame(p, "scene_id long, idx long, x double, y double, least double"), "scene_id", "idx").collect()}
    assert len(cuts) == 3  # the points, the open ones, and one round
    want = []
    for s, k, x, y, least in p:
        if all(s != t or (x - a) ** 2 + (y - b) ** 2 >= least**2 for t, _, a, b in want):
            want.append((s, k, x, y))
    assert kept == {w[:2] for w in want}


def test_covers_look_at_cells_with_points_only(spark, monkeypatch):
    square = [{"x": x, "y": y} for x, y in ((0.1, 0.1), (63.9, 0.1), (63.9, 63.9), (0.1, 63.9))]
    polygons = spark.createDataFrame([(k, square) for k in range(5)], "id long, vertices array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(0, 0.2, 30.0), (1, 30.0, 30.0), (2, 0.0, 30.0)], "idx long, x double, y double")
    cuts = counted(monkeypatch, polygon_cover)
    found = {(r.idx, r.id) for r in polygon_cover.members(points, polygons).collect()}
    assert found == {(p, k) for p in (0, 1) for k in range(5)} and sum(cuts) < 60


def test_blocked_segments_once_for_each_box(spark):
    """A pair that meets in many cells is one row; equal boxes are two, as in the SQL."""
    s = spark.createDataFrame([(1, 1, -7.0, -7.0, 9.0, 9.0), (1, 2, 9.0, 9.0, 9.0, 9.0), (2, 1, 5.0, -7.0, -7.0, 5.0)], "path_id long, seq long, x double, y double, nx double, ny double")
    b = spark.createDataFrame([(1, -4.5, -4.5, 4.5, 4.5), (1, -4.5, -4.5, 4.5, 4.5), (2, 9.0, 8.0, 10.0, 9.0), (3, 2.0, -2.0, 4.0, 0.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.path_id, r.seq, r.id) for r in geometry_queries.blocked_segments(s, b).select("path_id", "seq", "id").collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 1, 1)]


def test_grid_is_made_by_rows(spark):
    """Cells are not shuffled or sorted: runs meet rows. States as by looking at every box for every cell."""
    rng = random.Random(8)
    box = lambda s: (s, *(v for a in "xy" for v in sorted((rng.uniform(-1, 7), rng.uniform(-1, 7)))))
    names = "scene_id long, min_x double, max_x double, min_y double, max_y double"
    rooms, blocks = [box(s) for s in (0, 0, 1)] + [(1, 2.0, 2.1, 2.0, 2.1)], [box(s) for s in (0, 1, 1)]
    bounds = spark.createDataFrame([(0, -1.0, -1.0, 17, 13), (1, -1.0, -1.0, 9, 20), (2, 0.0, 0.0, 2, 2)], "scene_id long, low_x double, low_y double, nx int, ny int")
    found = grid.build(bounds, spark.createDataFrame(rooms, names), spark.createDataFrame(blocks, names), 0.5)
    assert "i#" in plan(found) and not any(", j#" in part.split(")")[0] for part in plan(found).split("hashpartitioning(")[1:])

    def covers(b, s, i, j, nx, ny, grow):
        x0, x1, y0, y1 = b[1] - grow, b[2] + grow, b[3] - grow, b[4] + grow
        at = lambda v, n: min(max(int((v + 1.0) / 0.5), 0), n - 1)
        return b[0] == s and x1 > x0 and y1 > y0 and at(x0, nx) <= i <= at(x1, nx) and at(y0, ny) <= j <= at(y1, ny)

    want = {}
    for s, nx, ny in ((0, 17, 13), (1, 9, 20), (2, 2, 2)):
        for i in range(nx):
            for j in range(ny):
                want[s, i, j] = 1 if any(covers(b, s, i, j, nx, ny, 0.25) for b in blocks) else 0 if any(covers(b, s, i, j, nx, ny, -0.15) for b in rooms) else 2
    assert {(r.scene_id, r.i, r.j): r.state for r in found.collect()} == want and set(want.values()) == {0, 1, 2}


def test_cells_of_lines_are_not_broadcast(spark, tmp_path):
    """Lines and floors have far more cells than the rows they are made of; a line is clear where all its cells are floor."""
    spark.createDataFrame([(0, k, 0, k % 5, 9, 4) for k in range(10)], "scene_id long, id long, i1 int, j1 int, i2 int, j2 int").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(0, i, j, 0 if (i, j) != (0, 1) else 1) for i in range(10) for j in range(5)], "scene_id long, i int, j int, state int").write.parquet(str(tmp_path / "g"))
    seen = grid.sight(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "g")), ("id",))
    assert "Broadcast" not in plan(seen)
    assert {r.id: r.clear for r in seen.collect()} == {k: k % 5 != 1 for k in range(10)}


def test_components_store_and_shuffle_packed_floors(spark, monkeypatch):
    """Up to 64 cells of a row are one row of what is cut and shuffled; labels as by going through the cells, past 64 too, and by rounds."""
    rng = random.Random(6)
    floor = sorted((s, i, j) for s in (0, 4) for i in range(3) for j in range(55, 75) if rng.random() < 0.6)
    want, number = {}, {0: 0, 4: 0}
    for cell in floor:
        if cell not in want:
            near, label = [cell], number[cell[0]]
            number[cell[0]] += 1
            while near:
                s, i, j = at = near.pop()
                if at not in want:
                    want[at] = label
                    near += [n for n in ((s, i + 1, j), (s, i - 1, j), (s, i, j + 1), (s, i, j - 1)) if n in floor]
    cells = spark.createDataFrame([(*cell, 0) for cell in floor], "scene_id long, i int, j int, state int")
    cuts = counted(monkeypatch, grid)
    found = grid.components(cells)
    assert cuts == [len({(s, i, j // 64) for s, i, j in floor})]
    assert "j#" not in "".join(part.split(")")[0] for part in plan(found).split("hashpartitioning(")[1:]) and "Broadcast" not in plan(found)
    assert {(r.scene_id, r.i, r.j): r.label for r in found.collect()} == want and len(set(want.values())) > 3
    monkeypatch.setattr(grid, "LARGE_CELLS", 3)
    assert {(r.scene_id, r.i, r.j): r.label for r in grid.components(cells).collect()} == want


def test_goals_of_paths_are_not_broadcast(spark, monkeypatch):
    """The file of part is small, its regions are not: paths meet their goals by a merge."""
    names = "scene_id long, source int, a long, b long, backwards boolean, path array<long>, distance double, rooms array<string>, n_rooms long, scale string"
    rows = [(0, 2, 3, 1, False, [1, 2, 5], 2.0, ["room_1"], 1, "short"), (0, 0, 3, 5, False, [3, 4, 5], 2.0, [], 0, "short")]
    monkeypatch.setattr(path_queries.N, "sampled_paths", lambda *_: spark.createDataFrame(rows, names))
    found = path_queries.paths_doc(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in plan(found)
    assert {r.source: r.goal_label for r in found.collect()} == {2: "object:3", 0: None}


SMALLEST = "/root/testdata/sf0.001"


def sent(df, run: bool = False) -> list[str]:
    """What a plan (run: as it ended) broadcasts, from the exchange down, but for what has one row a scene, and the rooms of the one floor plan (a product)."""
    parts = [part.splitlines() for part in plan(df).split("== Initial Plan ==")[0 if run else -1].split("BroadcastExchange")[1:]]
    return ["\n".join(p) for p in parts if "IdentityBroadcastMode" not in p[0] and "HashAggregate(keys=[scene_id" not in "".join(p[1:3])]


def test_candidates_are_not_broadcast(spark):
    """Waypoints, lines, walks, regions and paths meet by merges; only what has one row a scene is sent to all."""
    assert not sent(graph_queries.sample_vln_paths(spark, SMALLEST))
    assert not sent(graph_queries.seen_edges(spark, SMALLEST))


def two_scenes(spark):
    """Labelled floors of 5 x 4 and 3 x 3 cells, one cell of the first is missing, and questions between their corners."""
    cells = [(s, i, j, 0) for s, ni, nj in ((0, 5, 4), (1, 3, 3)) for i in range(ni) for j in range(nj) if (s, i, j) != (0, 2, 1)]
    asked = [(s, q, 0, 0, i, j) for s, q, i, j in ((0, 7, 4, 1), (1, 8, 2, 2), (1, 9, 0, 0))]
    return spark.createDataFrame(cells, "scene_id long, i int, j int, label int"), spark.createDataFrame(asked, "scene_id long, q long, i1 int, j1 int, i2 int, j2 int")


def test_searches_take_all_tasks(spark):
    """Packed floors have few bytes: groups are dealt to as many tasks as the session shuffles to, with paths as before."""
    labelled, asked = two_scenes(spark)
    found = grid.grid_paths(asked, labelled, 0.5, with_path=True)
    ends = spark.createDataFrame([(s, "both", i, 0, i, 0) for s, n in ((0, 5), (1, 3)) for i in range(n)], "scene_id long, role string, id long, pt int, i int, j int")
    pairs = grid.nearest_pairs(ends, labelled, 0.5)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.rdd.getNumPartitions() == pairs.rdd.getNumPartitions() == parts > 1
    assert {r.q: (round(r.distance, 6), [tuple(c) for c in r.path]) for r in found.collect()} == {
        7: (2.207107, [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)]), 8: (1.414214, [(0, 0), (1, 1), (2, 2)]), 9: (0.0, [(0, 0)])}
    assert {(r.scene_id, r.from_id, r.to_id): r.length for r in pairs.collect()} == {(s, a, b): abs(a - b) * 0.5 for s, n in ((0, 5), (1, 3)) for a in range(n) for b in range(n)}


def test_questions_are_not_broadcast(spark, monkeypatch):
    """Places of waypoints and their labels meet by merges, however few they turn out to be."""
    asked, own = [], grid.cut
    monkeypatch.setattr(grid, "cut", lambda df: (asked.append(df), own(df))[1])
    assert grid_queries.astar_path(spark, SMALLEST).count()
    questions = next(df for df in asked if "q" in df.columns)
    assert questions.collect() and not sent(questions, run=True)


def test_walks_and_their_lengths_take_all_tasks(spark):
    """Groups of a scene's edges are dealt likewise; a walk's length needs distances only, so no paths are made for it."""
    points = spark.createDataFrame([(s, k, f"room_{k}" if k % 2 else None) for s in (0, 3) for k in range(4)], "scene_id long, idx long, room string")
    web = graph.both_ways(spark.createDataFrame([(s, k, k + 1, 1.5) for s in (0, 3) for k in range(3)], "scene_id long, i long, j long, d double"))
    pairs, walks = graph.all_pairs(points.select("scene_id", "idx"), web, paths=False), folds.walks(web.select("scene_id", "i", "j"), points, 42)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pairs.rdd.getNumPartitions() == walks.rdd.getNumPartitions() == parts > 1
    lengths = graph_queries._walk_lengths(walks, pairs)
    assert {(r.scene_id, r.walk): r.distance for r in lengths.collect()} == {(r.scene_id, r.walk): 1.5 * (len(r.path) - 1) for r in walks.collect()}
    shown = plan(graph_queries.walk_distance(spark, SMALLEST)).split("== Initial Plan ==")[-1]
    assert "path array<bigint>" not in shown and shown.count("FlatMapCoGroupsInArrow") == shown.count("FlatMapCoGroupsInPandas") == 1
    assert not sent(graph_queries.walk_distance(spark, SMALLEST))


def test_small_groups_are_handed_over_together(spark):
    """Many rooms take one hand-over, not one each; groups that end within a batch, at its end or beyond it stay whole."""
    rng = random.Random(3)
    sizes = [rng.randint(1, 12) for _ in range(40)]
    rows = [(g, k // 4, k % 4, k // 4 * 0.5, k % 4 * 0.5, 1.0, 1 + g % 3) for g, n in enumerate(sizes) for k in range(n)]
    cells = spark.createDataFrame(rows, "g long, i int, j int, x double, y double, weight double, most int").repartition(3)
    want = set()
    for g, n in enumerate(sizes):
        own, held = [r for r in rows if r[0] == g], []
        for k in np.random.default_rng(42).permutation(n):
            if len(held) < 1 + g % 3 and all(math.dist(own[k][3:5], o[3:5]) >= 0.9 for o in held):
                held.append(own[k])
        want |= {r[:3] for r in held}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = folds.weighted_cells(cells, "g", 0.9, None, 42, tries=None)
        assert "FlatMapGroups" not in plan(found) and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {(r.g, r.i, r.j) for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_groups_stay_whole_after_a_join_by_their_keys(spark):
    """A join that deals rows by the same keys may become one that deals nothing: groups are dealt all the same."""
    rows = spark.createDataFrame([(k % 5, k) for k in range(60)], "k long, o long").repartition(4)
    few = spark.createDataFrame([(k,) for k in range(5)], "k long")
    both = rows.join(few, "k", "left_semi").unionByName(rows.join(few, "k", "left_semi"))

    def run(batches):
        for table, ends in folds.whole_groups(batches, ["k"]):
            yield pa.RecordBatch.from_arrays([pa.array(ends[1:] - ends[:-1])], ["n"])

    assert [r.n for r in folds.by_groups(both, ["k"], ["o"]).mapInArrow(run, "n long").collect()] == [24] * 5


def test_path_lines_in_one_pass(spark, monkeypatch):
    """Ways become points, lengths and rooms in one hand-over, as by the windows of resampled() and by looking at every room for every point."""
    rng = random.Random(5)
    ways = []
    for q in range(30):
        at = (rng.randint(0, 20), rng.randint(0, 20))
        path = [at]
        for _ in range(rng.randint(1, 25)):
            at = (at[0] + rng.choice((-1, 0, 1)), at[1] + 1)
            path.append(at)
        ways.append((q % 2, q % 3, q, path))
    boxes = [(s, r, rng.uniform(-2, 4), rng.uniform(-2, 8)) for s in (0, 1) for r in range(6)]
    rooms = [(s, b, r, x, y, x + 4.0, y + 5.0, 2.0 if r == 1 else 0.0, 3.0, -2.0, -2.0) for s, r, x, y in boxes for b in range(3)]
    paths = spark.createDataFrame([(s, b, q, [{"i": i, "j": j} for i, j in p]) for s, b, q, p in ways], "scene_id long, block long, q long, path array<struct<i:int,j:int>>")
    held = spark.createDataFrame(rooms, "scene_id long, block long, room_id int, min_x double, min_y double, max_x double, max_y double, min_z double, max_z double, low_x double, low_y double")
    vertices = [(q, k + 1, -2 + (i + 0.5) * 0.5, -2 + (j + 0.5) * 0.5, 1.5) for _, _, q, p in ways for k, (i, j) in enumerate(p)]
    t = spark.createDataFrame(vertices, "path_id long, seq long, x double, y double, z double")
    want = {}
    for r in path_queries.resampled(t, 1.5).collect():
        want.setdefault(r.path_id, []).append((r.k, r.x, r.y, r.z))
    length = {r.path_id: r.d for r in path_queries.stepped(t).groupBy("path_id").agg(F.sum("d").alias("d")).collect()}
    for most in (graph.HELD_VERTICES, 40):
        monkeypatch.setattr(graph, "HELD_VERTICES", most)
        found = graph.lines(paths, held, 0.5, 1.5, 1.5, ("q",))
        assert "Window" not in plan(found)
        got = {r.q: r for r in found.collect()}
        assert len(got) == len(ways)
        for s, _, q, _ in ways:
            assert [tuple(p) for p in got[q].line] == sorted(want[q]) and got[q].distance == length[q]
            first = [min((r[2] for r in rooms if r[0] == s and r[3] <= x <= r[5] and r[4] <= y <= r[6] and r[7] <= 1.5), default=None) for _, x, y, _ in want[q]]
            assert got[q].n_rooms == len({r for r in first if r is not None})


def test_region_paths_make_the_floor_once(spark, monkeypatch):
    """Starts, targets and searches read one labelled floor, and starts take no rounds."""
    made, own = [], grid_queries.grid
    monkeypatch.setattr(grid_queries, "grid", lambda *a: (made.append(a), own(*a))[1])
    found = path_queries.gr_paths(spark, SMALLEST)
    assert len(made) == 1 and "InPandas" not in plan(found).split("== Initial Plan ==")[-1].split("FlatMapGroupsInArrow")[0]
    cuts, own_cut = [], join_queries.cut
    monkeypatch.setattr(join_queries, "cut", lambda df: (cuts.append(df), own_cut(df))[1])
    assert join_queries.starts(spark, SMALLEST).count() and not cuts


def test_circles_are_not_repeated(spark):
    """Points of all sizes of circles, on their edges too; a circle is one row until it meets its points."""
    rng = random.Random(9)
    circles = [(k, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([0.0, 0.01, 0.5, 1.0, 1.3, 2.0, 5.0])) for k in range(60)] + [(60, 0.5, 0.5, -1.0), (61, 0.0, 0.0, 2.0), (62, 0.0, 0.0, 2.0)]
    points = [(k, rng.uniform(-4, 4), rng.uniform(-4, 4)) for k in range(150)] + [(200 + k, *circles[k][1:3]) for k in range(20)] + [(300, 2.0, 0.0), (301, -2.0, 0.0), (302, 0.0, -2.0)]
    found = spatial.points_in_circles(spark.createDataFrame(points, "idx long, x double, y double"), spark.createDataFrame(circles, "id long, cx double, cy double, r double"))
    node = found._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "Generate" not in node.left().toString() and "Generate" in node.right().toString()
    want = sorted((p, k) for p, x, y in points for k, cx, cy, r in circles if math.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= r)
    assert sorted((r.idx, r.id) for r in found.collect()) == want and {(300, 61), (301, 62), (302, 61)} < set(want)


def test_equal_boxes_are_judged_once(spark, monkeypatch):
    """Boxes that lie in the same place meet a segment as one row and come apart in the result, in parts of few."""
    monkeypatch.setattr(geometry_queries, "EQUAL_BOXES", 3)
    rng = random.Random(4)
    places = [(x, y, x + rng.uniform(0, 3), y + rng.uniform(0, 3)) for x, y in ((rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(12))]
    boxes = [(k, *places[k * k % 12]) for k in range(50)]
    ends = [(1, k, *(rng.uniform(-7, 7) for _ in range(4))) for k in range(40)]
    names = "path_id long, seq long, x double, y double, nx double, ny double"
    b = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    found = geometry_queries.blocked_segments(spark.createDataFrame(ends, names), b)
    node = found._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "Aggregate [x0" in node.right().toString() and "Broadcast" not in plan(found)
    every = spark.createDataFrame([(*e, *v) for e in ends for v in boxes], names + ", id long, x0 double, y0 double, x1 double, y1 double")
    want = every.filter(geometry_queries.G.segment_hits_box(*(F.col(n) for n in ("x", "y", "nx", "ny", "x0", "y0", "x1", "y1")))).select("seq", "id")
    assert sorted((r.seq, r.id) for r in found.select("seq", "id").collect()) == sorted((r.seq, r.id) for r in want.collect()) and want.count() > 100
    named = geometry_queries.blocked_segments(spark.createDataFrame(ends, names), b.withColumn("kind", F.col("id") % 3))
    assert sorted((r.seq, r.id, r.kind) for r in named.collect()) == sorted((r.seq, r.id, r.id % 3) for r in want.collect())
