"""Queries over spatial joins within scenes: neighbours, rooms, regions, free places around objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import folds as FO
from pathloom.operators import graph as GR
from pathloom.operators import grid as GD
from pathloom.operators import scene as S
from pathloom.operators.scene import cut
from pathloom.operators.spatial import distance_join, first_box, points_in_boxes
from pathloom.plans import graph_queries as N
from pathloom.plans import grid_queries as Q
from pathloom.plans.duck import sql
from pathloom.sources.views import view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, ctes)
        return f

    return add


c = F.col
SPACE = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
INSIDE = "r.scene_id=p.scene_id AND p.x BETWEEN r.min_x AND r.max_x AND p.y BETWEEN r.min_y AND r.max_y"
INSIDE_3D = INSIDE + " AND p.z BETWEEN r.min_z-5e-1 AND r.max_z+1e0"


def points(spark, sf_dir):
    return view(spark, sf_dir, "v_waypoints").select("scene_id", "idx", "x", "y", "z")


@query(f"SELECT a.idx AS i, b.idx AS j, {SPACE} AS d FROM v_waypoints a JOIN v_waypoints b ON a.idx<b.idx AND a.scene_id=b.scene_id AND {SPACE} <= 5e0 JOIN near p ON p.key=a.idx JOIN near q ON q.key=b.idx JOIN labels x ON x.s=p.s AND x.i=p.fi AND x.j=p.fj JOIN labels y ON y.s=q.s AND y.i=q.fi AND y.j=q.fj AND x.label=y.label", Q.LABELS + ", " + Q.PC + ", " + Q._near_sql("SELECT s, idx AS key, i, j FROM pc"))
def build_connectivity(spark, sf_dir):
    """Pairs of a scene at most 5 apart in space whose nearest places lie on one island."""
    island = Q.snap_to_grid(spark, sf_dir).select("idx", "island")
    p = points(spark, sf_dir).join(island, "idx")
    return GR.edges(p, 5.0, ("x", "y", "z"), ("scene_id", "island")).select("i", "j", "d")


@query(f"SELECT a.idx AS id, string_agg(CAST(b.idx AS VARCHAR), ',' ORDER BY b.idx) AS neighbours FROM v_waypoints a JOIN v_waypoints b ON a.idx<>b.idx AND a.scene_id=b.scene_id AND {SPACE} <= 5e0 GROUP BY a.idx")
def viewpoint_graph(spark, sf_dir):
    """The neighbours of each viewpoint at most 5 away in space, in order."""
    near = GR.both_ways(GR.edges(points(spark, sf_dir), 5.0, ("x", "y", "z"), ("scene_id",))).groupBy(c("i").alias("id")).agg(F.sort_array(F.collect_set("j")).alias("n"))
    return near.select("id", F.array_join(c("n").cast("array<string>"), ",").alias("neighbours"))


@query("SELECT i, j FROM e", N.edges_sql(f"{SPACE} <= 5e0"))
def fallback_connectivity(spark, sf_dir):
    """Ordered pairs in sight of each other and at most 5 apart in space."""
    return GR.both_ways(N.seen_edges(spark, sf_dir, 5.0, ("x", "y", "z"))).select("i", "j")


@query("SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM e", N.EDGES)
def undirected_edges(spark, sf_dir):
    """Each edge once, whichever way it is listed."""
    e = N.web(spark, sf_dir)
    return e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).dropDuplicates(["i", "j"])


@query("SELECT scene_id, type, CAST(count(*) AS BIGINT) AS n FROM v_waypoints GROUP BY scene_id, type")
def waypoint_type_counts(spark, sf_dir):
    return view(spark, sf_dir, "v_waypoints").groupBy("scene_id", "type").agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, sf_dir):
    found = first_box(points(spark, sf_dir).drop("z"), view(spark, sf_dir, "v_scene_rooms"), 3.2, ("idx",), "room_id", "type", keys=("scene_id",))
    return found.select("idx", F.coalesce("type", F.lit("unknown")).alias("label"))


@query(f"SELECT p.idx, coalesce((SELECT r.type FROM v_scene_rooms r WHERE {INSIDE} ORDER BY r.room_id LIMIT 1), 'unknown') AS label FROM v_waypoints p")
def viewpoint_room_label(spark, sf_dir):
    return _labelled(spark, sf_dir)


def rooms_of(t, spark, sf_dir, key: tuple[str, ...]):
    """key and room_id (or null) of points (scene_id, key, x, y, z): the first room of the scene that holds one, with its tolerance in height."""
    boxes = view(spark, sf_dir, "v_scene_rooms").select("scene_id", c("room_id").alias("order_id"), "room_id", "min_x", "min_y", "max_x", "max_y", "min_z", "max_z")
    return first_box(t, boxes, 3.2, key, "order_id", "room_id", (c("z") >= c("min_z") - 0.5) & (c("z") <= c("max_z") + 1.0), ("scene_id",))


@query(f"SELECT p.path_id, p.seq, (SELECT r.room_id FROM v_scene_rooms r WHERE {INSIDE_3D} ORDER BY r.room_id LIMIT 1) AS room_id FROM v_scene_track p")
def rooms_on_polyline(spark, sf_dir):
    return rooms_of(view(spark, sf_dir, "v_scene_track"), spark, sf_dir, ("path_id", "seq"))


@query(f"SELECT path_id, CAST(count(*) AS BIGINT) AS n_rooms, string_agg(CAST(room_id AS VARCHAR), ',' ORDER BY first) AS rooms FROM (SELECT path_id, room_id, min(seq) AS first FROM (SELECT p.path_id, p.seq, (SELECT r.room_id FROM v_scene_rooms r WHERE {INSIDE_3D} ORDER BY r.room_id LIMIT 1) AS room_id FROM v_scene_track p) WHERE room_id IS NOT NULL GROUP BY path_id, room_id) GROUP BY path_id")
def rooms_on_path(spark, sf_dir):
    """The rooms of each path in the order in which it enters them first."""
    first = rooms_on_polyline(spark, sf_dir).filter("room_id is not null").groupBy("path_id", "room_id").agg(F.min("seq").alias("first"))
    listed = first.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("first", "room_id"))).alias("l"))
    return listed.select("path_id", F.size("l").cast("long").alias("n_rooms"), F.array_join(F.transform("l", lambda s: s["room_id"].cast("string")), ",").alias("rooms"))


def _targets_sql(count: int) -> str:
    return f", places AS (SELECT s, region_id, i, j, row_number() OVER (PARTITION BY s, region_id ORDER BY i, j)-1 AS k, count(*) OVER (PARTITION BY s, region_id) AS n FROM mask), target AS (SELECT d.s, d.region_id, d.pt, m.i, m.j FROM (SELECT s, region_id, CAST(pt AS INTEGER) AS pt, (pt*7919+region_id*104729+42)%n AS k FROM (SELECT DISTINCT s, region_id, n FROM places) x, range({count}) r(pt)) d JOIN places m ON m.s=d.s AND m.region_id=d.region_id AND m.k=d.k)"


def sampled_targets(spark, sf_dir, count: int, scenes=None, floor=None):
    """scene_id, region_id, pt, i, j: `count` seeded draws (with repeats) from the floor cells of each region."""
    from pyspark.sql import Window

    places = Q.grid_mask(spark, sf_dir, scenes, floor).withColumn("k", (F.row_number().over(Window.partitionBy("scene_id", "region_id").orderBy("i", "j")) - 1).cast("long"))
    n = places.groupBy("scene_id", "region_id").agg(F.count(F.lit(1)).alias("n")).withColumn("pt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    drawn = n.withColumn("k", (c("pt").cast("long") * 7919 + c("region_id") * 104729 + 42) % c("n")).hint("merge")  # far more rows than estimated
    return drawn.join(places, ["scene_id", "region_id", "k"]).select("scene_id", "region_id", "pt", "i", "j")


#: Random starts of a scene, tries for each, the camera's height, and the distance that starts keep (half a step of the path points).
N_STARTS, TRIES, CAMERA_Z, START_SPREAD = 60, 200, 1.5, 0.75
DRAWN_STARTS = f""", tried AS (SELECT scene_id AS s, draw, try, ny, (draw*{FO.WALK}+try*{FO.STEP}+scene_id*{FO.SCENE}+42)*{FO.MULTIPLIER}%{FO.MODULUS}%(nx*ny) AS k FROM v_bounds, range({N_STARTS}) d(draw), range({TRIES}) t(try)),
hit AS (SELECT t.s, t.draw, arg_min(f.i, t.try) AS i, arg_min(f.j, t.try) AS j FROM tried t JOIN f ON f.s=t.s AND f.i=t.k//t.ny AND f.j=t.k%t.ny GROUP BY t.s, t.draw),
drawn_start AS (SELECT h.s, h.draw, h.i, h.j, b.low_x+(h.i+5e-1)*5e-1 AS x, b.low_y+(h.j+5e-1)*5e-1 AS y, row_number() OVER (PARTITION BY h.s ORDER BY h.draw) AS n FROM hit h JOIN v_bounds b ON b.scene_id=h.s),
spread_start(s, n, xs, ys, took) AS (SELECT DISTINCT s, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]), CAST(NULL AS BIGINT) FROM drawn_start
    UNION ALL SELECT s, n, CASE WHEN ok THEN list_append(xs, x) ELSE xs END, CASE WHEN ok THEN list_append(ys, y) ELSE ys END, CASE WHEN ok THEN draw END
    FROM (SELECT d.*, w.xs, w.ys, len(list_filter(range(1, len(w.xs)+1), lambda m: sqrt((w.xs[m]-d.x)*(w.xs[m]-d.x)+(w.ys[m]-d.y)*(w.ys[m]-d.y)) < 75e-2))=0 AS ok FROM spread_start w JOIN drawn_start d ON d.s=w.s AND d.n=w.n+1)),
start AS (SELECT d.s, d.draw, d.i, d.j, d.x, d.y FROM drawn_start d JOIN spread_start k ON k.s=d.s AND k.took=d.draw)"""


def starts(spark, sf_dir, count: int = N_STARTS, tries: int = TRIES, least: float = START_SPREAD, seed: int = 42, floor=None):
    """scene_id, start, i, j, x, y: `count` random floor cells of each scene (of `floor` if it is there already), each by the first of `tries` draws
    from the whole grid that hits a floor, in order, if they are at least `least` from all taken before."""
    floor = Q.grid(spark, sf_dir).filter("state = 0") if floor is None else floor
    return FO.random_cells(floor, Q.bounds(spark, sf_dir).select("scene_id", "low_x", "low_y", "nx", "ny"), Q.RES, count, tries, least, seed)


@query("SELECT s AS scene_id, draw AS start, i, j, x, y, 15e-1 AS z FROM start", Q.GRID + DRAWN_STARTS)
def random_starts(spark, sf_dir):
    """Spread random starts of each scene at camera height."""
    return starts(spark, sf_dir).withColumn("z", F.lit(CAMERA_Z))


START_PAIRS = Q.MASK.replace(Q.GRID, Q.LABELS) + DRAWN_STARTS + Q._search("SELECT DISTINCT s, i AS si, j AS sj FROM start") + _targets_sql(15)
HELD_IN = "EXISTS (SELECT 1 FROM v_regions r WHERE r.scene_id=p.s AND r.region_id=t.region_id AND sqrt((p.x-r.cx)*(p.x-r.cx)+(p.y-r.cy)*(p.y-r.cy)) <= r.radius)"


@query(f"SELECT s AS scene_id, draw AS start, region_id, pt, round(d{Q.METRES}, 6) AS distance FROM (SELECT p.s, p.draw, t.region_id, t.pt, w.d, row_number() OVER (PARTITION BY p.s, p.draw, t.region_id ORDER BY w.d, t.pt) AS k FROM start p JOIN target t ON t.s=p.s JOIN sp w ON w.s=p.s AND w.si=p.i AND w.sj=p.j AND w.i=t.i AND w.j=t.j JOIN labels x ON x.s=p.s AND x.i=p.i AND x.j=p.j JOIN labels y ON y.s=t.s AND y.i=t.i AND y.j=t.j AND y.label=x.label WHERE NOT {HELD_IN}) WHERE k=1 AND d{Q.METRES} >= 2e0", START_PAIRS)
def gr_candidates(spark, sf_dir):
    """Every random start against every goal region of its scene that it is not in: the nearest of 15 sampled targets by the way on the grid, 2 or more away."""
    labelled = Q.labels(spark, sf_dir)
    begun = cut(starts(spark, sf_dir, floor=labelled))
    return region_candidates(spark, sf_dir, begun, sampled_targets(spark, sf_dir, 15, floor=labelled), labelled).select("scene_id", "start", "region_id", "pt", F.round("distance", 6).alias("distance"))


def region_candidates(spark, sf_dir, begun, targets, labelled, least: float = 2.0):
    """scene_id, start, region_id, pt, distance of starts (scene_id, start, i, j, x, y) and targets (of sampled_targets())."""
    ends = begun.select("scene_id", F.lit("from").alias("role"), c("start").alias("id"), F.lit(0).alias("pt"), "i", "j").unionByName(
        targets.select("scene_id", F.lit("to").alias("role"), c("region_id").alias("id"), "pt", "i", "j"))
    found = GD.nearest_pairs(ends, labelled, Q.RES).filter(c("length") >= least)
    found = found.select("scene_id", c("from_id").alias("start"), c("to_id").alias("region_id"), c("pt_to").alias("pt"), c("length").alias("distance"))
    centres = view(spark, sf_dir, "v_regions").select("scene_id", "region_id", c("cx").alias("x"), c("cy").alias("y"))
    inside = distance_join(begun.select("scene_id", "start", "x", "y"), centres, 1.5, keys=("scene_id",))
    inside = inside.select(c("scene_id_a").alias("scene_id"), c("start_a").alias("start"), c("region_id_b").alias("region_id"))
    return found.join(inside, ["scene_id", "start", "region_id"], "left_anti")


@query("SELECT idx, region_id, pt, d FROM (SELECT p.idx, t.region_id, t.pt, sqrt((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)) AS d, row_number() OVER (PARTITION BY p.idx, t.region_id ORDER BY sqrt((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)), t.pt) AS k FROM v_waypoints p JOIN (SELECT g.s, g.region_id, g.pt, b.low_x+(g.i+5e-1)*5e-1 AS x, b.low_y+(g.j+5e-1)*5e-1 AS y FROM target g JOIN v_bounds b ON b.scene_id=g.s) t ON t.s=p.scene_id) WHERE k=1", Q.MASK + _targets_sql(20))
def nearest_in_region(spark, sf_dir):
    """The nearest, in a straight line, of 20 sampled targets of each region of a waypoint's scene."""
    t = sampled_targets(spark, sf_dir, 20, Q.waypoint_scenes(spark, sf_dir)).join(Q.bounds(spark, sf_dir), "scene_id").select("scene_id", "region_id", "pt", (c("low_x") + (c("i") + 0.5) * 0.5).alias("tx"), (c("low_y") + (c("j") + 0.5) * 0.5).alias("ty"))
    grouped = t.groupBy("scene_id", "region_id").agg(F.collect_list(F.struct("tx", "ty", "pt")).alias("ts"))  # 20 at most
    d = lambda q: F.sqrt((c("x") - q["tx"]) * (c("x") - q["tx"]) + (c("y") - q["ty"]) * (c("y") - q["ty"]))
    near = points(spark, sf_dir).join(grouped.hint("merge"), "scene_id").select("idx", "region_id", F.array_min(F.transform("ts", lambda q: F.struct(d(q).alias("d"), q["pt"].alias("pt")))).alias("m"))
    return near.select("idx", "region_id", "m.pt", "m.d")


@query(f"SELECT p.idx, EXISTS (SELECT 1 FROM (SELECT g.s, {Q.CENTRE} FROM f g JOIN v_bounds b ON b.scene_id=g.s) q WHERE q.s=p.scene_id AND sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z*1e-1-0e0)*(p.z*1e-1-0e0)) <= 5e-1) AS navigable FROM v_waypoints p", Q.GRID)
def is_navigable(spark, sf_dir):
    """Whether a place on the scene's floor (at height 0) is at most 0.5 away; heights count a tenth."""
    floor = Q.grid(spark, sf_dir, Q.waypoint_scenes(spark, sf_dir)).filter("state = 0").join(Q.bounds(spark, sf_dir).hint("merge"), "scene_id").select("scene_id", (c("low_x") + (c("i") + 0.5) * 0.5).alias("x"), (c("low_y") + (c("j") + 0.5) * 0.5).alias("y"), F.lit(0.0).alias("z"))
    p = points(spark, sf_dir).withColumn("z", c("z") * 0.1)
    near = distance_join(p, floor, 0.5, ("x", "y", "z"), ("scene_id",)).select(c("idx_a").alias("idx")).distinct().withColumn("navigable", F.lit(True))
    return p.select("idx").join(near, "idx", "left").select("idx", F.coalesce("navigable", F.lit(False)).alias("navigable"))


RING = "t AS (SELECT o.scene_id, o.id, r AS ring, a AS angle, cx+(half+6e-1*(r+1))*cos(a*(2e0*pi()/16)) AS x, cy+(half+6e-1*(r+1))*sin(a*(2e0*pi()/16)) AS y FROM v_scene_objects o, range(4) q(r), range(16) w(a))"


@query(f"SELECT id, CAST(ring AS INTEGER) AS ring, CAST(angle AS INTEGER) AS angle FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, angle) AS k FROM t p WHERE EXISTS (SELECT 1 FROM v_scene_rooms r WHERE {INSIDE}) AND NOT EXISTS (SELECT 1 FROM v_obstacles o WHERE o.scene_id=p.scene_id AND p.x BETWEEN o.min_x-3e-1 AND o.max_x+3e-1 AND p.y BETWEEN o.min_y-3e-1 AND o.max_y+3e-1)) WHERE k=1", RING)
def ring_search(spark, sf_dir):
    """For each object the first angle of the first ring around it that lies in a room of its scene and 0.3 clear of every obstacle."""
    t = S.ring_candidates(view(spark, sf_dir, "v_scene_objects"))
    rooms = view(spark, sf_dir, "v_scene_rooms").select("scene_id", "min_x", "min_y", "max_x", "max_y")
    free = points_in_boxes(points_in_boxes(t, rooms, 3.2, "left_semi", keys=("scene_id",)), grown_obstacles(spark, sf_dir), 1.0, "left_anti", keys=("scene_id",))
    return free.groupBy("id").agg(F.min(F.struct("ring", "angle")).alias("m")).select("id", "m.ring", "m.angle")


def grown_obstacles(spark, sf_dir, by: float = 0.3):
    return view(spark, sf_dir, "v_obstacles").select("scene_id", *((c(n) + (by if n.startswith("max") else -by)).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")))


@query(f"SELECT idx FROM v_waypoints p WHERE EXISTS (SELECT 1 FROM v_scene_rooms r WHERE {INSIDE})")
def point_in_room(spark, sf_dir):
    rooms = view(spark, sf_dir, "v_scene_rooms").select("scene_id", "min_x", "min_y", "max_x", "max_y")
    return points_in_boxes(points(spark, sf_dir), rooms, 3.2, "left_semi", keys=("scene_id",)).select("idx")


@query("SELECT idx FROM v_waypoints p WHERE NOT EXISTS (SELECT 1 FROM v_obstacles o WHERE o.scene_id=p.scene_id AND p.x BETWEEN o.min_x-3e-1 AND o.max_x+3e-1 AND p.y BETWEEN o.min_y-3e-1 AND o.max_y+3e-1)")
def clear_of_obstacles(spark, sf_dir):
    return points_in_boxes(points(spark, sf_dir), grown_obstacles(spark, sf_dir), 1.0, "left_anti", keys=("scene_id",)).select("idx")
