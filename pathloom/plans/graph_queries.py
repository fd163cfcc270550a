"""Queries over the waypoint graphs of all scenes: edges in sight, shortest paths, goal regions, candidates and their choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.operators import folds as FO
from pathloom.operators import graph as GR
from pathloom.operators import grid as GD
from pathloom.operators.scene import cut
from pathloom.operators.spatial import distance_join
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
REACH = 3.0
PAIR = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"


def edges_sql(near: str) -> str:
    """The pairs of a scene that are near by a condition on a and b and in sight of each other, both ways."""
    return Q.GRID + ", " + Q.PC + f""", pairs AS (SELECT a.scene_id AS s, a.idx AS i, b.idx AS j, {PAIR} AS d FROM v_waypoints a JOIN v_waypoints b ON a.scene_id=b.scene_id AND a.idx<b.idx AND {near}),
q AS (SELECT p.s, [p.i, p.j] AS id, a.i AS i1, a.j AS j1, b.i AS i2, b.j AS j2 FROM pairs p JOIN pc a ON a.idx=p.i JOIN pc b ON b.idx=p.j), {Q.walk_sql()},
clear AS (SELECT w.id FROM walk w LEFT JOIN grid g ON g.s=w.s AND g.i=w.i AND g.j=w.j GROUP BY w.id HAVING bool_and(coalesce(g.state=0, false))),
half AS (SELECT p.s, p.i, p.j, p.d FROM pairs p JOIN clear k ON k.id=[p.i, p.j]), e AS (SELECT s, i, j, d FROM half UNION ALL SELECT s, j, i, d FROM half)"""


EDGES = edges_sql(f"{PAIR} <= 3e0")


def waypoints(spark, sf_dir):
    return view(spark, sf_dir, "v_waypoints")


def seen_edges(spark, sf_dir, reach=REACH, axes=("x", "y")):
    """scene_id, i < j, d: waypoints of a scene at most `reach` apart over the axes with a clear line between them."""
    pairs = GR.edges(waypoints(spark, sf_dir).select("scene_id", "idx", *axes), reach, axes, ("scene_id",))
    at = Q.in_cells(spark, sf_dir)
    one, two = (at.select("scene_id", c("idx").alias(n), c("i").alias(f"i{k}"), c("j").alias(f"j{k}")) for n, k in (("a", 1), ("b", 2)))
    lines = pairs.select("scene_id", c("i").alias("a"), c("j").alias("b"), "d").join(one.hint("merge"), ["scene_id", "a"]).join(two.hint("merge"), ["scene_id", "b"])
    clear = GD.sight(lines, Q.grid(spark, sf_dir, Q.waypoint_scenes(spark, sf_dir)), ("a", "b", "d")).filter("clear")
    return clear.select("scene_id", c("a").alias("i"), c("b").alias("j"), "d")


def web(spark, sf_dir):
    return GR.both_ways(seen_edges(spark, sf_dir))


@query("SELECT s AS scene_id, i, j, d FROM e", EDGES)
def waypoint_edges(spark, sf_dir):
    return web(spark, sf_dir)


@query("SELECT p.idx AS i, coalesce(string_agg(CAST(e.j AS VARCHAR) || ':' || CAST(CAST(round(e.d*1e4) AS BIGINT) AS VARCHAR), ',' ORDER BY e.j), '') AS neighbours, CAST(count(e.j) AS BIGINT) AS degree FROM v_waypoints p LEFT JOIN e ON e.i=p.idx GROUP BY p.idx", EDGES)
def connectivity_r2r(spark, sf_dir):
    """All neighbours of each waypoint in their order, as index:distance in tenths of a millimetre."""
    near = web(spark, sf_dir).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.round(c("d") * 1e4).cast("long").alias("d")))).alias("n"))
    text = F.array_join(F.transform("n", lambda e: F.concat(e["j"], F.lit(":"), e["d"])), ",")
    t = waypoints(spark, sf_dir).select(c("idx").alias("i")).join(near, "i", "left")
    return t.select("i", F.coalesce(text, F.lit("")).alias("neighbours"), F.coalesce(F.size("n"), F.lit(0)).cast("long").alias("degree"))


@query("SELECT s AS scene_id, CAST(count(*) AS BIGINT) AS n_edges FROM e GROUP BY s", EDGES)
def edge_count(spark, sf_dir):
    """Directed edges of each scene, twice the undirected ones."""
    return seen_edges(spark, sf_dir).groupBy("scene_id").agg((2 * F.count(F.lit(1))).alias("n_edges"))


#: Lengths in whole units; the least vertex before v on any shortest way from src; and the ways, each vertex put behind the one before it.
SP = EDGES + f""", eu AS MATERIALIZED (SELECT s, i, j, greatest(1, CAST(round(d*{GR.UNITS}) AS BIGINT)) AS w FROM e),
reached(s, src, v, u) USING KEY (s, src, v) AS (SELECT scene_id, idx, idx, CAST(0 AS BIGINT) FROM v_waypoints
UNION SELECT n.s, n.src, n.v, n.u FROM (SELECT w.s, w.src, k.j AS v, CAST(min(w.u+k.w) AS BIGINT) AS u FROM reached w JOIN eu k ON k.s=w.s AND k.i=w.v GROUP BY ALL) n
LEFT JOIN recurring.reached o ON o.s=n.s AND o.src=n.src AND o.v=n.v WHERE o.u IS NULL OR n.u < o.u),
before AS MATERIALIZED (SELECT x.s, x.src, x.v, x.u, min(k.i) AS p FROM reached x JOIN eu k ON k.s=x.s AND k.j=x.v JOIN reached y ON y.s=x.s AND y.src=x.src AND y.v=k.i AND y.u+k.w=x.u GROUP BY ALL),
sp(s, src, v, d, path) AS (SELECT scene_id, idx, idx, 0e0, [idx] FROM v_waypoints
UNION ALL SELECT n.s, n.src, n.v, n.u/{GR.UNITS}e0, list_append(w.path, n.v) FROM sp w JOIN before n ON n.s=w.s AND n.src=w.src AND n.p=w.v)"""
#: Rooms and objects of paths (a table with s, path and more).
def _measured_sql(table: str, key: str) -> str:
    return f"(SELECT {key}, CAST(count(DISTINCT p.room) AS BIGINT) AS n_rooms, CAST(count(*) FILTER (WHERE p.type LIKE 'object:%') AS BIGINT) AS n_objects FROM (SELECT {key}, unnest(path) AS idx FROM {table}) u JOIN v_waypoints p ON p.idx=u.idx GROUP BY {key})"


def apsp_table(spark, sf_dir, paths=True):
    """scene_id, i, j, dist, pred (and path)."""
    return GR.all_pairs(waypoints(spark, sf_dir).select("scene_id", "idx"), web(spark, sf_dir), paths)


@query("SELECT src AS i, v AS j, round(d, 6) AS dist FROM sp", SP)
def apsp(spark, sf_dir):
    return apsp_table(spark, sf_dir, paths=False).select("i", "j", F.round("dist", 6).alias("dist"))


@query("SELECT src AS i, v AS j, p AS pred FROM before UNION ALL SELECT idx, idx, NULL FROM v_waypoints", SP)
def apsp_predecessors(spark, sf_dir):
    """The least waypoint before j on any shortest path from i, null where i = j."""
    return apsp_table(spark, sf_dir, paths=False).select("i", "j", "pred")


@query("SELECT src AS i, v AS j, array_to_string(path, ',') AS path FROM sp", SP)
def shortest_path(spark, sf_dir):
    return apsp_table(spark, sf_dir).select("i", "j", F.array_join(c("path").cast("array<string>"), ",").alias("path"))


@query("SELECT p.idx, r.region_id, r.label FROM v_waypoints p JOIN v_regions r ON r.scene_id=p.scene_id AND sqrt((p.x-r.cx)*(p.x-r.cx)+(p.y-r.cy)*(p.y-r.cy)) <= r.radius")
def waypoints_in_region(spark, sf_dir):
    return in_regions(spark, sf_dir).select("idx", "region_id", "label")


def in_regions(spark, sf_dir):
    centers = view(spark, sf_dir, "v_regions").select("scene_id", "region_id", "label", c("cx").alias("x"), c("cy").alias("y"))
    held = distance_join(waypoints(spark, sf_dir).select("scene_id", "idx", "x", "y"), centers, 1.5, keys=("scene_id",))
    return held.select(c("scene_id_a").alias("scene_id"), c("idx_a").alias("idx"), c("region_id_b").alias("region_id"), c("label_b").alias("label"))


INSIDE = ", inside AS (SELECT p.scene_id AS s, p.idx, r.region_id FROM v_waypoints p JOIN v_regions r ON r.scene_id=p.scene_id AND sqrt((p.x-r.cx)*(p.x-r.cx)+(p.y-r.cy)*(p.y-r.cy)) <= r.radius)"
NEAREST = SP + INSIDE + ", best AS (SELECT * FROM (SELECT x.s, x.src, n.region_id, x.v, x.d, x.path, row_number() OVER (PARTITION BY x.src, n.region_id ORDER BY round(x.d, 6), x.v) AS k FROM sp x JOIN inside n ON n.s=x.s AND n.idx=x.v) WHERE k=1)"


def to_regions(spark, sf_dir, pairs=None):
    """scene_id, idx, region_id, goal, dist, path: from each waypoint to the nearest one in each region of its scene."""
    inside = in_regions(spark, sf_dir).select("scene_id", c("idx").alias("j"), "region_id")
    near = (apsp_table(spark, sf_dir) if pairs is None else pairs).join(inside.hint("merge"), ["scene_id", "j"])
    best = near.groupBy("scene_id", c("i").alias("idx"), "region_id").agg(F.min(F.struct(F.round("dist", 6).alias("dist"), c("j").alias("goal"), "path")).alias("m"))
    return best.select("scene_id", "idx", "region_id", "m.goal", "m.dist", "m.path")


@query("SELECT src AS idx, region_id, v AS goal, round(d, 6) AS dist FROM best", NEAREST)
def nearest_wp_in_region(spark, sf_dir):
    return to_regions(spark, sf_dir).select("idx", "region_id", "goal", "dist")


@query(f"SELECT b.src AS idx, b.region_id, b.v AS goal, round(b.d, 6) AS length, array_to_string(b.path, ',') AS path, m.n_rooms FROM best b JOIN {_measured_sql('best', 'src, region_id')} m ON m.src=b.src AND m.region_id=b.region_id", NEAREST)
def path_to_region(spark, sf_dir):
    """The path to the nearest waypoint of each region and the rooms on it."""
    found = GR.measured(to_regions(spark, sf_dir), waypoints(spark, sf_dir), ("idx", "region_id"))
    return found.select("idx", "region_id", "goal", c("dist").alias("length"), F.array_join(c("path").cast("array<string>"), ",").alias("path"), F.size("rooms").cast("long").alias("n_rooms"))


WALKS = f"""walk_steps(s, walk, step, path, rooms) AS (SELECT n.s, n.walk, 0, [n.idx], CASE WHEN n.room IS NULL THEN CAST([] AS VARCHAR[]) ELSE [n.room] END
    FROM (SELECT w.s, w.walk, p.idx, p.room FROM (SELECT s, n, unnest(range(2*n)) AS walk FROM (SELECT scene_id AS s, count(*) AS n FROM v_waypoints WHERE scene_id IN (SELECT s FROM e) GROUP BY scene_id) z) w
        JOIN (SELECT scene_id AS s, idx, room, row_number() OVER (PARTITION BY scene_id ORDER BY idx)-1 AS k FROM v_waypoints) p ON p.s=w.s AND p.k=(w.walk*{FO.WALK}+w.s*{FO.SCENE}+42)%w.n) n
    UNION ALL SELECT s, walk, step+1, list_append(path, j), CASE WHEN room IS NULL THEN rooms ELSE list_append(rooms, room) END FROM (
        SELECT *, row_number() OVER (PARTITION BY s, walk ORDER BY j) AS k FROM (
            SELECT *, sum(wt) OVER (PARTITION BY s, walk ORDER BY j) AS cum, sum(wt) OVER (PARTITION BY s, walk) AS total FROM (
                SELECT w.s, w.walk, w.step, w.path, w.rooms, e.j, p.room, CASE WHEN list_contains(w.path, e.j) THEN 1 WHEN p.room IS NOT NULL AND NOT list_contains(w.rooms, p.room) THEN 30 ELSE 10 END AS wt
                FROM walk_steps w JOIN e ON e.s=w.s AND e.i=w.path[-1] JOIN v_waypoints p ON p.idx=e.j WHERE w.step < 30 AND (len(w.path) < 2 OR e.j <> w.path[-2])) o) u
        WHERE cum*{FO.MODULUS} > ((walk*{FO.WALK}+step*{FO.STEP}+s*{FO.SCENE}+42)*{FO.MULTIPLIER}%{FO.MODULUS})*total) x WHERE k=1),
walked AS (SELECT s, walk, arg_max(path, step) AS path FROM walk_steps GROUP BY s, walk HAVING max(step) >= 2)"""


@query("SELECT s AS scene_id, CAST(walk AS BIGINT) AS walk, array_to_string(path, ',') AS path FROM walked", EDGES + ", " + WALKS)
def random_walks(spark, sf_dir):
    return walked(spark, sf_dir).select("scene_id", "walk", F.array_join(c("path").cast("array<string>"), ",").alias("path"))


def walked(spark, sf_dir, near=None):
    return FO.walks((web(spark, sf_dir) if near is None else near).select("scene_id", "i", "j"), waypoints(spark, sf_dir), 42)


STEPS = ", steps AS (SELECT s, walk, path[k] AS a, path[k+1] AS b FROM (SELECT s, walk, path, unnest(range(1, len(path))) AS k FROM walked) u), lengths AS (SELECT t.s, t.walk, round(sum(coalesce(x.d, 0e0)), 5) AS distance FROM steps t LEFT JOIN sp x ON x.s=t.s AND x.src=t.a AND x.v=t.b GROUP BY t.s, t.walk)"


@query("SELECT s AS scene_id, CAST(walk AS BIGINT) AS walk, distance FROM lengths", SP + ", " + WALKS + STEPS)
def walk_distance(spark, sf_dir):
    """Sum of the shortest distances between the neighbours on each walk."""
    near = cut(web(spark, sf_dir))
    return _walk_lengths(walked(spark, sf_dir, near), GR.all_pairs(waypoints(spark, sf_dir).select("scene_id", "idx"), near, paths=False))


def _walk_lengths(walks, pairs):
    steps = F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("i"), F.slice("path", F.lit(2), F.size("path") - 1).alias("j")))
    step = walks.select("scene_id", "walk", steps.alias("s")).select("scene_id", "walk", "s.i", "s.j").join(pairs.select("scene_id", "i", "j", "dist").hint("merge"), ["scene_id", "i", "j"], "left")
    return step.groupBy("scene_id", "walk").agg(F.round(F.sum(F.coalesce("dist", F.lit(0.0))), 5).alias("distance"))


#: All candidates: source 0 pairs of waypoints, 1 walks, 2 paths to regions; a and b name a candidate of its source.
_GRAPH = "SELECT s, 0 AS source, src AS a, v AS b, round(d, 6) AS distance, path FROM sp WHERE src < v AND d >= 1e0 AND len(path) >= 3"
_REGION = "SELECT s, 2, region_id, src, round(d, 6), path FROM best WHERE len(path) >= 3 AND NOT EXISTS (SELECT 1 FROM inside n WHERE n.idx=src AND n.region_id=best.region_id)"
_SCORE = "round(CASE c.source WHEN 1 THEN len(c.path)*8e-1+3e0*m.n_rooms ELSE len(c.path)+3e0*m.n_rooms+2e0*m.n_objects+1e-1*c.distance+CASE c.source WHEN 2 THEN 5e0 ELSE 0e0 END END, 7)"
CANDIDATES = NEAREST + ", " + WALKS + STEPS + f""", raw AS ({_GRAPH} UNION ALL SELECT w.s, 1, w.walk, 0, l.distance, w.path FROM walked w JOIN lengths l ON l.s=w.s AND l.walk=w.walk UNION ALL {_REGION}),
cand AS (SELECT c.s, c.source, CAST(c.a AS BIGINT) AS a, CAST(c.b AS BIGINT) AS b, c.distance, c.path, m.n_rooms, m.n_objects, {_SCORE} AS score, CASE WHEN m.n_rooms<=1 THEN 'short' WHEN m.n_rooms<=3 THEN 'medium' ELSE 'long' END AS scale
    FROM raw c JOIN {_measured_sql('raw', 's, source, a, b')} m ON m.s=c.s AND m.source=c.source AND m.a=c.a AND m.b=c.b),
targets AS (SELECT scene_id AS s, greatest(20, CAST(floor(5e-1*count(*)) AS BIGINT)) AS short, greatest(30, CAST(floor(8e-1*count(*)) AS BIGINT)) AS medium, greatest(15, CAST(floor(3e-1*count(*)) AS BIGINT)) AS long FROM v_waypoints GROUP BY scene_id),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.s, c.scale ORDER BY c.score DESC, c.source, c.a, c.b) AS n, CASE c.scale WHEN 'short' THEN t.short WHEN 'medium' THEN t.medium ELSE t.long END AS target FROM cand c JOIN targets t ON t.s=c.s)"""


def candidates(spark, sf_dir):
    """scene_id, source, a, b, distance, path, n_rooms, n_objects, score, scale and rooms (in order of the path) of all candidates of the three sources."""
    points, near = cut(waypoints(spark, sf_dir)), cut(web(spark, sf_dir))  # read several times below, as are the pairs and the walks
    pairs = cut(GR.all_pairs(points.select("scene_id", "idx"), near))
    one = pairs.filter("i < j and dist >= 1 and size(path) >= 3").select("scene_id", F.lit(0).alias("source"), c("i").alias("a"), c("j").alias("b"), F.round("dist", 6).alias("distance"), "path")
    walks = cut(walked(spark, sf_dir, near))
    two = walks.join(_walk_lengths(walks, pairs).hint("merge"), ["scene_id", "walk"]).select("scene_id", F.lit(1).alias("source"), c("walk").alias("a"), F.lit(0).cast("long").alias("b"), "distance", "path")
    inside = in_regions(spark, sf_dir).select("scene_id", "idx", "region_id")
    three = to_regions(spark, sf_dir, pairs).filter("size(path) >= 3").join(inside.hint("merge"), ["scene_id", "idx", "region_id"], "left_anti")
    three = three.select("scene_id", F.lit(2).alias("source"), c("region_id").alias("a"), c("idx").alias("b"), c("dist").alias("distance"), "path")
    t = GR.measured(one.unionByName(two).unionByName(three), points, ("source", "a", "b")).withColumn("n_rooms", F.size("rooms").cast("long"))
    plain = GR.graph_score(F.size("path"), c("n_rooms"), c("n_objects"), c("distance")) + F.when(c("source") == 2, 5.0).otherwise(0.0)
    score = F.when(c("source") == 1, F.size("path") * F.lit(0.8) + 3.0 * c("n_rooms")).otherwise(plain)
    return t.select("scene_id", "source", "a", "b", "distance", "path", "n_rooms", "n_objects", F.round(score, 7).alias("score"), GR.scale(c("n_rooms")).alias("scale"), "rooms")


def _joined(t):
    return t.withColumn("path", F.array_join(c("path").cast("array<string>"), ","))


SHOWN = "s AS scene_id, source, a, b, distance, array_to_string(path, ',') AS path, n_rooms, n_objects, score, scale"


@query(f"SELECT {SHOWN} FROM cand", CANDIDATES)
def candidate_union(spark, sf_dir):
    """Every candidate of the three sources with its rooms, objects, score and class."""
    return _joined(candidates(spark, sf_dir).drop("rooms"))


@query("SELECT s AS scene_id, a AS i, b AS j, distance, array_to_string(path, ',') AS path, n_rooms, n_objects, score FROM cand WHERE source=0", CANDIDATES)
def path_candidates(spark, sf_dir):
    """Pairs i < j of a scene at least 1 apart over three waypoints or more, scored by vertices, rooms, objects and length."""
    return _joined(candidates(spark, sf_dir)).filter("source = 0").select("scene_id", c("a").alias("i"), c("b").alias("j"), "distance", "path", "n_rooms", "n_objects", "score")


@query("SELECT s AS scene_id, a AS region_id, b AS idx, distance, array_to_string(path, ',') AS path, n_rooms, n_objects, score FROM cand WHERE source=2", CANDIDATES)
def region_targeted_paths(spark, sf_dir):
    """Each waypoint outside a region to the nearest one inside, with a bonus of 5."""
    return _joined(candidates(spark, sf_dir)).filter("source = 2").select("scene_id", c("a").alias("region_id"), c("b").alias("idx"), "distance", "path", "n_rooms", "n_objects", "score")


@query("SELECT s AS scene_id, source, a, b, n_rooms, scale FROM cand", CANDIDATES)
def classify_scale(spark, sf_dir):
    return candidates(spark, sf_dir).select("scene_id", "source", "a", "b", "n_rooms", "scale")


def with_targets(t, spark, sf_dir):
    """target: how many paths of its class a scene of W waypoints wants (half, 0.8 and 0.3 of W, at least 20, 30 and 15)."""
    n = waypoints(spark, sf_dir).groupBy("scene_id").agg(F.count(F.lit(1)).alias("w"))
    most = lambda least, share: F.greatest(F.lit(least).cast("long"), F.floor(F.lit(share) * c("w")))
    return t.join(n, "scene_id").withColumn("target", F.when(c("scale") == "short", most(20, 0.5)).when(c("scale") == "medium", most(30, 0.8)).otherwise(most(15, 0.3))).drop("w")


@query("SELECT s AS scene_id, scale, source, a, b, CAST(n AS INTEGER) AS rank FROM ranked WHERE n <= target", CANDIDATES)
def topk_per_scale(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("scene_id", "scale").orderBy(F.desc("score"), "source", "a", "b"))
    return with_targets(candidates(spark, sf_dir), spark, sf_dir).withColumn("rank", rank).filter("rank <= target").select("scene_id", "scale", "source", "a", "b", "rank")


CHOSEN = CANDIDATES + """, sel(s, scale, n, cnt, cov, ok) AS (SELECT DISTINCT s, scale, CAST(0 AS BIGINT), 0, CAST([] AS BIGINT[]), false FROM ranked
UNION ALL SELECT s, scale, n, cnt+CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN list_distinct(list_concat(cov, marks)) ELSE cov END, ok FROM (
    SELECT r.s, r.scale, r.n, w.cnt, w.cov, r.marks, w.cnt < r.target AND (w.cnt < 5 OR len(list_filter(r.marks, lambda k: NOT list_contains(w.cov, k)))/len(r.marks) >= 3e-1) AS ok
    FROM sel w JOIN (SELECT *, list_distinct(path) AS marks FROM ranked) r ON r.s=w.s AND r.scale=w.scale AND r.n=w.n+1) x),
chosen AS (SELECT r.* FROM ranked r JOIN sel ON sel.s=r.s AND sel.scale=r.scale AND sel.n=r.n AND sel.ok)"""


def chosen(spark, sf_dir):
    t = with_targets(candidates(spark, sf_dir), spark, sf_dir).withColumn("marks", c("path"))
    return FO.novelty(t, ["scene_id", "scale"], ["source", "a", "b"], 0.3)


@query(f"SELECT {SHOWN} FROM chosen", CHOSEN)
def diverse_select(spark, sf_dir):
    return _joined(chosen(spark, sf_dir).drop("marks", "target", "rooms"))


@query(f"SELECT {SHOWN}, false AS backwards FROM chosen UNION ALL SELECT {SHOWN.replace('path,', 'list_reverse(path),', 1)}, true FROM chosen WHERE len(path) >= 4", CHOSEN)
def sample_vln_paths(spark, sf_dir):
    """Candidates of all sources, classes, novel choice, and the way back of paths of four waypoints or more."""
    return _joined(sampled_paths(spark, sf_dir).drop("rooms"))


def sampled_paths(spark, sf_dir):
    """The chosen candidates and their ways back, with path and rooms as arrays."""
    ways = F.filter(F.array(F.lit(False), F.lit(True)), lambda backwards: ~backwards | (F.size("path") >= 4))
    t = chosen(spark, sf_dir).drop("marks", "target").withColumn("backwards", F.explode(ways))  # both ways from one row: the choice is made once
    turned = lambda n: F.when(c("backwards"), F.reverse(n)).otherwise(c(n))
    return t.withColumn("path", turned("path")).withColumn("rooms", turned("rooms"))


def sample_semantic_waypoints(spark, sf_dir):
    """The waypoints of sample_vln_paths alone: scene_id, idx, x, y, z, type, room."""
    return waypoints(spark, sf_dir)
