"""Queries over the occupancy grids of all scenes: building, components, sight, search, and paths between objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.functions import geometry as G
from pathloom.operators import grid as GD
from pathloom.operators import search as S
from pathloom.operators.scene import cut
from pathloom.operators.spatial import distance_join
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
RES, BUDGET = 0.5, 10


def _ix(axis: str, value: str) -> str:
    return f"least(greatest(CAST(trunc(({value}-b.low_{axis})/5e-1) AS INTEGER),0),b.n{axis}-1)"


def _cells_sql(boxes: str, grow: str, shrink: str) -> str:
    """Distinct cells of boxes that grow by an amount below and one above."""
    span = ", ".join(f"{_ix(a, f'r.{m}_{a}{by}')} AS {a}{k}" for a in "xy" for k, (m, by) in enumerate((("min", grow), ("max", shrink))))
    return f"""(SELECT DISTINCT s, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM (SELECT s, unnest(generate_series(x0, x1)) AS i, y0, y1 FROM (SELECT r.scene_id AS s, {span}
    FROM {boxes} r JOIN v_bounds b ON b.scene_id=r.scene_id WHERE r.max_x{shrink} > r.min_x{grow} AND r.max_y{shrink} > r.min_y{grow}) q) x, LATERAL (SELECT unnest(generate_series(y0, y1)) AS j) y)"""


GRID = f"""room_cells AS {_cells_sql("v_scene_rooms", "+15e-2", "-15e-2")}, obstacle_cells AS {_cells_sql("v_obstacles", "-25e-2", "+25e-2")},
grid AS (SELECT b.scene_id AS s, CAST(b.i AS INTEGER) AS i, CAST(y.j AS INTEGER) AS j, CASE WHEN o.i IS NOT NULL THEN 1 WHEN r.i IS NOT NULL THEN 0 ELSE 2 END AS state
    FROM (SELECT scene_id, unnest(range(nx)) AS i, ny FROM v_bounds) b, LATERAL (SELECT unnest(range(b.ny)) AS j) y
    LEFT JOIN room_cells r ON r.s=b.scene_id AND r.i=b.i AND r.j=y.j LEFT JOIN obstacle_cells o ON o.s=b.scene_id AND o.i=b.i AND o.j=y.j),
f AS (SELECT s, i, j FROM grid WHERE state=0)"""
LABELS = GRID + """, n4 AS (SELECT a.s, a.i, a.j, b.i AS i2, b.j AS j2 FROM f a CROSS JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) o(di,dj) JOIN f b ON b.s=a.s AND b.i=a.i+o.di AND b.j=a.j+o.dj),
comp(s, i, j, root) USING KEY (s, i, j) AS (SELECT s, i, j, i*1000000+j FROM f
    UNION SELECT n.s, n.i, n.j, n.root FROM (SELECT g.s, g.i2 AS i, g.j2 AS j, min(w.root) AS root FROM comp w JOIN n4 g ON g.s=w.s AND g.i=w.i AND g.j=w.j GROUP BY ALL) n
    JOIN recurring.comp o ON o.s=n.s AND o.i=n.i AND o.j=n.j WHERE n.root < o.root),
labels AS (SELECT s, i, j, CAST(dense_rank() OVER (PARTITION BY s ORDER BY root)-1 AS INTEGER) AS label FROM comp)"""
PC = f"pc AS (SELECT p.idx, p.scene_id AS s, {_ix('x', 'p.x')} AS i, {_ix('y', 'p.y')} AS j FROM v_waypoints p JOIN v_bounds b ON b.scene_id=p.scene_id)"


def _search(sources: str, most: str = "true") -> str:
    """Steps d from each source cell (s, si, sj) to every cell."""
    return f""", n8 AS (SELECT a.s, a.i, a.j, b.i AS i2, b.j AS j2, CASE WHEN di=0 OR dj=0 THEN {S.STRAIGHT} ELSE {S.DIAGONAL} END AS w
    FROM f a CROSS JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) o(di,dj) JOIN f b ON b.s=a.s AND b.i=a.i+o.di AND b.j=a.j+o.dj),
src AS ({sources}),
sp(s, si, sj, i, j, d) USING KEY (s, si, sj, i, j) AS (SELECT s, si, sj, si, sj, CAST(0 AS BIGINT) FROM src
    UNION SELECT n.s, n.si, n.sj, n.i, n.j, n.d FROM (SELECT w.s, w.si, w.sj, e.i2 AS i, e.j2 AS j, CAST(min(w.d+e.w) AS BIGINT) AS d FROM sp w JOIN n8 e ON e.s=w.s AND e.i=w.i AND e.j=w.j GROUP BY ALL) n
    LEFT JOIN recurring.sp o ON o.s=n.s AND o.si=n.si AND o.sj=n.sj AND o.i=n.i AND o.j=n.j WHERE (o.d IS NULL OR n.d < o.d) AND {most})"""


FROM_WAYPOINTS = "SELECT DISTINCT p.s, p.i AS si, p.j AS sj FROM pc p JOIN f ON f.s=p.s AND f.i=p.i AND f.j=p.j"
METRES = "/1e12*5e-1"


def bounds(spark, sf_dir):
    return view(spark, sf_dir, "v_bounds")


def grid(spark, sf_dir, scenes=None):
    """The grids of all scenes, or of those in scenes (scene_id): what is asked of some scenes does not read the others' cells."""
    own = bounds(spark, sf_dir) if scenes is None else bounds(spark, sf_dir).join(scenes.distinct(), "scene_id")  # a semi join drops the distinct and sends a row for each waypoint
    return GD.build(own, view(spark, sf_dir, "v_scene_rooms"), view(spark, sf_dir, "v_obstacles"), RES)


def labels(spark, sf_dir, scenes=None):
    """The labelled floor, made once: searches read it several times."""
    return cut(GD.components(grid(spark, sf_dir, scenes)))


def waypoint_scenes(spark, sf_dir):
    """The scenes that have waypoints."""
    return view(spark, sf_dir, "v_waypoints").select("scene_id").distinct()


def celled(df, spark, sf_dir):
    """df (scene_id, x, y, ...) with the cell i, j of its scene's grid."""
    b = bounds(spark, sf_dir).select("scene_id", "low_x", "low_y", "nx", "ny")
    return df.join(b.hint("merge"), "scene_id").select(*df.columns, GD.index(c("x"), c("low_x"), RES, c("nx")).alias("i"), GD.index(c("y"), c("low_y"), RES, c("ny")).alias("j"))


def in_cells(spark, sf_dir):
    return celled(view(spark, sf_dir, "v_waypoints").select("scene_id", "idx", "x", "y"), spark, sf_dir).drop("x", "y")


@query("SELECT s AS scene_id, i, j, state FROM grid", GRID)
def grid_build(spark, sf_dir):
    return grid(spark, sf_dir)


@query("SELECT p.idx, g.state=0 AS free FROM pc p JOIN grid g ON g.s=p.s AND g.i=p.i AND g.j=p.j", GRID + ", " + PC)
def is_free(spark, sf_dir):
    return in_cells(spark, sf_dir).join(grid(spark, sf_dir, waypoint_scenes(spark, sf_dir)), ["scene_id", "i", "j"]).select("idx", (c("state") == 0).alias("free"))


@query("SELECT s AS scene_id, CAST(count(*) FILTER (WHERE state=0) AS BIGINT) AS n_free, count(*) FILTER (WHERE state=0)*5e-1*5e-1 AS area FROM grid GROUP BY s", GRID)
def grid_free_area(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("scene_id").agg(F.count_if(c("state") == 0).alias("n_free")).select("scene_id", "n_free", (c("n_free") * 0.5 * 0.5).alias("area"))


@query("SELECT s AS scene_id, i, j, CASE state WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 40 END AS red, CASE state WHEN 0 THEN 200 WHEN 1 THEN 0 ELSE 40 END AS green, CASE state WHEN 2 THEN 40 ELSE 0 END AS blue FROM grid", GRID)
def grid_to_rgb(spark, sf_dir):
    tone = lambda *v: F.when(c("state") == 0, v[0]).when(c("state") == 1, v[1]).otherwise(v[2])
    return grid(spark, sf_dir).select("scene_id", "i", "j", tone(0, 200, 40).alias("red"), tone(200, 0, 40).alias("green"), tone(0, 0, 40).alias("blue"))


CENTRE = "b.low_x+(g.i+5e-1)*5e-1 AS x, b.low_y+(g.j+5e-1)*5e-1 AS y"
MASK = GRID + f", mask AS (SELECT g.s, g.i, g.j, c.region_id FROM (SELECT g.s, g.i, g.j, {CENTRE} FROM f g JOIN v_bounds b ON b.scene_id=g.s) g JOIN v_regions c ON c.scene_id=g.s AND sqrt((g.x-c.cx)*(g.x-c.cx)+(g.y-c.cy)*(g.y-c.cy)) <= c.radius)"


@query("SELECT s AS scene_id, i, j, region_id FROM mask", MASK)
def grid_mask(spark, sf_dir, scenes=None, floor=None):
    """Floor cells (of `floor` if it is there already) whose centre lies in a goal region of their scene."""
    floor = (grid(spark, sf_dir, scenes).filter("state = 0") if floor is None else floor).join(bounds(spark, sf_dir).hint("merge"), "scene_id")  # cells look few before they are made
    floor = floor.select("scene_id", "i", "j", (c("low_x") + (c("i") + 0.5) * 0.5).alias("x"), (c("low_y") + (c("j") + 0.5) * 0.5).alias("y"))
    centers = view(spark, sf_dir, "v_regions").select("scene_id", "region_id", c("cx").alias("x"), c("cy").alias("y"))
    return distance_join(floor, centers, 1.5, keys=("scene_id",)).select(c("scene_id_a").alias("scene_id"), c("i_a").alias("i"), c("j_a").alias("j"), c("region_id_b").alias("region_id"))


@query("SELECT s AS scene_id, i, j, label FROM labels", LABELS)
def connected_components(spark, sf_dir):
    return GD.components(grid(spark, sf_dir))


@query("SELECT s AS scene_id, arg_min(label, -n*100000+label) AS label, max(n) AS n, CAST(count(*) AS BIGINT) AS n_components FROM (SELECT s, label, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY s, label) GROUP BY s", LABELS)
def largest_component(spark, sf_dir):
    sizes = GD.components(grid(spark, sf_dir)).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("scene_id").agg(F.max_by("label", F.struct("n", -c("label"))).alias("label"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_components"))


@query("SELECT p.idx, q.label, q.label IS NOT NULL AND t.label IS NOT NULL AND q.label=t.label AS reachable FROM pc p LEFT JOIN labels q ON q.s=p.s AND q.i=p.i AND q.j=p.j LEFT JOIN pc o ON o.s=p.s AND o.idx=p.idx+1 LEFT JOIN labels t ON t.s=o.s AND t.i=o.i AND t.j=o.j", LABELS + ", " + PC)
def reachable(spark, sf_dir):
    """The component of each waypoint, and whether the next waypoint of its scene lies in the same."""
    cell = in_cells(spark, sf_dir).join(labels(spark, sf_dir, waypoint_scenes(spark, sf_dir)), ["scene_id", "i", "j"], "left").select("scene_id", "idx", "label")
    after = cell.select("scene_id", (c("idx") - 1).alias("idx"), c("label").alias("other"))
    return cell.join(after, ["scene_id", "idx"], "left").select("idx", "label", F.coalesce(c("label") == c("other"), F.lit(False)).alias("reachable"))


LINE = "q AS (SELECT idx AS id, scene_id AS s, idx%17 AS i1, (idx*7)%13 AS j1, (idx*5)%19 AS i2, (idx*3)%23 AS j2 FROM v_waypoints)"


def walk_sql(pairs: str = "q") -> str:
    """The cells of the integer lines of pairs (id, s, i1, j1, i2, j2)."""
    return f"walk AS (SELECT id, s, 0 AS k, i1 AS i, j1 AS j, abs(i2-i1)-abs(j2-j1) AS err, i2, j2, abs(i2-i1) AS di, abs(j2-j1) AS dj, CASE WHEN i2>=i1 THEN 1 ELSE -1 END AS si, CASE WHEN j2>=j1 THEN 1 ELSE -1 END AS sj FROM {pairs} UNION ALL SELECT id, s, k+1, i+CASE WHEN 2*err>-dj THEN si ELSE 0 END, j+CASE WHEN 2*err<di THEN sj ELSE 0 END, err-CASE WHEN 2*err>-dj THEN dj ELSE 0 END+CASE WHEN 2*err<di THEN di ELSE 0 END, i2, j2, di, dj, si, sj FROM walk WHERE i<>i2 OR j<>j2)"


def lines(spark, sf_dir):
    k = c("idx")
    cell = lambda m, n: ((k * m) % n).cast("int")
    return view(spark, sf_dir, "v_waypoints").select("scene_id", k.alias("id"), cell(1, 17).alias("i1"), cell(7, 13).alias("j1"), cell(5, 19).alias("i2"), cell(3, 23).alias("j2"))


@query("SELECT id, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM walk", LINE + ", " + walk_sql())
def bresenham(spark, sf_dir):
    return lines(spark, sf_dir).select("id", F.posexplode(GD.bresenham(c("i1"), c("j1"), c("i2"), c("j2"))).alias("k", "c")).select("id", "k", "c.i", "c.j")


@query("SELECT w.id, bool_and(coalesce(g.state=0, false)) AS clear FROM walk w LEFT JOIN grid g ON g.s=w.s AND g.i=w.i AND g.j=w.j GROUP BY w.id", GRID + ", " + LINE + ", " + walk_sql())
def line_of_sight(spark, sf_dir):
    return GD.sight(lines(spark, sf_dir), grid(spark, sf_dir, waypoint_scenes(spark, sf_dir)), ("id",)).select("id", "clear")


def _near_sql(points: str) -> str:
    """The nearest floor cell of points (s, key, i, j)."""
    return f"near AS (SELECT s, key, fi, fj, d FROM (SELECT p.s, p.key, g.i AS fi, g.j AS fj, abs(g.i-p.i)+abs(g.j-p.j) AS d, row_number() OVER (PARTITION BY p.s, p.key ORDER BY abs(g.i-p.i)+abs(g.j-p.j), g.i, g.j) AS k FROM ({points}) p JOIN f g ON g.s=p.s AND abs(g.i-p.i)+abs(g.j-p.j) <= {BUDGET}) WHERE k=1)"


NEAREST = GRID + ", " + PC + ", " + _near_sql("SELECT s, idx AS key, i, j FROM pc")


@query("SELECT key AS idx, fi, fj, d FROM near", NEAREST)
def nearest_free(spark, sf_dir):
    return _nearest_free(spark, sf_dir).select(c("key").alias("idx"), "fi", "fj", "d")


def _nearest_free(spark, sf_dir):
    return GD.nearest_floor(in_cells(spark, sf_dir).withColumnRenamed("idx", "key"), grid(spark, sf_dir, waypoint_scenes(spark, sf_dir)), BUDGET)


@query("SELECT n.key AS idx, b.low_x+(n.fi+5e-1)*5e-1 AS x, b.low_y+(n.fj+5e-1)*5e-1 AS y, l.label AS island FROM near n JOIN v_bounds b ON b.scene_id=n.s JOIN labels l ON l.s=n.s AND l.i=n.fi AND l.j=n.fj", LABELS + ", " + PC + ", " + _near_sql("SELECT s, idx AS key, i, j FROM pc"))
def snap_to_grid(spark, sf_dir):
    """The nearest navigable place of each waypoint and the component (island) it lies in."""
    near = _nearest_free(spark, sf_dir).join(bounds(spark, sf_dir), "scene_id").join(labels(spark, sf_dir, waypoint_scenes(spark, sf_dir)).select("scene_id", c("i").alias("fi"), c("j").alias("fj"), "label"), ["scene_id", "fi", "fj"])
    return near.select(c("key").alias("idx"), (c("low_x") + (c("fi") + 0.5) * 0.5).alias("x"), (c("low_y") + (c("fj") + 0.5) * 0.5).alias("y"), c("label").alias("island"))


TO_ALL = LABELS + ", " + PC + _search(FROM_WAYPOINTS)


def waypoint_questions(spark, sf_dir):
    """From each waypoint to every other of its scene."""
    p = in_cells(spark, sf_dir)
    a, b = (p.select("scene_id", c("idx").alias(f"idx{k}"), c("i").alias(f"i{k}"), c("j").alias(f"j{k}")) for k in (1, 2))
    return a.join(b.hint("merge"), "scene_id").filter("idx1 <> idx2")


@query(f"SELECT a.idx AS from_idx, b.idx AS to_idx, round(w.d{METRES}, 6) AS distance FROM pc a JOIN pc b ON b.s=a.s AND b.idx<>a.idx JOIN sp w ON w.s=a.s AND w.si=a.i AND w.sj=a.j AND w.i=b.i AND w.j=b.j JOIN labels x ON x.s=a.s AND x.i=a.i AND x.j=a.j JOIN labels y ON y.s=b.s AND y.i=b.i AND y.j=b.j AND y.label=x.label", TO_ALL)
def astar_distance(spark, sf_dir):
    """Between all waypoints of a scene that reach each other."""
    found = GD.grid_paths(waypoint_questions(spark, sf_dir), labels(spark, sf_dir, waypoint_scenes(spark, sf_dir)), RES, key=("idx1", "idx2"))
    return found.select(c("idx1").alias("from_idx"), c("idx2").alias("to_idx"), F.round("distance", 6).alias("distance"))


@query("""SELECT q, CAST(max(k) OVER (PARTITION BY q)-k AS INTEGER) AS k, i, j FROM back""", TO_ALL + """, ask AS (SELECT a.idx AS q, a.s, a.i AS si, a.j AS sj, b.i, b.j FROM pc a JOIN pc b ON b.s=a.s AND b.idx=a.idx+1
    JOIN labels x ON x.s=a.s AND x.i=a.i AND x.j=a.j JOIN labels y ON y.s=b.s AND y.i=b.i AND y.j=b.j AND y.label=x.label),
pred AS (SELECT x.s, x.si, x.sj, x.i, x.j, min(e.i2*1000000+e.j2) AS p FROM sp x JOIN n8 e ON e.s=x.s AND e.i=x.i AND e.j=x.j JOIN sp y ON y.s=x.s AND y.si=x.si AND y.sj=x.sj AND y.i=e.i2 AND y.j=e.j2 AND y.d+e.w=x.d GROUP BY ALL),
back AS (SELECT q, s, si, sj, i, j, 0 AS k FROM ask UNION ALL SELECT b.q, b.s, b.si, b.sj, CAST(p.p//1000000 AS INTEGER), CAST(p.p%1000000 AS INTEGER), b.k+1 FROM back b JOIN pred p ON p.s=b.s AND p.si=b.si AND p.sj=b.sj AND p.i=b.i AND p.j=b.j)""")
def astar_path(spark, sf_dir):
    """The cells from each waypoint to the next one of its scene; of equal ways that over the least cells, seen from the goal."""
    ask = waypoint_questions(spark, sf_dir).filter("idx2 = idx1 + 1").select("scene_id", c("idx1").alias("q"), "i1", "j1", "i2", "j2")
    found = GD.grid_paths(ask, labels(spark, sf_dir, waypoint_scenes(spark, sf_dir)), RES, with_path=True)
    return found.select("q", F.posexplode("path").alias("k", "cell")).select("q", "k", "cell.i", "cell.j")


@query(f"SELECT p.idx, m.region_id, round(min(w.d){METRES}, 6) AS distance FROM pc p JOIN sp w ON w.s=p.s AND w.si=p.i AND w.sj=p.j JOIN mask m ON m.s=w.s AND m.i=w.i AND m.j=w.j GROUP BY p.idx, m.region_id", MASK + ", " + PC + _search(FROM_WAYPOINTS))
def astar_to_region(spark, sf_dir):
    """From each waypoint on a floor to the nearest cell of each goal region of its scene: 0 inside, no row where none is reached."""
    scenes = waypoint_scenes(spark, sf_dir)
    starts, mask = in_cells(spark, sf_dir), grid_mask(spark, sf_dir, scenes)
    cell = F.row_number().over(Window.partitionBy("scene_id", "region_id").orderBy("i", "j"))
    ends = starts.select("scene_id", F.lit("from").alias("role"), c("idx").alias("id"), F.lit(0).alias("pt"), "i", "j").unionByName(
        mask.select("scene_id", F.lit("to").alias("role"), c("region_id").alias("id"), cell.alias("pt"), "i", "j"))
    floor = cut(grid(spark, sf_dir, scenes).filter("state = 0").withColumn("label", F.lit(0)))  # this search asks for no common component
    found = GD.nearest_pairs(ends, floor, RES)
    return found.select(c("from_id").alias("idx"), c("to_id").alias("region_id"), F.round("length", 6).alias("distance"))


OBJ = "g AS (SELECT s, id, pt, x, y FROM (SELECT scene_id AS s, id, 0 AS pt, cx+half AS x, cy AS y FROM v_scene_objects UNION ALL SELECT scene_id, id, 1, cx-half, cy FROM v_scene_objects UNION ALL SELECT scene_id, id, 2, cx, cy+half FROM v_scene_objects UNION ALL SELECT scene_id, id, 3, cx, cy-half FROM v_scene_objects) u)"
GOALS = LABELS + ", " + OBJ + f", gc AS (SELECT g.s, g.id*4+g.pt AS key, {_ix('x', 'g.x')} AS i, {_ix('y', 'g.y')} AS j FROM g JOIN v_bounds b ON b.scene_id=g.s), " + _near_sql("SELECT * FROM gc") + ", goal AS (SELECT n.s, CAST(n.key//4 AS BIGINT) AS id, CAST(n.key%4 AS INTEGER) AS pt, n.fi AS i, n.fj AS j, l.label FROM near n JOIN labels l ON l.s=n.s AND l.i=n.fi AND l.j=n.fj)"
FROM_GOALS = _search("SELECT DISTINCT s, i AS si, j AS sj FROM goal")
DRAWN = ", numbered AS (SELECT s, i, j, label, row_number() OVER (PARTITION BY s ORDER BY i, j)-1 AS k, count(*) OVER (PARTITION BY s) AS n FROM labels), drawn AS (SELECT d.s, d.draw, m.i, m.j, m.label FROM (SELECT s, CAST(draw AS BIGINT) AS draw, (draw*7919+s*104729+12345)%n AS k FROM (SELECT DISTINCT s, n FROM numbered) x, range(100) r(draw)) d JOIN numbered m ON m.s=d.s AND m.k=d.k)"


def goals(spark, sf_dir):
    """Four goal points around each object, each on the nearest floor cell: scene_id, id, pt, i, j."""
    o = view(spark, sf_dir, "v_scene_objects")
    at = F.posexplode(F.array(*(F.struct((c("cx") + dx * c("half")).alias("x"), (c("cy") + dy * c("half")).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    p = o.select("scene_id", "id", at.alias("pt", "p")).select("scene_id", (c("id") * 4 + c("pt")).alias("key"), "p.x", "p.y")
    near = GD.nearest_floor(celled(p, spark, sf_dir), grid(spark, sf_dir), BUDGET)
    return near.select("scene_id", F.floor(c("key") / 4).alias("id"), (c("key") % 4).cast("int").alias("pt"), c("fi").alias("i"), c("fj").alias("j"))


@query(f"SELECT from_id, to_id, pt_from, pt_to, round(d{METRES}, 6) AS length FROM (SELECT a.id AS from_id, b.id AS to_id, a.pt AS pt_from, b.pt AS pt_to, w.d, row_number() OVER (PARTITION BY a.s, a.id, b.id ORDER BY w.d, a.pt, b.pt) AS k FROM goal a JOIN goal b ON a.s=b.s AND a.label=b.label JOIN sp w ON w.s=a.s AND w.si=a.i AND w.sj=a.j AND w.i=b.i AND w.j=b.j) WHERE k=1 AND d{METRES} >= 5e-1", GOALS + FROM_GOALS)
def object_pair_paths(spark, sf_dir):
    """The shortest way on the grid between the goal points of each ordered pair of a scene's objects, 0.5 m or more."""
    ends = goals(spark, sf_dir).withColumn("role", F.lit("both"))
    return GD.nearest_pairs(ends, labels(spark, sf_dir), RES).filter("length >= 0.5").select("from_id", "to_id", "pt_from", "pt_to", F.round("length", 6).alias("length"))


@query("SELECT s AS scene_id, draw, i, j FROM drawn", LABELS + DRAWN)
def random_cells(spark, sf_dir):
    return _drawn(spark, sf_dir)


def _drawn(spark, sf_dir, count: int = 100, seed: int = 12345):
    """`count` floor cells of each scene, with repeats, by a linear congruence of seed, scene and number."""
    order = Window.partitionBy("scene_id").orderBy("i", "j")
    floor = grid(spark, sf_dir).filter("state = 0").select("scene_id", "i", "j", (F.row_number().over(order) - 1).cast("long").alias("k"))
    n = floor.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return n.withColumn("k", (c("draw") * 7919 + c("scene_id") * 104729 + seed) % c("n")).hint("merge").join(floor, ["scene_id", "k"]).select("scene_id", "draw", "i", "j")


@query(f"SELECT draw, id, pt, round(d{METRES}, 6) AS length FROM (SELECT r.draw, a.id, a.pt, w.d, row_number() OVER (PARTITION BY a.s, a.id, r.draw ORDER BY w.d, a.pt) AS k FROM goal a JOIN drawn r ON a.s=r.s AND a.label=r.label JOIN sp w ON w.s=a.s AND w.si=a.i AND w.sj=a.j AND w.i=r.i AND w.j=r.j) WHERE k=1 AND d{METRES} >= 5e-1", GOALS + FROM_GOALS + DRAWN)
def object_random_paths(spark, sf_dir):
    """Each of a scene's 100 seeded random places to each of its objects, by the goal point that is nearest on the grid, 0.5 m or more."""
    ends = goals(spark, sf_dir).withColumn("role", F.lit("from")).unionByName(_drawn(spark, sf_dir).select("scene_id", c("draw").alias("id"), F.lit(0).alias("pt"), "i", "j").withColumn("role", F.lit("to")))
    found = GD.nearest_pairs(ends, labels(spark, sf_dir), RES).filter("length >= 0.5")
    return found.select(c("to_id").alias("draw"), c("from_id").alias("id"), c("pt_from").alias("pt"), F.round("length", 6).alias("length"))


NEAR_WAYPOINTS = LABELS + ", " + PC + _search(FROM_WAYPOINTS, f"n.d <= {3 * 2 * S.STRAIGHT}")


@query(f"SELECT a.idx AS i, b.idx AS j, round(w.d{METRES}, 6) AS d FROM v_waypoints a JOIN v_waypoints b ON a.scene_id=b.scene_id AND a.idx<b.idx AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 2e0 JOIN pc p ON p.idx=a.idx JOIN pc q ON q.idx=b.idx JOIN sp w ON w.s=p.s AND w.si=p.i AND w.sj=p.j AND w.i=q.i AND w.j=q.j JOIN labels x ON x.s=p.s AND x.i=p.i AND x.j=p.j JOIN labels y ON y.s=q.s AND y.i=q.i AND y.j=q.j AND x.label=y.label", NEAR_WAYPOINTS)
def navmesh_edges(spark, sf_dir):
    """Waypoints of a scene at most 2 apart in space that reach each other within 1.5 times that; weight: the way on the grid."""
    p = view(spark, sf_dir, "v_waypoints").select("scene_id", "idx", "x", "y", "z")
    pairs = distance_join(p, p, 2.0, ("x", "y", "z"), ("scene_id",)).filter("idx_a < idx_b").select(c("idx_a").alias("a"), c("idx_b").alias("b"))
    at = cut(in_cells(spark, sf_dir))
    one = at.select(c("idx").alias("a"), "scene_id", c("i").alias("i1"), c("j").alias("j1"))
    two = at.select(c("idx").alias("b"), c("i").alias("i2"), c("j").alias("j2"))
    found = GD.grid_paths(pairs.join(one, "a").join(two, "b"), labels(spark, sf_dir, waypoint_scenes(spark, sf_dir)), RES, most=3.0, key=("a", "b"))
    return found.select(c("a").alias("i"), c("b").alias("j"), F.round("distance", 6).alias("d"))
