"""Queries over goal regions that come as nested descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators import polygon_cover as PC
from pathloom.operators import region_trees as R
from pathloom.plans.duck import sql
from pathloom.sources.views import view

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def query(text: str, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql(text, ctes)
        return f

    return add


#: Corners around an object, and the waypoints (of its scene's 40) of its set.
ELL, TRIANGLE, PICKS = [(-1, -1), (2, -1), (2, 0), (0, 0), (0, 2), (-1, 2)], [(0, 1), (2, 3), (-2, 3)], (7, 11, 13)


def described(spark, sf_dir) -> DataFrame:
    """scene_id, id, description: circles, rectangles, polygons, nested composites and waypoint sets around the objects of scenes with 40 waypoints."""
    whole = view(spark, sf_dir, "v_waypoints").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 40").select("scene_id")
    o = view(spark, sf_dir, "v_scene_objects").join(whole, "scene_id")
    at = lambda dx, dy: F.array(c("cx") + float(dx), c("cy") + float(dy))
    shape = lambda kind, **rest: F.to_json(F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in rest.items())))
    corners = lambda places: F.array(*(at(*p) for p in places))
    both = lambda *parts: F.concat(F.lit('{"type":"composite","children":['), F.concat_ws(",", *parts), F.lit("]}"))
    nested = both(shape("circle", center=at(2, 0), radius=F.lit(1.0)), both(shape("rect", min_xy=at(-3, -1), max_xy=at(-1, 1)), shape("polygon", vertices=corners(TRIANGLE))))
    picks = F.array(*(c("scene_id") * 40 + (c("id") * m) % 40 for m in PICKS))
    kinds = [shape("circle", center=at(0, 0), radius=F.lit(1.5)), shape("rect", min_xy=at(-1, -2), max_xy=at(2, 1)), shape("polygon", vertices=corners(ELL)), nested, shape("waypoint_set", indices=picks, radius=F.lit(1.0))]
    text = kinds[-1]
    for k, kind in enumerate(kinds[:-1]):
        text = F.when(c("id") % 5 == k, kind).otherwise(text)
    return o.select("scene_id", "id", text.alias("description"))


def bound(spark, sf_dir) -> DataFrame:
    return R.bind(R.leaves(described(spark, sf_dir)), places(spark, sf_dir))


def places(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_waypoints").select("scene_id", "idx", "x", "y")


def _corners_sql(kind: int, ord_: int, offsets) -> str:
    rows = ", ".join(f"({n}, {dx}e0, {dy}e0)" for n, (dx, dy) in enumerate(offsets))
    return f"SELECT s, id, {ord_} AS ord, n, {len(offsets)} AS many, cx+dx AS x, cy+dy AS y FROM o, (VALUES {rows}) t(n, dx, dy) WHERE id%5={kind}"


LEAVES = f"""o AS (SELECT scene_id AS s, id, cx, cy FROM v_scene_objects WHERE scene_id IN (SELECT scene_id FROM v_waypoints GROUP BY scene_id HAVING count(*)=40)),
lc AS (SELECT s, id, 0 AS ord, cx, cy, 15e-1 AS r FROM o WHERE id%5=0 UNION ALL SELECT s, id, 0, cx+2e0, cy, 1e0 FROM o WHERE id%5=3),
lr AS (SELECT s, id, 0 AS ord, cx-1e0 AS x0, cy-2e0 AS y0, cx+2e0 AS x1, cy+1e0 AS y1 FROM o WHERE id%5=1 UNION ALL SELECT s, id, 1, cx-3e0, cy-1e0, cx-1e0, cy+1e0 FROM o WHERE id%5=3),
lv AS ({_corners_sql(2, 0, ELL)} UNION ALL {_corners_sql(3, 2, TRIANGLE)}),
le AS (SELECT a.s, a.id, a.ord, a.n, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM lv a JOIN lv b ON b.s=a.s AND b.id=a.id AND b.ord=a.ord AND b.n=(a.n+1)%a.many),
lw AS (SELECT o.s, o.id, k, w.x AS cx, w.y AS cy FROM o, (VALUES {", ".join(f"({k}, {m})" for k, m in enumerate(PICKS))}) t(k, m) JOIN v_waypoints w ON w.scene_id=o.s AND w.idx=o.s*40+(o.id*m)%40 WHERE o.id%5=4),
p AS (SELECT scene_id AS s, idx, x, y FROM v_waypoints)"""
INSIDE = LEAVES + """, inside AS (SELECT p.s, p.idx, l.id FROM p JOIN lc l ON l.s=p.s AND sqrt((p.x-l.cx)*(p.x-l.cx)+(p.y-l.cy)*(p.y-l.cy)) <= l.r
    UNION SELECT p.s, p.idx, l.id FROM p JOIN lr l ON l.s=p.s AND p.x BETWEEN l.x0 AND l.x1 AND p.y BETWEEN l.y0 AND l.y1
    UNION SELECT s, idx, id FROM (SELECT p.s, p.idx, l.id, l.ord FROM p JOIN le l ON l.s=p.s WHERE (l.ey > p.y) <> (l.ay > p.y) AND p.x < (l.ax-l.ex)*(p.y-l.ey)/CASE WHEN l.ay=l.ey THEN 1e0 ELSE l.ay-l.ey END+l.ex GROUP BY p.s, p.idx, l.id, l.ord HAVING count(*)%2=1) u
    UNION SELECT p.s, p.idx, l.id FROM p JOIN lw l ON l.s=p.s AND sqrt((p.x-l.cx)*(p.x-l.cx)+(p.y-l.cy)*(p.y-l.cy)) <= 1e0)"""


@query("SELECT s AS scene_id, idx, id AS region_id FROM inside", INSIDE)
def region_tree_contains(spark, sf_dir):
    """Waypoints in the regions of their scene, whatever a region is made of."""
    return R.members(places(spark, sf_dir), bound(spark, sf_dir)).select("scene_id", "idx", c("id").alias("region_id"))


@query("""SELECT s AS scene_id, id AS region_id, round(sum(area), 6) AS area, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM (
    SELECT s, id, pi()*r*r AS area, cx-r AS x0, cy-r AS y0, cx+r AS x1, cy+r AS y1 FROM lc
    UNION ALL SELECT s, id, (x1-x0)*(y1-y0), x0, y0, x1, y1 FROM lr
    UNION ALL SELECT s, id, 5e-1*abs(sum(ax*ey-ay*ex)), min(ax), min(ay), max(ax), max(ay) FROM le GROUP BY s, id, ord
    UNION ALL SELECT s, id, count(*)*pi(), min(cx)-1e0, min(cy)-1e0, max(cx)+1e0, max(cy)+1e0 FROM lw GROUP BY s, id) u GROUP BY s, id""", LEAVES)
def region_tree_metrics(spark, sf_dir):
    """Area (overlaps count twice) and box of each region."""
    return R.metrics(bound(spark, sf_dir)).select("scene_id", c("id").alias("region_id"), F.round("area", 6).alias("area"), *R.BOX)


NEAR = INSIDE + """, near_circle AS (SELECT p.s, p.idx, l.id, l.ord, CASE WHEN d < 1e-9 THEN l.cx+l.r ELSE l.cx+(p.x-l.cx)/d*l.r END AS qx, CASE WHEN d < 1e-9 THEN l.cy ELSE l.cy+(p.y-l.cy)/d*l.r END AS qy, p.x, p.y
    FROM p JOIN lc l ON l.s=p.s, LATERAL (SELECT sqrt((p.x-l.cx)*(p.x-l.cx)+(p.y-l.cy)*(p.y-l.cy)) AS d) q),
near_rect AS (SELECT s, idx, id, ord, CASE WHEN NOT i THEN least(greatest(x, x0), x1) WHEN x-x0=m THEN x0 WHEN x1-x=m THEN x1 ELSE x END AS qx,
    CASE WHEN NOT i THEN least(greatest(y, y0), y1) WHEN x-x0=m OR x1-x=m THEN y WHEN y-y0=m THEN y0 ELSE y1 END AS qy, x, y
    FROM (SELECT p.s, p.idx, l.id, l.ord, p.x, p.y, l.x0, l.y0, l.x1, l.y1, p.x BETWEEN l.x0 AND l.x1 AND p.y BETWEEN l.y0 AND l.y1 AS i, least(p.x-l.x0, l.x1-p.x, p.y-l.y0, l.y1-p.y) AS m FROM p JOIN lr l ON l.s=p.s) u),
near_edge AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, idx, id, ord ORDER BY (x-qx)*(x-qx)+(y-qy)*(y-qy), n) AS k FROM (
    SELECT p.s, p.idx, l.id, l.ord, l.n, l.ax+t*(l.ex-l.ax) AS qx, l.ay+t*(l.ey-l.ay) AS qy, p.x, p.y FROM p JOIN le l ON l.s=p.s,
    LATERAL (SELECT least(greatest(((p.x-l.ax)*(l.ex-l.ax)+(p.y-l.ay)*(l.ey-l.ay))/greatest((l.ex-l.ax)*(l.ex-l.ax)+(l.ey-l.ay)*(l.ey-l.ay), 1e-12), 0e0), 1e0) AS t) q) v) w WHERE k=1),
near_set AS (SELECT s, idx, id, 0 AS ord, CASE WHEN d < 1e-9 THEN cx+1e0 ELSE cx+(x-cx)/d*1e0 END AS qx, CASE WHEN d < 1e-9 THEN cy ELSE cy+(y-cy)/d*1e0 END AS qy, x, y
    FROM (SELECT *, row_number() OVER (PARTITION BY s, idx, id ORDER BY d, k) AS m FROM (SELECT p.s, p.idx, l.id, l.k, l.cx, l.cy, p.x, p.y, sqrt((p.x-l.cx)*(p.x-l.cx)+(p.y-l.cy)*(p.y-l.cy)) AS d FROM p JOIN lw l ON l.s=p.s) u) v WHERE m=1),
every AS (SELECT s, idx, id, ord, qx, qy, x, y FROM near_circle UNION ALL SELECT s, idx, id, ord, qx, qy, x, y FROM near_rect UNION ALL SELECT s, idx, id, ord, qx, qy, x, y FROM near_edge UNION ALL SELECT s, idx, id, ord, qx, qy, x, y FROM near_set),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, idx, id ORDER BY sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy)), ord) AS k FROM every) u WHERE k=1)"""


@query("SELECT b.s AS scene_id, b.idx, b.id AS region_id, round(b.qx, 9) AS bx, round(b.qy, 9) AS \"by\", round(CASE WHEN i.id IS NULL THEN 1 ELSE -1 END*sqrt((b.x-b.qx)*(b.x-b.qx)+(b.y-b.qy)*(b.y-b.qy)), 9) AS distance FROM best b LEFT JOIN inside i ON i.s=b.s AND i.idx=b.idx AND i.id=b.id", NEAR)
def region_tree_boundaries(spark, sf_dir):
    """The nearest boundary point of every region of a waypoint's scene, and its signed distance."""
    found = R.boundaries(places(spark, sf_dir), bound(spark, sf_dir))
    return found.select("scene_id", "idx", c("id").alias("region_id"), *(F.round(n, 9).alias(n) for n in ("bx", "by", "distance")))


@query("""SELECT scene_id, idx, id AS region_id FROM (SELECT w.scene_id, w.idx, e.id FROM v_waypoints w JOIN (
    SELECT a.s, a.id, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM big a JOIN big b ON b.s=a.s AND b.id=a.id AND b.n=(a.n+1)%a.many) e ON e.s=w.scene_id
    WHERE (e.ey > w.y) <> (e.ay > w.y) AND w.x < (e.ax-e.ex)*(w.y-e.ey)/CASE WHEN e.ay=e.ey THEN 1e0 ELSE e.ay-e.ey END+e.ex) u GROUP BY scene_id, idx, id HAVING count(*)%2=1""",
    "big AS (SELECT scene_id AS s, id, n, 6 AS many, cx+dx*(1e0+id%4) AS x, cy+dy*(1e0+id%4) AS y FROM v_scene_objects, (VALUES " + ", ".join(f"({n}, {x}e0, {y}e0)" for n, (x, y) in enumerate(ELL)) + ") t(n, dx, dy))")
def polygons_contain(spark, sf_dir):
    """Waypoints in a polygon of their scene, one around each object in four sizes, by cells of the polygons' covers."""
    scale = F.lit(1.0) + c("id") % 4
    corners = F.array(*(F.struct((c("cx") + F.lit(float(x)) * scale).alias("x"), (c("cy") + F.lit(float(y)) * scale).alias("y")) for x, y in ELL))
    polygons = view(spark, sf_dir, "v_scene_objects").select("scene_id", "id", corners.alias("vertices"))
    return PC.members(places(spark, sf_dir), polygons, keys=("scene_id",)).select("scene_id", "idx", c("id").alias("region_id"))
