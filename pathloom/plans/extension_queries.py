"""Queries through the extension points: a user's goal region, a sensor's frames, a table function."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import geometry as G
from pathloom.operators import table_functions as TF
from pathloom.operators.regions import Circle, GoalRegion, region
from pathloom.plans import graph_queries as N
from pathloom.plans import grid_queries as Q
from pathloom.plans import path_queries as P
from pathloom.plans.duck import sql
from pathloom.sources.sinks import Camera, CaptureConfig
from pathloom.sources.views import view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text if text.startswith("WITH") else sql(text, ctes)
        return f

    return add


@region("ring")
@dataclass
class Ring(GoalRegion):
    """A region as a user would add one: between two circles."""

    cx: float
    cy: float
    inner: float
    outer: float

    def _from_centre(self, x: Column, y: Column) -> Column:
        return G.norm(x - F.lit(self.cx), y - F.lit(self.cy))

    def contains(self, x: Column, y: Column) -> Column:
        return self._from_centre(x, y).between(self.inner, self.outer)

    def area(self) -> Column:
        return F.pi() * (self.outer * self.outer - self.inner * self.inner)

    def bounding_box(self) -> tuple[Column, Column, Column, Column]:
        return Circle(self.cx, self.cy, self.outer).bounding_box()

    def nearest_boundary(self, x: Column, y: Column) -> tuple[Column, Column]:
        nearer = self._from_centre(x, y) * 2 < self.inner + self.outer
        ends = [Circle(self.cx, self.cy, r).nearest_boundary(x, y) for r in (self.inner, self.outer)]
        return tuple(F.when(nearer, a).otherwise(b) for a, b in zip(*ends))


@query("SELECT scene_id, idx, round(CASE WHEN n*2 < 5e0 THEN 1e0-n ELSE n-4e0 END, 9) AS distance FROM (SELECT scene_id, idx, sqrt((x-1e0)*(x-1e0)+(y-1e0)*(y-1e0)) AS n FROM v_waypoints) q WHERE n BETWEEN 1e0 AND 4e0")
def user_region(spark, sf_dir):
    """Waypoints in a user's region and their signed distance to its boundary (negative inside)."""
    ring = Ring(1.0, 1.0, 1.0, 4.0)
    held = ring.members(view(spark, sf_dir, "v_waypoints"))
    return held.select("scene_id", "idx", F.round(ring.distance_to(F.col("x"), F.col("y")), 9).alias("distance"))


@query("SELECT path_id, seq AS frame, m.mode, concat(m.mode, '_', seq, CASE m.mode WHEN 'depth' THEN '.npy' ELSE '.png' END) AS file, 1280 AS width, 720 AS height, 87e0 AS fov FROM v_track, (VALUES ('rgb'), ('depth')) m(mode)")
def sensor_frames(spark, sf_dir):
    """What the camera sensor lists for a plan, in two modes."""
    plan = P.track(spark, sf_dir).select("path_id", F.col("seq").alias("frame"))
    return Camera(CaptureConfig(rgb_mode=True, depth_mode=True)).frames(plan)


def line_function():
    """A table function: the cells of the integer line between two cells, one row each."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="k int, i int, j int")
    class Line:
        def eval(self, i1: int, j1: int, i2: int, j2: int):
            di, dj = abs(i2 - i1), abs(j2 - j1)
            err, i, j = di - dj, i1, j1
            for k in range(max(di, dj) + 1):
                yield k, i, j
                twice = 2 * err
                if twice > -dj:
                    err, i = err - dj, i + (1 if i2 >= i1 else -1)
                if twice < di:
                    err, j = err + di, j + (1 if j2 >= j1 else -1)

    return Line


@query("SELECT id, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM walk", Q.LINE + ", " + Q.walk_sql())
def bresenham_rows(spark, sf_dir):
    """bresenham through a table function, as a user's generator of rows would come in."""
    asked = Q.lines(spark, sf_dir)
    line = line_function()(*(F.col(n).outer() for n in ("i1", "j1", "i2", "j2")))
    return asked.lateralJoin(line).select("id", "k", "i", "j")


@query(P.SQL["sample_path_points"])
def sample_path_points_rows(spark, sf_dir):
    """sample_path_points through a table function over the sorted rows of each path."""
    return TF.sampled_points(P.track(spark, sf_dir), 30.0)


@query(N.SQL["diverse_select"])
def diverse_select_rows(spark, sf_dir):
    """diverse_select through a table function over the sorted candidates of each scene and class."""
    t = N.with_targets(N.candidates(spark, sf_dir), spark, sf_dir).withColumn("marks", F.col("path"))
    return N._joined(TF.novel(t, ["scene_id", "scale"], [F.desc("score"), "source", "a", "b"], 0.3).drop("marks", "target", "rooms"))
