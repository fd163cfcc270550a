"""Points in tables of polygons: each polygon is covered by the cells of a quadtree, and points meet cells by equality.

Cells start `size` wide. A cell that no edge reaches lies wholly in or out of its polygon; one that an edge reaches is split in
four, down to `depth` halvings. So a point in an inner cell needs no test, whatever the polygon's size, and only points in the
smallest cells along an edge are tested against all corners. A polygon's cells follow its outline and not its area, and
split over as many tasks as there are cells. Cells in which no point lies are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geometry as G
from pathloom.operators.scene import cut

#: How far beyond a cell an edge still counts as reaching it, in its width: on the safe side of rounding.
SLACK = 1e-9


def _reached(low_x: Column, low_y: Column, width: Column) -> Column:
    """Whether an edge of the polygon (vertices) reaches the closed cell."""
    n, gap = F.size("vertices"), width * SLACK
    box = (low_x - gap, low_y - gap, low_x + width + gap, low_y + width + gap)

    def hit(i: Column) -> Column:
        a, b = F.get("vertices", i), F.get("vertices", (i + 1) % n)
        return G.segment_hits_box(a["x"], a["y"], b["x"], b["y"], *box)

    return F.exists(F.sequence(F.lit(0), n - 1), hit)


def cover(polygons: DataFrame, size: float, depth: int, keys: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """keys, id, level, ci, cj, whole and vertices (of cells that are not whole) of the cells that hold a part of each polygon (keys, id, vertices: array of x, y).

    wanted: keys, level, ci, cj of the only cells that are looked at (with each its larger ones); all if there is none."""
    ends = lambda pick, a: F.floor(pick(F.transform("vertices", lambda p: p[a])) / size).cast("long")
    span = lambda a: F.explode(F.sequence(ends(F.array_min, a), ends(F.array_max, a)))
    level = polygons.repartition(*keys, "id").select(*keys, "id", "vertices", span("x").alias("ci")).withColumn("cj", span("y"))
    found = None
    for number in range(depth + 1):
        width = F.lit(size / 2**number)
        if wanted is not None:
            level = level.hint("merge").join(wanted.filter(F.col("level") == number).drop("level"), [*keys, "ci", "cj"], "left_semi")
        x, y = F.col("ci") * width, F.col("cj") * width
        judged = level.withColumn("edge", _reached(x, y, width)).withColumn("whole", G.polygon_contains(x + width / 2.0, y + width / 2.0, F.col("vertices")))
        judged = cut(judged.filter("edge or whole"))
        done = judged if number == depth else judged.filter("not edge")
        part = done.select(*keys, "id", F.lit(number).alias("level"), "ci", "cj", (~F.col("edge")).alias("whole"), F.when(F.col("edge"), F.col("vertices")).alias("vertices"))
        found = part if found is None else found.unionByName(part)
        quarter = F.explode(F.array(*(F.struct((F.col("ci") * 2 + a).alias("i"), (F.col("cj") * 2 + b).alias("j")) for a in (0, 1) for b in (0, 1))))
        level = judged.filter("edge").select(*keys, "id", "vertices", quarter.alias("q")).select(*keys, "id", "vertices", F.col("q.i").alias("ci"), F.col("q.j").alias("cj"))
    return found


def members(points: DataFrame, polygons: DataFrame, size: float = 2.0, depth: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns of points (x, y, keys and more, none of them id) and the id of each polygon that holds them, as polygon_contains says."""
    at = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / (size / 2**k)).alias("ci"), F.floor(F.col("y") / (size / 2**k)).alias("cj")) for k in range(depth + 1)))
    placed = points.withColumn("c", F.explode(at)).select(*points.columns, "c.level", "c.ci", "c.cj")
    wanted = cut(placed.select(*keys, "level", "ci", "cj").distinct())  # no other cell of a polygon can meet a point
    cells = cover(polygons, size, depth, keys, wanted)
    met = placed.hint("merge").join(cells, [*keys, "level", "ci", "cj"])
    return met.filter(F.col("whole") | G.polygon_contains(F.col("x"), F.col("y"), F.col("vertices"))).select(*points.columns, "id")
