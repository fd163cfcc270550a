"""Geometry as column builders: regions, boxes, polygons, cameras and panoramas. No UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def circle_contains(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> Column:
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= r


def circle_nearest(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> tuple[Column, Column]:
    """The boundary point towards (x, y); to the right of a centre that it coincides with."""
    dx, dy = x - cx, y - cy
    d = F.sqrt(dx * dx + dy * dy)
    near = d < 1e-9
    safe = F.when(near, F.lit(1.0)).otherwise(d)
    return F.when(near, cx + r).otherwise(cx + dx / safe * r), F.when(near, cy).otherwise(cy + dy / safe * r)


def rect_contains(x: Column, y: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column, margin: float = 0.0) -> Column:
    return x.between(min_x + margin, max_x - margin) & y.between(min_y + margin, max_y - margin)


def rect_area(min_x, min_y, max_x, max_y, margin: float = 0.0) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), (hi - margin) - (lo + margin))
    return side(min_x, max_x) * side(min_y, max_y)


def rect_nearest(x: Column, y: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> tuple[Column, Column]:
    """Outside: the clipped point; inside: the nearest edge, ties to left, right, bottom, top."""
    inside = x.between(min_x, max_x) & y.between(min_y, max_y)
    gaps = [x - min_x, max_x - x, y - min_y, max_y - y]
    least = F.least(*gaps)
    left, right, bottom = (g == least for g in gaps[:3])
    clip = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    bx = F.when(~inside, clip(x, min_x, max_x)).when(left, min_x).when(right, max_x).otherwise(x)
    by = F.when(~inside, clip(y, min_y, max_y)).when(left | right, y).when(bottom, min_y).otherwise(max_y)
    return bx, by


def _corners(vertices: Column, i: Column) -> tuple[Column, Column]:
    """Vertex i and the one before it, of a closed ring (0-based)."""
    n = F.size(vertices)
    return F.get(vertices, i), F.get(vertices, F.pmod(i + n - 1, n))


def polygon_contains(x: Column, y: Column, vertices: Column) -> Column:
    """Even-odd rule for array<struct<x,y>>, rays to the right, strict comparisons."""

    def crosses(i: Column) -> Column:
        a, b = _corners(vertices, i)
        apart = (a["y"] > y) != (b["y"] > y)
        height = F.when(apart, b["y"] - a["y"]).otherwise(F.lit(1.0))
        return apart & (x < (b["x"] - a["x"]) * (y - a["y"]) / height + a["x"])

    hits = F.filter(F.sequence(F.lit(0), F.size(vertices) - 1), crosses)
    return F.size(hits) % 2 == 1


def polygon_area(vertices: Column) -> Column:
    """Half of the absolute shoelace sum."""

    def term(i: Column) -> Column:
        a, b = _corners(vertices, i)
        return b["x"] * a["y"] - b["y"] * a["x"]

    terms = F.transform(F.sequence(F.lit(0), F.size(vertices) - 1), term)
    return 0.5 * F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def segment_nearest(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The point of a segment nearest to (x, y)."""
    dx, dy = bx - ax, by - ay
    t = ((x - ax) * dx + (y - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return ax + t * dx, ay + t * dy


def to_index(value: Column, low: float, resolution: float, count: int) -> Column:
    """Cell number: truncated towards zero, then clipped."""
    return F.least(F.greatest(((value - low) / resolution).cast("int"), F.lit(0)), F.lit(count - 1))


def cell_center(index: Column, low: float, resolution: float) -> Column:
    return low + (index + 0.5) * resolution


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def look_at(eye: tuple, target: tuple) -> dict[str, Column]:
    """Rows of a camera matrix that looks from eye to target: right, up and back (the eye is its last row)."""
    d = [t - e for e, t in zip(eye, target)]
    length = norm(*d)
    still = length < 1e-6
    safe = F.when(still, F.lit(1.0)).otherwise(length)
    f = [F.when(still, F.lit(1.0 if k == 0 else 0.0)).otherwise(d[k] / safe) for k in range(3)]
    plain = cross(f, (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    other = cross(f, (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    upright = norm(*plain) < 1e-6
    r = [F.when(upright, o).otherwise(p) for p, o in zip(plain, other)]
    size = norm(*r)
    r = [c / size for c in r]
    u = cross(r, f)
    return {f"{name}_{axis}": v for name, row in (("right", r), ("up", u), ("back", [-c for c in f])) for axis, v in zip("xyz", row)}


#: Faces of a cube map by main axis and its sign; u and v as (sign, axis) over the main axis.
CUBE_FACES = (
    ("x", 1, (1, "y"), (1, "z")), ("x", -1, (1, "y"), (-1, "z")), ("y", 1, (-1, "x"), (1, "z")),
    ("y", -1, (-1, "x"), (-1, "z")), ("z", 1, (1, "y"), (-1, "x")), ("z", -1, (-1, "y"), (-1, "x")),
)


def panorama_lookup(row: Column, col: Column, width: int, height: int, face_size: int) -> tuple[Column, Column, Column]:
    """Cube face and position in it (u, v in pixels; u mirrored) of an equirectangular pixel."""
    theta = -math.pi + col * (2 * math.pi / width)
    phi = math.pi / 2 - row * (math.pi / height)
    d = {"x": F.cos(phi) * F.cos(theta), "y": F.cos(phi) * F.sin(theta), "z": F.sin(phi)}
    size = {a: F.abs(c) for a, c in d.items()}
    # ties between x and another axis go to x, between y and z to y
    main = F.when((size["x"] >= size["y"]) & (size["x"] >= size["z"]), "x").when(size["y"] >= size["z"], "y").otherwise("z")
    face = u = v = None
    for number, (axis, sign, (us, ua), (vs, va)) in enumerate(CUBE_FACES):
        here = (main == axis) & ((d[axis] >= 0) if sign > 0 else (d[axis] < 0))
        safe = F.when(here, d[axis]).otherwise(F.lit(1.0))
        place = lambda s, a: (1 - s * d[a] / safe) * 0.5 * (face_size - 1)  # noqa: E731, B023
        face = F.when(here, number) if face is None else face.when(here, number)
        u = F.when(here, place(us, ua)) if u is None else u.when(here, place(us, ua))
        v = F.when(here, place(vs, va)) if v is None else v.when(here, place(vs, va))
    return face, u, v


def axis_angle(ax: float, ay: float, az: float, degrees: Column) -> tuple[Column, Column, Column, Column]:
    half = F.radians(degrees) / 2.0
    return F.cos(half), ax * F.sin(half), ay * F.sin(half), az * F.sin(half)


def segment_hits_box(ax, ay, bx, by, min_x, min_y, max_x, max_y) -> Column:
    """Slab test of a segment with a closed box."""
    near, far = F.lit(0.0), F.lit(1.0)
    miss = F.lit(False)
    for a, b, lo, hi in ((ax, bx, min_x, max_x), (ay, by, min_y, max_y)):
        d = b - a
        flat = F.abs(d) < 1e-12
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        one, two = (lo - a) / safe, (hi - a) / safe
        near = F.when(flat, near).otherwise(F.greatest(near, F.least(one, two)))
        far = F.when(flat, far).otherwise(F.least(far, F.greatest(one, two)))
        miss = miss | (flat & ((a < lo) | (a > hi)))
    return ~miss & (near <= far)
