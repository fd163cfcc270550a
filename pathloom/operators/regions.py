"""Goal regions as a protocol: a user's region says in columns what it holds, the rest follows from that."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geometry as G

REGION_TYPES: dict[str, type] = {}


def region(kind: str):
    """Registers a region class under the type name that its description carries."""

    def add(cls: type) -> type:
        REGION_TYPES[kind] = cls
        return cls

    return add


class GoalRegion(ABC):
    """An area that an agent should reach. Methods return columns, so a region stays inside the plan."""

    @abstractmethod
    def contains(self, x: Column, y: Column) -> Column: ...

    @abstractmethod
    def area(self) -> Column: ...

    @abstractmethod
    def bounding_box(self) -> tuple[Column, Column, Column, Column]:
        """min_x, min_y, max_x, max_y."""

    @abstractmethod
    def nearest_boundary(self, x: Column, y: Column) -> tuple[Column, Column]: ...

    def contains_3d(self, x: Column, y: Column, z: Column) -> Column:  # noqa: ARG002  heights do not matter
        return self.contains(x, y)

    def distance_to(self, x: Column, y: Column) -> Column:
        """Signed distance to the boundary: negative inside."""
        near_x, near_y = self.nearest_boundary(x, y)
        d = G.norm(x - near_x, y - near_y)
        return F.when(self.contains(x, y), -d).otherwise(d)

    def members(self, points: DataFrame) -> DataFrame:
        """Points (x, y) inside; the plain range test of the box comes first and can reach the scan."""
        min_x, min_y, max_x, max_y = self.bounding_box()
        x, y = F.col("x"), F.col("y")
        return points.filter(x.between(min_x, max_x) & y.between(min_y, max_y)).filter(self.contains(x, y))


def deserialize(description: dict) -> GoalRegion:
    """The region of a description with a registered type; others are an error."""
    rest = dict(description)
    kind = rest.pop("type", None)
    if kind not in REGION_TYPES:
        raise ValueError(f"unknown region type: {kind}")
    return REGION_TYPES[kind](**rest)


@region("circle")
@dataclass
class Circle(GoalRegion):
    cx: float
    cy: float
    radius: float

    def _at(self) -> tuple[Column, Column, Column]:
        return F.lit(float(self.cx)), F.lit(float(self.cy)), F.lit(float(self.radius))

    def contains(self, x: Column, y: Column) -> Column:
        return G.circle_contains(x, y, *self._at())

    def area(self) -> Column:
        return F.pi() * self.radius * self.radius

    def bounding_box(self) -> tuple[Column, Column, Column, Column]:
        cx, cy, r = self._at()
        return cx - r, cy - r, cx + r, cy + r

    def nearest_boundary(self, x: Column, y: Column) -> tuple[Column, Column]:
        return G.circle_nearest(x, y, *self._at())


@region("rect")
@dataclass
class Rect(GoalRegion):
    min_x: float
    min_y: float
    max_x: float
    max_y: float
    margin: float = 0.0

    def _at(self) -> tuple[Column, Column, Column, Column]:
        m = float(self.margin)
        return F.lit(self.min_x + m), F.lit(self.min_y + m), F.lit(self.max_x - m), F.lit(self.max_y - m)

    def contains(self, x: Column, y: Column) -> Column:
        return G.rect_contains(x, y, *self._at())

    def area(self) -> Column:
        return G.rect_area(*self._at())

    def bounding_box(self) -> tuple[Column, Column, Column, Column]:
        return self._at()

    def nearest_boundary(self, x: Column, y: Column) -> tuple[Column, Column]:
        return G.rect_nearest(x, y, *self._at())
