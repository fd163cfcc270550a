"""All queries of the scene and path operators, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scene_queries", "geometry_queries", "grid_queries", "graph_queries", "join_queries", "path_queries", "extension_queries", "region_queries")


#: Read no table (generators, lookup tables, an empty result): examples that tests run, not queries.
EXAMPLES = ("gen_grid_cells", "to_xy", "equirect_lut", "equirect_stitch", "headings_elevations", "room_nav_points")


def _all(name: str, examples: bool = False) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"pathloom.plans.{module}"), name)
    return {k: v for k, v in found.items() if (k in EXAMPLES) == examples}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")


def examples() -> tuple[dict, dict[str, str]]:
    """The examples and their SQL."""
    return _all("QUERIES", True), _all("SQL", True)
