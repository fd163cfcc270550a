"""DuckDB texts of the queries: a body over the scene views gets the views it uses as common table expressions."""

from __future__ import annotations

import re

from pathloom.sources import views


def sql(body: str, ctes: str = "") -> str:
    """ctes: further common table expressions (name AS (...), ...), which may be recursive."""
    names = views.used(ctes + " " + body)
    ctes = re.sub(r"\b(?!walk\b|back\b)(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", ctes.strip().rstrip(","))  # each is read many times; these two are recursive
    parts = [f"{n} AS MATERIALIZED ({views.text(n, 'duck')})" for n in names] + ([ctes] if ctes else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def words(values) -> str:
    """An SQL list of strings for IN."""
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
