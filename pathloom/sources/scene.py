"""Scan of scene state documents, and the text forms of scene outputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import tags as T

RELATION = "STRUCT<relation_type: STRING, connector_types: ARRAY<STRING>, child_tags: ARRAY<STRING>, parent_tags: ARRAY<STRING>, margin: DOUBLE, check_z: STRING, rev_normal: STRING>"
RELATION_STATE = f"STRUCT<child_plane_idx: INT, parent_plane_idx: INT, target_name: STRING, value: STRING, relation: {RELATION}>"
OBJECT = f"STRUCT<obj: STRING, generator: STRING, active: STRING, tags: ARRAY<STRING>, relations: ARRAY<{RELATION_STATE}>, dof_matrix_translation: ARRAY<ARRAY<DOUBLE>>, dof_rotation_axis: ARRAY<DOUBLE>>"
DOCUMENT = f"STRUCT<objs: MAP<STRING, {OBJECT}>>"


def resolve_state_path(scene_dir: str, given: str | None = None, name: str = "solve_state.json") -> str | None:
    """The given path if it exists, else the first of the parent folder, the folder itself and its grandparent that has the file."""
    if given and os.path.exists(given):
        return given
    for folder in ("..", ".", "../.."):
        path = os.path.normpath(os.path.join(scene_dir, folder, name))
        if os.path.exists(path):
            return path
    return None


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """scene_id (the file's path) and value (whole text) of every state document."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("scene_id"), "value")


def scan_states(documents: DataFrame, keep_inactive: bool = False) -> DataFrame:
    """One row per state of every document (scene_id, value): ord, id, its fields, sem (semantic tags) and state_type.

    Inactive states are dropped right after the map is opened. A document that is not JSON has no states."""
    opened = documents.select("scene_id", F.posexplode(F.from_json("value", DOCUMENT)["objs"]).alias("ord", "id", "o")).filter(F.col("o").isNotNull())
    states = opened.select(
        "scene_id", "ord", "id", F.coalesce("o.obj", F.lit("")).alias("obj"), F.col("o.generator").alias("generator"), T.truthy(F.col("o.active")).alias("active"),
        F.coalesce("o.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("o.relations", F.array().cast(f"array<{RELATION_STATE}>")).alias("relations"),
        F.col("o.dof_matrix_translation").alias("dof"), F.col("o.dof_rotation_axis").alias("dof_axis"),
    )
    states = states if keep_inactive else states.filter("active")
    sem = T.semantics(F.col("tags"))
    return states.withColumn("sem", sem).withColumn("state_type", T.state_type(F.col("sem")))


def relation_rows(states: DataFrame) -> DataFrame:
    """One row per relation of a state, with the fields that its type has; others are null."""
    from pathloom.functions import vocab

    r = F.col("r.relation")
    kind = r["relation_type"]
    against = kind == "StableAgainst"
    shaped = kind.isin(*vocab.GEOMETRY_RELATIONS) | against
    none = F.array().cast("array<string>")
    return states.select("scene_id", F.col("id").alias("src_id"), F.posexplode("relations").alias("rel_ord", "r")).select(
        "scene_id", "src_id", "rel_ord", F.col("r.child_plane_idx").alias("child_plane_idx"), F.col("r.parent_plane_idx").alias("parent_plane_idx"),
        F.coalesce("r.target_name", F.lit("")).alias("target_name"), F.col("r.value").alias("value"), kind.alias("relation_type"),
        F.when(kind == "RoomNeighbour", F.coalesce(r["connector_types"], none)).alias("connector_types"),
        F.when(shaped, F.coalesce(r["child_tags"], none)).alias("child_tags"), F.when(shaped, F.coalesce(r["parent_tags"], none)).alias("parent_tags"),
        F.when(against, F.coalesce(r["margin"], F.lit(0.0))).alias("margin"), F.when(against, T.truthy(r["check_z"])).alias("check_z"), F.when(against, T.truthy(r["rev_normal"])).alias("rev_normal"),
    )


def parent_id(relations):
    """Target of the first StableAgainst relation of an array of relation states."""
    return F.get(F.filter(relations, lambda r: r["relation"]["relation_type"] == "StableAgainst"), F.lit(0))["target_name"]


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files of key: value lines, one folder per path_id; earlier output is overwritten."""
    lines.select("path_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("path_id").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON lines of nested rows; earlier output is overwritten."""
    documents.write.mode("overwrite").json(path)
