"""Scene views over the relational test tables, as one text for both dialects.

Numbers are written with an exponent, which makes them doubles in either engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

ROOM_TYPE = "CASE {k} % 5 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'bedroom' WHEN 2 THEN 'living-room' WHEN 3 THEN 'bathroom' ELSE 'office' END"

VIEWS: dict[str, str] = {
    "v_points": "SELECT vec_id AS idx, label AS room, CAST(AT(embedding, 1) AS DOUBLE)*2e1 AS x, CAST(AT(embedding, 2) AS DOUBLE)*2e1 AS y, CAST(AT(embedding, 3) AS DOUBLE)*2e1 AS z FROM embeddings",
    "v_rooms": """SELECT n_nationkey AS room_id, CASE n_regionkey WHEN 0 THEN 'kitchen' WHEN 1 THEN 'bedroom' WHEN 2 THEN 'living-room' WHEN 3 THEN 'bathroom' ELSE 'office' END AS type,
        -8e0+3.2e0*(n_nationkey%5) AS min_x, -8e0+3.2e0*CAST(floor(n_nationkey/5e0) AS INT) AS min_y, -8e0+3.2e0*(n_nationkey%5)+3.2e0 AS max_x, -8e0+3.2e0*CAST(floor(n_nationkey/5e0) AS INT)+3.2e0 AS max_y FROM nation""",
    "v_objects": "SELECT p_partkey AS id, -8e0+((p_partkey*37)%160)*1e-1 AS cx, -8e0+((p_partkey*61)%160)*1e-1 AS cy, 5e-2+1e-2*p_size AS half, p_size, p_type, p_brand FROM part",
    "v_relations": "SELECT p_partkey AS id, CASE WHEN p_partkey%97=96 THEN p_partkey WHEN p_partkey%89=88 THEN -1 WHEN p_partkey<25 THEN p_partkey ELSE CAST(floor(p_partkey/3e0) AS BIGINT) END AS parent, p_partkey<25 AS parent_is_room FROM part",
    "v_track": "SELECT user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, value/1e1 AS x, (event_id%50)*2e-1 AS y, 0e0 AS z FROM events",
    "v_tags": "SELECT p_partkey AS id, LIST('Semantics(object)', concat('Semantics(',p_type,')'), CASE WHEN p_size%5=0 THEN '-Semantics(door)' ELSE concat('FromGenerator(',p_brand,')') END, ' malformed ') AS tags FROM part",
    "v_states": f"""SELECT p_partkey AS k, CAST(floor(p_partkey/2e2) AS BIGINT) AS scene_id, concat('o', p_partkey) AS id,
        concat(replace(p_name, ' ', '-'), '/n.', p_partkey, '(', p_size, ')', CASE WHEN p_partkey%2=0 THEN '.meshed' ELSE '' END) AS obj,
        p_brand AS generator, p_size%7 <> 0 AS active,
        CASE WHEN p_partkey<25 THEN 'room' WHEN p_partkey%11=10 THEN 'cutter' ELSE 'object' END AS kind,
        LIST(concat('Semantics(', CASE WHEN p_partkey<25 THEN 'room' WHEN p_partkey%11=10 THEN 'cutter' ELSE 'object' END, ')'),
             concat('Semantics(', CASE WHEN p_partkey<25 THEN {ROOM_TYPE.format(k='p_partkey')}
                WHEN p_partkey%11=10 THEN CASE p_partkey%4 WHEN 0 THEN 'door' WHEN 1 THEN 'window' WHEN 2 THEN 'entrance' ELSE 'open' END
                ELSE CASE p_partkey%6 WHEN 0 THEN 'furniture' WHEN 1 THEN 'wall-decoration' WHEN 2 THEN 'dishware' WHEN 3 THEN 'lighting' WHEN 4 THEN 'chair' ELSE 'access-top' END END, ')'),
             CASE WHEN p_size%5=0 THEN '-Semantics(door)' ELSE concat('FromGenerator(', p_brand, ')') END, ' malformed ',
             CASE WHEN p_partkey%2=0 THEN 'Semantics(access-front)' ELSE 'Semantics(storage)' END) AS tags,
        CASE WHEN p_partkey%13=12 THEN NULL ELSE -8e0+((p_partkey*37)%160)*1e-1 END AS tx, -8e0+((p_partkey*61)%160)*1e-1 AS ty, 5e-2*(p_partkey%4) AS tz FROM part""",
    "v_edges_raw": """SELECT k, id, 0 AS rel_ord, 'CutFrom' AS relation_type, concat('o', k%25) AS target_name FROM v_states WHERE kind='cutter'
        UNION ALL SELECT k, id, 1, 'CutFrom', concat('o', (k*7+3)%25) FROM v_states WHERE kind='cutter'
        UNION ALL SELECT k, id, 2, 'CutFrom', 'o999999999' FROM v_states WHERE kind='cutter' AND k%3=0
        UNION ALL SELECT k, id, 0, 'Touching', concat('o', k-1) FROM v_states WHERE kind='object' AND k%3=0
        UNION ALL SELECT k, id, CASE WHEN k%3=0 THEN 1 ELSE 0 END, 'StableAgainst', CASE WHEN k%97=96 THEN id WHEN k%89=88 THEN 'missing' ELSE concat('o', CAST(floor(k/3e0) AS BIGINT)) END FROM v_states WHERE kind='object'""",
    "v_prims": """SELECT concat('/World/', translate(regexp_replace(obj, '[.]meshed$', ''), '-/.()', '_____')) AS prim_path, k,
        -8e0+((k*37)%160)*1e-1 - (5e-2+1e-2*(k%50)) AS x0, -8e0+((k*61)%160)*1e-1 - (5e-2+1e-2*(k%50)) AS y0, 1e-1*(k%3) AS z0,
        -8e0+((k*37)%160)*1e-1 + (5e-2+1e-2*(k%50)) AS x1, -8e0+((k*61)%160)*1e-1 + (5e-2+1e-2*(k%50)) AS y1, 1e-1*(k%3)+2e-2*(k%50) AS z1
        FROM v_states WHERE kind<>'room' AND k%17<>16
        UNION ALL SELECT concat('/World/', translate(regexp_replace(obj, '[.]meshed$', ''), '-/.()', '_____'), s.suffix), k,
        -8e0+3.2e0*(k%5)+s.inset, -8e0+3.2e0*CAST(floor(k/5e0) AS INT)+s.inset, 1e-1*(k%3)+s.up, -8e0+3.2e0*(k%5)+3.2e0-s.inset, -8e0+3.2e0*CAST(floor(k/5e0) AS INT)+3.2e0-s.inset, 1e-1*(k%3)+2.5e0
        FROM v_states CROSS JOIN (SELECT '_floor' AS suffix, 0e0 AS inset, 0e0 AS up UNION ALL SELECT '_wall', 1e-1, 1e-1 UNION ALL SELECT '_ceiling', 5e-2, 2.4e0) s
        WHERE kind='room' AND (s.suffix <> '_ceiling' OR k%2=0)""",
    # scenes: 40 waypoints and 20 objects each, and the rooms of the one floor plan but for every seventh, which another scene has
    "v_scenes": "SELECT DISTINCT scene_id FROM (SELECT CAST(floor(vec_id/4e1) AS BIGINT) AS scene_id FROM embeddings UNION ALL SELECT CAST(floor(p_partkey/2e1) AS BIGINT) AS scene_id FROM part) s",
    "v_scene_rooms": "SELECT s.scene_id, r.room_id, r.type, r.min_x, r.min_y, 1e-1*(r.room_id%3) AS min_z, r.max_x, r.max_y, 25e-1+1e-1*(r.room_id%3) AS max_z FROM v_scenes s CROSS JOIN v_rooms r WHERE (r.room_id+s.scene_id)%7 <> 3",
    "v_bounds": """SELECT scene_id, min(min_x)-1e0 AS low_x, min(min_y)-1e0 AS low_y, CAST(ceil((max(max_x)+1e0-(min(min_x)-1e0))/5e-1) AS INT) AS nx,
        CAST(ceil((max(max_y)+1e0-(min(min_y)-1e0))/5e-1) AS INT) AS ny FROM v_scene_rooms GROUP BY scene_id""",
    "v_scene_objects": "SELECT CAST(floor(id/2e1) AS BIGINT) AS scene_id, id, cx, cy, half, p_size FROM v_objects",
    "v_obstacles": """SELECT scene_id, id, cx-h AS min_x, cy-h AS min_y, cx+h AS max_x, cy+h AS max_y
        FROM (SELECT scene_id, id, cx, cy, CASE WHEN (2e0*half)*(2e0*half) > 4e-2 THEN half ELSE 3e-1 END AS h FROM v_scene_objects) o""",
    "v_waypoints": """SELECT CAST(floor(idx/4e1) AS BIGINT) AS scene_id, idx, x, y, z,
        CASE idx%3 WHEN 0 THEN concat('room:', CASE room%5 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'bedroom' WHEN 2 THEN 'living-room' WHEN 3 THEN 'bathroom' ELSE 'office' END)
            WHEN 1 THEN 'object:chair' ELSE 'transition:door' END AS type,
        CASE idx%3 WHEN 0 THEN concat('room_', room) WHEN 2 THEN concat('door_', idx) END AS room FROM v_points""",
    "v_regions": "SELECT scene_id, id AS region_id, concat('object:', id) AS label, cx, cy, 15e-1 AS radius FROM v_scene_objects",
    "v_scene_track": "SELECT path_id%12 AS scene_id, path_id, seq, x-8e0 AS x, y-5e0 AS y, 1e-1*(seq%50) AS z FROM v_track",
}


def text(name: str, dialect: str) -> str:
    """A view's definition for spark or duck."""
    body = VIEWS[name]
    names = {"LIST(": "array(", "AT(": "element_at("} if dialect == "spark" else {"LIST(": "list_value(", "AT(": "list_extract("}
    for mark, function in names.items():
        body = body.replace(mark, function)
    return body


def used(body: str) -> list[str]:
    """Views that a text needs, those that others need first."""
    order: list[str] = []

    def add(part: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", part) and name not in order:
                add(VIEWS[name])
                if name not in order:
                    order.append(name)

    add(body)
    return order


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scene view of the tables in sf_dir."""
    frames: dict[str, DataFrame] = {}
    for part in used(name):
        body = text(part, "spark")
        for table in TABLES + tuple(frames):
            body = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", body)
        wanted = {t: frames[t] if t in frames else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", body))}
        frames[part] = spark.sql(body, **wanted)
    return frames[name]
