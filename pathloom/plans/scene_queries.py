"""Queries over scene states and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import tags as T
from pathloom.functions import vocab
from pathloom.operators import folds as FO
from pathloom.operators import scene as S
from pathloom.plans.duck import sql, words
from pathloom.sources import scene as SRC
from pathloom.sources.views import view

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAT = r"^(-?)(\w+)\((.+)\)$"


def query(text: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, ctes)
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State documents made of the part table: JSON with a map of objects per scene."""
    states, raw = view(spark, sf_dir, "v_states"), view(spark, sf_dir, "v_edges_raw")
    relation = F.struct(F.col("relation_type"), F.lit(0.25).alias("margin"), F.lit(True).alias("check_z"), F.array(F.lit("Semantics(object)")).alias("child_tags"))
    edges = raw.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel_ord", F.struct("target_name", relation.alias("relation")).alias("r")))), lambda x: x["r"]).alias("relations"))
    row = lambda a, b, c, t: F.array(F.lit(a), F.lit(b), F.lit(c), t)
    dof = F.when(F.col("tx").isNotNull(), F.array(row(1.0, 0.0, 0.0, F.col("tx")), row(0.0, 1.0, 0.0, F.col("ty")), row(0.0, 0.0, 1.0, F.col("tz"))))
    body = F.struct("obj", "generator", "active", "tags", "relations", dof.alias("dof_matrix_translation"))
    entries = states.join(edges, "id", "left").select("scene_id", "k", "id", body.alias("o"))
    listed = entries.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("k", "id", "o"))).alias("l"))
    objs = F.map_from_entries(F.transform("l", lambda x: F.struct(x["id"], x["o"])))
    return listed.select("scene_id", F.to_json(F.struct(objs.alias("objs"))).alias("value"))


def states(spark, sf_dir, **options):
    return SRC.scan_states(documents(spark, sf_dir), **options)


SEM = "list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(trim(t), '^(-?)Semantics\\((.+)\\)$')), lambda t: concat(regexp_extract(trim(t), '^(-?)(\\w+)\\((.+)\\)$', 1), regexp_extract(trim(t), '^(-?)(\\w+)\\((.+)\\)$', 3))), lambda t: true)"
S_ACTIVE = f"s AS (SELECT *, {SEM} AS sem FROM v_states WHERE active)"


def pick(values, default="NULL"):
    return f"coalesce(list_filter(sem, lambda x: x IN {words(values)})[1], {default})"


@query("SELECT scene_id, id, kind AS state_type, obj, generator, CAST(len(tags) AS INTEGER) AS n_tags, CAST((SELECT count(*) FROM v_edges_raw r WHERE r.id = v_states.id) AS INTEGER) AS n_relations FROM v_states WHERE active")
def scan_state_json(spark, sf_dir):
    return states(spark, sf_dir).select("scene_id", "id", "state_type", "obj", "generator", F.size("tags").alias("n_tags"), F.size("relations").alias("n_relations"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events")
def scan_variant(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT s.id, p.prim_path FROM v_states s LEFT JOIN v_prims p ON p.prim_path = concat('/World/', translate(regexp_replace(s.obj, '[.]meshed$', ''), '-/.()', '_____')) WHERE s.active AND s.kind <> 'room'")
def prim_lookup_join(spark, sf_dir):
    prims = view(spark, sf_dir, "v_prims").select("prim_path", F.col("prim_path").alias("found"))
    s = states(spark, sf_dir).filter("state_type <> 'room'").select("id", F.concat(F.lit("/World/"), T.prim_name(F.col("obj"))).alias("prim_path"))
    return s.join(prims, "prim_path", "left").select("id", F.col("found").alias("prim_path"))


TAG_ROWS = "FROM (SELECT id, unnest(tags) AS t, generate_subscripts(tags, 1) AS i FROM v_tags) u"


@query(f"SELECT id, CAST(i - 1 AS INTEGER) AS ord, regexp_extract(trim(t), '{PAT}', 2) AS tag_key, concat(regexp_extract(trim(t), '{PAT}', 1), regexp_extract(trim(t), '{PAT}', 3)) AS tag_value {TAG_ROWS} WHERE regexp_matches(trim(t), '{PAT}')")
def parse_tags(spark, sf_dir):
    return view(spark, sf_dir, "v_tags").select("id", F.explode(T.parsed(F.col("tags"))).alias("e")).select("id", "e.ord", F.col("e.key").alias("tag_key"), F.col("e.value").alias("tag_value"))


@query(rf"SELECT id, CAST(i - 1 AS INTEGER) AS ord, regexp_extract(trim(t), '^(\w+)\((.+)\)$', 1) AS tag_key, regexp_extract(trim(t), '^(\w+)\((.+)\)$', 2) AS tag_value {TAG_ROWS} WHERE regexp_matches(trim(t), '^(\w+)\((.+)\)$')")
def parse_tags_legacy(spark, sf_dir):
    return view(spark, sf_dir, "v_tags").select("id", F.explode(T.parsed(F.col("tags"), T.UNSIGNED_TAG)).alias("e")).select("id", "e.ord", F.col("e.key").alias("tag_key"), F.col("e.value").alias("tag_value"))


@query("SELECT id, CAST(generate_subscripts(sem, 1) - 1 AS INTEGER) AS pos, unnest(sem) AS value FROM (SELECT id, " + SEM + " AS sem FROM v_tags)")
def semantic_tags(spark, sf_dir):
    return view(spark, sf_dir, "v_tags").select("id", F.posexplode(T.semantics(F.col("tags"))).alias("pos", "value"))


@query("SELECT id, kind AS state_type, active FROM v_states")
def state_dispatch(spark, sf_dir):
    return states(spark, sf_dir, keep_inactive=True).select("id", "state_type", "active")


@query("SELECT r.id AS src_id, r.rel_ord, r.relation_type, CASE WHEN relation_type='StableAgainst' THEN 25e-2 END AS margin, CASE WHEN relation_type='StableAgainst' THEN true END AS check_z, CASE WHEN relation_type IN ('StableAgainst','Touching') THEN 1 END AS n_child_tags FROM v_edges_raw r JOIN v_states s ON s.id=r.id WHERE s.active")
def relation_dispatch(spark, sf_dir):
    return SRC.relation_rows(states(spark, sf_dir)).select("src_id", "rel_ord", "relation_type", "margin", "check_z", F.when(F.col("child_tags").isNotNull(), F.size("child_tags")).alias("n_child_tags"))


@query("SELECT s.scene_id, r.id AS src_id, r.rel_ord, r.target_name, r.relation_type FROM v_edges_raw r JOIN v_states s ON s.id=r.id WHERE s.active")
def relations_explode(spark, sf_dir):
    return SRC.relation_rows(states(spark, sf_dir)).select("scene_id", "src_id", "rel_ord", "target_name", "relation_type")


@query(
    f"SELECT id, {pick(vocab.ROOM_TYPES)} AS room_type, {pick(vocab.OBJECT_TYPES)} AS object_type, {pick(vocab.OBJECT_ACCESS_TYPE)} AS access_type, {pick(vocab.OBJECT_ACCESS_METHOD)} AS access_method, {pick(vocab.FURNITURE_FUNCTIONS + vocab.SMALL_OBJECT_FUNCTIONS)} AS function_tag, {pick(vocab.CUTTER_TYPES)} AS cutter_type FROM s", S_ACTIVE
)
def first_vocab_match(spark, sf_dir):
    sem = F.col("sem")
    kinds = {"room_type": vocab.ROOM_TYPES, "object_type": vocab.OBJECT_TYPES, "access_type": vocab.OBJECT_ACCESS_TYPE, "access_method": vocab.OBJECT_ACCESS_METHOD, "function_tag": vocab.FURNITURE_FUNCTIONS + vocab.SMALL_OBJECT_FUNCTIONS, "cutter_type": vocab.CUTTER_TYPES}
    return states(spark, sf_dir).select("id", *(T.first_of(sem, w).alias(c) for c, w in kinds.items()))


@query("SELECT s.id, (SELECT r.target_name FROM v_edges_raw r WHERE r.id=s.id AND r.relation_type='StableAgainst' ORDER BY rel_ord LIMIT 1) AS parent_id FROM v_states s WHERE s.active")
def parent_id(spark, sf_dir):
    return states(spark, sf_dir).select("id", SRC.parent_id(F.col("relations")).alias("parent_id"))


@query("SELECT id, translate(regexp_replace(obj, '[.]meshed$', ''), '-/.()', '_____') AS prim_name FROM v_states WHERE active")
def prim_name(spark, sf_dir):
    return states(spark, sf_dir).select("id", T.prim_name(F.col("obj")).alias("prim_name"))


@query("SELECT id, replace(replace(replace(regexp_replace(obj, '[.]meshed$', ''), '-', '_'), '/', '_'), '.', '_') AS base FROM v_states WHERE active")
def prim_base_legacy(spark, sf_dir):
    return states(spark, sf_dir).select("id", T.prim_base(F.col("obj")).alias("base"))


@query("SELECT id, replace(replace(replace(obj, '.', '_'), '(', '_'), ')', '_') AS name FROM v_states WHERE active")
def prim_name_object(spark, sf_dir):
    return states(spark, sf_dir).select("id", T.prim_name_object(F.col("obj")).alias("name"))


def _rooms(spark, sf_dir):
    return states(spark, sf_dir).filter("state_type = 'room'").withColumn("type", T.first_of(F.col("sem"), vocab.ROOM_TYPES))


ROOM_PRIMS = f"""rp AS (SELECT s.id, s.k, x.o AS suffix_ord, p.* EXCLUDE (k) FROM v_states s, (SELECT unnest({[*vocab.ROOM_SUFFIXES]!r}) AS suffix, generate_subscripts({[*vocab.ROOM_SUFFIXES]!r}, 1) - 1 AS o) x
    JOIN v_prims p ON p.prim_path = concat('/World/', translate(regexp_replace(s.obj, '[.]meshed$', ''), '-/.()', '_____'), x.suffix) WHERE s.active AND s.kind='room'),
    {S_ACTIVE},
    rc AS (SELECT s.id, s.k, {pick(vocab.ROOM_TYPES)} AS type, b.* EXCLUDE (id), (x1-x0)*(y1-y0) AS area, z0 AS floor_z FROM s JOIN (SELECT id, min(x0) AS x0, min(y0) AS y0, min(z0) AS z0, max(x1) AS x1, max(y1) AS y1, max(z1) AS z1 FROM rp GROUP BY id) b ON s.id=b.id WHERE (x1-x0)*(y1-y0) >= 5e-1)"""


@query("SELECT id, CAST(suffix_ord AS INTEGER) AS suffix_ord, prim_path FROM rp", ROOM_PRIMS)
def room_prims_join(spark, sf_dir):
    return S.room_prims(_rooms(spark, sf_dir), view(spark, sf_dir, "v_prims").drop("k")).select("id", "suffix_ord", "prim_path")


def _collected(spark, sf_dir):
    return S.collected_rooms(_rooms(spark, sf_dir), view(spark, sf_dir, "v_prims").drop("k"))


@query("SELECT id, type, x0, y0, z0, x1, y1, z1, area, floor_z FROM rc", ROOM_PRIMS)
def rooms_collect(spark, sf_dir):
    return _collected(spark, sf_dir).select("id", "type", "x0", "y0", "z0", "x1", "y1", "z1", "area", "floor_z")


@query("SELECT k, min(x0) AS x0, min(y0) AS y0, min(z0) AS z0, max(x1) AS x1, max(y1) AS y1, max(z1) AS z1 FROM v_prims GROUP BY k")
def merged_bbox(spark, sf_dir):
    return S.merged_boxes(view(spark, sf_dir, "v_prims"), "k")


@query("SELECT CAST(floor(k/2e2) AS BIGINT) AS scene_id, max(x1)-min(x0)+1e0 AS size_x, max(y1)-min(y0)+1e0 AS size_y, max(z1)-min(z0)+2e-2 AS size_z, (min(x0)+max(x1))/2e0 AS center_x, (min(y0)+max(y1))/2e0 AS center_y, (min(z0)+max(z1))/2e0-2e-2 AS center_z FROM v_prims GROUP BY floor(k/2e2)")
def scene_bounds(spark, sf_dir):
    """The box of each scene's prims, widened."""
    p = view(spark, sf_dir, "v_prims").groupBy(F.floor(F.col("k") / 200).alias("scene_id"))
    size = lambda a, pad: (F.max(f"{a}1") - F.min(f"{a}0") + pad).alias(f"size_{a}")
    middle = lambda a: (F.min(f"{a}0") + F.max(f"{a}1")) / 2.0
    return p.agg(size("x", 1.0), size("y", 1.0), size("z", 0.02), middle("x").alias("center_x"), middle("y").alias("center_y"), (middle("z") - 0.02).alias("center_z"))


@query("SELECT v.scene_id, coalesce(min(rc.floor_z), 0e0) AS floor_z FROM v_states v LEFT JOIN rc ON rc.k=v.k GROUP BY v.scene_id", ROOM_PRIMS)
def floor_z(spark, sf_dir):
    """The lowest floor of each scene's rooms, 0 without rooms."""
    held = view(spark, sf_dir, "v_states").select("scene_id", "id").join(_collected(spark, sf_dir).select("id", "floor_z"), "id", "left")
    return held.groupBy("scene_id").agg(F.coalesce(F.min("floor_z"), F.lit(0.0)).alias("floor_z"))


@query(f"SELECT id, {pick(vocab.META_SKIP).replace('x IN', 'x NOT IN')} AS catalog_label, {pick(vocab.META_SKIP, chr(39) + 'object' + chr(39)).replace('x IN', 'x NOT IN')} AS waypoint_label FROM s", S_ACTIVE)
def sem_label(spark, sf_dir):
    sem = F.col("sem")
    return states(spark, sf_dir).select("id", T.first_not_of(sem, vocab.META_SKIP).alias("catalog_label"), T.first_not_of(sem, vocab.META_SKIP, "object").alias("waypoint_label"))


@query("SELECT id, CASE WHEN list_contains(sem, 'entrance') THEN 'entrance' ELSE 'door' END AS label FROM s WHERE kind='cutter'", S_ACTIVE)
def door_label(spark, sf_dir):
    return states(spark, sf_dir).filter("state_type = 'cutter'").select("id", T.door_label(F.col("sem")).alias("label"))


@query("SELECT id, tx AS x, ty AS y, tz AS z FROM v_states WHERE active AND tx IS NOT NULL")
def dof_translation(spark, sf_dir):
    s = states(spark, sf_dir).select("id", *(T.translation(F.col("dof"), r).alias(c) for r, c in enumerate("xyz")))
    return s.filter("x is not null and y is not null and z is not null")


@query("SELECT idx, printf('vp_%04d', idx) AS vp, printf('path_%04d', idx) AS path, printf('%s_%04d', 'scene', idx) AS image, printf('e%d_h%02d', room, idx%36) AS view_id FROM v_points")
def format_ids(spark, sf_dir):
    p = view(spark, sf_dir, "v_points")
    return p.select("idx", F.format_string("vp_%04d", "idx").alias("vp"), F.format_string("path_%04d", "idx").alias("path"), F.format_string("%s_%04d", F.lit("scene"), "idx").alias("image"), F.format_string("e%d_h%02d", "room", F.col("idx") % 36).alias("view_id"))


DOORS = "d AS (SELECT concat('/World/', CASE WHEN p_partkey%3=0 THEN 'Door_' ELSE 'wall_' END, CAST(floor(p_partkey/4e0) AS BIGINT), CASE WHEN p_partkey%4=0 THEN '' ELSE concat('/door_', p_partkey%4) END) AS path FROM part), u AS (SELECT DISTINCT path FROM d WHERE contains(lower(path), 'door'))"


@query("SELECT path FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE starts_with(u.path, concat(o.path, '/')))", DOORS)
def prefix_prune_antijoin(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    path = F.concat(F.lit("/World/"), F.when(k % 3 == 0, "Door_").otherwise("wall_"), F.floor(k / 4), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("/door_"), k % 4)))
    doors = part.select(path.alias("path")).filter(F.lower("path").contains("door")).distinct()
    # an ancestor is one of the path's own prefixes, so the theta join becomes an equi-join on them
    parts = F.split("path", "/")
    above = doors.select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")).select("path", F.array_join(F.slice(parts, 1, F.col("n")), "/").alias("prefix"))
    covered = above.join(doors.select(F.col("path").alias("prefix")), "prefix", "left_semi").select("path").distinct()
    return doors.join(covered, "path", "left_anti")


@query("SELECT prim_path, len(list_intersect(string_split(prim_path, '_'), ['ceiling','exterior'])) > 0 AS hidden FROM v_prims")
def path_token_overlap(spark, sf_dir):
    return view(spark, sf_dir, "v_prims").select("prim_path", F.arrays_overlap(F.split("prim_path", "_"), F.array(F.lit("ceiling"), F.lit("exterior"))).alias("hidden"))


@query("SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS pos, CAST(trim(v) AS DOUBLE) AS value FROM (SELECT n_nationkey, unnest(string_split(concat('-', n_nationkey, '.5, ', n_regionkey, ' ,30'), ',')) AS v, generate_subscripts(string_split(concat('-', n_nationkey, '.5, ', n_regionkey, ' ,30'), ','), 1) AS i FROM nation)")
def parse_csv_floats(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.concat(F.lit("-"), "n_nationkey", F.lit(".5, "), "n_regionkey", F.lit(" ,30"))
    return nation.select("n_nationkey", F.posexplode(F.transform(F.split(text, ","), lambda v: F.trim(v).cast("double"))).alias("pos", "value"))


@query("SELECT CAST(h AS INTEGER) AS h_idx, CAST(e AS INTEGER) AS e_idx, h*(360e0/12) AS heading, (e-1)*30e0 AS elevation FROM range(12) a(h), range(3) b(e)")
def headings_elevations(spark, sf_dir):
    h, e = spark.range(12).select(F.col("id").cast("int").alias("h_idx")), spark.range(3).select(F.col("id").cast("int").alias("e_idx"))
    return e.join(F.broadcast(h)).select("h_idx", "e_idx", (F.col("h_idx") * F.lit(360.0 / 12)).alias("heading"), ((F.col("e_idx") - 1) * 30.0).alias("elevation"))


@query("SELECT p_partkey AS id, round(20955e-3/(2e0*tan(radians(30e0+p_size)/2e0)), 6) AS focal, round(1280e0/(2e0*tan(radians(30e0))), 6) AS panorama, round(1280e0/(2e0*tan(radians(180e0/(3+p_size%20)))), 6) AS by_headings FROM part")
def camera_intrinsics(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    over = lambda width, angle: F.round(F.lit(width) / (2.0 * F.tan(angle)), 6)
    return p.select(F.col("p_partkey").alias("id"), over(20.955, F.radians(30.0 + F.col("p_size")) / 2.0).alias("focal"), over(1280.0, F.radians(F.lit(30.0))).alias("panorama"), over(1280.0, F.radians(F.lit(180.0) / (3 + F.col("p_size") % 20))).alias("by_headings"))


@query(f"SELECT id FROM s WHERE len(list_filter(sem, lambda x: x IN {words(vocab.SKIP_SEMANTICS)})) = 0", S_ACTIVE)
def skip_semantics(spark, sf_dir):
    return states(spark, sf_dir).filter(~T.any_of(F.col("sem"), vocab.SKIP_SEMANTICS)).select("id")


OBSTACLE_SKIP = ("room", "door", "window", "entrance", "open", "ceiling-light", "lighting", "wall-decoration") + vocab.ROOM_TYPES


@query(
    f"SELECT s.id, CASE WHEN (p.x1-p.x0)*(p.y1-p.y0) > 4e-2 THEN p.x0 ELSE s.tx-3e-1 END AS min_x, CASE WHEN (p.x1-p.x0)*(p.y1-p.y0) > 4e-2 THEN p.y0 ELSE s.ty-3e-1 END AS min_y, CASE WHEN (p.x1-p.x0)*(p.y1-p.y0) > 4e-2 THEN p.x1 ELSE s.tx+3e-1 END AS max_x, CASE WHEN (p.x1-p.x0)*(p.y1-p.y0) > 4e-2 THEN p.y1 ELSE s.ty+3e-1 END AS max_y FROM s LEFT JOIN v_prims p ON p.k=s.k AND s.kind<>'room' WHERE s.tx IS NOT NULL AND len(list_filter(sem, lambda x: x IN {words(OBSTACLE_SKIP)})) = 0",
    S_ACTIVE,
)
def obstacles(spark, sf_dir):
    s = states(spark, sf_dir).filter(~T.any_of(F.col("sem"), OBSTACLE_SKIP)).withColumn("tx", T.translation(F.col("dof"), 0)).withColumn("ty", T.translation(F.col("dof"), 1)).filter("tx is not null")
    s = s.withColumn("prim_path", F.concat(F.lit("/World/"), T.prim_name(F.col("obj")))).join(view(spark, sf_dir, "v_prims"), "prim_path", "left")
    wide = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > 0.04
    side = lambda box, t, by: F.when(wide, F.col(box)).otherwise(F.col(t) + by)
    return s.select("id", side("x0", "tx", -0.3).alias("min_x"), side("y0", "ty", -0.3).alias("min_y"), side("x1", "tx", 0.3).alias("max_x"), side("y1", "ty", 0.3).alias("max_y"))


@query("SELECT DISTINCT r.target_name AS room_id, s.id AS cutter_id FROM s JOIN v_edges_raw r ON r.id=s.id JOIN s m ON m.id=r.target_name AND m.kind='room' WHERE s.kind='cutter' AND r.relation_type='CutFrom' AND (list_contains(s.sem, 'door') OR list_contains(s.sem, 'entrance'))", S_ACTIVE)
def room_access(spark, sf_dir):
    s = states(spark, sf_dir)
    cutters = s.filter("state_type = 'cutter'").filter(T.any_of(F.col("sem"), ("door", "entrance")))
    cuts = SRC.relation_rows(cutters).filter("relation_type = 'CutFrom'").select(F.col("target_name").alias("room_id"), F.col("src_id").alias("cutter_id"))
    return cuts.join(s.filter("state_type = 'room'").select(F.col("id").alias("room_id")), "room_id", "left_semi").distinct()


@query("SELECT room_id, string_agg(cutter_id, ',' ORDER BY cutter_id) AS navigation_access FROM (SELECT DISTINCT r.target_name AS room_id, s.id AS cutter_id FROM s JOIN v_edges_raw r ON r.id=s.id JOIN s m ON m.id=r.target_name AND m.kind='room' WHERE s.kind='cutter' AND r.relation_type='CutFrom' AND (list_contains(s.sem, 'door') OR list_contains(s.sem, 'entrance'))) GROUP BY room_id", S_ACTIVE)
def room_navigation_access(spark, sf_dir):
    """All doors and entrances of each room."""
    return room_access(spark, sf_dir).groupBy("room_id").agg(F.array_join(F.sort_array(F.collect_set("cutter_id")), ",").alias("navigation_access"))


@query("SELECT id, CAST(NULL AS INTEGER) AS pt, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS z FROM v_states WHERE false")
def room_nav_points(spark, sf_dir):
    """Goal points of rooms and cutters: none are defined, so there are no rows."""
    return states(spark, sf_dir).filter(F.lit(False)).select("id", *(F.lit(None).cast(kind).alias(n) for n, kind in (("pt", "int"), ("x", "double"), ("y", "double"), ("z", "double"))))


_FIRST = f"own AS (SELECT s.id, p.prim_path, p.x0, p.y0, p.z0, p.x1, p.y1, p.z1, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN p.prim_path LIKE '%_floor' THEN 0 WHEN p.prim_path LIKE '%_wall' THEN 1 WHEN p.prim_path LIKE '%_ceiling' THEN 2 ELSE 3 END) AS k FROM s JOIN v_prims p ON p.k=s.k)"


@query("SELECT id, prim_path, (x0+x1)/2e0 AS cx, (y0+y1)/2e0 AS cy, (z0+z1)/2e0 AS cz, (x1-x0)/2e0 AS hx, (y1-y0)/2e0 AS hy, (z1-z0)/2e0 AS hz FROM own WHERE k=1", S_ACTIVE + ", " + _FIRST)
def first_prim_obb(spark, sf_dir):
    found = S.first_prims(states(spark, sf_dir), view(spark, sf_dir, "v_prims"))
    return found.select("id", "prim_path", "cx", "cy", "cz", *(F.get("h", F.lit(k)).alias(f"h{a}") for k, a in enumerate("xyz")))


@query()
def object_nav_points(spark, sf_dir):
    """All goal points of every object: its centre, a seeded Poisson set over its footprint, a row before it on the wall, or none."""
    kinds = nav_points(spark, sf_dir).filter("goal_kind is not null").select("id", "goal_kind")
    own = S.first_prims(states(spark, sf_dir).filter("state_type = 'object'"), view(spark, sf_dir, "v_prims")).join(kinds, "id")
    centre = own.filter("goal_kind = 'center'").select("id", "goal_kind", F.lit(0).alias("pt"), *(F.col(f"c{a}").alias(a) for a in "xyz"))
    half = lambda k: F.get("h", F.lit(k))
    box = own.filter("goal_kind = 'around'").select("id", *((F.col(f"c{a}") + sign * half(k)).alias(f"{m}_{a}") for m, sign in (("min", -1), ("max", 1)) for k, a in enumerate("xy")))
    around = FO.darts(box, "id", 0.2, 8, kind="string").select("id", F.lit("around").alias("goal_kind"), F.col("pt").cast("int").alias("pt"), "x", "y", F.lit(0.02).alias("z"))
    rooms = S.resolve_rooms(view(spark, sf_dir, "v_relations")).select(F.concat(F.lit("o"), "id").alias("id"), F.concat(F.lit("o"), "room").alias("room"))
    room_boxes = S.first_prims(states(spark, sf_dir).filter("state_type = 'room'"), view(spark, sf_dir, "v_prims")).select(F.col("id").alias("room"), *(F.col(f"c{a}").alias(f"r{a}") for a in "xyz"))
    wall = own.filter("goal_kind = 'wall'").join(rooms, "id", "left").join(room_boxes, "room", "left")
    along = S.wall_points(wall).select("id", F.lit("wall").alias("goal_kind"), "pt", "x", "y", "z")
    return centre.unionByName(around).unionByName(along)


@query("SELECT s.id, (m0.x0+m0.x1)/2e0/2e0+(m1.x0+m1.x1)/2e0/2e0 AS x, (m0.y0+m0.y1)/2e0/2e0+(m1.y0+m1.y1)/2e0/2e0 AS y FROM s JOIN v_edges_raw a ON a.id=s.id AND a.rel_ord=0 JOIN v_edges_raw b ON b.id=s.id AND b.rel_ord=1 JOIN rc m0 ON m0.id=a.target_name JOIN rc m1 ON m1.id=b.target_name WHERE s.kind='cutter' AND (list_contains(s.sem, 'door') OR list_contains(s.sem, 'entrance'))", ROOM_PRIMS)
def door_midpoints(spark, sf_dir):
    doors = states(spark, sf_dir).filter("state_type = 'cutter'").filter(T.any_of(F.col("sem"), ("door", "entrance")))
    first = SRC.relation_rows(doors).filter("relation_type = 'CutFrom' and rel_ord < 2").select("src_id", "rel_ord", F.col("target_name").alias("id"))
    centers = _collected(spark, sf_dir).select("id", ((F.col("x0") + F.col("x1")) / 2.0 / 2.0).alias("cx"), ((F.col("y0") + F.col("y1")) / 2.0 / 2.0).alias("cy"))
    pair = first.join(centers, "id").groupBy("src_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("x"), F.sum("cy").alias("y"))
    return pair.filter("n = 2").select(F.col("src_id").alias("id"), "x", "y")


@query("SELECT id, min(room) AS room FROM (SELECT id, parent AS room FROM walk WHERE done) GROUP BY id", "walk AS (SELECT id, parent, parent_is_room AS done, 0 AS depth FROM v_relations UNION ALL SELECT w.id, r.parent, r.parent_is_room, w.depth+1 FROM walk w JOIN v_relations r ON r.id=w.parent WHERE NOT w.done AND w.depth < 40)")
def object_room_recursive(spark, sf_dir):
    return S.resolve_rooms(view(spark, sf_dir, "v_relations"))


@query("SELECT room, CAST(count(*) AS BIGINT) AS n_objects, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS objects FROM (SELECT DISTINCT id, room FROM walk WHERE done) GROUP BY room", "walk AS (SELECT id, parent AS room, parent_is_room AS done, 0 AS depth FROM v_relations UNION ALL SELECT w.id, r.parent, r.parent_is_room, w.depth+1 FROM walk w JOIN v_relations r ON r.id=w.room WHERE NOT w.done AND w.depth < 40)")
def room_members(spark, sf_dir):
    rooms = S.resolve_rooms(view(spark, sf_dir, "v_relations"))
    return rooms.groupBy("room").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("room", F.size("ids").cast("long").alias("n_objects"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("objects"))


@query(
    f"""SELECT concat('room:', coalesce(type,'unknown'), '/', id) AS label, 'rect' AS kind, 0 AS part_no, CAST(NULL AS DOUBLE) AS cx, CAST(NULL AS DOUBLE) AS cy, CAST(NULL AS DOUBLE) AS r, x0+3e-1 AS min_x, y0+3e-1 AS min_y, x1-3e-1 AS max_x, y1-3e-1 AS max_y FROM rc
    UNION ALL SELECT concat('rooms:', coalesce(type,'unknown')), CASE WHEN count(*) OVER (PARTITION BY type) > 1 THEN 'composite' ELSE 'rect' END, CAST(row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS INTEGER), NULL, NULL, NULL, x0+3e-1, y0+3e-1, x1-3e-1, y1-3e-1 FROM rc
    UNION ALL SELECT concat('object:', {pick(vocab.META_SKIP).replace('x IN', 'x NOT IN')}, '/', id), 'circle', 0, tx, ty, 15e-1, NULL, NULL, NULL, NULL FROM s WHERE kind='object' AND tx IS NOT NULL AND {pick(vocab.META_SKIP).replace('x IN', 'x NOT IN')} IS NOT NULL AND len(list_filter(sem, lambda x: x IN {words(vocab.SKIP_SEMANTICS)})) = 0""",
    ROOM_PRIMS,
)
def region_catalog(spark, sf_dir):
    objects = states(spark, sf_dir).filter("state_type = 'object'").withColumn("tx", T.translation(F.col("dof"), 0)).withColumn("ty", T.translation(F.col("dof"), 1))
    return S.region_catalog(_collected(spark, sf_dir), objects)


@query(f"SELECT s.id, CASE WHEN len(list_filter(sem, lambda x: x IN {words(vocab.SMALL_OBJECT_FUNCTIONS)}))>0 OR (p.x1-p.x0)*(p.y1-p.y0)*(p.z1-p.z0) < 125e-3 THEN 'center' WHEN list_contains(sem, 'furniture') THEN 'around' WHEN list_contains(sem, 'wall-decoration') THEN 'wall' END AS goal_kind, (p.x0+p.x1)/2e0 AS x, (p.y0+p.y1)/2e0 AS y FROM s JOIN v_prims p ON p.k=s.k WHERE s.kind='object'", S_ACTIVE)
def nav_points(spark, sf_dir):
    s = states(spark, sf_dir).filter("state_type = 'object'").withColumn("prim_path", F.concat(F.lit("/World/"), T.prim_name(F.col("obj")))).join(view(spark, sf_dir, "v_prims"), "prim_path")
    volume = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))
    return s.select("id", S.goal_kind(F.col("sem"), volume).alias("goal_kind"), ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))


WALL = "w AS (SELECT k, 5e-2 AS h1, 2e-1+1e-2*(k%20) AS h2, CASE WHEN k%3=0 THEN 3e0 ELSE 3e-1 END AS h3, -8e0+((k*37)%160)*1e-1 AS cx, -8e0+((k*61)%160)*1e-1 AS cy, 15e-1 AS cz, CASE WHEN k%2=0 THEN 1e0 ELSE -1e0 END AS turn FROM v_states WHERE kind='object' AND k%6=1), n AS (SELECT *, CASE WHEN h2>=h3 OR h3>1e0 THEN h2 ELSE h3 END AS half, CASE WHEN cx*turn > 0 THEN -1e0 ELSE 1e0 END AS sign FROM w)"


@query("SELECT k AS id, CAST(pt AS INTEGER) AS pt, round(cx+1e-1*sign*turn, 6)+0e0 AS x, round(cy+CASE WHEN pt=0 OR NOT (h3>1e0 OR h2>=h3) THEN 0e0 ELSE -half+(pt-1)*1e-1 END, 6)+0e0 AS y, round(cz+CASE WHEN pt=0 OR (h3>1e0 OR h2>=h3) THEN 0e0 ELSE (-half+(pt-1)*1e-1)*5e-1 END, 6)+0e0 AS z FROM n, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(2e0*half/1e-1) AS BIGINT))) AS pt)", WALL)
def wall_decoration_points(spark, sf_dir):
    s = view(spark, sf_dir, "v_states").filter("kind = 'object' and k % 6 = 1")
    k = F.col("k")
    turn = F.when(k % 2 == 0, 1.0).otherwise(-1.0)
    upright = F.when(k % 3 == 0, 3.0).otherwise(0.3)
    axis = lambda x, y, z: F.array(x, F.lit(y), z)
    third = F.when(k % 3 == 0, 1.0).otherwise(0.5)
    o = s.select(
        k.alias("id"), (F.lit(-8.0) + ((k * 37) % 160) * 0.1).alias("cx"), (F.lit(-8.0) + ((k * 61) % 160) * 0.1).alias("cy"), F.lit(1.5).alias("cz"), F.array(F.lit(0.05), 0.2 + 0.01 * (k % 20), upright).alias("h"),
        F.array(axis(turn, 0.0, F.lit(0.0)), axis(F.lit(0.0), 1.0, F.lit(0.0)), axis(F.lit(0.0), 0.0, third)).alias("axes"), *(F.lit(0.0).alias(c) for c in ("rx", "ry", "rz")),
    )
    return S.wall_points(o).select("id", "pt", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


@query("SELECT prim_path, greatest((x1-x0)/2e0, (y1-y0)/2e0) AS half FROM v_prims")
def object_half_extent(spark, sf_dir):
    return view(spark, sf_dir, "v_prims").select("prim_path", F.greatest((F.col("x1") - F.col("x0")) / 2.0, (F.col("y1") - F.col("y0")) / 2.0).alias("half"))


@query("SELECT prim_path, (x0+x1)/2e0 AS cx, (y0+y1)/2e0 AS cy, (z0+z1)/2e0 AS cz, (x1-x0)*(y1-y0)*(z1-z0) AS volume, x1-x0 AS ex, y1-y0 AS ey, z1-z0 AS ez FROM v_prims")
def bbox_metrics(spark, sf_dir):
    side = {a: F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"}
    return view(spark, sf_dir, "v_prims").select("prim_path", *(((F.col(f"{a}0") + F.col(f"{a}1")) / 2.0).alias(f"c{a}") for a in "xyz"), (side["x"] * side["y"] * side["z"]).alias("volume"), *(side[a].alias(f"e{a}") for a in "xyz"))


@query("SELECT id, greatest(1, CAST(trunc(3*CASE type WHEN 'living-room' THEN 2e0 WHEN 'kitchen' THEN 15e-1 WHEN 'dining-room' THEN 15e-1 WHEN 'bedroom' THEN 12e-1 WHEN 'office' THEN 12e-1 WHEN 'bathroom' THEN 6e-1 WHEN 'closet' THEN 4e-1 WHEN 'balcony' THEN 6e-1 ELSE 1e0 END*greatest(1e0, sqrt(area)/2e0)) AS INTEGER)) AS budget FROM rc", ROOM_PRIMS)
def room_wp_budget(spark, sf_dir):
    weight = F.create_map(*(F.lit(x) for pair in vocab.ROOM_WEIGHT.items() for x in pair))
    w = F.coalesce(F.try_element_at(weight, F.col("type")), F.lit(1.0))
    return _collected(spark, sf_dir).select("id", F.greatest(F.lit(1), (3 * w * F.greatest(F.lit(1.0), F.sqrt("area") / 2.0)).cast("int")).alias("budget"))
