"""Queries on identity, palettes and packaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import packaging as K
from ..operators import profiles as P
from . import geometry, matching
from .registry import Views, query

MORE = matching.MORE


def mint(prefix: str, *parts: str) -> str:
    return f"'{prefix}-' || left(sha256(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 32)"


@query(
    f"""SELECT workspace_id, ordinal, name, id AS old_id, CASE WHEN id <> '' AND row_number() OVER (PARTITION BY workspace_id, id ORDER BY ordinal) > 1
        THEN {mint('cp', 'workspace_id', 'id', 'ordinal')} ELSE id END AS new_id FROM v_palette""",
    "v_palette",
)
def duplicate_id_repair(v):
    return I.duplicate_id_repair(v("v_palette"))


@query(
    f"""SELECT workspace_id, ordinal, CASE WHEN id = '' THEN 'cp-' || name ELSE id END AS old_id, CASE WHEN id = '' THEN {mint('cp', 'workspace_id', 'name', 'ordinal')} ELSE id END AS new_id FROM v_palette""",
    "v_palette",
)
def mint_missing_ids(v):
    return I.mint_missing_ids(v("v_palette"))


@query(
    f"""SELECT project_uid, pos, CASE WHEN uid = '' OR row_number() OVER (PARTITION BY project_uid, uid ORDER BY pos) > 1 THEN {mint('file', 'project_uid', 'uid', 'pos')} ELSE uid END AS uid
        FROM (SELECT project_uid, ord AS pos, CASE WHEN pk % 13 = 0 THEN '' ELSE 'f-' || (pk % 5) END AS uid FROM v_inputs) q""",
    "v_inputs",
)
def ensure_unique_file_uids(v):
    files = v("v_inputs").select("project_uid", F.col("ord").alias("pos"), F.when(F.col("pk") % 13 == 0, "").otherwise(F.concat(F.lit("f-"), (F.col("pk") % 5).cast("string"))).alias("uid"))
    return I.ensure_unique_file_uids(files)


def signed_presets(v: Views):
    return P.preset_catalogue(v.spark).withColumn("signature", F.format_string("w%dh%d", "target_width", "slice_height"))


@query(
    f"""SELECT workspace_id, u.ordinal, u.id AS old_id,
               CASE WHEN p.id IS NOT NULL AND u.signature = 'w' || p.target_width || 'h' || p.slice_height THEN 'drop' WHEN p.id IS NOT NULL THEN 'renew'
                    WHEN n.id IS NOT NULL AND u.signature = 'w' || n.target_width || 'h' || n.slice_height THEN 'relink' ELSE 'keep' END AS action,
               CASE WHEN p.id IS NOT NULL AND u.signature <> 'w' || p.target_width || 'h' || p.slice_height THEN {mint('op', 'workspace_id', 'u.id', 'u.ordinal')}
                    WHEN p.id IS NULL AND n.id IS NOT NULL AND u.signature = 'w' || n.target_width || 'h' || n.slice_height THEN n.id ELSE u.id END AS new_id
        FROM v_user_outputs u LEFT JOIN presets p ON p.id = u.id LEFT JOIN presets n ON 'op-' || n.name = u.id""",
    "v_user_outputs", "presets", more=MORE,
)
def preset_migration(v):
    return I.preset_migration(v("v_user_outputs"), signed_presets(v))


@query(
    """SELECT project_uid, string_agg(CASE WHEN CAST(substr(id, 4) AS INT) % 7 = 0 THEN 'new-' || id ELSE id END, ',' ORDER BY prio) AS ids FROM v_links GROUP BY project_uid""",
    "v_links",
)
def relink_profile_ids(v):
    mapping = v("v_canvas_profiles").where("ordinal % 7 = 0").select(F.col("id").alias("old_id"), F.concat(F.lit("new-"), "id").alias("new_id"))
    lists = v("v_links").groupBy("project_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("prio", "id"))), lambda s: s["id"]).alias("ids"))
    return I.relink_profile_ids(lists, mapping).select("project_uid", F.array_join("ids", ",").alias("ids"))


@query(
    f"""SELECT workspace_id, id, name, 'existing' AS origin FROM v_user_outputs
        UNION ALL SELECT workspace_id, {mint('op', "'import'", 'workspace_id', 'id', 'ordinal')}, name, 'imported' FROM v_user_outputs WHERE ordinal % 2 = 0 AND id NOT IN (SELECT id FROM presets)""",
    "v_user_outputs", "presets", more=MORE,
)
def import_profiles(v):
    outs = v("v_user_outputs")
    return I.import_profiles(outs, outs.where("ordinal % 2 = 0"), P.preset_catalogue(v.spark), "op")


@query(
    f"""SELECT r.workspace_id, r.ordinal, CASE WHEN r.id = '' OR rn > 1 THEN {mint('cp', 'r.workspace_id', 'r.id', 'r.ordinal')} ELSE r.id END AS id, r.name, coalesce(t, '') AS templates
        FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, id ORDER BY ordinal) AS rn FROM (SELECT * FROM v_palette WHERE k % 8 <> 0) q) r
        LEFT JOIN (SELECT workspace_id, id, arg_min('t' || ordinal, ordinal) AS t FROM v_palette WHERE id <> '' AND k % 3 <> 0 GROUP BY workspace_id, id) c ON c.workspace_id = r.workspace_id AND c.id = r.id""",
    "v_palette",
)
def merge_palettes(v):
    current = v("v_palette").where("k % 3 <> 0").withColumn("templates", F.concat(F.lit("t"), F.col("ordinal").cast("string")))
    return I.merge_palettes(current, v("v_palette").where("k % 8 <> 0"), P.preset_catalogue(v.spark))


@query(
    """SELECT workspace_id, ordinal, bool_or(NOT (s OR m OR c OR d)) AS duplicate,
              CASE WHEN bool_or(NOT (s OR m OR c OR d)) THEN '' ELSE concat_ws(',', CASE WHEN bool_or(s) THEN 'size' END, CASE WHEN bool_or(m) THEN 'margins' END,
                   CASE WHEN bool_or(c) THEN 'colours' END, CASE WHEN bool_or(d) THEN 'dpi' END) END AS differs
       FROM (SELECT a.workspace_id, a.ordinal, a.width <> b.width OR a.height <> b.height AS s, a.margin <> b.margin AS m, a.colour <> b.colour AS c, a.dpi <> b.dpi AS d
             FROM v_palette a JOIN v_palette b ON a.workspace_id = b.workspace_id AND lower(a.name) = lower(b.name) AND a.ordinal <> b.ordinal) q GROUP BY workspace_id, ordinal""",
    "v_palette",
)
def distinguish_profiles(v):
    return P.distinguish_profiles(v("v_palette"))


@query(
    """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.height <> b.height OR a.name <> b.name THEN 'changed' ELSE 'template' END AS change
       FROM (SELECT id, name, height + CASE WHEN ordinal % 7 = 0 THEN 1 ELSE 0 END AS height, ordinal % 4 AS t FROM v_canvas_profiles WHERE ordinal % 6 <> 0) a
       FULL JOIN (SELECT id, name, height, ordinal % 2 AS t FROM v_canvas_profiles WHERE ordinal % 5 <> 0) b ON a.id = b.id
       WHERE a.id IS NULL OR b.id IS NULL OR a.height <> b.height OR a.name <> b.name OR a.t <> b.t""",
    "v_canvas_profiles",
)
def meta_changes(v):
    c, o = v("v_canvas_profiles"), F.col("ordinal")
    after = c.where("ordinal % 6 <> 0").withColumns({"height": F.col("height") + (o % 7 == 0).cast("int"), "t": o % 4})
    before = c.where("ordinal % 5 <> 0").withColumn("t", o % 2)
    return P.meta_changes(before, after, ["name", "height"], "t")


@query(
    """SELECT t.id, t.format, coalesce(s.l, '') AS shared_with, coalesce(d.n, 0) AS n_differences FROM v_templates t
       LEFT JOIN (SELECT a.id, string_agg(DISTINCT b.id, ',' ORDER BY b.id) AS l FROM v_templates a JOIN v_templates b ON lower(a.path) = lower(b.path) AND a.id <> b.id GROUP BY a.id) s ON s.id = t.id
       LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT id, was, unnest(string_split(now, ';')) AS p FROM v_templates) q
                  WHERE split_part(p, '=', 2) <> coalesce(regexp_extract(';' || was || ';', ';' || split_part(p, '=', 1) || '=([^;]*);', 1), '') GROUP BY id) d ON d.id = t.id""",
    "v_templates",
)
def template_check(v):
    return P.template_check(v("v_templates"))


@query(
    """SELECT 'link' AS kind, project_uid AS owner, id AS missing_id FROM v_links l WHERE id NOT IN (SELECT id FROM v_canvas_profiles WHERE ordinal % 20 <> 3)
       UNION ALL SELECT 'anchor', project_uid, anchor_input_uid FROM v_overlays o WHERE anchor_input_uid <> '' AND NOT EXISTS (SELECT 1 FROM v_inputs i WHERE i.project_uid = o.project_uid AND i.uid = o.anchor_input_uid AND pk % 6 <> 0)
       UNION ALL SELECT 'exclusion', project_uid, uid FROM v_exclusions e WHERE NOT EXISTS (SELECT 1 FROM v_inputs i WHERE i.project_uid = e.project_uid AND i.uid = e.uid AND pk % 6 <> 0)""",
    "v_links", "v_canvas_profiles", "v_overlays", "v_exclusions", "v_inputs",
)
def dangling_references(v):
    return I.dangling_references(v("v_links"), v("v_overlays"), v("v_exclusions"), v("v_canvas_profiles").where("ordinal % 20 <> 3"), v("v_inputs").where("pk % 6 <> 0"))


@query(
    """SELECT 'canvas' AS kind, id, name, width - ml - mr AS width, height - mt - mb AS height, '' AS ext, 'user' AS tag FROM v_canvas_profiles
       UNION ALL SELECT 'output', project_uid || '/' || id, id, target_width, slice_height, CASE format WHEN 'PNG' THEN '.png' WHEN 'JPEG' THEN '.jpg' ELSE '.webp' END, 'user' FROM profiled
       UNION ALL SELECT 'output', id, name, target_width, slice_height, CASE format WHEN 'PNG' THEN '.png' WHEN 'JPEG' THEN '.jpg' ELSE '.webp' END, 'preset' FROM presets""",
    "v_canvas_profiles", "profiled", "presets", more=MORE | geometry.MORE,
)
def list_profiles(v):
    user = geometry.profiled(v).withColumns({"name": F.col("id"), "id": F.concat_ws("/", "project_uid", "id")})
    return P.list_profiles(v("v_canvas_profiles"), user, P.preset_catalogue(v.spark))


@query(
    """SELECT 'kept' AS outcome, name, id FROM v_canvas_profiles WHERE name IN (SELECT trim(w) FROM (SELECT unnest(string_split(l, ',')) AS w FROM wanted) q)
       UNION ALL SELECT 'unmatched', trim(w), '' FROM (SELECT unnest(string_split(l, ',')) AS w FROM wanted) q WHERE trim(w) <> '' AND trim(w) NOT IN (SELECT name FROM v_canvas_profiles)""",
    "v_canvas_profiles", "wanted", more={"wanted": "SELECT string_agg(name, ' , ' ORDER BY id) || ', no such name,' AS l FROM {v_canvas_profiles} WHERE ordinal % 10 = 3"},
)
def only_names_filter(v):
    """Profiles of a comma list of names (every tenth profile's and one that none has), and the names that matched none."""
    palette = v("v_canvas_profiles")
    asked = palette.where("ordinal % 10 = 3").select("name").unionByName(v.spark.sql("SELECT ' no such name ' AS name"))
    kept, unmatched = P.only_names(palette, asked)
    kept = kept.select(F.lit("kept").alias("outcome"), "name", "id")
    return kept.unionByName(unmatched.select(F.lit("unmatched").alias("outcome"), "name", F.lit("").alias("id")))


@query(
    """SELECT workspace_id, count(*) AS n_profiles, string_agg(id, ',' ORDER BY ordinal) AS ids FROM v_user_outputs WHERE id NOT IN (SELECT id FROM presets) GROUP BY workspace_id""",
    "v_user_outputs", "presets", more=MORE,
)
def export_profiles(v):
    from ..sources.documents import profile_bundles

    bundles = profile_bundles(v("v_user_outputs"), P.preset_catalogue(v.spark))
    return bundles.select("workspace_id", F.size("profiles").cast("long").alias("n_profiles"), F.array_join(F.transform("profiles", lambda p: p["id"]), ",").alias("ids"))


RAW = """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 9 = 0 THEN '800 by 1280' ELSE CAST(o_orderkey % 3000 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'X' END || CAST(o_custkey AS STRING) END AS size,
                CAST(o_custkey % 40 AS STRING) || ',8,' || CAST(o_orderkey % 9 - 1 AS STRING) || ',8' AS margins,
                CAST(o_custkey % 400 AS STRING) || ',10,-5' || CASE WHEN o_orderkey % 4 = 0 THEN ',128' ELSE '' END AS colour,
                CASE o_orderkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'webp' ELSE 'gif' END AS format,
                CASE WHEN o_orderkey % 11 = 0 THEN '-1' ELSE '72.5' END AS dpi FROM {orders}"""


@query(
    """SELECT key, CASE WHEN ok THEN TRY_CAST(split_part(lower(size), 'x', 1) AS BIGINT) END AS width, CASE WHEN ok THEN TRY_CAST(split_part(lower(size), 'x', 2) AS BIGINT) END AS height,
              least(255, greatest(0, CAST(split_part(colour, ',', 1) AS BIGINT))) AS red, least(255, greatest(0, CAST(split_part(colour, ',', 3) AS BIGINT))) AS blue,
              CASE WHEN split_part(colour, ',', 4) = '' THEN 255 ELSE CAST(split_part(colour, ',', 4) AS BIGINT) END AS alpha,
              CASE lower(format) WHEN 'png' THEN 'PNG' WHEN 'jpg' THEN 'JPEG' WHEN 'jpeg' THEN 'JPEG' WHEN 'webp' THEN 'WebP' END AS format,
              CASE WHEN NOT ok THEN 'size' WHEN CAST(split_part(margins, ',', 3) AS BIGINT) < 0 THEN 'margins' WHEN lower(format) = 'gif' THEN 'format' WHEN dpi = '-1' THEN 'dpi' ELSE '' END AS reject_reason
       FROM (SELECT *, regexp_matches(lower(size), '^[0-9]+x[0-9]+$') AND split_part(lower(size), 'x', 1) <> '0' AND split_part(lower(size), 'x', 2) <> '0' AS ok FROM raw_rows) q""",
    "raw_rows", more={"raw_rows": RAW},
)
def ingest_profile_definitions(v):
    from ..sources.documents import parse_profile_definitions

    raw = v.spark.sql(RAW, orders=v("orders"))
    return parse_profile_definitions(raw).select("key", "width", "height", "red", "blue", "alpha", "format", "reject_reason")


PACK = {
    "refs": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws, lower(source) ORDER BY seq, source) AS k FROM {v_refs}) q WHERE k = 1",
    "v_refs": "SELECT ws, min(seq) AS seq, source, min(kind) AS kind, any_value(folder) AS folder, bool_and(present) AS present, CAST(max(bytes) AS BIGINT) AS bytes FROM {v_references} GROUP BY ws, source",
    "claimed": """SELECT *, row_number() OVER (PARTITION BY ws, dir, lower(name) ORDER BY inside DESC, seq, source) AS n FROM (
                    SELECT *, regexp_extract(source, '[^/]*$') AS name,
                           CASE WHEN inside THEN regexp_replace(substr(source, length(folder) + 1), '[^/]*$', '') ELSE kind || '/' END AS dir
                    FROM (SELECT *, starts_with(source, folder) AS inside FROM {refs}) a) b""",
    "plan": """SELECT ws, source, dir || CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || ' (' || n || ')' || regexp_extract(name, '\\.[^.]*$') END AS target,
                      NOT present AS missing, bytes, present FROM {claimed}""",
}


def references(v: Views):
    """One row for each spelling of a path, as several pages may name it."""
    r = v("v_references")
    return r.groupBy("ws", "source").agg(
        F.min("seq").alias("seq"), F.min("kind").alias("kind"), F.min("folder").alias("folder"),
        F.bool_and("present").alias("present"), F.max(F.col("bytes").cast("long")).alias("bytes"),
    )


@query("SELECT ws, source, target, missing FROM plan", "plan", more=PACK)
def package_plan(v):
    return K.package_plan(references(v))


@query("SELECT ws, source, target FROM plan", "plan", more=PACK)
def package_target_claim(v):
    return K.package_target_claim(K.distinct_references(references(v))).select("ws", "source", "target")


@query(
    """SELECT ws, target, 'unsafe' AS problem FROM bent WHERE target = '' OR target LIKE '/%' OR target LIKE '../%' OR target LIKE '%/../%'
       UNION ALL SELECT ws, lower(target), 'clash' FROM bent GROUP BY ws, lower(target) HAVING count(*) > 1""",
    "bent", more=PACK | {"bent": "SELECT ws, CASE WHEN bytes % 10 = 0 THEN '../' || target WHEN bytes % 10 = 1 THEN '/' || target WHEN bytes % 10 = 2 THEN 'inputs/one.png' ELSE target END AS target FROM {plan}"},
)
def package_plan_check(v):
    b = F.col("bytes") % 10
    plan = K.package_target_claim(K.distinct_references(references(v)))
    bent = F.when(b == 0, F.concat(F.lit("../"), "target")).when(b == 1, F.concat(F.lit("/"), "target")).when(b == 2, "inputs/one.png").otherwise(F.col("target"))
    return K.package_plan_check(plan.select("ws", bent.alias("target")))


@query(
    """SELECT ws, entry, 'not a file' AS problem FROM entries WHERE NOT is_file
       UNION ALL SELECT ws, entry, 'unsafe' FROM entries WHERE entry LIKE '%..%' OR entry LIKE '/%'
       UNION ALL SELECT ws, lower(entry), 'repeated' FROM entries GROUP BY ws, lower(entry) HAVING count(*) > 1
       UNION ALL SELECT ws, '', 'no manifest' FROM entries GROUP BY ws HAVING NOT bool_or(entry = 'manifest.json')
       UNION ALL SELECT ws, '', 'no workspace file' FROM entries GROUP BY ws HAVING NOT bool_or(entry LIKE '%.workspace.json' AND entry NOT LIKE '%/%')""",
    "entries", more={"entries": """SELECT ws, CASE WHEN seq % 97 = 0 THEN 'manifest.json' WHEN seq % 89 = 0 THEN 'a.workspace.json' WHEN seq % 83 = 0 THEN '../up.png' ELSE substr(source, 2) END AS entry,
                                       seq % 71 <> 0 AS is_file FROM {v_references}"""},
)
def package_entry_audit(v):
    s = F.col("seq")
    entry = F.when(s % 97 == 0, "manifest.json").when(s % 89 == 0, "a.workspace.json").when(s % 83 == 0, "../up.png").otherwise(F.expr("substr(source, 2)"))
    return K.package_entry_audit(v("v_references").select("ws", entry.alias("entry"), (s % 71 != 0).alias("is_file")))


@query(
    """SELECT d.ws, coalesce(n, 0) AS n_files, CAST(coalesce(b, 0) + 1000 AS BIGINT) AS bytes FROM (SELECT DISTINCT ws FROM v_references) d
       LEFT JOIN (SELECT ws, count(*) AS n, sum(bytes) AS b FROM plan WHERE present GROUP BY ws) p ON p.ws = d.ws""",
    "plan", "v_references", more=PACK,
)
def package_totals(v):
    documents = v("v_references").select("ws").distinct().withColumn("document_bytes", F.lit(1000).cast("long"))
    return K.package_totals(references(v), documents)


@query("SELECT project_uid, uid, ord, 'Pending' AS status, '' AS sha256, '' AS contributes_to FROM v_inputs", "v_inputs")
def package_workspace_copy(v):
    return K.package_workspace_copy(v("v_inputs"), v("v_overlays"))[0]


@query(
    """SELECT ws, target, target = '' OR contains(target, chr(92)) OR target LIKE '/%' OR list_contains(string_split(target, '/'), '..') AS unsafe
       FROM (SELECT ws, CASE seq % 5 WHEN 0 THEN source WHEN 1 THEN substr(source, 2) WHEN 2 THEN 'a/../' || substr(source, 2) WHEN 3 THEN 'a' || chr(92) || 'b' ELSE 'a..b/c' END AS target FROM v_references) q""",
    "v_references",
)
def unsafe_target(v):
    s = F.col("seq") % 5
    target = F.when(s == 0, F.col("source")).when(s == 1, F.expr("substr(source, 2)")).when(s == 2, F.concat(F.lit("a/../"), F.expr("substr(source, 2)"))).when(s == 3, "a\\b").otherwise("a..b/c")
    return v("v_references").select("ws", target.alias("target")).withColumn("unsafe", K.unsafe_target(F.col("target")))
