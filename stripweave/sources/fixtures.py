"""Catalogue views derived from the driver's tables, in SQL that Spark and DuckDB share.

Names in braces are tables or other views. ``view`` gives a view as a DataFrame; ``cte`` gives the
WITH clause for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "v_projects": """
        SELECT 'proj-' || CAST(o_orderkey AS STRING) AS project_uid,
               CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'op-' || CAST(o_orderkey % 4 AS STRING) END AS output_profile_id,
               o_orderkey % 3 = 0 AS accepts_all, o_orderkey AS k,
               o_orderkey % (SELECT CAST(floor((max(p_partkey) - 1) / 100.0) AS BIGINT) + 1 FROM {part}) AS ws
        FROM {orders}""",
    "v_inputs": """
        SELECT 'proj-' || CAST(k AS STRING) AS project_uid,
               'file-' || CAST(k AS STRING) || '-' || CAST(ord AS STRING) AS uid,
               '/in/' || CAST(k AS STRING) || '/p' || CAST(ord AS STRING) || '.png' AS file_path,
               ord, 800 * (1 + pk % 3) AS width, 128 * q AS height,
               CASE WHEN sk % 13 = 0 THEN 'Missing' WHEN pk % 17 = 0 THEN 'Pending' ELSE 'Processed' END AS status,
               sha2(CAST(pk AS STRING), 256) AS sha256, pk, sk
        FROM (SELECT l_orderkey AS k, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q,
                     CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                             l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS BIGINT) AS ord
              FROM {lineitem}) t""",
    # a workspace has a palette of a hundred canvas profiles
    "v_canvas_profiles": """
        SELECT 'cp-' || CAST(p_partkey AS STRING) AS id, p_partkey AS ordinal, p_name AS name,
               800 * (1 + p_partkey % 3) AS width, 128 * p_size AS height,
               8 * (p_partkey % 4) AS mt, 8 * (p_partkey % 3) AS mr, 8 * (p_partkey % 5) AS mb, 8 * (p_partkey % 2) AS ml,
               CAST(floor((p_partkey - 1) / 100.0) AS BIGINT) AS ws
        FROM {part}""",
    "v_links": """
        SELECT project_uid, id, row_number() OVER (PARTITION BY project_uid ORDER BY ordinal DESC) AS prio
        FROM {v_projects} o JOIN {v_canvas_profiles} c ON c.ws = o.ws AND c.ordinal % 5 = o.k % 5
        WHERE NOT accepts_all""",
    "v_overlays": """
        SELECT 'ovl-' || CAST(event_id AS STRING) AS uid, 'proj-' || CAST(event_id % 500 AS STRING) AS project_uid,
               event_id AS z,
               CASE WHEN user_id % 7 = 0 THEN ''
                    ELSE 'file-' || CAST(event_id % 500 AS STRING) || '-' || CAST(event_id % 5 AS STRING) END AS anchor_input_uid,
               CAST(user_id % 100 AS DOUBLE) / 100 AS x_frac, value / 100 AS y_frac, CAST(event_id % 4 AS DOUBLE) / 10 AS w_frac,
               event_type <> 'error' AS enabled, event_type AS kind, 240 AS asset_w, 160 AS asset_h,
               CASE WHEN event_id % 11 = 0 THEN '' ELSE '/art/' || CAST(event_id % 37 AS STRING) || '.png' END AS asset_path,
               CASE WHEN event_id % 6 = 0 THEN '' ELSE sha2(CAST(event_id % 37 AS STRING), 256) END AS sha256,
               CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 4 ELSE 5 END AS blend
        FROM {events}""",
    "v_scan_old": """
        SELECT source AS project_uid, '/scan/' || source || '/' || CAST(doc_id AS STRING) AS file_path,
               sha2(text, 256) AS sha256, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS ord,
               'old-' || CAST(doc_id AS STRING) AS uid
        FROM {documents} WHERE doc_id % 10 < 8""",
    "v_scan_new": """
        SELECT source AS project_uid,
               CASE WHEN doc_id % 4 = 0 THEN '/moved/' ELSE '/scan/' END || source || '/' || CAST(doc_id AS STRING) AS file_path,
               sha2(text, 256) AS sha256, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS ord
        FROM {documents} WHERE doc_id % 10 <> 3""",
    "v_pixels": """
        SELECT l_orderkey AS image_uid, l_partkey % 64 AS x, l_suppkey % 64 AS y,
               max(l_partkey % 256) AS r, max(l_suppkey % 256) AS g, max(l_orderkey % 256) AS b, max(l_linenumber * 36) AS a
        FROM {lineitem} GROUP BY l_orderkey, l_partkey % 64, l_suppkey % 64""",
    "v_output_profiles": """
        SELECT id, ordinal, name, target_width, slice_height, policy, format, start_index, CAST(dpi AS DOUBLE) AS dpi,
               jpeg_quality, png_compression, webp_quality, webp_lossless
        FROM (VALUES ('op-1', 1, 'Plain', 800, 1280, 'KeepAsIs', 'JPEG', 1, 72.0, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BOOLEAN)),
                              ('op-2', 2, 'Wide', 940, 1504, 'Crop', 'PNG', 5, 72.5, 85, 9, NULL, false),
                              ('op-3', 3, 'Print', 1200, 1600, 'PadWhite', 'WebP', 998, 300.0, NULL, NULL, 75, true))
               AS t(id, ordinal, name, target_width, slice_height, policy, format, start_index, dpi, jpeg_quality, png_compression, webp_quality, webp_lossless)""",
    # a file may have a check against an older recorded hash besides that of today
    "v_disk_checks": """
        SELECT project_uid, file_path, pk % 11 <> 0 AS found,
               CASE WHEN ord = 6 THEN sha2('older', 256) ELSE sha256 END AS recorded_sha256,
               CASE WHEN pk % 11 = 0 THEN '' WHEN sk % 7 = 0 THEN sha2(CAST(sk AS STRING), 256) ELSE sha256 END AS disk_sha256
        FROM {v_inputs} WHERE pk % 10 <> 9
        UNION ALL
        SELECT project_uid, file_path, pk % 5 <> 0, sha2('before' || CAST(pk AS STRING), 256), CASE WHEN pk % 5 = 0 THEN '' ELSE sha2('before' || CAST(pk AS STRING), 256) END
        FROM {v_inputs} WHERE pk % 4 = 1""",
    "v_conversation_strips": """
        SELECT CAST(conv_id AS STRING) AS project_uid, CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS uid,
               CAST(turn AS BIGINT) AS ord, 800 AS width, CAST(length(text) AS BIGINT) AS height, 'Processed' AS status
        FROM {conversations}""",
    "v_grades": """
        SELECT 'proj-' || CAST(o_orderkey AS STRING) AS project_uid, CAST(o_orderkey % 5 - 2 AS DOUBLE) / 10 AS brightness,
               1 + CAST(o_orderkey % 3 - 1 AS DOUBLE) / 10 AS contrast, 1 + CAST(o_orderkey % 7 - 3 AS DOUBLE) / 10 AS saturation,
               o_orderkey AS k
        FROM {orders}""",
    "v_curve_points": """
        SELECT 'proj-' || CAST(o_orderkey AS STRING) AS project_uid, channel, seq, CAST(x AS DOUBLE) AS x,
               CAST(y AS DOUBLE) + CASE WHEN seq = 1 THEN CAST(o_orderkey % 3 AS DOUBLE) / 10 ELSE 0 END AS y
        FROM {orders} CROSS JOIN (VALUES ('m', 0, 0.0, 0.0), ('m', 1, 0.5, 0.4), ('m', 2, 1.0, 1.0),
                                         ('r', 0, 1.0, 0.9), ('r', 1, 0.25, 0.2), ('b', 1, 0.75, 0.7)) AS t(channel, seq, x, y)
        WHERE o_orderkey % 4 <> 0 AND (channel <> 'r' OR o_orderkey % 2 = 1)""",
    # what the last run recorded: altered copies of the tables above
    "v_projects_then": """
        SELECT project_uid, CASE WHEN k % 10 = 1 THEN 'op-2' ELSE output_profile_id END AS output_profile_id, k, ws FROM {v_projects} WHERE k % 5 <> 0""",
    "v_output_profiles_then": """
        SELECT id, ordinal, name, target_width, CASE WHEN id = 'op-3' THEN slice_height + 100 ELSE slice_height END AS slice_height, policy, format, start_index, dpi,
               jpeg_quality, CASE WHEN id = 'op-2' THEN 6 ELSE png_compression END AS png_compression, webp_quality, webp_lossless
        FROM {v_output_profiles}""",
    "v_canvas_profiles_then": """
        SELECT id, ordinal, name, width, CASE WHEN ordinal % 11 = 0 THEN height + 128 ELSE height END AS height,
               CASE WHEN ordinal % 25 = 0 THEN mt + 8 ELSE mt END AS mt, mr, mb, ml, ws
        FROM {v_canvas_profiles} WHERE ordinal % 40 <> 7""",
    "v_links_then": """
        SELECT project_uid, id, CASE WHEN CAST(substr(id, 4) AS BIGINT) % 41 = 0 THEN prio + 100 ELSE prio END AS prio FROM {v_links}""",
    "v_pages_then": """
        SELECT project_uid, uid, CASE WHEN pk % 37 = 0 THEN 0 ELSE width END AS width_then, CASE WHEN pk % 37 = 0 THEN 0 ELSE height END AS height_then FROM {v_inputs}""",
    "v_order_then": """
        SELECT project_uid, uid, CASE WHEN pk % 50 = 0 THEN -1 ELSE ord END AS pos, ord FROM {v_inputs} WHERE pk % 40 <> 1""",
    "v_grades_then": """
        SELECT project_uid, CASE WHEN k % 8 = 2 THEN brightness + CAST(0.05 AS DOUBLE) ELSE brightness END AS brightness, contrast, saturation, k FROM {v_grades}""",
    "v_overlays_then": "SELECT * FROM {v_overlays} WHERE z % 17 <> 0",
    "v_page_files": """
        SELECT project_uid, uid, file_path, ord, width, height, pk, sk, CASE WHEN pk % 19 = 0 THEN 'Error' WHEN pk % 23 = 0 THEN 'Skipped' ELSE status END AS status,
               CASE WHEN pk % 29 = 0 THEN '' ELSE sha256 END AS sha256
        FROM {v_inputs}""",
    "v_exclusions": "SELECT project_uid, uid FROM {v_inputs} WHERE pk % 9 = 0",
    "v_templates": """
        SELECT 'cp-' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'PNG' ELSE 'PSD' END AS format,
               '/tpl/' || CAST(CAST(floor((p_partkey - 1) / 100.0) AS BIGINT) AS STRING) || '/' || CASE WHEN p_partkey % 10 = 0 THEN 'Shared' ELSE 't' || CAST(p_partkey % 40 AS STRING) END || '.png' AS path,
               'cw=' || CAST(800 * (1 + p_partkey % 3) AS STRING) || ';ch=' || CAST(128 * (p_size + p_partkey % 2) AS STRING) || ';mt=' || CAST(8 * (p_partkey % 4) AS STRING) AS was,
               'cw=' || CAST(800 * (1 + p_partkey % 3) AS STRING) || ';ch=' || CAST(128 * p_size AS STRING) || ';mt=' || CAST(8 * (p_partkey % 7) AS STRING) || ';fmt=' || CAST(p_partkey % 2 AS STRING) AS now,
               sha2(CAST(p_partkey % 40 AS STRING), 256) AS sha256, p_partkey AS k
        FROM {part}""",
    "v_palette": """
        SELECT 'ws-' || CAST(CAST(floor((p_partkey - 1) / 100.0) AS BIGINT) AS STRING) AS workspace_id, p_partkey AS ordinal,
               CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'cp-' || CAST(p_partkey % 50 AS STRING) END AS id,
               CASE WHEN p_partkey % 6 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS name,
               800 * (1 + p_partkey % 3) AS width, 128 * p_size AS height, 8 * (p_partkey % 4) AS margin,
               p_partkey % 2 AS colour, CAST(CASE WHEN p_partkey % 3 = 0 THEN 300 ELSE 72 END AS DOUBLE) AS dpi, p_partkey AS k
        FROM {part}""",
    "v_user_outputs": """
        SELECT 'ws-' || CAST(CAST(floor((p_partkey - 1) / 100.0) AS BIGINT) AS STRING) AS workspace_id, p_partkey AS ordinal,
               CASE WHEN p_partkey % 9 = 0 THEN 'op-preset-webtoon-standard' WHEN p_partkey % 9 = 1 THEN 'op-Webtoon Standard'
                    ELSE 'op-' || CAST(p_partkey AS STRING) END AS id,
               CASE WHEN p_partkey % 2 = 0 THEN 'w800h1280' ELSE 'w' || CAST(p_size AS STRING) || 'h1280' END AS signature,
               p_name AS name
        FROM {part}""",
    "v_references": """
        SELECT 'ws-' || CAST(l_orderkey % 50 AS STRING) AS ws, l_orderkey * 10 + l_linenumber AS seq,
               CASE WHEN l_partkey % 5 = 0 THEN '/ws/' || CAST(l_orderkey % 50 AS STRING) || '/in/' ELSE '/src/' || CAST(l_suppkey % 3 AS STRING) || '/' END
                 || CASE WHEN l_suppkey % 11 = 0 THEN 'scan' WHEN l_partkey % 2 = 0 THEN 'Page' ELSE 'page' END || CAST(l_partkey % 40 AS STRING)
                 || CASE WHEN l_suppkey % 11 = 0 THEN ' (3).png' ELSE '.png' END AS source,
               CASE WHEN l_linenumber % 4 = 0 THEN 'external' ELSE 'inputs' END AS kind,
               '/ws/' || CAST(l_orderkey % 50 AS STRING) || '/' AS folder,
               l_partkey % 13 <> 0 AS present, l_quantity AS bytes
        FROM {lineitem}""",
}


def _inputs(lineitem: DataFrame) -> DataFrame:
    """``v_inputs``, dealt by project before pages are numbered, so what joins or sums by project shuffles no page again.

    The SQL orders ties by four columns more. Rows that agree in these four make the same page at either number, so the others are not dealt.
    """
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = lineitem.select(F.concat(F.lit("proj-"), F.col("l_orderkey").cast("string")).alias("project_uid"), *order)
    k, pk, sk = F.substr("project_uid", F.lit(6)), F.col("l_partkey"), F.col("l_suppkey")
    rows = rows.withColumn("ord", (F.row_number().over(Window.partitionBy("project_uid").orderBy(*order)) - 1).cast("long"))
    at = F.col("ord").cast("string")
    status = F.when(sk % 13 == 0, "Missing").when(pk % 17 == 0, "Pending").otherwise("Processed")
    return rows.select(
        "project_uid", F.concat(F.lit("file-"), k, F.lit("-"), at).alias("uid"), F.concat(F.lit("/in/"), k, F.lit("/p"), at, F.lit(".png")).alias("file_path"), "ord",
        (800 * (1 + pk % 3)).alias("width"), (128 * F.col("l_quantity").cast("long")).alias("height"), status.alias("status"), F.sha2(pk.cast("string"), 256).alias("sha256"), pk.alias("pk"), sk.alias("sk"),
    )


def _links(v_projects: DataFrame, v_canvas_profiles: DataFrame) -> DataFrame:
    """``v_links``: the links of a workspace and remainder are ranked once, and a project takes them as one list, dealt before it is unrolled."""
    ranked = F.sort_array(F.collect_list(F.struct("ordinal", "id")), asc=False)
    lists = v_canvas_profiles.groupBy("ws", (F.col("ordinal") % 5).alias("r")).agg(F.transform(ranked, lambda s: s["id"]).alias("ids"))
    # a project that is listed n times has each of its links n times, all numbered
    some = v_projects.where("NOT accepts_all").groupBy("project_uid", "ws", (F.col("k") % 5).alias("r")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    ids = F.when(F.col("n") == 1, F.col("ids")).otherwise(F.flatten(F.transform("ids", lambda i: F.array_repeat(i, F.col("n")))))
    own = some.join(lists, ["ws", "r"]).select("project_uid", ids.alias("ids")).repartition("project_uid")
    return own.select("project_uid", F.posexplode("ids").alias("pos", "id")).select("project_uid", "id", (F.col("pos") + 1).alias("prio"))


def _disk_checks(v_inputs: DataFrame) -> DataFrame:
    """``v_disk_checks``: the checks of a page beside each other, so pages are read once."""
    pk, sk, before = F.col("pk"), F.col("sk"), F.sha2(F.concat(F.lit("before"), F.col("pk").cast("string")), 256)
    recorded = F.when(F.col("ord") == 6, F.sha2(F.lit("older"), 256)).otherwise(F.col("sha256"))
    disk = F.when(pk % 11 == 0, "").when(sk % 7 == 0, F.sha2(sk.cast("string"), 256)).otherwise(F.col("sha256"))
    today = F.struct((pk % 11 != 0).alias("found"), recorded.alias("recorded_sha256"), disk.alias("disk_sha256"))
    older = F.struct((pk % 5 != 0).alias("found"), before.alias("recorded_sha256"), F.when(pk % 5 == 0, "").otherwise(before).alias("disk_sha256"))
    both = F.array(F.when(pk % 10 != 9, today), F.when(pk % 4 == 1, older))  # as compiled code, which an array without its nulls is not
    return v_inputs.select("project_uid", "file_path", F.explode(both).alias("c")).where("c IS NOT NULL").select("project_uid", "file_path", "c.*")


def pages_and_then(v_page_files: DataFrame) -> DataFrame:
    """``v_page_files`` with the sizes of ``v_pages_then`` beside them, so that pages are read once and not joined with themselves."""
    known = F.col("pk") % 37 != 0
    return v_page_files.withColumns({f"{c}_then": F.when(known, F.col(c)).otherwise(0) for c in ("width", "height")})


#: Views that Spark builds by these functions, with the rows of their SQL, from the tables and views that the SQL names.
BUILT: dict[str, Callable[..., DataFrame]] = {"v_inputs": _inputs, "v_disk_checks": _disk_checks, "v_links": _links}


def view(spark: SparkSession, sf_dir: str, name: str, made: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A table or derived view as a DataFrame; ``made`` gives the views it stands on."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    made = made or (lambda n: view(spark, sf_dir, n))
    names = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    if name in BUILT:
        return BUILT[name](**{n: made(n) for n in names})
    return spark.sql(VIEWS[name], **{n: made(n) for n in names})


def duck(sql: str) -> str:
    """Spark's spelling of a shared statement in DuckDB's."""
    return re.sub(r"sha2\(((?:[^()]|\([^()]*\))+), 256\)", r"sha256(\1)", sql)


def cte(*names: str, more: dict[str, str] | None = None) -> str:
    """``WITH`` clause that defines the named views, those of ``more`` included, in order of need."""
    all_views = VIEWS | (more or {})
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done or name in TABLES:
            return
        for n in re.findall(r"\{([a-z]\w*)\}", all_views[name]):
            need(n)
        done[name] = duck(re.sub(r"\{([a-z]\w*)\}", r"\1", all_views[name])).strip()

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n"
