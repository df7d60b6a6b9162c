"""Queries on layout, slices and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import layout as L
from .registry import Views, query

WIDTH, HEIGHT = 800, 1280

MORE = {
    "scaled": "SELECT *, CAST(greatest(1, floor(height * 800.0 / width + 0.5)) AS BIGINT) AS h FROM {v_inputs} WHERE status <> 'Missing'",
    "layout": """SELECT *, CAST(coalesce(sum(h) OVER (PARTITION BY project_uid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_y
                 FROM {scaled}""",
    "totals": "SELECT project_uid, CAST(sum(h) AS BIGINT) AS total_height, count(*) AS n_pages FROM {layout} GROUP BY project_uid",
    "idx": "SELECT unnest(range(0, (SELECT CAST(max(total_height) AS BIGINT) // 1280 + 1 FROM {totals}))) AS idx",
    "seg": """SELECT project_uid, uid, ord AS seq, CAST(i.idx AS BIGINT) AS slice_index, file_path, status, sha256,
                     CAST(greatest(start_y, i.idx * 1280) - start_y AS BIGINT) AS source_y,
                     CAST(least(start_y + h, (i.idx + 1) * 1280) - greatest(start_y, i.idx * 1280) AS BIGINT) AS height
              FROM {layout} JOIN {idx} i ON i.idx * 1280 < start_y + h AND (i.idx + 1) * 1280 > start_y""",
    "profiled": """SELECT p.project_uid, o.* EXCLUDE (name, ordinal) FROM {v_projects} p
                   JOIN {v_output_profiles} o ON o.id = CASE WHEN p.output_profile_id = '' THEN 'op-1' ELSE p.output_profile_id END""",
    "p_totals": """SELECT i.project_uid, max(target_width) AS target_width, any_value(slice_height) AS slice_height, any_value(policy) AS policy,
                          any_value(start_index) AS start_index, any_value(format) AS format,
                          CAST(sum(CAST(greatest(1, floor(i.height * CAST(target_width AS DOUBLE) / i.width + 0.5)) AS BIGINT)) AS BIGINT) AS total_height
                   FROM {v_inputs} i JOIN {profiled} p ON i.project_uid = p.project_uid WHERE i.status <> 'Missing' GROUP BY i.project_uid""",
    "p_count": """SELECT *, total_height // slice_height AS n_full, total_height % slice_height AS tail,
                         total_height // slice_height + CASE WHEN total_height % slice_height > 0 AND policy <> 'Crop' THEN 1 ELSE 0 END AS n_slices
                  FROM {p_totals}""",
    "p_names": """SELECT project_uid, CAST(i AS BIGINT) AS idx, 'output_' || CASE WHEN start_index + i < 1000 THEN lpad(CAST(start_index + i AS VARCHAR), 3, '0') ELSE CAST(start_index + i AS VARCHAR) END
                         || CASE format WHEN 'PNG' THEN '.png' WHEN 'JPEG' THEN '.jpg' ELSE '.webp' END AS file_name
                  FROM (SELECT *, unnest(range(0, n_slices)) AS i FROM {p_count}) t""",
}


def scaled(v: Views):
    return L.scaled_size(v("v_inputs").where("status <> 'Missing'"), F.lit(WIDTH))


def layout(v: Views):
    return L.strip_layout(scaled(v))


def segments(v: Views):
    return v.once("segments", lambda: L.slice_source_map(layout(v), F.lit(HEIGHT)))


def profiled(v: Views, then: str = ""):
    """Each project with its output profile, the first one if it names none; ``then``: as the last run saw them."""
    key = F.when(F.col("output_profile_id") == "", "op-1").otherwise(F.col("output_profile_id"))
    return v(f"v_projects{then}").withColumn("id", key).join(v(f"v_output_profiles{then}").drop("name", "ordinal"), "id")


def counted(v: Views):
    rows = v("v_inputs").where("status <> 'Missing'").join(profiled(v).select("project_uid", "target_width"), "project_uid")
    totals = L.strip_totals(L.scaled_size(rows, F.col("target_width")))
    return L.slice_count(totals.join(profiled(v), "project_uid"))


def named(v: Views):
    return L.slice_names(counted(v))


@query("SELECT project_uid, uid, width, height, CASE WHEN width >= height THEN height ELSE width END AS short_side, CAST(800 AS BIGINT) AS scaled_w, h AS scaled_h FROM scaled", "scaled", more=MORE)
def scaled_size(v):
    return scaled(v).select("project_uid", "uid", "width", "height", F.least("width", "height").alias("short_side"), "scaled_w", "scaled_h")


@query("SELECT project_uid, uid, ord, start_y, h FROM layout", "layout", more=MORE)
def strip_layout(v):
    return layout(v).select("project_uid", "uid", "ord", "start_y", F.col("scaled_h").alias("h"))


@query("SELECT project_uid, uid, ord, start_y, h FROM layout", "layout", more=MORE)
def strip_layout_chunked(v):
    return L.strip_layout_chunked(scaled(v), chunk=4).select("project_uid", "uid", "ord", "start_y", F.col("scaled_h").alias("h"))


@query(
    """SELECT project_uid, uid, ord, CAST(coalesce(sum(height) OVER (PARTITION BY project_uid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_y,
              height AS h FROM v_conversation_strips""",
    "v_conversation_strips",
)
def strip_layout_conversations(v):
    return L.strip_layout(v("v_conversation_strips"), "height").select("project_uid", "uid", "ord", "start_y", F.col("height").alias("h"))


@query("SELECT project_uid, CAST(800 AS BIGINT) AS width, total_height, n_pages, total_height > 2147483647 AS overflow FROM totals", "totals", more=MORE)
def strip_totals(v):
    return L.strip_totals(layout(v))


@query("SELECT project_uid, total_height, n_full, tail, n_slices FROM p_count", "p_count", more=MORE)
def slice_count(v):
    return counted(v).select("project_uid", "total_height", "n_full", "tail", "n_slices")


@query("SELECT project_uid, idx, file_name FROM p_names", "p_names", more=MORE)
def slice_file_name(v):
    return named(v)


@query("SELECT project_uid, id, format, CASE format WHEN 'PNG' THEN '.png' WHEN 'JPEG' THEN '.jpg' ELSE '.webp' END AS ext FROM profiled", "profiled", more=MORE)
def format_extension(v):
    return profiled(v).select("project_uid", "id", "format", E.lookup(F.col("format"), E.EXTENSIONS).alias("ext"))


@query("SELECT project_uid, slice_index, seq, uid, source_y, height FROM seg", "seg", more=MORE)
def slice_source_map(v):
    """Which rows of which page feed each slice."""
    return segments(v)


@query(
    """SELECT project_uid, slice_index, expected, actual, expected = actual AS ok FROM (
         SELECT s.project_uid, slice_index, CAST(sum(height) AS BIGINT) AS actual, CAST(least(1280, any_value(total_height) - slice_index * 1280) AS BIGINT) AS expected
         FROM seg s JOIN totals t ON s.project_uid = t.project_uid GROUP BY s.project_uid, slice_index) q""",
    "seg", "totals", more=MORE,
)
def provenance_check(v):
    return L.provenance_check(segments(v), L.strip_totals(layout(v)), HEIGHT)


@query("SELECT project_uid, uid, string_agg(CAST(slice_index AS VARCHAR), ',' ORDER BY slice_index) AS slices FROM seg GROUP BY project_uid, uid", "seg", more=MORE)
def contributes_to(v):
    return L.contributes_to(segments(v))


@query(
    """SELECT project_uid, slice_index, n_pages, max(n_pages) OVER (PARTITION BY project_uid) AS peak
       FROM (SELECT project_uid, slice_index, count(*) AS n_pages FROM seg GROUP BY project_uid, slice_index) q""",
    "seg", more=MORE,
)
def slice_fan_in(v):
    return L.slice_fan_in(segments(v))


@query("SELECT project_uid, file_path AS path, slice_index FROM seg", "seg", more=MORE)
def outputs_for_input(v):
    paths = v("v_inputs").select("project_uid", "uid", F.col("file_path").alias("path"))
    return segments(v).join(paths, ["project_uid", "uid"]).select("project_uid", "path", "slice_index")


@query("SELECT project_uid, idx, file_name, CASE WHEN idx % 3 = 1 THEN 'render' ELSE 'skip' END AS action FROM p_names", "p_names", more=MORE)
def slices_to_render(v):
    return L.slices_to_render(named(v), named(v).where("idx % 3 = 1"))


@query("SELECT project_uid, file_name FROM p_names WHERE idx % 4 = 3", "p_names", more=MORE)
def stale_output_files(v):
    return L.stale_output_files(named(v), named(v).where("idx % 4 <> 3"))


@query("SELECT project_uid, uid, row_number() OVER (PARTITION BY project_uid ORDER BY ord % 3, ord) AS rn FROM v_inputs", "v_inputs")
def inputs_in_order(v):
    pages = v("v_inputs").select("project_uid", "uid", F.col("ord").alias("stored"), (F.col("ord") % 3).alias("ord"))
    return L.inputs_in_order(pages, "stored")


PROPOSED = "SELECT project_uid, ord AS pos, CASE WHEN pk % 29 = 0 THEN 'file-x' ELSE uid END AS uid FROM {v_inputs} WHERE pk % 31 <> 0 OR ord = 0"


@query(
    """SELECT project_uid, reason = '' AS accepted, reason FROM (
         SELECT p.project_uid, CASE WHEN count(*) <> any_value(n) THEN 'count' WHEN count(DISTINCT p.uid) <> count(*) THEN 'repeated'
                                    WHEN count(*) FILTER (WHERE i.uid IS NULL) > 0 THEN 'unknown' ELSE '' END AS reason
         FROM proposed p LEFT JOIN v_inputs i ON p.project_uid = i.project_uid AND p.uid = i.uid
         JOIN (SELECT project_uid, count(*) AS n FROM v_inputs GROUP BY project_uid) c ON c.project_uid = p.project_uid GROUP BY p.project_uid) q""",
    "proposed", more={"proposed": PROPOSED},
)
def validate_input_order(v):
    pages = v("v_inputs")
    proposals = pages.where("pk % 31 <> 0 OR ord = 0").select(
        "project_uid", F.col("ord").alias("pos"), F.when(F.col("pk") % 29 == 0, "file-x").otherwise(F.col("uid")).alias("uid")
    )
    return L.validate_input_order(proposals, pages)


@query(
    """SELECT project_uid, string_agg(uid, ',' ORDER BY first_slice, first_seq) AS input_order FROM (
         SELECT project_uid, uid, min(slice_index) AS first_slice, min(seq) AS first_seq FROM seg GROUP BY project_uid, uid) q GROUP BY project_uid""",
    "seg", more=MORE,
)
def composition_backfill(v):
    return L.composition_backfill(segments(v).withColumn("file_name", F.format_string("output_%06d.jpg", F.col("slice_index") + 1)))


@query(
    """SELECT a.project_uid, coalesce(b.l, '') <> '' AND a.l <> b.l AS changed FROM
         (SELECT project_uid, string_agg(uid, ',' ORDER BY ord) AS l FROM v_inputs GROUP BY project_uid) a LEFT JOIN
         (SELECT project_uid, string_agg(uid, ',' ORDER BY CASE WHEN pk % 50 = 0 THEN -1 ELSE ord END, ord) AS l FROM v_inputs WHERE pk % 40 <> 1 GROUP BY project_uid) b
         ON a.project_uid = b.project_uid""",
    "v_inputs",
)
def sequence_change(v):
    def listed(rows, order, name):
        pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("ord").alias("p"), F.col("uid").alias("u"))))
        return rows.groupBy("project_uid").agg(F.transform(pairs, lambda s: s["u"]).alias(name))

    now = listed(v("v_inputs"), F.col("ord"), "now")
    old = listed(v("v_inputs").where("pk % 40 <> 1"), F.when(F.col("pk") % 50 == 0, -1).otherwise(F.col("ord")), "baseline")
    return L.sequence_change(now, old)
