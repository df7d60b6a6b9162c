"""Queries on signatures, grades, overlays and profile definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import overlays as O
from ..operators import profiles as P
from ..operators import signatures as S
from . import geometry, matching
from .geometry import HEIGHT, WIDTH
from .registry import query

MORE = geometry.MORE | matching.MORE

FINGERPRINT = "'cw=' || width || ';ch=' || height || ';mt=' || mt || ';mr=' || mr || ';mb=' || mb || ';ml=' || ml"


@query("SELECT id, width - ml - mr AS safe_w, height - mt - mb AS safe_h FROM v_canvas_profiles", "v_canvas_profiles")
def safe_area(v):
    return P.safe_area(v("v_canvas_profiles"))


@query("SELECT id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM v_canvas_profiles", "v_canvas_profiles")
def canvas_from_safe_area(v):
    c = v("v_canvas_profiles")
    return P.canvas_from_safe_area(c.join(P.safe_area(c), "id"))


TIGHT = "SELECT id, width - 800 AS width, height - 512 AS height, mt - 8 AS mt, mr, mb, ml FROM {v_canvas_profiles}"


@query(
    """SELECT id, reason = '' AS ok, reason FROM (SELECT id, CASE WHEN least(mt, mr, mb, ml) < 0 THEN 'negative margin' WHEN width - ml - mr <= 0 THEN 'no width left'
              WHEN height - mt - mb <= 0 THEN 'no height left' ELSE '' END AS reason FROM tight) q""",
    "tight", more={"tight": TIGHT},
)
def validate_margins(v):
    tight = v("v_canvas_profiles").withColumns({"width": F.col("width") - 800, "height": F.col("height") - 512, "mt": F.col("mt") - 8})
    return P.validate_margins(tight)


@query(
    """SELECT m.project_uid, m.uid, CASE WHEN c THEN ml ELSE 0 END AS x, CASE WHEN c THEN mt ELSE 0 END AS y, CASE WHEN c THEN w - ml - mr ELSE w END AS w,
              CASE WHEN c THEN h - mt - mb ELSE h END AS h, c AS do_crop
       FROM (SELECT m.project_uid, m.uid, i.width AS w, i.height AS h, mt, mr, mb, ml, coalesce(greatest(mt, mr, mb, ml) > 0, false) AS c
             FROM matched m JOIN v_inputs i ON m.project_uid = i.project_uid AND m.uid = i.uid LEFT JOIN v_canvas_profiles p ON p.id = m.profile_id) m""",
    "matched", more=MORE,
)
def margin_crop_rect(v):
    return P.margin_crop_rect(matching.matched(v), v("v_canvas_profiles"))


@query(f"SELECT id, {FINGERPRINT} AS signature FROM v_canvas_profiles", "v_canvas_profiles")
def canvas_render_fingerprint(v):
    return S.canvas_render_fingerprint(v("v_canvas_profiles"))


OP_SIGNATURE = """'w' || target_width || 'h' || slice_height || 'p' || CASE policy WHEN 'PadWhite' THEN 0 WHEN 'Crop' THEN 1 ELSE 2 END
   || 'f' || CASE format WHEN 'PNG' THEN 0 WHEN 'JPEG' THEN 1 ELSE 2 END || 'i' || start_index || ';jpeg' || coalesce(jpeg_quality, 90) || ',0,1,0;png' || coalesce(png_compression, 6) || ',0;webp' || coalesce(webp_quality, 80)
   || ',' || CASE WHEN webp_lossless THEN 1 ELSE 0 END || ',4;dpi'
   || CASE WHEN dpi = floor(dpi) THEN CAST(CAST(dpi AS BIGINT) AS VARCHAR) ELSE CAST(dpi AS VARCHAR) END"""


@query(f"SELECT project_uid, {OP_SIGNATURE} AS signature FROM profiled", "profiled", more=MORE)
def output_profile_signature(v):
    return S.output_profile_signature(geometry.profiled(v), ("project_uid",))


@query(
    f"""SELECT id, {FINGERPRINT} || ';vc=' || (ordinal % 256) || ',0,0,255;bg=' || (ordinal % 7) || ',1,1,0;dpi=' || CASE WHEN ordinal % 3 = 0 THEN '300' ELSE '72.5' END
        || ';fmt=' || CASE WHEN ordinal % 2 = 0 THEN 'PNG' ELSE 'PSD;layer=' || (ordinal % 4 // 2) END AS signature FROM v_canvas_profiles""",
    "v_canvas_profiles",
)
def template_signature(v):
    o = F.col("ordinal")
    rows = v("v_canvas_profiles").withColumns(
        {
            "visual": F.format_string("%d,0,0,255", o % 256), "background": F.format_string("%d,1,1,0", o % 7), "dpi": F.when(o % 3 == 0, 300.0).otherwise(72.5),
            "format": F.when(o % 2 == 0, "PNG").otherwise("PSD"), "layer": (o % 4) >= 2,
        }
    )
    return S.template_signature(rows)


@query(
    """SELECT id AS key, CAST(seq AS BIGINT) AS seq, field, was, now FROM (
         SELECT id, i AS seq, split_part(p, '=', 1) AS field, split_part(p, '=', 2) AS now,
                coalesce(regexp_extract(';' || t.was || ';', ';' || split_part(p, '=', 1) || '=([^;]*);', 1), '') AS was
         FROM (SELECT id, was, string_split(now, ';') AS parts, unnest(range(0, len(string_split(now, ';')))) AS i, unnest(string_split(now, ';')) AS p FROM v_templates) t) q
       WHERE was <> now""",
    "v_templates",
)
def signature_diff(v):
    return P.signature_diff(v("v_templates").select(F.col("id").alias("key"), "was", "now"))


NEUTRAL = """SELECT g.project_uid, abs(brightness) < 1e-6 AND abs(contrast - 1) < 1e-6 AND abs(saturation - 1) < 1e-6
                    AND NOT EXISTS (SELECT 1 FROM {v_curve_points} c WHERE c.project_uid = g.project_uid) AS is_neutral FROM {v_grades} g"""


@query("SELECT project_uid, is_neutral FROM neutral", "neutral", more={"neutral": NEUTRAL})
def neutral_grade(v):
    return S.neutral_grade(v("v_grades"), v("v_curve_points"))


@query(
    """SELECT i.project_uid, i.uid, NOT n.is_neutral AND NOT EXISTS (SELECT 1 FROM v_exclusions e WHERE e.project_uid = i.project_uid AND e.uid = i.uid) AS graded
       FROM v_inputs i JOIN neutral n ON n.project_uid = i.project_uid""",
    "neutral", "v_inputs", "v_exclusions", more={"neutral": NEUTRAL},
)
def page_is_graded(v):
    return S.page_is_graded(v("v_inputs"), S.neutral_grade(v("v_grades"), v("v_curve_points")), v("v_exclusions"))


@query(
    "SELECT project_uid, channel, string_agg(printf('%.6f,%.6f', x, y), ' ' ORDER BY x, seq) AS points FROM v_curve_points GROUP BY project_uid, channel",
    "v_curve_points",
)
def curve_points_by_x(v):
    return S.curve_points_by_x(v("v_curve_points"))


def processing_sql(then: str = "") -> dict[str, str]:
    """Statements of the processing signatures of today, or of those recorded by the last run (``then``)."""
    return {
        f"neutral{then}": NEUTRAL.replace("{v_grades}", f"{{v_grades{then}}}"),
        "curves": "SELECT project_uid, channel, string_agg(printf('%.6f,%.6f', x, y), ' ' ORDER BY seq) AS t FROM {v_curve_points} GROUP BY project_uid, channel",
        f"stack{then}": f"""SELECT project_uid, string_agg('ov{{' || sha256 || ';' || anchor_input_uid || '@' || printf('%.6f,%.6fx%.6f', x_frac, y_frac, w_frac) || ';' || blend || '}}', '' ORDER BY z) AS t
                    FROM {{v_overlays{then}}} WHERE enabled GROUP BY project_uid""",
        "leftout": "SELECT project_uid, string_agg(DISTINCT uid, ',' ORDER BY uid) AS t FROM {v_exclusions} GROUP BY project_uid",
        f"processing{then}": f"""SELECT g.project_uid, CASE WHEN n.is_neutral AND s.t IS NULL THEN '' ELSE 'cc{{cu m(' || coalesce(m.t, '') || ')r(' || coalesce(r.t, '') || ')g(' || coalesce(gg.t, '') || ')b(' || coalesce(b.t, '')
              || ');' || printf('%.6f;%.6f;%.6f', brightness, contrast, saturation) || ';x' || coalesce(x.t, '') || '}}' || coalesce(s.t, '') END AS signature
            FROM {{v_grades{then}}} g JOIN {{neutral{then}}} n ON n.project_uid = g.project_uid LEFT JOIN {{stack{then}}} s ON s.project_uid = g.project_uid LEFT JOIN {{leftout}} x ON x.project_uid = g.project_uid
            LEFT JOIN {{curves}} m ON m.project_uid = g.project_uid AND m.channel = 'm' LEFT JOIN {{curves}} r ON r.project_uid = g.project_uid AND r.channel = 'r'
            LEFT JOIN {{curves}} gg ON gg.project_uid = g.project_uid AND gg.channel = 'g' LEFT JOIN {{curves}} b ON b.project_uid = g.project_uid AND b.channel = 'b'""",
    }


@query("SELECT project_uid, signature FROM processing", "processing", more=processing_sql())
def processing_signature(v):
    return S.processing_signature(v("v_grades"), v("v_curve_points"), v("v_exclusions"), v("v_overlays"))


PLACED = """SELECT o.project_uid, o.uid, CAST(round(x_frac * 800) AS BIGINT) AS x, CAST(round(y_frac * 800) AS BIGINT) + coalesce(l.start_y, 0) AS y,
                   CAST(round(w_frac * 800) AS BIGINT) AS width, enabled, blend, z, asset_path, asset_w, asset_h
            FROM {v_overlays} o LEFT JOIN {layout} l ON l.project_uid = o.project_uid AND l.uid = o.anchor_input_uid
            WHERE o.anchor_input_uid = '' OR l.uid IS NOT NULL"""


def placed(v):
    return O.resolve_overlay_anchors(v("v_overlays"), geometry.layout(v), F.lit(WIDTH))


@query("SELECT project_uid, uid, x, y, width, enabled, blend, z FROM placed", "placed", more=MORE | {"placed": PLACED})
def resolve_overlay_anchors(v):
    return placed(v)


@query(
    """SELECT o.project_uid, o.uid FROM v_overlays o WHERE anchor_input_uid <> ''
       AND NOT EXISTS (SELECT 1 FROM layout l WHERE l.project_uid = o.project_uid AND l.uid = o.anchor_input_uid)""",
    "v_overlays", "layout", more=MORE,
)
def orphan_overlays(v):
    return O.orphan_overlays(v("v_overlays"), geometry.layout(v))


@query(
    """SELECT project_uid, CAST(idx AS BIGINT) AS slice_index, uid, z, x AS local_x, CAST(y - idx * 1280 AS BIGINT) AS local_y
       FROM (SELECT p.*, t.total_height, greatest(1, CAST(floor(asset_h * CAST(width AS DOUBLE) / asset_w + 0.5) AS BIGINT)) AS oh
             FROM placed p JOIN totals t ON t.project_uid = p.project_uid WHERE enabled AND asset_path <> '' AND width > 0) p
       JOIN idx i ON y < (i.idx + 1) * 1280 AND y + oh > i.idx * 1280 AND i.idx * 1280 < total_height AND y < total_height AND y + oh > 0""",
    "placed", "totals", "idx", more=MORE | {"placed": PLACED},
)
def overlay_slices(v):
    art = v("v_overlays").select("uid", "asset_path", "asset_w", "asset_h")
    return O.overlay_slices(placed(v).join(art, "uid"), L.strip_totals(geometry.layout(v)), HEIGHT)


@query(
    """SELECT project_uid, uid, CASE WHEN sha256 = '' THEN asset_path ELSE coalesce(first_path, asset_path) END AS stored_path FROM (
         SELECT o.*, (SELECT arg_min(p.asset_path, p.z) FROM v_overlays p WHERE p.project_uid = o.project_uid AND p.sha256 = o.sha256 AND p.asset_path <> '' AND p.z <= o.z) AS first_path
         FROM v_overlays o) q""",
    "v_overlays",
)
def overlay_asset_dedup(v):
    return O.overlay_asset_dedup(v("v_overlays"))
