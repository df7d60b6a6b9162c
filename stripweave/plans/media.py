"""Queries on files, documents, pixels and events."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import layout as L
from ..operators import pixels as X
from ..sources import documents as D
from ..sources import files as S
from ..sources.kept import keep, scratch
from ..sources.session import PARTITIONS
from ..sources.state import State
from ..streaming import catalogue as C
from . import geometry
from .geometry import HEIGHT
from .registry import Views, query

P = "'proj-' || image_uid"
BYTE = "CAST(least(255, greatest(0, floor({} + 0.5))) AS BIGINT)"


def byte(e: str) -> str:
    return BYTE.format(e)


LISTING = """SELECT '/scan/' || source || '/' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' WHEN 3 THEN '.Tiff' WHEN 4 THEN '' ELSE '.jpeg' END AS path,
                    length(text) AS length, doc_id FROM {documents}"""


def listing(v: Views):
    d = F.col("doc_id") % 6
    ext = F.when(d == 0, ".PNG").when(d == 1, ".jpg").when(d == 2, ".txt").when(d == 3, ".Tiff").when(d == 4, "").otherwise(".jpeg")
    path = F.concat(F.lit("/scan/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return v("documents").select(path.alias("path"), F.length("text").cast("long").alias("length"), F.col("doc_id").alias("modification_time"))


@query("SELECT path, length FROM listing WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg|tif|tiff)$')", "listing", more={"listing": LISTING})
def scan_image_dir(v):
    return S.image_files(listing(v)).select("path", "length")


@query(
    "SELECT path, row_number() OVER (ORDER BY path) AS n FROM listing WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg|tif|tiff)$')", "listing", more={"listing": LISTING}
)
def sorted_scan(v):
    """Paths ascending; the position is counted inside range partitions, so the sort stays spread."""
    ranged = S.only_images(listing(v)).select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id())
    rows = v.keep("ranged paths", lambda: ranged)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    return rows.join(F.broadcast(counts), "part").select("path", (inside + F.col("shift")).alias("n"))


HEADERS = """SELECT file_path AS path, CASE WHEN pk % 31 = 0 THEN 0 ELSE width END AS raw_w, height AS raw_h, pk % 9 AS orientation FROM {v_inputs}"""
SIDES = """SELECT path, CAST(CASE WHEN raw_w <= 0 OR raw_h <= 0 THEN -1 WHEN orientation BETWEEN 5 AND 8 THEN raw_h ELSE raw_w END AS BIGINT) AS width,
                  CAST(CASE WHEN raw_w <= 0 OR raw_h <= 0 THEN -1 WHEN orientation BETWEEN 5 AND 8 THEN raw_w ELSE raw_h END AS BIGINT) AS height FROM headers"""


def headers(v: Views):
    return v("v_inputs").select(F.col("file_path").alias("path"), F.when(F.col("pk") % 31 == 0, 0).otherwise(F.col("width")).alias("raw_w"), F.col("height").alias("raw_h"), (F.col("pk") % 9).alias("orientation"))


@query(SIDES, "headers", more={"headers": HEADERS})
def display_orientation(v):
    return S.display_orientation(headers(v))


HEADS = """SELECT k AS n, CASE WHEN k % 31 = 0 THEN -1 WHEN turn BETWEEN 5 AND 8 THEN height ELSE width END AS width, CASE WHEN k % 31 = 0 THEN -1 WHEN turn BETWEEN 5 AND 8 THEN width ELSE height END AS height,
                  CASE WHEN k % 31 = 0 THEN 0 WHEN k % 3 = 2 THEN 3 WHEN k % 2 = 0 THEN 3 ELSE 1 END AS bands
           FROM (SELECT ordinal AS k, width, height, CASE WHEN ordinal % 3 = 0 THEN 1 ELSE 1 + ordinal % 8 END AS turn FROM v_canvas_profiles) q"""


#: Images in a folder.
FOLDER = 500


def _head(kind: int, width: int, height: int, bands: int, turn: int) -> bytes:
    """The first bytes of a PNG (0), JPEG (1) or TIFF (2) of a size; the turned ones say so in their Exif data."""
    colour = {1: 0, 3: 2}[bands]
    if kind == 0:
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", width, height, 8, colour, 0, 0, 0, 0) + struct.pack(">I4sI", 0, b"IDAT", 0)
    tags = [(256, 4, 1, width), (257, 4, 1, height), (274, 3, 1, turn), (277, 3, 1, bands)] if kind == 2 else [(274, 3, 1, turn)]
    tiff = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    if kind == 2:
        return tiff
    exif = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, height, width, bands) + b"\x01\x11\x00" * bands
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame


@query(HEADS, "v_canvas_profiles")
def scan_image_headers(v):
    """An image for each canvas profile, written as a PNG, JPEG or TIFF head (some cut short), and read back from the files.

    Files are many and small beside the table, so it is their number that is dealt to tasks, and a folder holds some hundreds.
    """
    folder, k, tasks = f"{scratch(v.spark)}/images", F.col("ordinal"), int(v.spark.conf.get(PARTITIONS))
    rows = v("v_canvas_profiles").repartition(tasks).select(
        F.concat(F.lit(f"{folder}/"), F.expr(f"ordinal div {FOLDER}").cast("string"), F.lit("/"), k.cast("string"), F.element_at(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".tif")), (k % 3 + 1).cast("int"))).alias("path"),
        (k % 3).alias("kind"), "width", "height", F.when((k % 3 == 2) | (k % 2 == 0), 3).otherwise(1).alias("bands"), (1 + k % 8).alias("turn"), (k % 31 == 0).alias("cut"),
    )
    head = _head

    @F.pandas_udf("binary")
    def content(kind: pd.Series, width: pd.Series, height: pd.Series, bands: pd.Series, turn: pd.Series, cut: pd.Series) -> pd.Series:
        made = (head(*map(int, row)) for row in zip(kind, width, height, bands, turn))
        return pd.Series([data[:12] if c else data for data, c in zip(made, cut)], dtype=object)

    files = keep(S.write_files(rows.select("path", content("kind", "width", "height", "bands", "turn", "cut").alias("content"))))
    found = S.scan_image_headers(v.spark, folder, tasks) if not files.isEmpty() else files.select("path", *[F.lit(0).cast("long").alias(c) for c in ("width", "height", "bands")])
    return found.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("n"), "width", "height", "bands")


@query(
    """SELECT path, CASE WHEN d % 3 = 0 THEN false ELSE length % 5 <> 0 END AS cached, d % 3 <> 0 AND length % 5 <> 0 AND d % 7 <> 0 AS fresh FROM (SELECT path, length, doc_id AS d FROM listing) q""",
    "listing", more={"listing": LISTING},
)
def thumbnail_freshness(v):
    src = listing(v)
    d = F.col("modification_time")
    thumbs = src.where(d % 3 != 0).select(
        F.concat(F.lit("/thumbs/"), F.sha2("path", 256), F.lit(".v2.png")).alias("path"), (F.col("length") % 5).alias("length"), F.when(d % 7 == 0, d - 1).otherwise(d).alias("modification_time")
    )
    return S.thumbnail_freshness(src, thumbs)


@query(
    """SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN '/ws/' || source || '/art/' || doc_id || '.png' WHEN doc_id % 5 = 0 THEN '/abs/' || doc_id || '.png' ELSE '/ws/' || doc_id || '.png' END AS path
       FROM documents"""
)
def rebase_paths(v):
    i, d = F.col("doc_id"), F.col("doc_id").cast("string")
    folder = F.concat(F.lit("/ws/"), "source")
    rows = v("documents").select(
        i.alias("key"), folder.alias("folder"), F.when(i % 3 == 0, F.concat(F.lit("art/./"), d, F.lit(".png"))).otherwise("").alias("relative"),
        F.when(i % 5 == 0, F.concat(F.lit("/abs//"), d, F.lit(".png"))).otherwise(F.concat(F.lit("../"), d, F.lit(".png"))).alias("path"),
    )
    there = v("documents").where(i % 2 == 0).select(F.concat(folder, F.lit("/art/"), d, F.lit(".png")).alias("path"))
    return D.rebase_paths(rows, there)


@query(
    """SELECT id, CASE WHEN k % 3 = 0 THEN CASE WHEN path LIKE '%.psd' THEN 'PSD' ELSE 'PNG' END ELSE format END AS format,
              was || CASE WHEN k % 2 = 0 THEN ';dpi=25.4' ELSE ';dpi=72' END || ';fmt=' || CASE WHEN k % 3 = 0 THEN CASE WHEN path LIKE '%.psd' THEN 'PSD' ELSE 'PNG' END ELSE format END AS fingerprint
       FROM v_templates""",
    "v_templates",
)
def normalise_legacy_records(v):
    k = F.col("k")
    old = v("v_templates").select("id", "path", F.when(k % 3 == 0, "").otherwise(F.col("format")).alias("format"), F.when(k % 2 == 0, F.col("was")).otherwise(F.concat("was", F.lit(";dpi=72"))).alias("fingerprint"))
    return D.legacy_templates(old).select("id", "format", "fingerprint")


def documents_of(v: Views):
    """One workspace document per order, with its pages."""
    i = v("v_inputs").select(F.col("project_uid").alias("workspace_id"), "project_uid", F.col("ord").alias("pos"), "uid", "file_path", "sha256", "ord", "status", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit("").alias("canvas_profile_id"))
    p = v("v_projects").select(F.col("project_uid").alias("workspace_id"), "project_uid", F.lit(0).alias("p_ord"), F.col("project_uid").alias("name"), F.lit("/in").alias("input_directory"), "output_profile_id", F.array().cast("array<string>").alias("canvas_profile_ids"))
    s = geometry.segments(v)
    name = E.slice_name(F.col("slice_index") + 1, F.lit(".jpg"))
    segments = s.select(F.col("project_uid").alias("workspace_id"), "project_uid", name.alias("file_name"), "seq", F.col("uid").alias("source_file_path"), "source_y", "height")
    # heights tell how many slices a strip has, without its segments
    last = F.expr(f"sequence(CAST(0 AS BIGINT), (total_height - 1) div {HEIGHT})")
    slices = L.strip_totals(geometry.scaled(v)).where("total_height > 0").select("project_uid", F.explode(last).alias("slice_index"))
    outs = slices.select(F.col("project_uid").alias("workspace_id"), "project_uid", F.col("slice_index").alias("pos"), F.lit("").alias("uid"), name.alias("file_name"), F.lit("").alias("sha256"), F.lit("Done").alias("status"))
    w = p.select("workspace_id", F.lit(3).alias("version"), F.lit("/out").alias("output_directory"), F.lit(False).alias("strip_dirty"))
    return D.workspace_documents({"workspaces": w, "projects": p, "inputs": i, "outputs": outs, "segments": segments})


@query(
    """SELECT p.project_uid AS workspace_id, 3 AS version, coalesce(n, 0) AS n_inputs, coalesce(s, 0) AS n_segments FROM v_projects p
       LEFT JOIN (SELECT project_uid, count(*) AS n FROM v_inputs GROUP BY project_uid) i ON i.project_uid = p.project_uid
       LEFT JOIN (SELECT project_uid, count(*) AS s FROM seg GROUP BY project_uid) g ON g.project_uid = p.project_uid""",
    "v_projects", "v_inputs", "seg", more=geometry.MORE,
)
def write_workspaces(v):
    """Documents made from the tables and parsed again."""
    d = D.parse_workspaces(documents_of(v))
    p = F.get("projectItems", F.lit(0))
    n = F.coalesce(F.size(p["inputs"]), F.lit(0))
    s = F.aggregate(F.coalesce(p["outputs"], F.array().cast(f"array<{D.OUTPUT}>")), F.lit(0), lambda a, o: a + F.coalesce(F.size(o["sourceMap"]), F.lit(0)))
    return d.select("workspace_id", "version", F.greatest(n, F.lit(0)).cast("long").alias("n_inputs"), s.cast("long").alias("n_segments"))


@query("SELECT project_uid AS workspace_id, project_uid, uid, file_path, ord, width, height, status FROM v_inputs", "v_inputs")
def read_workspaces(v):
    """Pages read back from workspace documents."""
    tables = D.workspace_tables(D.parse_workspaces(documents_of(v)))
    return tables["inputs"].select("workspace_id", "project_uid", "uid", "file_path", *[F.col(c).cast("long").alias(c) for c in ("ord", "width", "height")], "status")


MORE = {
    "px": f"SELECT p.*, {P} AS project_uid FROM {{v_pixels}} p",
    "curved0": """SELECT p.image_uid, p.x, p.y, p.a, p.project_uid, c.channel, c.v FROM {px} p, LATERAL (VALUES ('r', r), ('g', g), ('b', b)) AS c(channel, v)""",
    "lut": """SELECT project_uid, channel, CAST(i AS BIGINT) AS v,
                CAST(least(255, greatest(0, floor(255 * CASE WHEN lo.x IS NULL THEN fy WHEN hi.x IS NULL THEN lo.y ELSE lo.y + (hi.y - lo.y) * (i / 255.0::DOUBLE - lo.x) / (hi.x - lo.x) END + 0.5))) AS BIGINT) AS w
              FROM (SELECT k.project_uid, k.channel, i, k.fy, (SELECT {{'x': max(x), 'y': max_by(y, x)}} FROM {v_curve_points} c WHERE c.project_uid = k.project_uid AND c.channel = k.channel AND c.x <= i / 255.0::DOUBLE) AS lo,
                           (SELECT {{'x': min(x), 'y': min_by(y, x)}} FROM {v_curve_points} c WHERE c.project_uid = k.project_uid AND c.channel = k.channel AND c.x > i / 255.0::DOUBLE) AS hi
                    FROM (SELECT project_uid, channel, min_by(y, x) AS fy FROM {v_curve_points} GROUP BY project_uid, channel) k, range(0, 256) AS t(i)) q""".replace("{{", "{").replace("}}", "}"),
    "curved1": """SELECT c.*, coalesce(m.w, c.v) AS v1 FROM {curved0} c LEFT JOIN {lut} m ON m.project_uid = c.project_uid AND m.channel = 'm' AND m.v = c.v""",
    "curved": """SELECT image_uid, project_uid, x, y, a, max(v2) FILTER (WHERE channel = 'r') AS r, max(v2) FILTER (WHERE channel = 'g') AS g, max(v2) FILTER (WHERE channel = 'b') AS b
                 FROM (SELECT c.*, coalesce(o.w, c.v1) AS v2 FROM {curved1} c LEFT JOIN {lut} o ON o.project_uid = c.project_uid AND o.channel = c.channel AND o.v = c.v1) q GROUP BY image_uid, project_uid, x, y, a""",
}


def px(v: Views):
    return v("v_pixels").withColumn("project_uid", F.concat(F.lit("proj-"), F.col("image_uid").cast("string")))


def graded(v: Views):
    return X.with_grades(px(v), v("v_grades"), X.sorted_curves(v("v_curve_points")))


OUT = ("image_uid", "x", "y", "r", "g", "b", "a")


@query(
    f"""SELECT image_uid, x, y, {byte('r * contrast + 127.5::DOUBLE * (1 - contrast) + brightness * 255')} AS r, {byte('g * contrast + 127.5::DOUBLE * (1 - contrast) + brightness * 255')} AS g,
        {byte('b * contrast + 127.5::DOUBLE * (1 - contrast) + brightness * 255')} AS b, a FROM px JOIN v_grades USING (project_uid)""",
    "px", "v_grades", more=MORE,
)
def grade_levels(v):
    return X.grade_levels(graded(v)).select(*OUT)


LUM = "(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE)"


@query(
    f"""SELECT image_uid, x, y, {byte(f'r * saturation + {LUM} * (1 - saturation)')} AS r, {byte(f'g * saturation + {LUM} * (1 - saturation)')} AS g, {byte(f'b * saturation + {LUM} * (1 - saturation)')} AS b, a
        FROM px JOIN v_grades USING (project_uid)""",
    "px", "v_grades", more=MORE,
)
def grade_saturation(v):
    return X.grade_saturation(graded(v)).select(*OUT)


@query("SELECT image_uid, x, y, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, a FROM curved", "curved", more=MORE)
def grade_curves(v):
    return X.grade_curves(graded(v)).select(*OUT)


LV = "({} * contrast + 127.5::DOUBLE * (1 - contrast) + brightness * 255)"
LL = f"({LV.format('c.r')} * 0.2126::DOUBLE + {LV.format('c.g')} * 0.7152::DOUBLE + {LV.format('c.b')} * 0.0722::DOUBLE)"


@query(
    "SELECT c.image_uid, c.x, c.y, " + ", ".join(f"CASE WHEN flat THEN p.{c} ELSE {byte(f'{LV.format(f'c.{c}')} * saturation + {LL} * (1 - saturation)')} END AS {c}" for c in "rgb") + """, c.a
       FROM curved c JOIN px p ON p.image_uid = c.image_uid AND p.x = c.x AND p.y = c.y
       JOIN (SELECT g.*, abs(brightness) < 1e-6 AND abs(contrast - 1) < 1e-6 AND abs(saturation - 1) < 1e-6 AND NOT EXISTS (SELECT 1 FROM v_curve_points q WHERE q.project_uid = g.project_uid) AS flat FROM v_grades g) g
         ON g.project_uid = c.project_uid""",
    "curved", "px", "v_grades", "v_curve_points", more=MORE,
)
def grade_page(v):
    return X.grade_page(graded(v)).select(*OUT)


@query(
    "SELECT image_uid, x - 8 AS x, y - 4 AS y, r, g, b, a FROM v_pixels WHERE x >= 8 AND x < 8 + 40 + image_uid % 3 AND y >= 4 AND y < 4 + 50",
    "v_pixels",
)
def crop_pixels(v):
    rects = v("v_pixels").select("image_uid").distinct().select("image_uid", F.lit(8).alias("x0"), F.lit(4).alias("y0"), (40 + F.col("image_uid") % 3).alias("w"), F.lit(50).alias("h"))
    return X.crop_pixels(v("v_pixels"), rects)


def pixel_layout(v: Views):
    i = F.col("image_uid")
    return v("v_pixels").select("image_uid").distinct().select("image_uid", F.floor(i / 5).cast("long").alias("project_uid"), ((i % 5) * 64).cast("long").alias("start_y"))


@query(
    """SELECT image_uid // 5 AS project_uid, ((image_uid % 5) * 64 + y) // 100 AS idx, x, ((image_uid % 5) * 64 + y) % 100 AS y, r, g, b, a FROM v_pixels""",
    "v_pixels",
)
def stack_and_slice_pixels(v):
    return X.stack_and_slice_pixels(v("v_pixels"), pixel_layout(v), 100)


@query(
    """SELECT project_uid, total_height // 1280 AS idx, CAST(y AS BIGINT) AS y, 255::BIGINT AS r, 255::BIGINT AS g, 255::BIGINT AS b, 255::BIGINT AS a
       FROM (SELECT *, unnest(range(total_height % 1280, 1280)) AS y FROM totals WHERE total_height % 1280 > 0) q""",
    "totals", more=geometry.MORE,
)
def pad_tail_white(v):
    return X.pad_tail_white(L.strip_totals(geometry.layout(v)), HEIGHT)


TOPS = {
    "tops": """SELECT image_uid, (x + z) % 64 AS x, y, z, z % 6 AS blend, (r * 7) % 256 AS r, (g + 31) % 256 AS g, b, CASE z WHEN 1 THEN 128 WHEN 2 THEN a ELSE 255 END AS a
               FROM {v_pixels} CROSS JOIN (VALUES (1), (2), (4)) AS t(z) WHERE (x + y + z) % 3 <> 0""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY image_uid, x, y ORDER BY z, blend, r, g, b, a) AS k FROM {tops}",
}
_B = "CASE t.blend WHEN 1 THEN f.{c} * s WHEN 2 THEN f.{c} + s - f.{c} * s WHEN 3 THEN CASE WHEN f.{c} <= 0.5 THEN 2 * f.{c} * s ELSE 1 - 2 * (1 - f.{c}) * (1 - s) END WHEN 4 THEN least(f.{c}, s) WHEN 5 THEN greatest(f.{c}, s) ELSE s END"


def _mix(c: str) -> str:
    s = f"(t.{c} / 255.0::DOUBLE)"
    b = _B.format(c=c).replace(" s", f" {s}").replace("(s", f"({s}").replace("- s)", f"- {s})")
    ta, al = "(t.a / 255.0::DOUBLE)", "((t.a / 255.0::DOUBLE) + f.a * (1 - (t.a / 255.0::DOUBLE)))"
    return f"CASE WHEN {al} > 0 THEN ({ta} * (1 - f.a) * {s} + {ta} * f.a * ({b}) + (1 - {ta}) * f.a * f.{c}) / {al} ELSE 0 END"


FOLD = f"""SELECT image_uid, x, y, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, a / 255.0::DOUBLE AS a, 0 AS k FROM v_pixels
           UNION ALL SELECT f.image_uid, f.x, f.y, {_mix('r')}, {_mix('g')}, {_mix('b')}, (t.a / 255.0::DOUBLE) + f.a * (1 - (t.a / 255.0::DOUBLE)), f.k + 1
           FROM fold f JOIN ranked t ON t.image_uid = f.image_uid AND t.x = f.x AND t.y = f.y AND t.k = f.k + 1"""


@query(
    f"""SELECT image_uid, x, y, {byte('r * 255')} AS r, {byte('g * 255')} AS g, {byte('b * 255')} AS b, {byte('a * 255')} AS a FROM (
          SELECT *, row_number() OVER (PARTITION BY image_uid, x, y ORDER BY k DESC) AS n FROM fold) q WHERE n = 1""",
    "v_pixels", "ranked", "fold", more=TOPS | {"fold": FOLD},
)
def composite_overlays(v):
    z = v.spark.range(1, 5).where("id <> 3").select(F.col("id").alias("z"))
    tops = v("v_pixels").join(F.broadcast(z)).where((F.col("x") + F.col("y") + F.col("z")) % 3 != 0)
    tops = tops.select(
        "image_uid", ((F.col("x") + F.col("z")) % 64).alias("x"), "y", "z", (F.col("z") % 6).alias("blend"), ((F.col("r") * 7) % 256).alias("r"), ((F.col("g") + 31) % 256).alias("g"), "b",
        F.when(F.col("z") == 1, 128).when(F.col("z") == 2, F.col("a")).otherwise(255).alias("a"),
    )
    return X.composite_overlays(v("v_pixels"), tops)


@query(
    f"SELECT image_uid, x, y, {byte('r * (a / 255.0::DOUBLE) + 255 * (1 - (a / 255.0::DOUBLE))')} AS r, {byte('g * (a / 255.0::DOUBLE) + 255 * (1 - (a / 255.0::DOUBLE))')} AS g, {byte('b * (a / 255.0::DOUBLE) + 255 * (1 - (a / 255.0::DOUBLE))')} AS b, 255::BIGINT AS a FROM v_pixels",
    "v_pixels",
)
def flatten_alpha_white(v):
    return X.flatten_alpha_white(v("v_pixels"))


@query(
    """SELECT image_uid, x, y, r, CASE WHEN n <= 2 THEN r ELSE g END AS g, CASE WHEN n <= 2 THEN r ELSE b END AS b, CASE WHEN n IN (2, 4) THEN a ELSE 255::BIGINT END AS a FROM (SELECT *, 1 + image_uid % 4 AS n FROM v_pixels) q""",
    "v_pixels",
)
def promote_bands(v):
    return X.promote_bands(v("v_pixels").withColumn("bands", 1 + F.col("image_uid") % 4)).drop("bands")


@query(
    """SELECT project_uid, uid, lo <> hi AND n <= 2 AS to_rgb, lo <> hi AND al AND n NOT IN (2, 4) AS add_alpha, CAST(CASE WHEN lo = hi THEN n WHEN al THEN 4 ELSE 3 END AS BIGINT) AS target_bands FROM (
         SELECT project_uid, uid, n, min(n) OVER w AS lo, max(n) OVER w AS hi, bool_or(n IN (2, 4)) OVER w AS al
         FROM (SELECT project_uid, uid, CASE WHEN pk % 5 = 0 THEN 1 WHEN pk % 17 = 0 THEN 4 ELSE 3 END AS n FROM v_inputs) b WINDOW w AS (PARTITION BY project_uid)) q""",
    "v_inputs",
)
def band_normalisation(v):
    pk = F.col("pk")
    return X.band_normalisation(v("v_inputs").select("project_uid", "uid", F.when(pk % 5 == 0, 1).when(pk % 17 == 0, 4).otherwise(3).alias("bands")))


@query(
    """SELECT date_trunc('hour', ts) AS window_start, 'proj-' || (event_id % 500) AS project_uid, event_type AS status, count(*) AS n FROM events GROUP BY ALL"""
)
def render_event_counts(v):
    e = v("events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("proj-"), (F.col("event_id") % 500).cast("string")).alias("project_uid"), F.col("event_type").alias("status"))
    return C.render_event_counts(e)


@query(
    """SELECT i.project_uid, 'input' AS kind, i.file_path AS path,
              CASE WHEN c.found IS NULL THEN i.status WHEN NOT found THEN 'Missing' WHEN disk_sha256 = sha256 THEN 'Processed' ELSE 'Modified' END AS status, sha256
       FROM v_inputs i LEFT JOIN v_disk_checks c ON c.project_uid = i.project_uid AND c.file_path = i.file_path AND c.recorded_sha256 = i.sha256""",
    "v_inputs", "v_disk_checks",
)
def disk_check_stream(v):
    """Checks arrive as files in two batches; the second is run again as after a failure before its commit, and finds itself done."""
    folder = scratch(v.spark)
    state = State(v.spark, f"{folder}/state")
    state.publish({"files": v("v_inputs").select("project_uid", F.lit("input").alias("kind"), F.col("file_path").alias("path"), "status", "sha256")})
    checks = v("v_disk_checks").withColumnRenamed("file_path", "path").withColumn("checked_at", F.lit(2))
    older = checks.withColumns({"disk_sha256": F.lit("stale"), "checked_at": F.lit(1)})
    for batch in (older, checks):
        batch.write.mode("append").parquet(f"{folder}/checks")
        source = v.spark.readStream.schema(checks.schema).parquet(f"{folder}/checks")
        C.disk_check_stream(source, state, f"{folder}/checkpoint").awaitTermination()
    done = v.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits/1")
    done.getFileSystem(v.spark._jsc.hadoopConfiguration()).delete(done, False)
    C.disk_check_stream(source, state, f"{folder}/checkpoint").awaitTermination()
    return state.read("files").drop("bucket")
