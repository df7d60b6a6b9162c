"""Text signatures that tell whether a configuration has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import FORMAT_ORDINALS, POLICY_ORDINALS, joined, lookup, shortest_decimal

NEUTRAL = 1e-6
CHANNELS = ("m", "r", "g", "b")
#: Encoder options of an output profile that sets none.
ENCODER_DEFAULTS = {
    "jpeg_quality": 90, "jpeg_subsampling": 0, "jpeg_optimize": 1, "jpeg_progressive": 0, "png_compression": 6, "png_interlace": 0,
    "webp_quality": 80, "webp_lossless": 0, "webp_effort": 4,
}


def six(value: Column) -> Column:
    """A double with six decimals."""
    return F.format_string("%.6f", value)


def fingerprint() -> Column:
    """What a canvas profile renders as: size and margins only; colours and resolution do not count."""
    return F.format_string("cw=%d;ch=%d;mt=%d;mr=%d;mb=%d;ml=%d", "width", "height", "mt", "mr", "mb", "ml")


def canvas_render_fingerprint(profiles: DataFrame) -> DataFrame:
    """``id, signature``: the ``fingerprint`` of each profile."""
    return profiles.select("id", fingerprint().alias("signature"))


def output_profile_signature(profiles: DataFrame, keep: tuple = ("id",)) -> DataFrame:
    """``id, signature`` of output profiles; booleans as 0 or 1, enumerations as ordinals. Encoder options that a profile leaves
    null, or has no column for, are those of ``ENCODER_DEFAULTS``."""
    c = profiles.columns
    option = {n: (F.coalesce(F.col(n).cast("int"), F.lit(v)) if n in c else F.lit(v)) for n, v in ENCODER_DEFAULTS.items()}
    o = option
    text = joined(
        "w", F.col("target_width"), "h", F.col("slice_height"), "p", lookup(F.col("policy"), POLICY_ORDINALS), "f", lookup(F.col("format"), FORMAT_ORDINALS),
        "i", F.col("start_index"), ";jpeg", o["jpeg_quality"], ",", o["jpeg_subsampling"], ",", o["jpeg_optimize"], ",", o["jpeg_progressive"],
        ";png", o["png_compression"], ",", o["png_interlace"], ";webp", o["webp_quality"], ",", o["webp_lossless"], ",", o["webp_effort"],
        ";dpi", shortest_decimal(F.col("dpi")),
    )
    return profiles.select(*keep, text.alias("signature"))


def template_signature(profiles: DataFrame) -> DataFrame:
    """``id, signature`` of a canvas template: fingerprint, colours, resolution, format, and for PSD
    whether an empty layer is added."""
    text = joined(
        F.format_string("cw=%d;ch=%d;mt=%d;mr=%d;mb=%d;ml=%d", "width", "height", "mt", "mr", "mb", "ml"),
        ";vc=", F.col("visual"), ";bg=", F.col("background"), ";dpi=", shortest_decimal(F.col("dpi")), ";fmt=", F.col("format"),
        F.when(F.col("format") == "PSD", F.concat(F.lit(";layer="), F.col("layer").cast("int").cast("string"))).otherwise(""),
    )
    return profiles.select("id", text.alias("signature"))


def neutral_grade(grades: DataFrame, points: DataFrame) -> DataFrame:
    """``project_uid, is_neutral``: no curve, and all three numbers within a millionth of neutral."""
    curved = points.select("project_uid").distinct().withColumn("__curved", F.lit(True))
    flat = (F.abs("brightness") < NEUTRAL) & (F.abs(F.col("contrast") - 1) < NEUTRAL) & (F.abs(F.col("saturation") - 1) < NEUTRAL)
    return grades.join(curved, "project_uid", "left").select("project_uid", (flat & F.col("__curved").isNull()).alias("is_neutral"))


def page_is_graded(pages: DataFrame, neutral: DataFrame, exclusions: DataFrame) -> DataFrame:
    """``project_uid, uid, graded``: the grade does something and leaves the page in."""
    out = exclusions.select("project_uid", "uid").distinct().withColumn("__out", F.lit(True))
    rows = pages.select("project_uid", "uid").join(neutral, "project_uid", "left").join(out, ["project_uid", "uid"], "left")
    return rows.select("project_uid", "uid", (~F.coalesce("is_neutral", F.lit(True)) & F.col("__out").isNull()).alias("graded"))


def curve_points_by_x(points: DataFrame) -> DataFrame:
    """``project_uid, channel, points``: the points of each curve ordered by x, ties by position."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "seq", "y")))
    text = F.transform(ordered, lambda p: F.concat(six(p["x"]), F.lit(","), six(p["y"])))
    return points.groupBy("project_uid", "channel").agg(F.array_join(text, " ").alias("points"))


def processing_signature(grades: DataFrame, points: DataFrame, exclusions: DataFrame, overlays: DataFrame) -> DataFrame:
    """``project_uid, signature``: grade and enabled overlays in z order; empty if nothing is set."""
    stored = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    text = F.array_join(F.transform(stored, lambda p: F.concat(six(p["x"]), F.lit(","), six(p["y"]))), " ")
    curves = points.groupBy("project_uid").pivot("channel", list(CHANNELS)).agg(text)
    left_out = exclusions.groupBy("project_uid").agg(F.array_join(F.array_sort(F.collect_set("uid")), ",").alias("__x"))
    placed = overlays.where("enabled").withColumn(
        "__t", joined("ov{", F.col("sha256"), ";", F.col("anchor_input_uid"), "@", six(F.col("x_frac")), ",", six(F.col("y_frac")), "x", six(F.col("w_frac")), ";", F.col("blend"), "}")
    )
    stack = placed.groupBy("project_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "__t"))), lambda s: s["__t"]), "").alias("__ov"))
    rows = (
        grades.join(neutral_grade(grades, points), "project_uid")
        .join(curves, "project_uid", "left")
        .join(left_out, "project_uid", "left")
        .join(stack, "project_uid", "left")
    )
    curve = [x for c in CHANNELS for x in (f"{c}(", F.coalesce(c, F.lit("")), ")")]
    grade = joined("cc{cu ", *curve, ";", six(F.col("brightness")), ";", six(F.col("contrast")), ";", six(F.col("saturation")), ";x", F.coalesce("__x", F.lit("")), "}")
    whole = F.when(F.col("is_neutral") & F.col("__ov").isNull(), "").otherwise(F.concat(grade, F.coalesce("__ov", F.lit(""))))
    return rows.select("project_uid", whole.alias("signature"))
