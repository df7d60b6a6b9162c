"""Pixel tables ``image_uid, x, y, r, g, b, a``: grading, cropping, stacking and blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.signatures import NEUTRAL

COLOURS = ("r", "g", "b")
#: Rec. 709 luminance weights.
LUMA = {"r": 0.2126, "g": 0.7152, "b": 0.0722}
POINT = "struct<x:double,y:double>"


def to_byte(value: Column, top: int = 255) -> Column:
    """Nearest whole number, halves up, between 0 and ``top``."""
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(value + 0.5))).cast("long")


def levels(value: Column, brightness: Column, contrast: Column, top: int = 255) -> Column:
    return value * contrast + (top / 2) * (1 - contrast) + brightness * top


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA["r"] + g * LUMA["g"] + b * LUMA["b"]


def curve_value(points: Column, value: Column) -> Column:
    """Piecewise linear curve over ``array<struct<x, y>>`` sorted by x; ends are clamped.

    The neighbours of the value are found once and bound; a curve has few points, so this is cheaper
    than a table of all bytes unless a project has very many pixels for each of its curves.
    """

    def between(n: Column) -> Column:
        lo, hi = n["lo"], n["hi"]
        dx = hi["x"] - lo["x"]
        inside = F.when(dx <= 1e-9, lo["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (n["v"] - lo["x"]) / dx)
        return F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(inside)

    ends = F.struct(
        value.alias("v"),
        F.aggregate(points, F.lit(None).cast(POINT), lambda lo, p: F.when(p["x"] <= value, p).otherwise(lo)).alias("lo"),
        F.aggregate(points, F.lit(None).cast(POINT), lambda hi, p: F.when(hi.isNull() & (p["x"] > value), p).otherwise(hi)).alias("hi"),
    )
    return F.element_at(F.transform(F.array(ends), between), 1)


def sorted_curves(points: DataFrame) -> DataFrame:
    """One row per project with an array of sorted points for each channel."""
    arrays = F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    wide = points.groupBy("project_uid").pivot("channel", ["m", "r", "g", "b"]).agg(arrays)
    return wide.select("project_uid", *[F.col(c).alias(f"__c_{c}") for c in ("m", "r", "g", "b")])


def _through(curve: str, value: Column) -> Column:
    """A byte through a curve; without one, or without points, it stays."""
    bound = F.transform(F.array(value), lambda x: to_byte(curve_value(F.col(curve), x / 255) * 255))
    return F.when(F.coalesce(F.size(curve), F.lit(0)) <= 0, value).otherwise(F.element_at(bound, 1))


def grade_levels(pixels: DataFrame, top: int = 255) -> DataFrame:
    """Brightness and contrast of ``pixels`` that carry their grade."""
    return pixels.withColumns({c: to_byte(levels(F.col(c), F.col("brightness"), F.col("contrast"), top), top) for c in COLOURS})


def grade_saturation(pixels: DataFrame) -> DataFrame:
    """Colours moved from or to their luminance."""
    lum, s = luminance(*[F.col(c) for c in COLOURS]), F.col("saturation")
    return pixels.withColumns({c: to_byte(F.col(c) * s + lum * (1 - s)) for c in COLOURS})


def grade_curves(pixels: DataFrame) -> DataFrame:
    """Master curve, then the channel's own, on bytes."""
    after = pixels.withColumns({c: _through("__c_m", F.col(c)) for c in COLOURS})
    return after.withColumns({c: _through(f"__c_{c}", F.col(c)) for c in COLOURS})


def grade_page(pixels: DataFrame) -> DataFrame:
    """Curves, levels, saturation, then rounding; alpha stays; a neutral grade changes nothing."""
    # each step is its own projection, so no step is worked out again for every use of it
    rows = pixels.withColumns({f"__l_{c}": _through("__c_m", F.col(c)) for c in COLOURS})
    rows = rows.withColumns({f"__l_{c}": _through(f"__c_{c}", F.col(f"__l_{c}")) for c in COLOURS})
    rows = rows.withColumns({f"__l_{c}": levels(F.col(f"__l_{c}"), F.col("brightness"), F.col("contrast")) for c in COLOURS})
    lum, s = luminance(*[F.col(f"__l_{c}") for c in COLOURS]), F.col("saturation")
    flat = (F.abs("brightness") < NEUTRAL) & (F.abs(F.col("contrast") - 1) < NEUTRAL) & (F.abs(s - 1) < NEUTRAL)
    bare = F.coalesce("__c_m", "__c_r", "__c_g", "__c_b").isNull()
    graded = {c: F.when(flat & bare, F.col(c)).otherwise(to_byte(F.col(f"__l_{c}") * s + lum * (1 - s))).cast("long") for c in COLOURS}
    return rows.withColumns(graded).drop(*[f"__l_{c}" for c in COLOURS])


def with_grades(pixels: DataFrame, grades: DataFrame, curves: DataFrame) -> DataFrame:
    """Pixels with the numbers and curves of their project."""
    return pixels.join(grades.select("project_uid", "brightness", "contrast", "saturation").join(curves, "project_uid", "left"), "project_uid")


def crop_pixels(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels inside ``x0, y0, w, h`` of their image, moved to its corner."""
    rows = pixels.join(rects, "image_uid")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h"))
    return rows.where(inside).select("image_uid", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), *COLOURS, "a")


def stack_and_slice_pixels(pixels: DataFrame, layout: DataFrame, slice_height: int) -> DataFrame:
    """``project_uid, idx, x, y`` and colours: rows of pages on the strip, cut into slices."""
    rows = pixels.join(layout, "image_uid").withColumn("__row", (F.col("start_y") + F.col("y")).cast("long"))
    return rows.select("project_uid", F.expr(f"__row div {slice_height}").alias("idx"), "x", F.expr(f"__row % {slice_height}").alias("y"), *COLOURS, "a")


def pad_tail_white(strips: DataFrame, slice_height: int) -> DataFrame:
    """``project_uid, idx, y, r, g, b, a``: the white rows that fill the last slice of a strip."""
    tail = F.col("total_height") % slice_height
    some = strips.where(tail > 0).withColumn("y", F.explode(F.sequence(tail, F.lit(slice_height - 1).cast("long"))))
    return some.select("project_uid", F.expr(f"total_height div {slice_height}").alias("idx"), "y", *[F.lit(255).cast("long").alias(c) for c in (*COLOURS, "a")])


def blend_mode(kind: Column, below: Column, above: Column) -> Column:
    """Separable blend functions of the W3C compositing text, on values from 0 to 1."""
    screen = below + above - below * above
    overlay = F.when(below <= 0.5, 2 * below * above).otherwise(1 - 2 * (1 - below) * (1 - above))
    return (
        F.when(kind == 1, below * above)
        .when(kind == 2, screen)
        .when(kind == 3, overlay)
        .when(kind == 4, F.least(below, above))
        .when(kind == 5, F.greatest(below, above))
        .otherwise(above)
    )


def composite_overlays(base: DataFrame, overlays: DataFrame) -> DataFrame:
    """``image_uid, x, y, r, g, b, a`` with overlay pixels ``z, blend`` folded on top in z order.

    Pixels without an overlay pass unchanged. Both tables may hold any number of images.
    """
    names = ("r", "g", "b", "a")
    stacked = overlays.groupBy("image_uid", "x", "y").agg(F.array_sort(F.collect_list(F.struct("z", "blend", *names))).alias("__s"))
    rows = base.join(stacked, ["image_uid", "x", "y"], "left")
    start = F.struct(*[(F.col(c) / 255.0).alias(c) for c in names])

    def put(acc: Column, top: Column) -> Column:
        above, under = top["a"] / 255.0, acc["a"]
        alpha = above + under * (1 - above)

        def colour(c: str) -> Column:
            source = top[c] / 255.0
            mixed = above * (1 - under) * source + above * under * blend_mode(top["blend"], acc[c], source) + (1 - above) * under * acc[c]
            return F.when(alpha > 0, mixed / alpha).otherwise(0.0).alias(c)

        return F.struct(colour("r"), colour("g"), colour("b"), alpha.alias("a"))

    done = F.aggregate("__s", start, put)
    return rows.withColumn("__d", done).select(
        "image_uid", "x", "y", *[F.when(F.col("__s").isNull(), F.col(c)).otherwise(to_byte(F.col("__d")[c] * 255)).cast("long").alias(c) for c in names]
    )


def flatten_alpha_white(pixels: DataFrame) -> DataFrame:
    """Colours over white; alpha becomes opaque."""
    a = F.col("a") / 255.0
    return pixels.withColumns({c: to_byte(F.col(c) * a + 255 * (1 - a)) for c in COLOURS} | {"a": F.lit(255).cast("long")})


def band_normalisation(pages: DataFrame) -> DataFrame:
    """``project_uid, uid, to_rgb, add_alpha, target_bands``: nothing is done where all pages of a
    strip have as many bands; else grey becomes colour and all get alpha if one has it."""
    strips = pages.groupBy("project_uid").agg(F.min("bands").alias("__lo"), F.max("bands").alias("__hi"), F.bool_or(F.col("bands").isin(2, 4)).alias("__alpha"))
    rows = pages.join(strips, "project_uid")
    mixed = F.col("__lo") != F.col("__hi")
    target = F.when(~mixed, F.col("bands")).when(F.col("__alpha"), 4).otherwise(3)
    return rows.select(
        "project_uid", "uid", (mixed & (F.col("bands") <= 2)).alias("to_rgb"), (mixed & F.col("__alpha") & ~F.col("bands").isin(2, 4)).alias("add_alpha"), target.cast("long").alias("target_bands")
    )


def promote_bands(pixels: DataFrame) -> DataFrame:
    """Pixels of images with ``bands`` as four bands: grey is repeated, missing alpha is opaque."""
    grey = F.col("bands") <= 2
    return pixels.withColumns(
        {
            "g": F.when(grey, F.col("r")).otherwise(F.col("g")),
            "b": F.when(grey, F.col("r")).otherwise(F.col("b")),
            "a": F.when(F.col("bands").isin(2, 4), F.col("a")).otherwise(255).cast("long"),
        }
    )
