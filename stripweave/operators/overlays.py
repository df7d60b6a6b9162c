"""Overlays: where they lie on the strip and which slices they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_overlay_anchors(overlays: DataFrame, layout: DataFrame, target_width: Column) -> DataFrame:
    """``project_uid, uid, x, y, width, enabled, blend, z``; orphans are left out.

    Fractions scale by the target width; an anchored overlay starts at its page's top.
    """
    tops = layout.select("project_uid", F.col("uid").alias("anchor_input_uid"), F.col("start_y").alias("__top"))
    rows = overlays.join(tops, ["project_uid", "anchor_input_uid"], "left")
    rows = rows.where((F.col("anchor_input_uid") == "") | F.col("__top").isNotNull())

    def px(name: str) -> Column:
        return F.round(F.col(name) * target_width).cast("long")

    return rows.select(
        "project_uid", "uid", px("x_frac").alias("x"), (px("y_frac") + F.coalesce("__top", F.lit(0))).alias("y"), px("w_frac").alias("width"), "enabled", "blend", "z"
    )


def orphan_overlays(overlays: DataFrame, layout: DataFrame) -> DataFrame:
    """``project_uid, uid`` of overlays anchored to a page that is not in the layout."""
    pages = layout.select("project_uid", F.col("uid").alias("anchor_input_uid"))
    return overlays.where("anchor_input_uid <> ''").join(pages, ["project_uid", "anchor_input_uid"], "left_anti").select("project_uid", "uid")


def overlay_slices(placed: DataFrame, counted: DataFrame, slice_height: int) -> DataFrame:
    """``project_uid, slice_index, uid, z, local_x, local_y``: slices that an overlay touches.

    ``placed`` has ``asset_path, asset_w, asset_h``; the height follows the asset's shape. The span
    is clamped to the strip, so slices are named by division.
    """
    height = F.greatest(F.lit(1).cast("long"), F.floor(F.col("asset_h") * F.col("width") / F.col("asset_w") + 0.5).cast("long"))
    rows = placed.where(F.col("enabled") & (F.col("asset_path") != "") & (F.col("width") > 0)).withColumn("__h", height)
    rows = rows.join(counted.select("project_uid", "total_height"), "project_uid")
    rows = rows.withColumn("__from", F.greatest(F.lit(0).cast("long"), F.col("y"))).withColumn("__to", F.least(F.col("y") + F.col("__h"), F.col("total_height")))
    rows = rows.where("__to > __from").withColumn("slice_index", F.explode(F.expr(f"sequence(__from div {slice_height}, (__to - 1) div {slice_height})")))
    return rows.select("project_uid", "slice_index", "uid", "z", F.col("x").alias("local_x"), (F.col("y") - F.col("slice_index") * slice_height).alias("local_y"))


def overlay_asset_dedup(overlays: DataFrame) -> DataFrame:
    """``project_uid, uid, stored_path``: the same content in a project reuses the first path."""
    order = Window.partitionBy("project_uid", "sha256").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("asset_path") != "", F.col("asset_path")), ignorenulls=True).over(order)
    own = F.when(F.col("sha256") != "", first)
    return overlays.select("project_uid", "uid", F.coalesce(own, F.col("asset_path")).alias("stored_path"))
