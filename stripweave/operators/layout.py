"""Placing pages on strips, cutting strips into slices and tracing which rows feed which slice.

Strips are keyed by ``project_uid``. Pages have ``uid, ord, width, height``; sums are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import EXTENSIONS, lookup, scaled_height, slice_name

INT_MAX = 2**31 - 1


def scaled_size(pages: DataFrame, target_width: Column) -> DataFrame:
    """Add ``scaled_w, scaled_h``; pages without a width or with a target under 1 get nulls."""
    ok = (F.col("width") > 0) & (target_width >= 1)
    return pages.withColumns(
        {
            "scaled_w": F.when(ok, target_width.cast("long")),
            "scaled_h": F.when(ok, scaled_height(F.col("height"), F.col("width"), target_width)),
        }
    )


def strip_layout(pages: DataFrame, height: str = "scaled_h") -> DataFrame:
    """Add ``start_y``: the heights of all earlier pages of the strip."""
    before = Window.partitionBy("project_uid").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start_y", F.coalesce(F.sum(F.col(height).cast("long")).over(before), F.lit(0)))


def strip_layout_chunked(pages: DataFrame, height: str = "scaled_h", chunk: int = 100_000) -> DataFrame:
    """``strip_layout`` for very long strips: sums inside chunks, shifted by the chunks before."""
    cut = pages.withColumn("__chunk", F.floor(F.col("ord") / chunk).cast("long"))
    sums = cut.groupBy("project_uid", "__chunk").agg(F.sum(F.col(height).cast("long")).alias("__sum"))
    before = Window.partitionBy("project_uid").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("project_uid", "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("project_uid", "__chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("start_y", F.coalesce(F.sum(F.col(height).cast("long")).over(inside), F.lit(0)))
        .join(sums, ["project_uid", "__chunk"])
        .withColumn("start_y", F.col("start_y") + F.col("__shift"))
        .drop("__chunk", "__shift")
    )


def strip_totals(layout: DataFrame, height: str = "scaled_h", width: str = "scaled_w") -> DataFrame:
    """``project_uid, width, total_height, n_pages, overflow``; overflow past 32 bits is flagged."""
    return layout.groupBy("project_uid").agg(
        F.max(width).alias("width"),
        F.sum(F.col(height).cast("long")).alias("total_height"),
        F.count(F.lit(1)).alias("n_pages"),
        (F.sum(F.col(height).cast("long")) > INT_MAX).alias("overflow"),
    )


def slice_count(totals: DataFrame) -> DataFrame:
    """Add ``n_full, tail, n_slices`` for strips with ``total_height, slice_height, policy``."""
    ok = F.col("slice_height") > 0
    full = F.when(ok, F.expr("total_height div slice_height")).otherwise(F.lit(0).cast("long"))
    tail = F.when(ok, F.expr("total_height % slice_height")).otherwise(F.lit(0).cast("long"))
    return totals.withColumns({"n_full": full, "tail": tail.cast("long")}).withColumn(
        "n_slices", F.col("n_full") + ((F.col("tail") > 0) & (F.col("policy") != "Crop")).cast("long")
    )


def slice_names(counted: DataFrame) -> DataFrame:
    """One row per slice of every strip: ``project_uid, idx, file_name``."""
    some = counted.where("n_slices > 0").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slices") - 1)))
    return some.select("project_uid", "idx", slice_name(F.col("start_index") + F.col("idx"), lookup(F.col("format"), EXTENSIONS)).alias("file_name"))


def slice_source_map(layout: DataFrame, slice_height: Column, height: str = "scaled_h") -> DataFrame:
    """``project_uid, slice_index, seq, uid, source_y, height``: rows of pages that feed slices.

    Each page names its own slices by division, so no rows are compared across a range.
    """
    start, h, step = F.col("start_y"), F.col(height).cast("long"), slice_height.cast("long")
    rows = layout.where((h > 0) & (step > 0)).withColumn("__step", step).withColumn("__h", h)
    rows = rows.withColumn("slice_index", F.explode(F.expr("sequence(start_y div __step, (start_y + __h - 1) div __step)")))
    top, bottom = F.col("slice_index") * F.col("__step"), (F.col("slice_index") + 1) * F.col("__step")
    first, last = F.greatest(start, top), F.least(start + F.col("__h"), bottom)
    return rows.select(
        "project_uid", "slice_index", F.col("ord").alias("seq"), "uid", (first - start).cast("long").alias("source_y"), (last - first).cast("long").alias("height")
    )


def provenance_check(segments: DataFrame, totals: DataFrame, slice_height: int) -> DataFrame:
    """Per slice of every strip in ``totals``: expected height, the height of its segments, and whether they
    agree and each later segment starts at its page's first row. A slice without segments has height 0."""
    order = Window.partitionBy("project_uid", "slice_index").orderBy("seq")
    held = (
        segments.withColumn("__ok", (F.row_number().over(order) == 1) | (F.col("source_y") == 0))
        .groupBy("project_uid", "slice_index")
        .agg(F.sum("height").alias("__held"), F.bool_and("__ok").alias("__follows"))
    )
    last = F.expr(f"(total_height - 1) div {slice_height}")
    due = totals.where("total_height > 0").select("project_uid", "total_height", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slice_index"))
    expected = F.least(F.lit(slice_height).cast("long"), F.col("total_height") - F.col("slice_index") * slice_height)
    actual = F.coalesce("__held", F.lit(0).cast("long"))
    rows = due.join(held, ["project_uid", "slice_index"], "full_outer").withColumns({"expected": F.coalesce(expected, F.lit(0).cast("long")), "actual": actual})
    ok = F.coalesce("__follows", F.lit(False)) & (F.col("expected") == F.col("actual"))
    return rows.select("project_uid", "slice_index", "expected", "actual", ok.alias("ok"))


def contributes_to(segments: DataFrame) -> DataFrame:
    """Per page the comma-joined numbers of the slices that it feeds, in order."""
    return segments.groupBy("project_uid", "uid").agg(F.array_join(F.array_sort(F.collect_list("slice_index")), ",").alias("slices"))


def slice_fan_in(segments: DataFrame) -> DataFrame:
    """Per slice the number of pages that feed it, and the project's peak."""
    fan = segments.groupBy("project_uid", "slice_index").agg(F.count(F.lit(1)).alias("n_pages"))
    return fan.join(fan.groupBy("project_uid").agg(F.max("n_pages").alias("peak")), "project_uid").select("project_uid", "slice_index", "n_pages", "peak")


def slices_to_render(planned: DataFrame, wanted: DataFrame) -> DataFrame:
    """Planned slices with ``action``: render if named in ``wanted``, else skip."""
    names = wanted.select("project_uid", "file_name").distinct().withColumn("__hit", F.lit(True))
    return planned.join(names, ["project_uid", "file_name"], "left").select(
        "project_uid", "idx", "file_name", F.when(F.col("__hit"), "render").otherwise("skip").alias("action")
    )


def stale_output_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old output names that a new run no longer makes."""
    return old.select("project_uid", "file_name").join(new.select("project_uid", "file_name"), ["project_uid", "file_name"], "left_anti")


def inputs_in_order(pages: DataFrame, stored: str) -> DataFrame:
    """``project_uid, uid, rn``: stable order by ``ord``, ties by stored position."""
    return pages.select("project_uid", "uid", F.row_number().over(Window.partitionBy("project_uid").orderBy("ord", stored)).cast("long").alias("rn"))


def validate_input_order(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """``project_uid, accepted, reason``: a proposal must be a permutation of the project's uids.

    ``proposals`` has one row for each ``project_uid, pos, uid``.
    """
    known = pages.select("project_uid", F.col("uid"), F.lit(True).alias("__known"))
    per_pages = pages.groupBy("project_uid").agg(F.count(F.lit(1)).alias("__n"))
    seen = (
        proposals.join(known, ["project_uid", "uid"], "left")
        .groupBy("project_uid")
        .agg(F.count(F.lit(1)).alias("__m"), F.count_distinct("uid").alias("__d"), F.count_if(F.col("__known").isNull()).alias("__u"))
    )
    both = seen.join(per_pages, "project_uid", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    reason = (
        F.when(F.col("__m") != F.col("__n"), "count")
        .when(F.col("__d") != F.col("__m"), "repeated")
        .when(F.col("__u") > 0, "unknown")
        .otherwise("")
    )
    return both.select("project_uid", (reason == "").alias("accepted"), reason.alias("reason"))


def composition_backfill(segments: DataFrame) -> DataFrame:
    """``project_uid, input_order``: sources by first appearance in slices ordered by file name."""
    first = segments.groupBy("project_uid", "uid").agg(F.min(F.struct("file_name", "seq")).alias("__first"))
    return first.groupBy("project_uid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__first", "uid"))), lambda s: s["uid"]), ",").alias("input_order")
    )


def sequence_change(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """``project_uid, changed``: two ordered lists compared as a whole; an empty baseline is none."""
    both = now.join(baseline, "project_uid", "left")
    old = F.coalesce(F.col("baseline"), F.array().cast("array<string>"))
    return both.select("project_uid", ((F.size(old) > 0) & (F.col("now") != old)).alias("changed"))


def order_digest(rows: DataFrame, *order: str) -> DataFrame:
    """``project_uid`` and three numbers that tell the uids of its pages in order, so that no list is made."""
    at = F.row_number().over(Window.partitionBy("project_uid").orderBy(*order))
    return ranked_digest(rows.select("project_uid", "uid", at.alias("__at")))


def ranked_digest(rows: DataFrame) -> DataFrame:
    """``order_digest`` of pages that carry their place ``__at``, a whole number from 1."""
    h = F.xxhash64(F.col("__at").cast("int"), "uid")
    sums = [F.count(F.lit(1)), F.bit_xor("__h"), F.sum(F.pmod(F.col("__h"), F.lit(2**31 - 1)))]
    return rows.select("project_uid", h.alias("__h")).groupBy("project_uid").agg(F.struct(*sums).alias("__digest"))


def order_change(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """``sequence_change`` of two ``order_digest``: ``project_uid, changed``."""
    both = now.withColumnRenamed("__digest", "__now").join(baseline, "project_uid", "left")
    return both.select("project_uid", (F.col("__digest").isNotNull() & ~F.col("__now").eqNullSafe(F.col("__digest"))).alias("changed"))
