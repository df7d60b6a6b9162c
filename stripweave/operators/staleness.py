"""Disk checks, what is stale and why, and recording the results of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEAN = ("Processed", "Done")


def disk_check_plan(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``project_uid, kind, path, recorded_sha256`` of the files whose hash decides something."""
    ins = inputs.where((F.col("sha256") != "") | (F.col("status") == "Error")).select(
        "project_uid", F.lit("input").alias("kind"), F.col("file_path").alias("path"), F.col("sha256").alias("recorded_sha256")
    )
    outs = outputs.where("sha256 <> ''").select("project_uid", F.lit("output").alias("kind"), F.col("file_name").alias("path"), F.col("sha256").alias("recorded_sha256"))
    return ins.unionByName(outs)


def apply_disk_checks(files: DataFrame, checks: DataFrame) -> DataFrame:
    """Files ``project_uid, kind, path, status, sha256`` after checks ``project_uid, path,
    recorded_sha256, found, disk_sha256``.

    A check counts only if it was measured against the hash that is still recorded; of several such
    checks, as a path may be listed twice, one is taken by found and hash. Files pass once each.
    """
    keys = [F.col("project_uid").alias("__p"), F.col("path").alias("__f"), F.col("recorded_sha256").alias("__r")]
    measured = F.struct(F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("disk_sha256", F.lit("")).alias("d"))
    c = checks.groupBy(*keys).agg(F.max(measured).alias("__c"))
    same_hash = (F.col("project_uid") == F.col("__p")) & (F.col("path") == F.col("__f")) & F.col("sha256").eqNullSafe(F.col("__r"))
    rows = files.join(c, same_hash, "left").withColumns({"found": F.col("__c.found"), "__d": F.col("__c.d")})
    current, on_disk = F.col("__c").isNotNull(), F.col("__d") != ""
    status = _status(current, F.col("__d") == F.col("sha256"), on_disk)
    adopt = current & F.col("found") & (F.col("kind") == "input") & (F.col("status") == "Error") & on_disk
    return rows.select("project_uid", "kind", "path", status.alias("status"), F.when(adopt, F.col("__d")).otherwise(F.col("sha256")).alias("sha256"))


def _status(current: Column, same: Column, on_disk: Column) -> Column:
    """Status of a file after the check that counts for it, if there is a ``current`` one: ``found``, and whether what lies on disk is the same and there at all."""
    none = F.col("sha256") == ""
    compared = F.when(none, "Pending").when(same, "Processed").otherwise("Modified")
    as_input = (
        F.when(~F.col("found"), "Missing")
        .when((F.col("status") == "Error") & ~on_disk, "Error")
        .when(F.col("status") == "Error", "Processed")
        .when((F.col("status") == "Skipped") & (none | same), "Skipped")
        .otherwise(compared)
    )
    as_output = F.when(~F.col("found"), "Missing").when(none | same, "Done").otherwise("Modified")
    return F.when(current, F.when(F.col("kind") == "input", as_input).otherwise(as_output)).otherwise(F.col("status"))


def status_after_checks(files: DataFrame, checks: DataFrame) -> DataFrame:
    """``files`` with the status of ``apply_disk_checks``, and the hashes and further columns that they had.

    A status only asks whether a hash is empty, below, equal to or above the recorded one. So a check is one number that orders as found and
    hash do, and the last one is the largest number.
    """
    keys = [F.col("project_uid").alias("__p"), F.col("path").alias("__f"), F.col("recorded_sha256").alias("__r")]
    disk, r = F.coalesce("disk_sha256", F.lit("")), F.col("recorded_sha256")
    place = F.when(disk == "", 0).when(disk < r, 1).when(disk == r, 2).when(disk > r, 3).otherwise(1)
    c = checks.groupBy(*keys).agg(F.max(place + F.when(F.coalesce("found", F.lit(False)), 4).otherwise(0)).alias("__c"))
    same_hash = (F.col("project_uid") == F.col("__p")) & (F.col("path") == F.col("__f")) & F.col("sha256").eqNullSafe(F.col("__r"))
    rows = files.join(c, same_hash, "left").withColumns({"found": F.col("__c") >= 4, "__place": F.col("__c") % 4})
    status = _status(F.col("__c").isNotNull(), F.col("__place") == 2, F.col("__place") > 0)
    return rows.withColumn("status", status).select(*files.columns)


def files_ok(files: DataFrame) -> DataFrame:
    """``project_uid, up_to_date`` of projects with files: none is missing, pending or modified."""
    return files.groupBy("project_uid").agg(F.bool_and(~F.col("status").isin("Missing", "Pending", "Modified")).alias("up_to_date"))


def up_to_date(projects: DataFrame, files: DataFrame) -> DataFrame:
    """``project_uid, up_to_date``: no file is missing, pending or modified; no files is fine."""
    rows = projects.select("project_uid").join(files_ok(files), "project_uid", "left")
    return rows.select("project_uid", F.coalesce("up_to_date", F.lit(True)).alias("up_to_date"))


def dirty_outputs(outputs: DataFrame) -> DataFrame:
    """Outputs that are not done."""
    return outputs.where("status <> 'Done'").select("project_uid", "file_name")


def canvas_staleness(pages: DataFrame, palette: DataFrame) -> DataFrame:
    """``pages`` with ``changed`` and ``unknown``.

    Pages carry the match of today (``profile_id``), what was recorded at render (``profile_then,
    fingerprint_then``, null or empty for none) and ``width_then, height_then`` (0 if unknown);
    ``palette`` of today has ``id, signature``.
    """
    today = palette.select(F.col("id").alias("profile_id"), F.col("signature").alias("__now"))
    then = palette.select(F.col("id").alias("profile_then"), F.col("signature").alias("__still"))
    rows = pages.join(today, "profile_id", "left").join(then, "profile_then", "left")
    profile, mark = F.coalesce("profile_then", F.lit("")), F.coalesce("fingerprint_then", F.lit(""))
    sized = (F.col("width_then") > 0) & (F.col("height_then") > 0)
    differs = (F.coalesce("profile_id", F.lit("")) != profile) | (F.coalesce("__now", F.lit("")) != mark)
    gone = (profile != "") & (F.col("__still").isNull() | (F.col("__still") != mark))
    return rows.withColumns({"changed": F.when(sized, differs).otherwise(gone), "unknown": ~sized}).select(*pages.columns, "changed", "unknown")


def canvas_flags(changes: DataFrame, ids_now: DataFrame, ids_then: DataFrame) -> DataFrame:
    """``project_uid, pages_changed, list_changed`` from page changes and ordered id lists."""
    rolled = changes.groupBy("project_uid").agg(F.bool_or("changed").alias("pages_changed"), F.bool_or("unknown").alias("__any"))
    lists = ids_now.select("project_uid", F.col("ids").alias("__n")).join(ids_then.select("project_uid", F.col("ids").alias("__t")), "project_uid", "full_outer")
    rows = rolled.join(lists, "project_uid", "left")
    return rows.select("project_uid", "pages_changed", (F.col("__any") & ~F.col("__n").eqNullSafe(F.col("__t"))).alias("list_changed"))


def staleness_report(projects: DataFrame, files_ok: DataFrame, outputs: DataFrame, canvas: DataFrame, composition: DataFrame) -> DataFrame:
    """Flags of each project.

    Projects carry ``output_then, output_now`` signatures (null or empty: none), the wanted ``ext`` and either
    ``processing_changed`` or the signatures ``processing_then, processing_now``. An output signature that was never
    recorded is no change.
    """
    if "processing_changed" in projects.columns:
        processing = F.coalesce("processing_changed", F.lit(False))
    else:
        processing = F.coalesce("processing_then", F.lit("")) != F.coalesce("processing_now", F.lit(""))
    first = outputs.groupBy("project_uid").agg(F.min_by("file_name", "idx").alias("__first"))
    rows = (
        projects.join(first, "project_uid", "left")
        .join(files_ok, "project_uid", "left")
        .join(canvas, "project_uid", "left")
        .join(composition.withColumnRenamed("changed", "__comp"), "project_uid", "left")
    )
    has = F.col("__first").isNotNull()
    ext = F.regexp_extract(F.coalesce("__first", F.lit("")), r"(\.[^.]*)$", 1)
    flags = rows.select(
        "project_uid",
        has.alias("has_outputs"),
        (~F.coalesce("up_to_date", F.lit(True))).alias("content_dirty"),
        (F.coalesce(F.col("output_then") != "", F.lit(False)) & (F.col("output_then") != F.col("output_now"))).alias("output_profile_changed"),
        ((ext != "") & (ext != F.col("ext"))).alias("output_format_changed"),
        processing.alias("processing_changed"),
        (has & F.coalesce("__comp", F.lit(False))).alias("composition_changed"),
        (has & (F.coalesce("pages_changed", F.lit(False)) | F.coalesce("list_changed", F.lit(False)))).alias("canvas_changed"),
        (has & F.coalesce("list_changed", F.lit(False))).alias("list_changed"),
    )
    any_flag = F.col("output_profile_changed") | F.col("output_format_changed") | F.col("processing_changed") | F.col("composition_changed") | F.col("canvas_changed")
    return flags.withColumn("configuration_changed", F.col("has_outputs") & any_flag).withColumn("needs_render", F.col("content_dirty") | F.col("configuration_changed"))


def render_decision(report: DataFrame, inputs: DataFrame) -> DataFrame:
    """``project_uid, decision``: up_to_date, partial or full."""
    settled = inputs.groupBy("project_uid").agg(F.bool_and(F.col("status").isin("Processed", "Skipped", "Error")).alias("__settled"))
    rows = report.join(settled, "project_uid", "left")
    decision = (
        F.when(F.col("has_outputs") & ~F.col("needs_render"), "up_to_date")
        .when(F.col("has_outputs") & ~F.col("configuration_changed") & F.coalesce("__settled", F.lit(False)), "partial")
        .otherwise("full")
    )
    return rows.select("project_uid", decision.alias("decision"))


def file_staleness(report: DataFrame, pages: DataFrame, outputs: DataFrame, segments: DataFrame) -> DataFrame:
    """``project_uid, kind, name, status, canvas, composition, unrendered, output, processing`` for every
    file of projects with outputs.

    Pages carry ``status`` and ``changed``; ``segments`` links their uids to output indexes.
    """
    flags = report.where("has_outputs").select(
        "project_uid", "list_changed", "composition_changed", (F.col("output_profile_changed") | F.col("output_format_changed")).alias("__out"), "processing_changed"
    )
    pending = pages.groupBy("project_uid").agg(F.bool_or(F.col("status") == "Pending").alias("__pending"))
    moved = pages.where("changed").select("project_uid", "uid").distinct()
    fed = segments.join(moved, ["project_uid", "uid"]).select("project_uid", F.col("slice_index").alias("idx")).distinct().withColumn("__page", F.lit(True))
    no = F.lit(False)
    ins = pages.join(flags, "project_uid").select(
        "project_uid", F.lit("input").alias("kind"), F.col("uid").alias("name"), "status", (F.col("list_changed") | F.col("changed")).alias("canvas"),
        no.alias("composition"), no.alias("unrendered"), no.alias("output"), no.alias("processing"),
    )
    outs = outputs.join(flags.join(pending, "project_uid", "left"), "project_uid").join(fed, ["project_uid", "idx"], "left").select(
        "project_uid", F.lit("output").alias("kind"), F.col("file_name").alias("name"), "status", (F.col("list_changed") | F.coalesce("__page", no)).alias("canvas"),
        F.col("composition_changed").alias("composition"), F.coalesce("__pending", no).alias("unrendered"), F.col("__out").alias("output"),
        F.col("processing_changed").alias("processing"),
    )
    return ins.unionByName(outs)


def display_status(files: DataFrame) -> DataFrame:
    """``project_uid, kind, name, shown_status``: a clean file that is stale shows as desynchronized."""
    stale = F.col("canvas") | F.col("composition") | F.col("unrendered") | F.col("output") | F.col("processing")
    return files.select("project_uid", "kind", "name", F.when(F.col("status").isin(*CLEAN) & stale, "Desynchronized").otherwise(F.col("status")).alias("shown_status"))


def project_status(shown: DataFrame, pages: DataFrame, palette: DataFrame) -> DataFrame:
    """``project_uid, kind, name, shown_status, profile_name``; ids without a profile are missing."""
    names = palette.select(F.col("id").alias("profile_then"), F.col("name").alias("__n"))
    of_page = pages.select("project_uid", F.col("uid").alias("name"), "profile_then")
    # only pages have profiles, so no other file is looked up
    rows = shown.where("kind = 'input'").join(of_page, ["project_uid", "name"], "left").join(names, "profile_then", "left")
    named = F.when(F.coalesce("profile_then", F.lit("")) == "", "").otherwise(F.coalesce("__n", F.lit("(missing)")))
    others = shown.where("NOT (kind <=> 'input')").select("project_uid", "kind", "name", "shown_status", F.lit("").alias("profile_name"))
    return rows.select("project_uid", "kind", "name", "shown_status", named.alias("profile_name")).unionByName(others)


def apply_render_results(inputs: DataFrame, records: DataFrame, feeds: DataFrame, applied: DataFrame, more: tuple = ()) -> DataFrame:
    """Inputs after a run: ``project_uid, uid, status, sha256, contributes_to, width, height,
    profile_then, error`` and ``more`` columns of ``inputs`` or ``applied`` as they are.

    ``records`` has ``outcome`` (skipped or rendered) and the measured ``new_sha256`` per page;
    ``feeds`` the slices of each page; ``applied`` the profile and size used.
    """
    rows = (
        inputs.join(records, ["project_uid", "uid"], "left").join(feeds, ["project_uid", "uid"], "left").join(applied, ["project_uid", "uid"], "left")
    )
    skipped, run = F.col("outcome") == "skipped", F.col("outcome") == "rendered"
    hashed = F.coalesce("new_sha256", F.lit("")) != ""
    status = F.when(skipped, "Skipped").when(run & hashed, "Processed").when(run, "Error").otherwise(F.col("status"))
    return rows.select(
        "project_uid", "uid", status.alias("status"),
        F.when(run & hashed, F.col("new_sha256")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(run, F.coalesce("slices", F.lit(""))).otherwise("").alias("contributes_to"),
        F.when(run & (F.coalesce("used_width", F.lit(0)) > 0), F.col("used_width")).otherwise(F.col("width")).alias("width"),
        F.when(run & (F.coalesce("used_height", F.lit(0)) > 0), F.col("used_height")).otherwise(F.col("height")).alias("height"),
        F.when(run, F.coalesce("used_profile", F.lit(""))).otherwise("").alias("profile_then"),
        F.when(run & ~hashed, "InputHashFailed").otherwise("").alias("error"), *more,
    )


def apply_partial_results(outputs: DataFrame, done: DataFrame) -> DataFrame:
    """Outputs with the hashes of the slices that a partial run wrote; these are done."""
    new = done.select("project_uid", "file_name", F.col("sha256").alias("__new"))
    rows = outputs.join(new, ["project_uid", "file_name"], "left")
    return rows.select(
        "project_uid", "file_name", F.coalesce("__new", "sha256").alias("sha256"), F.when(F.col("__new").isNotNull(), "Done").otherwise(F.col("status")).alias("status")
    )


def run_summary(names: DataFrame, plan: DataFrame, decision: DataFrame) -> DataFrame:
    """``project_uid, slice_count, output_files, skipped_pages, incremental, up_to_date``."""
    files = names.groupBy("project_uid").agg(
        F.count(F.lit(1)).alias("__n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "file_name"))), lambda s: s["file_name"]), ",").alias("__f")
    )
    skipped = plan.groupBy("project_uid").agg(F.count_if(F.col("plan").startswith("Skipped")).alias("__s"))
    rows = decision.join(files, "project_uid", "left").join(skipped, "project_uid", "left")
    return rows.select(
        "project_uid", F.coalesce("__n", F.lit(0)).alias("slice_count"), F.coalesce("__f", F.lit("")).alias("output_files"), F.coalesce("__s", F.lit(0)).alias("skipped_pages"),
        (F.col("decision") == "partial").alias("incremental"), (F.col("decision") == "up_to_date").alias("up_to_date"),
    )


def list_projects(projects: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``project_uid, n_inputs, n_outputs``."""
    i = inputs.groupBy("project_uid").agg(F.count(F.lit(1)).alias("__i"))
    o = outputs.groupBy("project_uid").agg(F.count(F.lit(1)).alias("__o"))
    rows = projects.select("project_uid").join(i, "project_uid", "left").join(o, "project_uid", "left")
    return rows.select("project_uid", F.coalesce("__i", F.lit(0)).alias("n_inputs"), F.coalesce("__o", F.lit(0)).alias("n_outputs"))


def latest(checks: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last check of each key."""
    last = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return checks.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")
