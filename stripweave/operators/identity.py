"""Repairing identifiers and moving references to new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import minted_id


def duplicate_id_repair(palette: DataFrame, prefix: str = "cp") -> DataFrame:
    """``workspace_id, ordinal, name, old_id, new_id``: the first holder keeps an id, later ones get
    another; empty ids are left alone."""
    order = Window.partitionBy("workspace_id", "id").orderBy("ordinal")
    again = (F.col("id") != "") & (F.row_number().over(order) > 1)
    rows = palette.withColumn("__again", again)
    fresh = minted_id(prefix, F.col("workspace_id"), F.col("id"), F.col("ordinal"))
    return rows.select("workspace_id", "ordinal", "name", F.col("id").alias("old_id"), F.when(F.col("__again"), fresh).otherwise(F.col("id")).alias("new_id"))


def mint_missing_ids(palette: DataFrame, prefix: str = "cp") -> DataFrame:
    """``workspace_id, ordinal, old_id, new_id``: empty ids are minted; ``old_id`` is then the name
    that references may have used."""
    empty = F.coalesce("id", F.lit("")) == ""
    fresh = minted_id(prefix, F.col("workspace_id"), F.col("name"), F.col("ordinal"))
    return palette.select(
        "workspace_id", "ordinal", F.when(empty, F.concat(F.lit(prefix + "-"), F.col("name"))).otherwise(F.col("id")).alias("old_id"), F.when(empty, fresh).otherwise(F.col("id")).alias("new_id")
    )


def ensure_unique_file_uids(files: DataFrame, prefix: str = "file") -> DataFrame:
    """``project_uid, pos, uid``: empty or repeated uids are minted anew, in stored order."""
    order = Window.partitionBy("project_uid", "uid").orderBy("pos")
    bad = (F.col("uid") == "") | (F.row_number().over(order) > 1)
    return files.select("project_uid", "pos", F.when(bad, minted_id(prefix, F.col("project_uid"), F.col("uid"), F.col("pos"))).otherwise(F.col("uid")).alias("uid"))


def preset_migration(outputs: DataFrame, presets: DataFrame) -> DataFrame:
    """``workspace_id, ordinal, old_id, action, new_id`` for stored output profiles.

    A stored preset is dropped if unchanged and becomes a user profile if changed; ``op-<name>`` with
    the preset's signature is relinked to it.
    """
    by_id = F.broadcast(presets.select(F.col("id").alias("__pid"), F.col("signature").alias("__sig")))
    by_name = F.broadcast(presets.select(F.concat(F.lit("op-"), F.col("name")).alias("__old"), F.col("id").alias("__target"), F.col("signature").alias("__nsig")))
    rows = outputs.join(by_id, F.col("id") == F.col("__pid"), "left").join(by_name, F.col("id") == F.col("__old"), "left")
    action = (
        F.when(F.col("__pid").isNotNull() & (F.col("signature") == F.col("__sig")), "drop")
        .when(F.col("__pid").isNotNull(), "renew")
        .when(F.col("__target").isNotNull() & (F.col("signature") == F.col("__nsig")), "relink")
        .otherwise("keep")
    )
    fresh = minted_id("op", F.col("workspace_id"), F.col("id"), F.col("ordinal"))
    new = F.when(action == "renew", fresh).when(action == "relink", F.col("__target")).otherwise(F.col("id"))
    return rows.select("workspace_id", "ordinal", F.col("id").alias("old_id"), action.alias("action"), new.alias("new_id"))


def relink_profile_ids(lists: DataFrame, mapping: DataFrame, column: str = "ids") -> DataFrame:
    """Lists of ids with old ids replaced; the order stays. ``mapping`` has ``old_id, new_id``."""
    old, new = F.col("old_id"), F.col("new_id")
    flat = lists.select("*", F.posexplode_outer(column).alias("__pos", "old_id")).join(mapping.select(old, new), "old_id", "left")
    keys = [c for c in lists.columns if c != column]
    item = F.when(old.isNotNull(), F.struct("__pos", F.coalesce(new, old).alias("i")))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["i"]).alias(column))


def import_profiles(existing: DataFrame, bundle: DataFrame, presets: DataFrame, prefix: str = "cp") -> DataFrame:
    """``workspace_id, id, name, origin``: a bundle is appended under fresh ids; presets are skipped."""
    fresh = minted_id(prefix, F.lit("import"), F.col("workspace_id"), F.col("id"), F.col("ordinal"))
    new = bundle.join(F.broadcast(presets.select("id")), "id", "left_anti").select("workspace_id", fresh.alias("id"), "name", F.lit("imported").alias("origin"))
    return existing.select("workspace_id", "id", "name", F.lit("existing").alias("origin")).unionByName(new)


def merge_palettes(current: DataFrame, replacement: DataFrame, presets: DataFrame) -> DataFrame:
    """``workspace_id, ordinal, id, name, templates``: a palette replaced as a whole.

    Templates are carried from the current profile of the same id, preset ids are stripped, missing
    ids minted and repeated ones renewed.
    """
    carried = current.where("id <> ''").groupBy("workspace_id", "id").agg(F.min_by("templates", "ordinal").alias("templates"))
    rows = replacement.join(F.broadcast(presets.select("id")), "id", "left_anti")
    empty = F.col("id") == ""
    again = F.row_number().over(Window.partitionBy("workspace_id", "id").orderBy("ordinal")) > 1
    rows = rows.withColumn("__bad", empty | again).join(carried, ["workspace_id", "id"], "left")
    fresh = minted_id("cp", F.col("workspace_id"), F.col("id"), F.col("ordinal"))
    return rows.select(
        "workspace_id", "ordinal", F.when(F.col("__bad"), fresh).otherwise(F.col("id")).alias("id"), "name", F.coalesce("templates", F.lit("")).alias("templates")
    )


def dangling_references(links: DataFrame, overlays: DataFrame, exclusions: DataFrame, palette: DataFrame, pages: DataFrame) -> DataFrame:
    """``kind, owner, missing_id``: ids in links, anchors and exclusions that point at nothing."""
    uids = pages.select("project_uid", F.col("uid").alias("missing_id"))

    def against(rows: DataFrame, kind: str, known: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(known, on, "left_anti").select(F.lit(kind).alias("kind"), F.col("project_uid").alias("owner"), "missing_id")

    of_links = against(links.select("project_uid", F.col("id").alias("missing_id")), "link", palette.select(F.col("id").alias("missing_id")), ["missing_id"])
    anchors = overlays.where("anchor_input_uid <> ''").select("project_uid", F.col("anchor_input_uid").alias("missing_id"))
    left_out = exclusions.select("project_uid", F.col("uid").alias("missing_id"))
    both = ["project_uid", "missing_id"]
    return of_links.unionByName(against(anchors, "anchor", uids, both)).unionByName(against(left_out, "exclusion", uids, both))
