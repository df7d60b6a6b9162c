"""Canvas and output profiles: margins, catalogue of presets, comparison, import and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import EXTENSIONS, lookup

#: The presets, in order: id, name, width, slice height, format.
PRESETS = [
    ("op-preset-webtoon-standard", "Webtoon Standard", 800, 1280, "JPEG"),
    ("op-preset-tapas", "Tapas", 940, 1504, "JPEG"),
    ("op-preset-namicomi", "NAMICOMI", 1200, 1600, "PNG"),
    ("op-preset-globalcomix", "GlobalComix (HD)", 1280, 2560, "WebP"),
    ("op-preset-popjoy", "Popjoy", 1000, 2000, "JPEG"),
    ("op-preset-comicfury", "ComicFury / Indie", 950, 1500, "JPEG"),
]


def presets_sql() -> str:
    """The presets as an inline relation, in SQL."""
    rows = ", ".join(f"('{i}', {k}, '{n}', {w}, {h}, '{f}')" for k, (i, n, w, h, f) in enumerate(PRESETS, 1))
    return f"SELECT * FROM (VALUES {rows}) AS t(id, ordinal, name, target_width, slice_height, format)"


def preset_catalogue(spark: SparkSession) -> DataFrame:
    """The presets as an inline relation; all keep the tail, start at 1 and have 72 dpi."""
    table = spark.sql(presets_sql())
    return table.withColumns({"policy": F.lit("KeepAsIs"), "start_index": F.lit(1), "dpi": F.lit(72.0)})


def safe_area(profiles: DataFrame) -> DataFrame:
    """``id, safe_w, safe_h``: the canvas without its margins."""
    return profiles.select("id", (F.col("width") - F.col("ml") - F.col("mr")).alias("safe_w"), (F.col("height") - F.col("mt") - F.col("mb")).alias("safe_h"))


def canvas_from_safe_area(areas: DataFrame) -> DataFrame:
    """``id, width, height``: the safe area with its margins."""
    return areas.select("id", (F.col("safe_w") + F.col("ml") + F.col("mr")).alias("width"), (F.col("safe_h") + F.col("mt") + F.col("mb")).alias("height"))


def validate_margins(profiles: DataFrame) -> DataFrame:
    """``id, ok, reason``: margins must not be negative and must leave a width and a height."""
    long = {c: F.col(c).cast("long") for c in ("width", "height", "mt", "mr", "mb", "ml")}
    reason = (
        F.when(F.least(long["mt"], long["mr"], long["mb"], long["ml"]) < 0, "negative margin")
        .when(long["width"] - long["ml"] - long["mr"] <= 0, "no width left")
        .when(long["height"] - long["mt"] - long["mb"] <= 0, "no height left")
        .otherwise("")
    )
    return profiles.select("id", (reason == "").alias("ok"), reason.alias("reason"))


def margin_crop_rect(matched: DataFrame, profiles: DataFrame) -> DataFrame:
    """``project_uid, uid, x, y, w, h, do_crop``: only matched pages with a margin are cropped."""
    p = profiles.select(F.col("id").alias("profile_id"), "mt", "mr", "mb", "ml")
    rows = matched.join(p, "profile_id", "left")
    crop = F.col("mt").isNotNull() & (F.greatest("mt", "mr", "mb", "ml") > 0)

    def either(a: Column, b: Column) -> Column:
        return F.when(crop, a).otherwise(b).cast("long")

    return rows.select(
        "project_uid", "uid",
        either(F.col("ml"), F.lit(0)).alias("x"), either(F.col("mt"), F.lit(0)).alias("y"),
        either(F.col("width") - F.col("ml") - F.col("mr"), F.col("width")).alias("w"),
        either(F.col("height") - F.col("mt") - F.col("mb"), F.col("height")).alias("h"),
        F.coalesce(crop, F.lit(False)).alias("do_crop"),
    )


def list_profiles(canvas: DataFrame, user: DataFrame, presets: DataFrame) -> DataFrame:
    """``kind, id, name, width, height, ext, tag``: canvas profiles, user outputs, then presets."""
    area = safe_area(canvas)
    c = canvas.join(area, "id").select(F.lit("canvas").alias("kind"), "id", "name", F.col("safe_w").alias("width"), F.col("safe_h").alias("height"), F.lit("").alias("ext"), F.lit("user").alias("tag"))

    def outputs(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(F.lit("output").alias("kind"), "id", "name", F.col("target_width").alias("width"), F.col("slice_height").alias("height"), lookup(F.col("format"), EXTENSIONS).alias("ext"), F.lit(tag).alias("tag"))

    return c.unionByName(outputs(user, "user")).unionByName(outputs(presets, "preset"))


#: Groups of profile fields that are compared, in the order in which differences are listed.
FIELD_GROUPS = {"size": ["width", "height"], "margins": ["margin"], "colours": ["colour"], "dpi": ["dpi"]}


def distinguish_profiles(palette: DataFrame) -> DataFrame:
    """``workspace_id, ordinal, duplicate, differs``: a profile against others of the same name."""
    key = F.lower("name").alias("__name")
    fields = [f for group in FIELD_GROUPS.values() for f in group]
    own = palette.select("workspace_id", "ordinal", key, *fields)
    other = palette.select("workspace_id", F.col("ordinal").alias("__o"), key, *[F.col(f).alias(f"__{f}") for f in fields])
    pairs = own.join(other, ["workspace_id", "__name"]).where("ordinal <> __o")
    diff = {g: ~_all_same(names) for g, names in FIELD_GROUPS.items()}
    any_diff = [F.bool_or(d).alias(g) for g, d in diff.items()]
    every = F.lit(True)
    for d in diff.values():
        every = every & ~d
    found = pairs.groupBy("workspace_id", "ordinal").agg(F.bool_or(every).alias("duplicate"), *any_diff)
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(g), F.lit(g)) for g in diff])), ",")
    return found.select("workspace_id", "ordinal", "duplicate", F.when(F.col("duplicate"), "").otherwise(named).alias("differs"))


def _all_same(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return out


def only_names(profiles: DataFrame, names: DataFrame | str) -> tuple[DataFrame, DataFrame]:
    """Profiles of the names, and the names that matched none.

    ``names`` is a comma list or a frame with ``name``; blanks around names do not count.
    """
    if isinstance(names, str):
        names = profiles.sparkSession.createDataFrame([(n,) for n in names.split(",")], "name string")
    wanted = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    return profiles.join(wanted, "name", "left_semi"), wanted.join(profiles.select("name"), "name", "left_anti")


def template_check(templates: DataFrame) -> DataFrame:
    """``id, format, shared_with, n_differences``: profiles whose template lies at the same path,
    and signature fields that changed. Paths compare without case and with either slash."""
    path = F.lower(F.translate("path", "\\", "/"))
    rows = templates.withColumn("__path", path)
    shared = rows.select(F.col("id").alias("__id"), "__path")
    others = rows.join(shared, "__path").where("id <> __id").groupBy("id", "format").agg(F.array_join(F.array_sort(F.collect_set("__id")), ",").alias("shared_with"))
    return (
        rows.withColumn("n_differences", F.size(_changed_fields(F.col("was"), F.col("now"))).cast("long"))
        .join(others, ["id", "format"], "left")
        .select("id", "format", F.coalesce("shared_with", F.lit("")).alias("shared_with"), "n_differences")
    )


def _changed_fields(was: Column, now: Column) -> Column:
    old = F.str_to_map(was, F.lit(";"), F.lit("="))
    pairs = F.filter(F.split(now, ";"), lambda p: F.length(p) > 0)
    return F.filter(
        pairs, lambda p: F.coalesce(F.try_element_at(old, F.split_part(p, F.lit("="), F.lit(1))), F.lit("")) != F.split_part(p, F.lit("="), F.lit(2))
    )


def signature_diff(rows: DataFrame) -> DataFrame:
    """``key, seq, field, was, now``: fields of the new signature whose old value differs."""
    old = F.str_to_map(F.col("was"), F.lit(";"), F.lit("="))
    parts = rows.select("key", old.alias("__old"), F.posexplode(F.split("now", ";")).alias("seq", "__p")).where("length(__p) > 0")
    field = F.split_part("__p", F.lit("="), F.lit(1))
    parts = parts.withColumn("field", field).withColumn("now", F.split_part("__p", F.lit("="), F.lit(2)))
    parts = parts.withColumn("was", F.coalesce(F.try_element_at("__old", F.col("field")), F.lit("")))
    return parts.where("was <> now").select("key", F.col("seq").cast("long").alias("seq"), "field", "was", "now")


def meta_changes(before: DataFrame, after: DataFrame, fields: list[str], template: str) -> DataFrame:
    """``id, change`` between two snapshots of a palette: added, removed, changed or template only."""

    def packed(rows: DataFrame, p: str) -> DataFrame:
        return rows.select("id", F.to_json(F.struct(*fields)).alias(f"{p}_fields"), F.col(template).alias(f"{p}_template"), F.lit(True).alias(f"{p}_is"))

    both = packed(before, "b").join(packed(after, "a"), "id", "full_outer")
    change = (
        F.when(F.col("b_is").isNull(), "added")
        .when(F.col("a_is").isNull(), "removed")
        .when(~F.col("b_fields").eqNullSafe(F.col("a_fields")), "changed")
        .when(~F.col("b_template").eqNullSafe(F.col("a_template")), "template")
    )
    return both.select("id", change.alias("change")).where("change IS NOT NULL")


def first_holders(palette: DataFrame, key: list[str], order: str) -> DataFrame:
    """Add ``__rn``: 1 for the first holder of each key."""
    return palette.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
