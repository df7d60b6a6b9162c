"""Workspace documents: reading, normalising, writing, and the text forms of profile values.

A workspace is one JSON document. ``read_workspaces`` gives the catalogue tables; documents that
break a required rule go to ``bad_workspaces``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT_VERSION = 3

SEGMENT = "struct<sourceFilePath:string,srcY:int,height:int>"
INPUT = "struct<uid:string,filePath:string,sha256:string,order:int,status:string,lastProcessed:string,contributesTo:array<string>,canvasProfileId:string,canvasFingerprint:string,width:int,height:int>"
OUTPUT = f"struct<uid:string,fileName:string,sha256:string,sourceMap:array<{SEGMENT}>,status:string>"
OVERLAY = "struct<uid:string,assetPath:string,assetPathRelative:string,sha256:string,anchorInputUid:string,xFrac:double,yFrac:double,wFrac:double,enabled:boolean,blend:string,content:string>"
TEMPLATE = "struct<path:string,format:string,fingerprint:string,sha256:string,generatedAt:string>"
CANVAS = f"struct<id:string,name:string,canvasSize:struct<width:int,height:int>,margins:struct<top:int,right:int,bottom:int,left:int>,dpi:double,templates:array<{TEMPLATE}>,templateInfo:{TEMPLATE}>"
OUT_PROFILE = "struct<id:string,name:string,targetWidth:int,sliceHeight:int,lastSlicePolicy:string,outputFormat:string,startIndex:int,dpi:double>"
PROJECT = f"struct<name:string,uid:string,inputDirectory:string,outputProfileId:string,canvasProfileIds:array<string>,inputs:array<{INPUT}>,outputs:array<{OUTPUT}>,overlays:array<{OVERLAY}>>"
SCHEMA = f"version int, outputDirectory string, canvasProfiles array<{CANVAS}>, outputProfiles array<{OUT_PROFILE}>, projectItems array<{PROJECT}>, stripDirty boolean, _corrupt string"


def parse_workspaces(documents: DataFrame) -> DataFrame:
    """Documents ``workspace_id, json`` parsed to one typed row each, with ``problem`` (empty if fine)."""
    # unrolled, so a filter on the fields does not parse the text again for each of them
    parsed = documents.select("workspace_id", "json", F.inline(F.array(F.from_json("json", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}))))
    problem = (
        F.when(F.col("_corrupt").isNotNull(), "not a document")
        .when(F.col("version").isNull(), "no version")
        .when(F.col("version") > CURRENT_VERSION, "newer version")
        .when(F.col("projectItems").isNull(), "layout without projects")
        .otherwise("")
    )
    return parsed.withColumn("problem", problem)


def _or(value: str, default) -> Column:
    return F.coalesce(F.col(value), F.lit(default))


def workspace_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The catalogue tables of parsed documents; optional fields take their defaults."""
    good, w = parsed.where("problem = ''"), "workspace_id"
    projects = good.select(w, F.posexplode("projectItems").alias("p_ord", "p"))
    key = [w, F.col("p.uid").alias("project_uid")]
    canvas = good.select(w, F.posexplode("canvasProfiles").alias("ordinal", "c"))
    templates = normalised_templates(canvas)
    inputs = projects.select(*key, F.posexplode("p.inputs").alias("pos", "i"))
    outputs = projects.select(*key, F.posexplode("p.outputs").alias("pos", "o"))
    overlays = projects.select(*key, F.posexplode("p.overlays").alias("z", "v"))
    return {
        "workspaces": good.select(w, F.lit(CURRENT_VERSION).alias("version"), _or("outputDirectory", "").alias("output_directory"), _or("stripDirty", False).alias("strip_dirty")),
        "projects": projects.select(*key, "p_ord", F.col("p.name").alias("name"), _or("p.inputDirectory", "").alias("input_directory"), _or("p.outputProfileId", "").alias("output_profile_id"), F.coalesce("p.canvasProfileIds", F.array().cast("array<string>")).alias("canvas_profile_ids")),
        "inputs": inputs.select(w, "project_uid", "pos", _or("i.uid", "").alias("uid"), F.col("i.filePath").alias("file_path"), _or("i.sha256", "").alias("sha256"), F.coalesce("i.order", "pos").alias("ord"), _or("i.status", "Pending").alias("status"), _or("i.width", 0).alias("width"), _or("i.height", 0).alias("height"), _or("i.canvasProfileId", "").alias("canvas_profile_id")),
        "outputs": outputs.select(w, "project_uid", "pos", _or("o.uid", "").alias("uid"), F.col("o.fileName").alias("file_name"), _or("o.sha256", "").alias("sha256"), _or("o.status", "Done").alias("status")),
        "segments": outputs.select(w, "project_uid", F.col("o.fileName").alias("file_name"), F.posexplode("o.sourceMap").alias("seq", "s")).select(w, "project_uid", "file_name", "seq", F.col("s.sourceFilePath").alias("source_file_path"), F.col("s.srcY").alias("source_y"), F.col("s.height").alias("height")),
        "overlays": overlays.select(w, "project_uid", "z", _or("v.uid", "").alias("uid"), _or("v.assetPath", "").alias("asset_path"), _or("v.assetPathRelative", "").alias("asset_path_relative"), _or("v.sha256", "").alias("sha256"), _or("v.anchorInputUid", "").alias("anchor_input_uid"), _or("v.xFrac", 0.0).alias("x_frac"), _or("v.yFrac", 0.0).alias("y_frac"), _or("v.wFrac", 0.0).alias("w_frac"), _or("v.enabled", True).alias("enabled"), _or("v.blend", "Over").alias("blend"), F.col("v.content").alias("content")),
        "canvas_profiles": canvas.select(w, "ordinal", _or("c.id", "").alias("id"), F.col("c.name").alias("name"), F.col("c.canvasSize.width").alias("width"), F.col("c.canvasSize.height").alias("height"), _or("c.margins.top", 0).alias("mt"), _or("c.margins.right", 0).alias("mr"), _or("c.margins.bottom", 0).alias("mb"), _or("c.margins.left", 0).alias("ml"), _or("c.dpi", 72.0).alias("dpi")),
        "templates": templates,
        "output_profiles": good.select(w, F.posexplode("outputProfiles").alias("ordinal", "o")).select(w, "ordinal", _or("o.id", "").alias("id"), F.col("o.name").alias("name"), _or("o.targetWidth", 800).alias("target_width"), _or("o.sliceHeight", 1280).alias("slice_height"), _or("o.lastSlicePolicy", "KeepAsIs").alias("policy"), _or("o.outputFormat", "JPEG").alias("format"), _or("o.startIndex", 1).alias("start_index"), _or("o.dpi", 72.0).alias("dpi")),
        "bad_workspaces": parsed.where("problem <> ''").select(w, "problem", "json"),
    }


def normalised_templates(canvas: DataFrame) -> DataFrame:
    """Template rows of profiles; a single ``templateInfo`` of older documents becomes one."""
    old = F.when(F.col("c.templateInfo").isNotNull(), F.array("c.templateInfo"))
    listed = F.when(F.size("c.templates") > 0, F.col("c.templates")).otherwise(old)
    rows = canvas.select("workspace_id", F.col("c.id").alias("canvas_profile_id"), F.explode(listed).alias("t")).select("workspace_id", "canvas_profile_id", "t.*")
    return legacy_templates(rows)


def legacy_templates(rows: DataFrame) -> DataFrame:
    """Templates with the format guessed from the extension and old fingerprints completed."""
    guessed = F.when(F.lower("path").endswith(".psd"), "PSD").otherwise("PNG")
    kind = F.when(F.coalesce("format", F.lit("")) == "", guessed).otherwise(F.col("format"))
    mark = F.coalesce("fingerprint", F.lit(""))
    dpi = F.when((mark != "") & ~F.contains(mark, F.lit(";dpi=")), F.concat(mark, F.lit(";dpi=25.4"))).otherwise(mark)
    both = F.when((dpi != "") & ~F.contains(dpi, F.lit(";fmt=")), F.concat(dpi, F.lit(";fmt="), kind)).otherwise(dpi)
    return rows.withColumns({"format": kind, "fingerprint": both})


def read_workspaces(spark: SparkSession, glob: str) -> dict[str, DataFrame]:
    """Catalogue tables of all workspace documents under a path or glob."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("workspace_id"), F.col("value").alias("json"))
    return workspace_tables(parse_workspaces(files))


def workspace_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """``workspace_id, json``: tables regrouped to documents of the current version."""

    def nested(rows: DataFrame, keys: list[str], order: str, fields: dict[str, str], name: str) -> DataFrame:
        item = F.struct(order, F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("v"))
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item))["v"].alias(name))

    p = ["workspace_id", "project_uid"]
    inputs = nested(tables["inputs"], p, "pos", {"uid": "uid", "filePath": "file_path", "sha256": "sha256", "order": "ord", "status": "status", "width": "width", "height": "height", "canvasProfileId": "canvas_profile_id"}, "inputs")
    segments = nested(tables["segments"], [*p, "file_name"], "seq", {"sourceFilePath": "source_file_path", "srcY": "source_y", "height": "height"}, "sourceMap")
    outs = tables["outputs"].join(segments, [*p, "file_name"], "left")
    outputs = nested(outs, p, "pos", {"uid": "uid", "fileName": "file_name", "sha256": "sha256", "status": "status", "sourceMap": "sourceMap"}, "outputs")
    rows = tables["projects"].join(inputs, p, "left").join(outputs, p, "left")
    projects = nested(rows, ["workspace_id"], "p_ord", {"name": "name", "uid": "project_uid", "inputDirectory": "input_directory", "outputProfileId": "output_profile_id", "canvasProfileIds": "canvas_profile_ids", "inputs": "inputs", "outputs": "outputs"}, "projectItems")
    whole = tables["workspaces"].join(projects, "workspace_id", "left")
    none = F.array().cast(projects.schema["projectItems"].dataType)
    body = F.struct(F.col("version"), F.col("output_directory").alias("outputDirectory"), F.col("strip_dirty").alias("stripDirty"), F.coalesce("projectItems", none).alias("projectItems"))
    return whole.select("workspace_id", F.to_json(body).alias("json"))


def write_workspaces(tables: dict[str, DataFrame], path: str) -> None:
    """Write one JSON document per row; Spark's commit protocol publishes them together."""
    workspace_documents(tables).select(F.col("json").alias("value")).write.text(path)


def profile_bundles(profiles: DataFrame, presets: DataFrame, version: int = 1) -> DataFrame:
    """``workspace_id, version, profiles``: palettes without presets, in order."""
    own = profiles.join(F.broadcast(presets.select("id")), "id", "left_anti")
    fields = [c for c in own.columns if c not in ("workspace_id", "ordinal", "templates")]
    item = F.struct("ordinal", F.struct(*fields).alias("v"))
    listed = own.groupBy("workspace_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias("profiles"))
    return listed.select("workspace_id", F.lit(version).alias("version"), "profiles")


def read_profile_bundles(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of bundles ``bundle_id, json`` of version 1, and rejected bundles with a reason."""
    parsed = documents.select("bundle_id", F.from_json("json", "version int, profiles array<struct<id:string,name:string>>").alias("d"))
    reason = F.when(F.col("d.version").isNull(), "no version").when(F.col("d.version") > 1, "newer version").otherwise("")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where("reason = ''").select("bundle_id", F.posexplode("d.profiles").alias("ordinal", "p")).select("bundle_id", "ordinal", "p.id", "p.name")
    return good, parsed.where("reason <> ''").select("bundle_id", "reason")


def rebase_paths(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """``key, path``: on load, the relative path wins if that file exists; relative paths are put
    under their ``folder``; ``.`` and ``..`` parts are resolved. ``listing`` has ``path`` of files."""
    relative = F.when(F.col("relative") != "", normal_path(F.concat_ws("/", "folder", "relative")))
    found = listing.select(F.col("path").alias("__there")).distinct()
    out = rows.withColumn("__rel", relative).join(found, F.col("__rel") == F.col("__there"), "left")
    own = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat_ws("/", "folder", "path"))
    return out.select("key", F.when(F.col("__there").isNotNull(), F.col("__there")).otherwise(normal_path(own)).alias("path"))


def normal_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts."""
    start = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, start, lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


#: Spellings of output formats.
FORMATS = {"png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "webp": "WebP"}


def parse_profile_definitions(raw: DataFrame) -> DataFrame:
    """Typed profile values of text rows ``size, margins, colour, format, dpi``, with
    ``reject_reason`` naming the first value that is not valid."""
    size = F.lower("size")
    good_size = size.rlike("^[0-9]+x[0-9]+$") & (F.split_part(size, F.lit("x"), F.lit(1)) != "0") & (F.split_part(size, F.lit("x"), F.lit(2)) != "0")

    def side(k: int) -> Column:
        return F.when(good_size, F.split_part(size, F.lit("x"), F.lit(k)).try_cast("long"))

    def part(column: str, k: int) -> Column:
        return F.trim(F.split_part(column, F.lit(","), F.lit(k))).try_cast("long")

    def channel(k: int, default=None) -> Column:
        value = F.least(F.lit(255), F.greatest(F.lit(0), part("colour", k)))
        return F.when(part("colour", k).isNull(), F.lit(default)).otherwise(value).cast("long")

    kind = F.lower("format")
    form = F.lit(None).cast("string")
    for spelling, name in FORMATS.items():
        form = F.when(kind == spelling, name).otherwise(form)
    margins = [part("margins", k) for k in range(1, 5)]
    any_null = margins[0].isNull() | margins[1].isNull() | margins[2].isNull() | margins[3].isNull()
    dpi = F.col("dpi").try_cast("double")
    reason = (
        F.when(~good_size, "size")
        .when(any_null | (F.least(*margins) < 0), "margins")
        .when(part("colour", 3).isNull(), "colour")
        .when(form.isNull(), "format")
        .when(dpi.isNull() | (dpi <= 0), "dpi")
        .otherwise("")
    )
    names = dict(zip(("mt", "mr", "mb", "ml"), margins))
    return raw.withColumns(
        {"width": side(1), "height": side(2), **names, "red": channel(1), "green": channel(2), "blue": channel(3), "alpha": channel(4, 255), "__f": form, "dpi": dpi, "reject_reason": reason}
    ).drop("format").withColumnRenamed("__f", "format")
