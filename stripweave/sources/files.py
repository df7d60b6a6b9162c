"""Listings of files and what is read from their headers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import extension_of
from .headers import UNREADABLE, image_header
from .kept import running_total

#: Fixed value: extensions of page images.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff")


def _store(path: str):
    """The store of a path (local, HDFS, S3, ... as far as Arrow knows it) and the path inside it."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S)
    if scheme[1] in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^//+", "/", scheme[2])
    return fs.FileSystem.from_uri(quote(path, safe=":/@[]~"))


def _entries(folders: DataFrame, kind: str, batch: int = 10_000) -> DataFrame:
    """``path, length, modification_time`` of what lies directly in ``folders``: of the ``kind`` File or Directory, names that begin with ``.`` or ``_`` left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in batches:
            for folder in frame["path"]:
                store, inner = _store(folder)
                found = store.get_file_info(fs.FileSelector(inner))
                for k in range(0, len(found), batch):
                    some = [i for i in found[k : k + batch] if i.type == fs.FileType[kind] and i.base_name[0] not in "._"]
                    rows = [(f"{folder.rstrip('/')}/{i.base_name}", i.size or 0, i.mtime) for i in some]
                    made = pd.DataFrame(rows, columns=["path", "length", "modification_time"])
                    yield made.astype({"length": "int64"}).assign(modification_time=pd.to_datetime(made["modification_time"], utc=True))

    return folders.select("path").mapInPandas(run, "path string, length long, modification_time timestamp")


def list_files(spark: SparkSession, folder: str, tasks: int = 0) -> DataFrame:
    """``path, length, modification_time`` of a folder's own files; contents are not read.

    With ``tasks`` also of the files in its folders, which are dealt to so many tasks: a folder is listed by one task, never by the driver.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    own = spark.range(0, 1, 1, 1).select(F.lit(whole).alias("path"))
    files = _entries(own, "File")
    return files.unionByName(_entries(_entries(own, "Directory").select("path").repartition(tasks), "File")) if tasks else files


def only_images(listing: DataFrame) -> DataFrame:
    """The listed page images; extensions match in any case."""
    return listing.where(extension_of(F.col("path")).isin(*IMAGE_EXTENSIONS))


def image_files(listing: DataFrame) -> DataFrame:
    """The listed page images, by path."""
    return only_images(listing).orderBy("path")


def scan_image_dir(spark: SparkSession, folder: str) -> DataFrame:
    """Page images of a folder, by path; extensions match in any case."""
    return image_files(list_files(spark, folder))


def _open(path: str):
    """A file of any store that Arrow knows, opened for reading."""
    store, inner = _store(path)
    return store.open_input_file(inner)


def write_files(rows: DataFrame) -> DataFrame:
    """Write ``content`` of each row to ``path``, on any store that Arrow knows; returns ``path, length``, once for each row written.

    The frame that is returned writes when it runs, and once more whenever it runs again: keep it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        made = set()
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                scheme = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S)
                if scheme[1] in (None, "file"):
                    store, inner = fs.LocalFileSystem(), re.sub("^//+", "/", scheme[2])
                else:
                    store, inner = fs.FileSystem.from_uri(path)
                folder = path.rsplit("/", 1)[0]
                if folder not in made:  # once in a task
                    store.create_dir(inner.rsplit("/", 1)[0])
                    made.add(folder)
                with store.open_output_stream(inner) as f:
                    f.write(content)
            yield pd.DataFrame({"path": frame["path"], "length": frame["content"].map(len)})

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, length long")


def dealt_by_length(listing: DataFrame, bytes_per_task: int = 1 << 30) -> DataFrame:
    """The listing in tasks of about ``bytes_per_task`` each, however the lengths differ; a longer file has a task of its own."""
    summed = running_total(listing, ["path"], F.col("length"), "__to").withColumn("__bin", F.expr(f"(__to - length) div {bytes_per_task}"))
    last = summed.agg(F.max("__bin")).first()[0] or 0
    return summed.repartitionByRange(int(last) + 1, "__bin").drop("__to", "__bin")


def check_files(plan: DataFrame, listing: DataFrame, bytes_per_task: int = 1 << 30) -> DataFrame:
    """Results ``project_uid, path, recorded_sha256, found, disk_sha256`` of a disk check plan.

    Only files that the plan names are opened, each once however many records name it; tasks read about ``bytes_per_task``.
    A file that cannot be read, or gives other than the listed number of bytes, is found with the hash "".
    """
    wanted = listing.join(plan.select("path").distinct(), "path", "left_semi").select("path", "length")
    hashes = hash_of(dealt_by_length(wanted, bytes_per_task)).withColumnRenamed("key", "path").withColumn("found", F.lit(True))
    rows = plan.join(hashes, "path", "left")
    return rows.select("project_uid", "path", "recorded_sha256", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("sha256", F.lit("")).alias("disk_sha256"))


def hash_listed(spark: SparkSession, folder: str) -> DataFrame:
    """``key, sha256`` of a folder's files."""
    return hash_of(list_files(spark, folder))


def hash_of(listing: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``key, sha256`` of listed files; "" where a file cannot be read or gives other than the listed number of bytes.

    Tasks read ``chunk`` bytes at a time, so a file of any size takes little memory.
    """

    def digest(path: str, length: int) -> str:
        state, seen = hashlib.sha256(), 0
        try:
            with _open(path) as f:
                while data := f.read(chunk):
                    state.update(data)
                    seen += len(data)
        except OSError:
            return ""
        return state.hexdigest() if seen == length else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"key": frame["path"], "sha256": [digest(p, n) for p, n in zip(frame["path"], frame["length"])]})

    return listing.select("path", "length").mapInPandas(run, "key string, sha256 string")


def display_orientation(headers: DataFrame, *keep: str) -> DataFrame:
    """``path, width, height`` and the columns to ``keep``: orientations 5 to 8 swap the sides; unreadable headers give -1."""
    turned = F.col("orientation").between(5, 8)
    ok = (F.col("raw_w") > 0) & (F.col("raw_h") > 0)

    def side(a: str, b: str):
        return F.when(~F.coalesce(ok, F.lit(False)), -1).when(turned, F.col(b)).otherwise(F.col(a)).cast("long")

    return headers.select("path", side("raw_w", "raw_h").alias("width"), side("raw_h", "raw_w").alias("height"), *keep)


def scan_image_headers(spark: SparkSession, folder: str, tasks: int = 0) -> DataFrame:
    """``path, width, height, bands`` of a folder's images as displayed, from their headers alone; -1 if unreadable. ``tasks`` as in ``list_files``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path in frame["path"]:
                try:
                    with _open(path) as f:
                        rows.append((path, *image_header(f)))
                except OSError:
                    rows.append((path, *UNREADABLE))
            yield pd.DataFrame(rows, columns=["path", "raw_w", "raw_h", "bands", "orientation"])

    found = only_images(list_files(spark, folder, tasks)).select("path").mapInPandas(run, "path string, raw_w long, raw_h long, bands long, orientation long")
    return display_orientation(found, "bands")


def thumbnail_freshness(sources: DataFrame, thumbs: DataFrame) -> DataFrame:
    """``path, cached, fresh``: a thumbnail is named by its source's digest; it is fresh if it is not
    older than the source. Both listings have ``path, length, modification_time``."""
    names = sources.withColumn("__name", F.concat(F.sha2("path", 256), F.lit(".v2.png")))
    kept = thumbs.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("__name"), F.col("length").alias("__len"), F.col("modification_time").alias("__at"))
    rows = names.join(kept, "__name", "left")
    cached = F.coalesce(F.col("__len") > 0, F.lit(False))
    return rows.select("path", cached.alias("cached"), (cached & (F.col("__at") >= F.col("modification_time"))).alias("fresh"))
