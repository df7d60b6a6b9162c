"""Planning how a workspace and its files are shipped together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep, running_total


def unsafe_target(target: Column) -> Column:
    """True for an empty, rooted, drive-lettered or backslashed path, or one with a ``..`` part."""
    return (
        (F.coalesce(target, F.lit("")) == "")
        | F.contains(target, F.lit("\\"))
        | target.startswith("/")
        | target.rlike(r"^[A-Za-z]:")
        | F.array_contains(F.split(target, "/"), "..")
    )


def distinct_references(references: DataFrame) -> DataFrame:
    """One row per file: the first reference to each case-folded path of a workspace.

    References have ``ws, seq, source, kind, folder, present, bytes``.
    """
    first = Window.partitionBy("ws", F.lower("source")).orderBy("seq", "source")
    return references.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def _skipped_numbers(kids: DataFrame, more: DataFrame) -> DataFrame | None:
    """``ws, __dir, __lname, __j, __c``: how many numbers are found taken while request ``__j`` of a name looks for its own.

    ``kids`` are the numbered names ``__number`` below a name, with the place ``__t`` of their first reference; ``more`` the requests of
    the name, ``__j`` from 1, with theirs. A number is taken if its name was referenced before the request that would get it. Which
    request that is depends on how many smaller numbers were taken, so all numbers are judged at once from a guess, and again from what came
    out, until nothing changes. The smallest that were wrong are right after each round, so it ends; mostly after two.
    """
    group = ["ws", "__dir", "__lname"]
    before = Window.partitionBy(*group).orderBy("__number").rowsBetween(Window.unboundedPreceding, -1)
    requests = more.select(*group, "__j", F.col("__t").alias("__asked"))
    guess = kids.withColumn("__skip", F.lit(1))
    while True:
        at = guess.withColumn("__j", F.col("__number") - 1 - F.coalesce(F.sum("__skip").over(before), F.lit(0)))
        met = at.join(requests, [*group, "__j"], "left")
        now = F.coalesce((F.col("__t") < F.col("__asked")).cast("int"), F.lit(0))
        judged = keep(met.withColumn("__now", now).drop("__asked"))
        if judged.where("__now <> __skip").isEmpty():
            return judged.where("__skip = 1").groupBy(*group, "__j").agg(F.count(F.lit(1)).alias("__c"))
        guess = judged.withColumn("__skip", F.col("__now")).drop("__now", "__j")


def package_target_claim(files: DataFrame) -> DataFrame:
    """Add ``target``: files of the folder keep their place, others go to a folder of their kind.

    Names that clash without regard to case become ``stem (2).ext``, ``stem (3).ext`` and so on, each with the smallest number that is
    free then, in order of reference, files of the folder first. References to a name are ranked once, by ranges, so a name that very many
    share is split. Names are settled by how many numbers they end in: a name's later references ask for numbers, which may be names
    one level deeper.
    """
    inside = F.startswith("source", "folder")
    relative = F.expr("substring(source, length(folder) + 1)")
    name = F.regexp_extract("source", r"([^/]*)$", 1)
    home = F.regexp_extract(relative, r"^(.*/)?[^/]*$", 1)
    stem, ext = F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 2)
    rows = files.withColumns({"__out": ~inside, "__name": name, "__dir": F.when(inside, home).otherwise(F.concat(F.col("kind"), F.lit("/")))})
    low, one = F.lower(stem), r" \(([2-9]|[1-9]\d{1,17})\)$"
    rows = rows.withColumns(
        {
            "__lname": F.lower("__name"), "__t": F.struct("__out", "seq", "source"),
            "__number": F.when(low.rlike(one), F.regexp_extract(low, one, 1).cast("long")), "__above": F.concat(F.regexp_replace(low, one, ""), F.lower(ext)),
            "__depth": F.regexp_count(F.regexp_extract(low, r"((?: \((?:[2-9]|[1-9]\d{1,17})\))*)$", 1), F.lit(r"\(")),
        }
    )
    group = ["ws", "__dir", "__lname"]
    ranked = keep(running_total(rows, [*group, "__out", "seq", "source"], F.lit(1), "__n"))
    facts = [F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__count"), F.min("__t").alias("__t"), *[F.first(c).alias(c) for c in ("__number", "__above", "__depth")]]
    names = keep(ranked.groupBy(*group).agg(*facts))
    ranked = ranked.join(names.select(*group, "__first"), group).withColumn("__place", F.col("__n") - F.col("__first"))
    made = names.limit(0).select(*group)
    done = None
    for depth in range((names.agg(F.max("__depth")).first()[0] or 0) + 1):
        # a name that a number has made is taken before its first reference
        own = names.where(F.col("__depth") == depth).join(made.withColumn("__made", F.lit(1)), group, "left")
        own = keep(own.select(*group, F.coalesce("__made", F.lit(0)).alias("__made"), "__count"))
        level = ranked.where(F.col("__depth") == depth).join(own.select(*group, "__made"), group).withColumn("__j", F.col("__place") + F.col("__made"))
        more = keep(level.where("__j > 0"))
        parents = own.select("ws", "__dir", F.col("__lname").alias("__above"), (F.col("__count") - 1 + F.col("__made")).alias("__asks")).where("__asks > 0")
        kids = names.where(F.col("__depth") == depth + 1).drop("__lname").join(parents, ["ws", "__dir", "__above"]).withColumnRenamed("__above", "__lname")
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("__number"))
        # larger numbers are never reached
        kids = keep(kids.withColumn("__i", rank).where("__number <= __asks + __i").select(*group, "__number", "__t"))
        numbered = more.withColumn("__k", F.col("__j") + 1)
        if not kids.isEmpty():
            upto = Window.partitionBy(*group).orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
            numbered = more.join(_skipped_numbers(kids, more), [*group, "__j"], "left").withColumn("__k", F.col("__j") + 1 + F.coalesce(F.sum("__c").over(upto), F.lit(0)))
            taken = numbered.select("ws", "__dir", F.concat(low, F.lit(" ("), F.col("__k").cast("string"), F.lit(")"), F.lower(ext)).alias("__lname"))
            made = keep(taken.join(names.select(*group), group, "left_semi"))
        else:
            made = names.limit(0).select(*group)
        firsts = level.where("__j = 0").select(*files.columns, F.concat("__dir", "__name").alias("target"))
        others = numbered.select(*files.columns, F.concat("__dir", stem, F.lit(" ("), F.col("__k").cast("string"), F.lit(")"), ext).alias("target"))
        done = firsts.unionByName(others) if done is None else done.unionByName(firsts).unionByName(others)
    return done


def package_plan(references: DataFrame) -> DataFrame:
    """``ws, source, target, missing``: one place for each file, however often it is referenced."""
    claimed = package_target_claim(distinct_references(references))
    return claimed.select("ws", "source", "target", (~F.col("present")).alias("missing"))


def package_plan_check(plan: DataFrame) -> DataFrame:
    """``ws, target, problem``: unsafe targets and targets that clash without regard to case."""
    bad = plan.where(unsafe_target(F.col("target"))).select("ws", "target", F.lit("unsafe").alias("problem"))
    clash = plan.groupBy("ws", F.lower("target").alias("target")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return bad.unionByName(clash.select("ws", "target", F.lit("clash").alias("problem")))


def package_entry_audit(entries: DataFrame, manifest: str = "manifest.json") -> DataFrame:
    """``ws, entry, problem`` for an archive listing ``ws, entry, is_file``: entries that are not
    regular, unsafe or repeated, archives without a manifest or a workspace file at the root."""
    odd = entries.where("NOT is_file").select("ws", "entry", F.lit("not a file").alias("problem"))
    unsafe = entries.where(unsafe_target(F.col("entry"))).select("ws", "entry", F.lit("unsafe").alias("problem"))
    again = entries.groupBy("ws", F.lower("entry").alias("entry")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("ws", "entry", F.lit("repeated").alias("problem"))
    whole = entries.groupBy("ws").agg(
        F.bool_or(F.col("entry") == manifest).alias("__m"), F.bool_or(F.col("entry").rlike(r"^[^/]+\.workspace\.json$")).alias("__w")
    )
    gaps = whole.select("ws", F.explode(F.array_compact(F.array(F.when(~F.col("__m"), F.lit("no manifest")), F.when(~F.col("__w"), F.lit("no workspace file"))))).alias("problem"))
    return odd.unionByName(unsafe).unionByName(again).unionByName(gaps.select("ws", F.lit("").alias("entry"), "problem"))


def package_totals(references: DataFrame, documents: DataFrame) -> DataFrame:
    """``ws, n_files, bytes``: every packed file once, and the workspace document itself."""
    files = distinct_references(references).where("present").groupBy("ws").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("__b"))
    rows = documents.join(files, "ws", "left")
    return rows.select("ws", F.coalesce("n_files", F.lit(0)).alias("n_files"), (F.coalesce("__b", F.lit(0)) + F.col("document_bytes")).alias("bytes"))


def package_workspace_copy(inputs: DataFrame, overlays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs and overlays as shipped: what runs have recorded is cleared, uids and overlay hashes stay."""
    ins = inputs.select("project_uid", "uid", "ord", F.lit("Pending").alias("status"), F.lit("").alias("sha256"), F.lit("").alias("contributes_to"))
    return ins, overlays.select("project_uid", "uid", "z", "sha256")
