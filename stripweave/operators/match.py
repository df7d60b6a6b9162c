"""Which canvas profile and which output profile apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_profiles(projects: DataFrame, links: DataFrame, palette: DataFrame) -> DataFrame:
    """``project_uid, id, prio``: linked profiles that exist, or the whole palette if none is linked.

    Projects and palettes belong to workspaces ``ws``. This is the row form; ``match_pages`` does
    without it, as a project that links nothing has as many rows here as its palette.
    """
    linked = links.join(palette.select("id"), "id").select("project_uid", "id", F.col("prio").cast("long").alias("prio"))
    free = projects.select("project_uid", "ws").join(links.select("project_uid").distinct(), "project_uid", "left_anti")
    every = free.join(_palette_lists(palette), "ws").select("project_uid", F.posexplode("__all").alias("__p", "id"))
    return linked.unionByName(every.select("project_uid", "id", (F.col("__p") + 1).cast("long").alias("prio")))


def _palette_lists(palette: DataFrame, *keys: str, first: tuple = ()) -> DataFrame:
    """Profile ids of each workspace (and size) in palette order, and columns of its ``first`` profile; a palette is a short list."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id")))
    leads = [F.min(F.struct("ordinal", *first)).alias("__first")] if first else []
    return palette.groupBy("ws", *keys).agg(F.transform(ordered, lambda s: s["id"]).alias("__all"), *leads)


def linked_lists(links: DataFrame) -> DataFrame:
    """``project_uid``, its links in order as ``__list`` and two numbers ``__k1``, ``__k2`` that tell the list."""
    lists = links.groupBy("project_uid").agg(F.sort_array(F.collect_list(F.struct(F.col("prio").cast("long").alias("prio"), "id"))).alias("__list"))
    return lists.select("project_uid", "__list", F.xxhash64("__list").alias("__k1"), F.xxhash64(F.lit(1), "__list").alias("__k2"))


@dataclass(frozen=True)
class LinkLists:
    """Links with each distinct list held once, so that none is made for each project. Operators take them in place of rows of links.

    ``projects``  project_uid, ws of all projects and two numbers ``__k1, __k2`` that tell the list (null: nothing is linked)
    ``lists``     ``__k1, __k2`` and ``__list``, structs of prio and id
    """

    projects: DataFrame
    lists: DataFrame


def link_lists(projects: DataFrame, links: DataFrame | LinkLists) -> LinkLists:
    """The lists of ``projects``, from rows ``project_uid, id, prio``."""
    if isinstance(links, LinkLists):
        return links
    lists = linked_lists(links)
    return LinkLists(projects.select("project_uid", "ws").join(lists.drop("__list"), "project_uid", "left"), lists)


def links_of(projects: DataFrame, links: DataFrame | LinkLists) -> DataFrame | LinkLists:
    """The links of some projects."""
    some = projects.select("project_uid").distinct()
    if isinstance(links, LinkLists):
        return LinkLists(links.projects.join(some, "project_uid", "left_semi"), links.lists)
    return links.join(some, "project_uid", "left_semi")


def distinct_links(lists: DataFrame) -> DataFrame:
    """``__k1, __k2, prio, id``: each distinct list of ``linked_lists`` once, so profiles are looked up for lists and not for projects."""
    once = lists.groupBy("__k1", "__k2").agg(F.first("__list").alias("__list"))
    return once.select("__k1", "__k2", F.explode("__list").alias("__l")).select("__k1", "__k2", "__l.prio", "__l.id")


def list_ids(lists: DataFrame, palette: DataFrame) -> DataFrame:
    """``__k1, __k2, __ids``: the ids of each distinct list that exist, joined in order; none for a list of which no profile exists."""
    held = distinct_links(lists).join(palette.select("id"), "id").groupBy("__k1", "__k2").agg(F.sort_array(F.collect_list(F.struct("prio", "id"))).alias("__own"))
    return held.select("__k1", "__k2", F.array_join(F.transform("__own", lambda s: s["id"]), ",").alias("__ids"))


def palette_ids(palette: DataFrame) -> DataFrame:
    """``ws, __whole``: the ids of each palette, joined in order."""
    return _palette_lists(palette).select("ws", F.array_join("__all", ",").alias("__whole"))


def effective_ids(projects: DataFrame, links: DataFrame | LinkLists, palette: DataFrame) -> DataFrame:
    """``project_uid, ids``: effective profile ids of each project, joined in order."""
    linked, empty = link_lists(projects, links), F.lit("")
    own, whole, facts = list_ids(linked.lists, palette), palette_ids(palette), linked.projects
    linked = F.col("__k1").isNotNull()
    # texts are found once for each list and palette, and meet the projects last
    rows = facts.where(linked).join(own, ["__k1", "__k2"], "left").select("project_uid", F.coalesce("__ids", empty).alias("ids"))
    free = facts.where(~linked).join(whole, "ws", "left").select("project_uid", F.col("__whole").alias("ids"))
    return rows.unionByName(free)


def match_pages(pages: DataFrame, projects: DataFrame, links: DataFrame | LinkLists, palette: DataFrame, name: str = "profile_id", facts: tuple = ()) -> DataFrame:
    """``pages`` with ``name``, the first effective profile of exactly the page's size, its ``facts`` (columns of the palette), and ``__other``,
    the same-size profiles of the palette where none is effective.

    A project without links takes the first profile of the size in its workspace's palette, one with
    links the first link of the size. If no link has the size, no profile of that size is effective, so
    all of them are candidates. No page carries a list: projects ask once for each size of their pages.
    """
    held = link_lists(projects, links)
    size = [F.col(c).cast("long").alias(f"__{c[0]}") for c in ("width", "height")]
    own = distinct_links(held.lists).join(palette.select("id", *size, *facts), "id").groupBy("__k1", "__k2", "__w", "__h").agg(F.min(F.struct("prio", "id", *facts)).alias("__hit"))
    every = _palette_lists(palette, "width", "height", first=("id", *facts)).select("ws", *size, "__all", "__first")
    asked = pages.select("project_uid", *size).join(held.projects, "project_uid").distinct()  # pages are dealt by project as they meet it, and not for this alone
    asked = asked.join(own, ["__k1", "__k2", "__w", "__h"], "left").join(every, ["ws", "__w", "__h"], "left")
    linked = F.col("__k1").isNotNull()
    hit, *more = [F.when(linked, F.col(f"__hit.{c}")).otherwise(F.col(f"__first.{c}")) for c in ("id", *facts)]
    known = [c.alias(f"__fact_{f}") for f, c in zip(facts, more)]
    met = asked.select(F.col("project_uid").alias("__p"), "__w", "__h", hit.alias("__id"), F.when(linked & hit.isNull(), F.col("__all")).alias("__rest"), *known)
    met = met.where("__id IS NOT NULL OR __rest IS NOT NULL")
    here = (F.col("project_uid") == F.col("__p")) & (F.col("width").cast("long") == F.col("__w")) & (F.col("height").cast("long") == F.col("__h"))
    other = F.coalesce("__rest", F.array().cast("array<string>"))
    found = {name: F.col("__id"), "__other": other} | {f: F.col(f"__fact_{f}") for f in facts}
    return pages.join(met, here, "left").withColumns(found).select(*pages.columns, *found)


def match_canvas_profile(pages: DataFrame, projects: DataFrame, links: DataFrame, palette: DataFrame) -> DataFrame:
    """``project_uid, uid, profile_id``: the first effective profile of exactly the page's size."""
    return match_pages(pages.select("project_uid", "uid", "width", "height"), projects, links, palette).select("project_uid", "uid", "profile_id")


def unlinked_candidates(pages: DataFrame, projects: DataFrame, links: DataFrame, palette: DataFrame) -> DataFrame:
    """``project_uid, uid, match, candidate_ids``: for pages without a match, same-size profiles of
    the palette that are not effective, in palette order."""
    rows = match_pages(pages.select("project_uid", "uid", "width", "height"), projects, links, palette).where("profile_id IS NULL")
    found = F.when(F.size("__other") > 0, "FoundInWorkspaceOnly").otherwise("NotFoundAnywhere")
    return rows.select("project_uid", "uid", found.alias("match"), F.array_join("__other", ",").alias("candidate_ids"))


def skipped() -> Column:
    """Why a run skips a page: it is missing or unreadable; null if it does not. No profile decides that."""
    return F.when(F.col("status") == "Missing", "SkippedMissing").when((F.col("width") <= 0) | (F.col("height") <= 0), "SkippedError")


def page_plan(matched: DataFrame, has_palette: bool = True) -> DataFrame:
    """``matched`` (of ``match_pages``) with ``plan``, what a run does with each page; the profile only of appended pages.

    Pages have ``status`` (Missing pages are skipped) and sizes (0 or less: unreadable).
    """
    done = skipped()
    if has_palette:
        done = (
            done.when(F.col("profile_id").isNotNull(), "Appended")
            .when(F.size("__other") > 0, "AppendedProfileNotLinked")
            .otherwise("AppendedWithoutProfile")
        )
    else:
        done = done.otherwise("Appended")
    return matched.withColumn("plan", done).withColumn("profile_id", F.when(F.col("plan") == "Appended", F.col("profile_id"))).drop("__other")


def input_status_counts(plan: DataFrame) -> DataFrame:
    """Pages per project by what happens to them."""

    def n(*names: str):
        return F.count_if(F.col("plan").isin(*names))

    return plan.groupBy("project_uid").agg(
        n("Appended").alias("appended"),
        n("AppendedWithoutProfile").alias("no_profile"),
        n("AppendedProfileNotLinked").alias("unlinked"),
        n("SkippedMissing", "SkippedError").alias("skipped"),
    )


def link_conflicts(requests: DataFrame, links: DataFrame, palette: DataFrame) -> DataFrame:
    """``project_uid, id, verdict`` for requested links: unknown, linked, conflict or ok."""
    sizes = palette.select("id", F.col("width").alias("w"), F.col("height").alias("h"))
    taken = links.join(sizes, "id").groupBy("project_uid", "w", "h").agg(F.count(F.lit(1)).alias("__same"))
    own = links.select("project_uid", "id").distinct().withColumn("__own", F.lit(True))
    rows = (
        requests.join(sizes, "id", "left")
        .join(own, ["project_uid", "id"], "left")
        .join(taken, ["project_uid", "w", "h"], "left")
    )
    verdict = F.when(F.col("__own"), "linked").when(F.col("w").isNull(), "unknown").when(F.col("__same").isNotNull(), "conflict").otherwise("ok")
    return rows.select("project_uid", "id", verdict.alias("verdict"))


def resolve_output_profile(ids: DataFrame, presets: DataFrame, user: DataFrame) -> DataFrame:
    """``key, id, source, name``: a preset wins over a user profile of the same id, else none."""
    p = F.broadcast(presets.select("id", F.col("name").alias("__pn")))
    u = user.select("id", F.col("name").alias("__un"))
    rows = ids.join(p, "id", "left").join(u, "id", "left")
    source = F.when(F.col("__pn").isNotNull(), "preset").when(F.col("__un").isNotNull(), "user").otherwise("none")
    return rows.select("key", "id", source.alias("source"), F.coalesce("__pn", "__un").alias("name"))


def first_profile_default(user: DataFrame) -> DataFrame:
    """The first output profile by position, one row."""
    return user.agg(F.min_by(F.struct(*[c for c in user.columns]), "ordinal").alias("__p")).select("__p.*")


def select_output_profile(projects: DataFrame, presets: DataFrame, user: DataFrame, wanted: str, fallback: str) -> DataFrame:
    """``project_uid, profile_id``: the id asked for, the project's own, the workspace's first, the
    fallback preset; an id counts only if it exists."""
    ids = presets.select("id").unionByName(user.select("id")).distinct().withColumn("__known", F.lit(True))
    first = first_profile_default(user).select(F.col("id").alias("__first"))
    asked = ids.select(F.col("id").alias(wanted), F.col("__known").alias("__a"))
    own = ids.select(F.col("id").alias("output_profile_id"), F.col("__known").alias("__o"))
    rows = projects.join(asked, wanted, "left").join(own, "output_profile_id", "left").join(F.broadcast(first), how="left")
    chosen = F.coalesce(F.when(F.col("__a"), F.col(wanted)), F.when(F.col("__o"), F.col("output_profile_id")), F.col("__first"), F.lit(fallback))
    return rows.select("project_uid", chosen.alias("profile_id"))
