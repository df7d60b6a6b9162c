"""What keeps the cost of a query in proportion to its tables."""

import re

import pytest
from pyspark.sql import functions as F

from stripweave.operators import canvas_changes
from stripweave.plans import QUERIES
from stripweave.sources import fixtures, session, state
from stripweave.streaming import catalogue as stream

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(fixtures.BUILT))
def test_built_views_hold_the_rows_of_their_sql(spark, name):
    used = re.findall(r"\{(\w+)\}", fixtures.VIEWS[name])
    want = spark.sql(fixtures.VIEWS[name], **{n: fixtures.view(spark, FOLDER, n) for n in set(used)})
    got = fixtures.view(spark, FOLDER, name)
    assert got.columns == want.columns
    assert got.exceptAll(want.select(*[F.col(f.name).cast(f.dataType) for f in got.schema])).isEmpty() and got.count() == want.count()


def test_settings_follow_the_tables_and_leave_the_session_alone(spark, monkeypatch):
    before = dict(spark.conf.getAll)
    monkeypatch.setattr(session, "table_bytes", lambda *_: 600 << 20)
    own = session.sized_session(spark, FOLDER)
    assert own.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "400"
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert dict(spark.conf.getAll) == before
    assert session.sized_session(spark, FOLDER).conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


@pytest.mark.parametrize("name, exchanges", [("provenance_check", 2), ("slice_fan_in", 2), ("composition_backfill", 1), ("validate_input_order", 3), ("apply_disk_checks", 4)])
def test_pages_are_dealt_by_project_once(spark, name, exchanges):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", plan)
    assert len(dealt) <= exchanges and all(re.fullmatch(r"project_uid#\d+", d) for d in dealt), dealt


def test_projects_with_the_same_links_share_one_list(spark):
    links = spark.createDataFrame([(f"p{k}", f"c{i}", i) for k in range(50) for i in range(3)], "project_uid string, id string, prio int")
    palette = spark.createDataFrame([("c0", 0, 7, 10, 20), ("c1", 1, 7, 10, 20), ("c2", 2, 7, 30, 20)], "id string, ordinal int, ws int, width int, height int")
    found = canvas_changes._firsts(canvas_changes._listed(links, "n"), palette, "n").collect()
    assert sorted((r.width, r["__n"].id) for r in found) == [(10, "c0"), (10, "c0"), (30, "c2"), (30, "c2")]


def test_publishing_and_checks_move_and_store_no_table(spark, tmp_path):
    store = state.State(spark, str(tmp_path / "state"), buckets=2)
    rows = spark.range(60).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project_uid"), F.lit("input").alias("kind"), F.lit("/a").alias("path"), F.lit("Processed").alias("status"), F.lit("h").alias("sha256"))
    store.publish({"files": rows.repartition(3)})
    assert len(list((tmp_path / "state").rglob("*.parquet"))) == 6  # as dealt, not shuffled once more
    held = []
    batch = rows.select("project_uid", "path", F.col("sha256").alias("recorded_sha256"), F.lit(False).alias("found"), F.lit("").alias("disk_sha256"), F.lit(1).alias("checked_at"))
    publish = store.publish
    store.publish = lambda *a: (held.append(batch.storageLevel.useDisk), publish(*a))[1]
    stream.upsert_checks(store, batch, "b:0")
    assert held == [False] and {r.status for r in store.read("files").collect()} == {"Missing"}


def test_report_copies_no_pages(spark, monkeypatch):
    from stripweave.plans import registry

    copied = []
    monkeypatch.setattr(registry, "keep_bucketed", lambda rows, *a: (copied.append(rows.columns), rows)[1])
    QUERIES["staleness_report"](spark, FOLDER)
    assert not copied


def test_only_pages_look_for_a_profile(spark):
    from stripweave.operators.staleness import project_status

    shown = spark.createDataFrame([("p", "input", "u", "Done"), ("p", "output", "u", "Done"), ("p", None, "u", "Done")], "project_uid string, kind string, name string, shown_status string")
    pages = spark.createDataFrame([("p", "u", "c")], "project_uid string, uid string, profile_then string")
    rows = project_status(shown, pages, spark.createDataFrame([("c", "n")], "id string, name string"))
    assert {(r.kind, r.profile_name) for r in rows.collect()} == {("input", "n"), ("output", ""), (None, "")}
    assert "Union" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_dealt_as_lists(spark):
    plan = QUERIES["relink_profile_ids"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "REPARTITION_BY_COL" in plan
    # a project that is listed twice has each link twice, all numbered
    projects = spark.createDataFrame([("a", 1, 1, False), ("a", 1, 1, False), ("b", 1, 2, True)], "project_uid string, ws int, k int, accepts_all boolean")
    palette = spark.createDataFrame([("c1", 1, 1), ("c6", 6, 1), ("c7", 7, 1)], "id string, ordinal int, ws int")
    want = spark.sql(fixtures.VIEWS["v_links"], v_projects=projects, v_canvas_profiles=palette).collect()
    assert sorted(map(tuple, fixtures._links(projects, palette).collect())) == sorted(map(tuple, want)) and len(want) == 4


def test_pages_carry_no_list_of_links(spark):
    from stripweave.operators import match

    links = spark.createDataFrame([("p", "c1", 1), ("p", "c2", 2), ("q", "gone", 1)], "project_uid string, id string, prio int")
    projects = spark.createDataFrame([("p", 7), ("q", 7), ("r", 7)], "project_uid string, ws int")
    palette = spark.createDataFrame([("c0", 0, 7, 10, 20), ("c1", 1, 7, 10, 20), ("c2", 2, 7, 10, 20), ("c3", 3, 7, 5, 5)], "id string, ordinal int, ws int, width int, height int")
    pages = spark.createDataFrame([(p, f"{p}{w}", w, h) for p in "pqrs" for w, h in ((10, 20), (5, 5), (1, 1))], "project_uid string, uid string, width int, height int")
    met = match.match_pages(pages, projects, links, palette)
    found = {r.uid: (r.profile_id, r["__other"]) for r in met.collect()}
    assert found["p10"] == ("c1", []) and found["p5"] == (None, ["c3"]) and found["q10"] == (None, ["c0", "c1", "c2"]) and found["r10"] == ("c0", [])
    assert all(found[u] == (None, []) for u in ("p1", "q1", "r1", "s1", "s5", "s10"))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "__own" not in plan
    ids = {r.project_uid: r.ids for r in match.effective_ids(projects, links, palette).collect()}
    assert ids == {"p": "c1,c2", "q": "", "r": "c0,c1,c2,c3"}


def test_buckets_follow_the_tables(spark, monkeypatch):
    from stripweave.plans import registry

    made = []
    monkeypatch.setattr(registry, "keep_bucketed", lambda rows, key, n: (made.append((rows.rdd.getNumPartitions(), n)), rows)[1])
    monkeypatch.setattr(session, "table_bytes", lambda *_: 60 << 20)
    registry.Views(session.sized_session(spark, FOLDER), FOLDER).keep("v_projects", by="project_uid")
    assert made == [(40, 40)]


def test_a_task_reads_a_bounded_part_of_a_file(spark):
    own = session.sized_session(spark, FOLDER)
    assert own.conf.get("spark.sql.files.maxPartitionBytes") == str(16 << 20) != spark.conf.get("spark.sql.files.maxPartitionBytes")


def test_pages_are_dealt_without_columns_that_decide_nothing(spark):
    plan = QUERIES["up_to_date"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    held = [line for line in plan.split("\n") if "AS project_uid" in line and "l_linenumber" in line]
    assert held and not any(c in line for line in held for c in ("l_extendedprice", "l_shipdate", "l_discount", "l_tax"))
    # rows that agree in the columns dealt are the same page at either number
    line = [(1, 5, 7, 1, 2.0, price, 0.0, 0.0, "2020-01-01") for price in (9.0, 3.0)] + [(1, 4, 7, 1, 3.0, 1.0, 0.0, 0.0, "2020-01-01")]
    lineitem = spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string")
    want = spark.sql(fixtures.VIEWS["v_inputs"], lineitem=lineitem).collect()
    assert sorted(map(tuple, fixtures._inputs(lineitem).collect())) == sorted(map(tuple, want))


def test_images_are_listed_in_tasks_and_dealt_by_number(spark, tmp_path, monkeypatch):
    from stripweave.sources import files

    for name in ("a.png", "x/b.jpg", "x/_c.png", "y/d.tif", "y/z/e.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"12")
    found = files.list_files(spark, str(tmp_path), 3)
    assert sorted((r.path.removeprefix(f"file:{tmp_path}/"), r.length) for r in found.collect()) == [("a.png", 2), ("x/b.jpg", 2), ("y/d.tif", 2)]
    assert found.inputFiles() == []  # no index of files in the driver
    written, write = [], files.write_files
    monkeypatch.setattr(files, "write_files", lambda rows: (written.append(rows), write(rows))[1])
    read = QUERIES["scan_image_headers"](spark, FOLDER)
    tasks = int(written[0].sparkSession.conf.get(session.PARTITIONS))
    assert written[0].rdd.getNumPartitions() == tasks > 1 and read.inputFiles() == []


def test_documents_are_parsed_once(spark):
    plan = QUERIES["read_workspaces"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "format_string(output" in plan
    rows = spark.createDataFrame([("a", None), ("b", "{"), ("c", '{"version":9,"projectItems":[]}'), ("d", '{"version":3,"projectItems":[]}'), ("e", "{}")], "workspace_id string, json string")
    from stripweave.sources import documents

    found = {r.workspace_id: r.problem for r in documents.parse_workspaces(rows).collect()}
    assert found == {"a": "no version", "b": "not a document", "c": "newer version", "d": "", "e": "no version"}


def test_plain_slice_names_are_not_formatted_row_by_row(spark):
    from stripweave.functions.expressions import slice_name

    rows = spark.createDataFrame([(n, e) for n in (-100, -5, 0, 7, 42, 999, 1000, 123456, None) for e in (".png", None)], "n long, e string")
    name = slice_name(F.col("n"), F.col("e"))
    assert "CASE" in str(name) and rows.where(~name.eqNullSafe(F.format_string("output_%03d%s", "n", "e"))).isEmpty()


def test_file_staleness_matches_pages_once_and_keeps_no_hashes(spark, monkeypatch):
    from stripweave.plans import registry
    from stripweave.operators import canvas_changes as C

    kept, asked, keep, changes = [], [], registry.keep, C.page_changes
    monkeypatch.setattr(registry, "keep", lambda rows: (kept.append(rows.columns), keep(rows))[1])
    monkeypatch.setattr(C, "page_changes", lambda *a: (asked.append(1), changes(*a))[1])
    plan = QUERIES["file_staleness"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and ["project_uid", "uid", "status", "profile_then", "changed", "unknown"] in kept
    assert "fingerprint" not in plan and "ws#" not in plan


def test_projects_name_their_lists_and_carry_none(spark):
    from stripweave.plans import incremental, matching, registry

    v = registry.Views(session.sized_session(spark, FOLDER), FOLDER)
    for held, name in ((matching.linked(v), "v_links"), (incremental.linked_then(v), "v_links_then")):
        rows = held.projects.join(held.lists, ["__k1", "__k2"]).select("project_uid", F.explode("__list").alias("l")).select("project_uid", "l.id", F.col("l.prio").cast("int").alias("prio"))
        want = v(name).select("project_uid", "id", F.col("prio").cast("int").alias("prio"))
        assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty() and held.lists.count() < held.projects.count()
    assert held.projects.count() == v("v_projects").count()
    plan = QUERIES["staleness_report"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan and "RepartitionByExpression" not in plan


def test_a_project_listed_twice_links_twice(spark):
    from stripweave.plans import matching, registry

    v = registry.Views(session.sized_session(spark, FOLDER), FOLDER)
    projects = spark.createDataFrame([("a", 1, 1, False), ("a", 1, 1, False), ("b", 1, 2, True), ("c", 1, 3, False)], "project_uid string, ws int, k int, accepts_all boolean")
    palette = spark.createDataFrame([("c1", 1, 1), ("c6", 6, 1), ("c7", 7, 1)], "id string, ordinal int, ws int")
    v._made |= {"v_projects": projects, "v_canvas_profiles": palette}
    held = matching.linked(v)
    keys = [(r.project_uid, r["__k1"] is None) for r in held.projects.collect()]
    assert sorted(keys) == [("a", False), ("a", False), ("b", True), ("c", True)]  # c: no profile has its remainder
    assert [[(x.prio, x.id) for x in r["__list"]] for r in held.lists.collect()] == [[(1, "c6"), (2, "c6"), (3, "c1"), (4, "c1")]]


def test_pages_are_not_joined_with_themselves(spark):
    want = fixtures.view(spark, FOLDER, "v_page_files").join(fixtures.view(spark, FOLDER, "v_pages_then"), ["project_uid", "uid"])
    got = fixtures.pages_and_then(fixtures.view(spark, FOLDER, "v_page_files")).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    plan = QUERIES["canvas_staleness"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((project_uid" not in plan


def test_checks_as_numbers_give_the_same_status(spark):
    from stripweave.operators import staleness as S

    hashes = ["", "a", "b", "c"]
    files = spark.createDataFrame([("p", k, f"{k}{s}{h}", s, h) for k in ("input", "output") for s in ("Error", "Skipped", "Pending", "Done") for h in hashes], "project_uid string, kind string, path string, status string, sha256 string")
    seen = spark.createDataFrame([(f, d) for f in (True, False, None) for d in [*hashes, None]], "found boolean, disk_sha256 string")
    one = files.crossJoin(seen.withColumn("n", F.monotonically_increasing_id())).withColumn("path", F.concat("path", F.col("n").cast("string")))
    checks = one.select("project_uid", "path", F.col("sha256").alias("recorded_sha256"), "found", "disk_sha256")
    more = checks.unionByName(checks.select("project_uid", "path", "recorded_sha256", F.lit(True).alias("found"), F.lit("b").alias("disk_sha256")))
    rows = one.drop("found", "disk_sha256", "n")
    for c in (checks, more):
        want = S.apply_disk_checks(rows, c).select("project_uid", "kind", "path", "status")
        got = S.status_after_checks(rows, c)
        assert got.columns == rows.columns and got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    plan = S.status_after_checks(rows, checks)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_orders_are_compared_without_lists(spark):
    from stripweave.operators import layout as L

    rows = spark.createDataFrame([(p, u, i) for p, us in {"same": "abc", "moved": "abc", "more": "ab", "new": "a"}.items() for i, u in enumerate(us)], "project_uid string, uid string, ord int")
    then = spark.createDataFrame([(p, u, i * 10) for p, us in {"same": "abc", "moved": "acb", "more": "abc"}.items() for i, u in enumerate(us)], "project_uid string, uid string, pos int")
    got = L.order_change(L.order_digest(rows, "ord", "uid"), L.order_digest(then, "pos", "uid"))
    assert {r.project_uid: r.changed for r in got.collect()} == {"same": False, "moved": True, "more": True, "new": False}
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_recorded_matches_are_compared_without_dealing_pages_by_profile(spark):
    from stripweave.operators import match, results, signatures, staleness

    palette = spark.createDataFrame([(f"c{i}", i, 7, 10 * (i % 3), 20, i, 0, 0, 0) for i in range(6)], "id string, ordinal int, ws int, width int, height int, mt int, mr int, mb int, ml int")
    marks = {r.id: r.signature for r in signatures.canvas_render_fingerprint(palette).collect()}
    projects = spark.createDataFrame([("p", 7), ("q", 7)], "project_uid string, ws int")
    links = spark.createDataFrame([("p", "c4", 1), ("p", "gone", 2)], "project_uid string, id string, prio int")
    was = [(w, h, c, m) for w, h in ((10, 20), (0, 0), (None, 1)) for c, m in (("", ""), (None, None), ("c1", marks["c1"]), ("c4", marks["c4"]), ("c4", "old"), ("gone", "x"), ("c2", None))]
    recorded = spark.createDataFrame([(p, f"u{i}", *w) for p in "pq" for i, w in enumerate(was)], "project_uid string, uid string, width_then int, height_then int, profile_then string, fingerprint_then string")
    pages = recorded.select("project_uid", "uid", (F.ascii(F.substr("uid", F.lit(2))) % 3 * 10).alias("width"), F.lit(20).alias("height"))
    met = match.match_pages(pages, projects, links, palette).drop("__other")
    want = staleness.canvas_staleness(met.join(recorded, ["project_uid", "uid"]), signatures.canvas_render_fingerprint(palette)).select("project_uid", "changed", F.coalesce("unknown", F.lit(True)).alias("unknown"))
    got = results._recorded_changes(recorded, pages, projects, links, palette)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r.changed for r in got.collect()} == {True, False}
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("profile_id#" in j for j in joins)


def test_a_run_stores_no_checks_and_finds_its_projects_once(spark, monkeypatch):
    from stripweave.plans import registry

    kept, keep = [], registry.keep
    monkeypatch.setattr(registry, "keep", lambda rows: (kept.append(rows.columns), keep(rows))[1])
    QUERIES["report_after_run"](spark, FOLDER)
    assert not any("path" in c or "used_fingerprint" in c for c in kept)
    assert ["project_uid", "ids", "output_signature", "processing_signature"] in [[x.replace("profile_ids", "ids") for x in c] for c in kept]


def test_a_summary_looks_for_no_profile_of_its_own(spark, monkeypatch):
    from stripweave.operators import match

    def none(*a, **k):
        raise AssertionError("pages are matched for their skips")

    monkeypatch.setattr(match, "match_pages", none)
    assert "skipped_pages" in QUERIES["run_summary"](spark, FOLDER).columns
    rows = spark.createDataFrame([("Missing", 1, 1), ("Missing", 0, 1), ("Done", 0, 1), ("Done", 1, -1), ("Done", 1, 1)], "status string, width int, height int")
    assert [r.p for r in rows.select(match.skipped().alias("p")).collect()] == ["SkippedMissing", "SkippedMissing", "SkippedError", "SkippedError", None]
