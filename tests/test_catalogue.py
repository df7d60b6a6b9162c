"""Small hand-made cases: known results, rules as properties, and step-by-step models."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from stripweave.operators import identity, layout, match, overlays, packaging, pixels, profiles, scan_merge, signatures, staleness
from stripweave.sources import documents, files, state
from stripweave.streaming import catalogue as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pages(spark, *heights, width=800, project="p"):
    rows = [(project, f"u{i}", i, width, h) for i, h in enumerate(heights)]
    return layout.scaled_size(frame(spark, rows, "project_uid string, uid string, ord long, width long, height long"), F.lit(width))


def test_two_pages_make_two_slices(spark):
    segments = layout.slice_source_map(layout.strip_layout(pages(spark, 1200, 1200)), F.lit(1280))
    got = sorted((r.slice_index, r.uid, r.source_y, r.height) for r in segments.collect())
    assert got == [(0, "u0", 0, 1200), (0, "u1", 0, 80), (1, "u1", 80, 1120)]
    assert {r.uid: r.slices for r in layout.contributes_to(segments).collect()} == {"u0": "0", "u1": "0,1"}


@pytest.mark.parametrize("policy, slices", [("Crop", 2), ("PadWhite", 3), ("KeepAsIs", 3)])
def test_tail_policies(spark, policy, slices):
    totals = layout.strip_totals(layout.strip_layout(pages(spark, 150, 100))).withColumns({"slice_height": F.lit(100), "policy": F.lit(policy)})
    row = layout.slice_count(totals).first()
    assert (row.n_full, row.tail, row.n_slices) == (2, 50, slices)


def test_slice_height_of_zero_gives_none(spark):
    totals = layout.strip_totals(layout.strip_layout(pages(spark, 10))).withColumns({"slice_height": F.lit(0), "policy": F.lit("KeepAsIs")})
    assert layout.slice_count(totals).first().n_slices == 0


def test_overflow_is_flagged(spark):
    assert layout.strip_totals(layout.strip_layout(pages(spark, 2_000_000_000, 2_000_000_000))).first().overflow


def test_segments_tile_every_slice(spark):
    random.seed(5)
    heights = [random.randint(1, 900) for _ in range(60)]
    strip = layout.strip_layout(pages(spark, *heights))
    segments = layout.slice_source_map(strip, F.lit(128)).cache()
    assert segments.agg(F.sum("height")).first()[0] == sum(heights)
    totals = layout.strip_totals(strip)
    assert layout.provenance_check(segments, totals, 128).where("NOT ok").isEmpty()
    last = segments.agg(F.max("slice_index")).first()[0]
    bad = layout.provenance_check(segments.where(f"NOT (slice_index = 3) AND NOT (slice_index = {last})").unionByName(segments.where("slice_index = 5")), totals, 128)
    assert sorted(r.slice_index for r in bad.where("NOT ok").collect()) == [3, 5, last]
    chunked = layout.strip_layout_chunked(pages(spark, *heights), chunk=7)
    assert sorted((r.uid, r.start_y) for r in chunked.collect()) == sorted((r.uid, r.start_y) for r in strip.collect())


def test_names_grow_past_three_digits(spark):
    row = spark.range(1).select(layout.slice_name(F.lit(998) + F.lit(4), F.lit(".png")).alias("n")).first()
    assert row.n == "output_1002.png"


def test_scaled_size_of_a_cropped_page(spark):
    row = layout.scaled_size(frame(spark, [(160, 360)], "width long, height long"), F.lit(80)).first()
    assert (row.scaled_w, row.scaled_h) == (80, 180)


PALETTE = [("cp-1", 1, 1600, 10240), ("cp-2", 2, 1600, 5120), ("cp-3", 3, 1600, 5120)]


def matched(spark, links):
    palette = frame(spark, [(*p, 7) for p in PALETTE] + [("cp-0", 1, 800, 1280, 8)], "id string, ordinal int, width long, height long, ws long")
    projects = frame(spark, [("p", 7)], "project_uid string, ws long")
    own = frame(spark, links, "project_uid string, id string, prio int")
    rows = frame(spark, [("p", "a", 1600, 5120), ("p", "b", 800, 1280)], "project_uid string, uid string, width long, height long")
    hit = match.match_canvas_profile(rows, projects, own, palette)
    other = match.unlinked_candidates(rows, projects, own, palette)
    plan = match.page_plan(match.match_pages(rows.withColumn("status", F.lit("Processed")), projects, own, palette))
    whole = match.effective_profiles(projects, own, palette).orderBy("prio").collect()
    assert [r.id for r in whole] == match.effective_ids(projects, own, palette).first().ids.split(",")
    profiles, candidates = {r.uid: r.profile_id for r in hit.collect()}, {r.uid: (r["match"], r.candidate_ids) for r in other.collect()}
    names = {"FoundInWorkspaceOnly": "AppendedProfileNotLinked", "NotFoundAnywhere": "AppendedWithoutProfile"}
    assert {r.uid: (r.plan, r.profile_id) for r in plan.collect()} == {u: ("Appended", p) if p else (names[candidates[u][0]], None) for u, p in profiles.items()}
    return profiles, candidates


def test_no_link_accepts_the_whole_palette(spark):
    assert matched(spark, []) == ({"a": "cp-2", "b": None}, {"b": ("NotFoundAnywhere", "")})


def test_priority_decides_and_unknown_links_are_dropped(spark):
    assert matched(spark, [("p", "cp-x", 1), ("p", "cp-3", 2), ("p", "cp-2", 3)])[0]["a"] == "cp-3"


def test_profiles_that_are_not_linked_are_candidates(spark):
    assert matched(spark, [("p", "cp-1", 1)]) == ({"a": None, "b": None}, {"a": ("FoundInWorkspaceOnly", "cp-2,cp-3"), "b": ("NotFoundAnywhere", "")})


def test_anchors(spark):
    tops = frame(spark, [("p", "a", 0), ("p", "b", 100), ("p", "c", 250)], "project_uid string, uid string, start_y long")
    rows = frame(
        spark, [("p", "o1", "c", 0.05, 0.025, 0.1, True, 0, 0), ("p", "o2", "", 0.0, 1.125, 0.0, True, 0, 1), ("p", "o3", "gone", 0.0, 0.0, 0.1, False, 0, 2)],
        "project_uid string, uid string, anchor_input_uid string, x_frac double, y_frac double, w_frac double, enabled boolean, blend int, z int",
    )
    got = {r.uid: (r.x, r.y, r.width) for r in overlays.resolve_overlay_anchors(rows, tops, F.lit(800)).collect()}
    assert got == {"o1": (40, 270, 80), "o2": (0, 900, 0)}
    assert [r.uid for r in overlays.orphan_overlays(rows, tops).collect()] == ["o3"]


def test_disk_checks_change_status_once(spark):
    schema = "project_uid string, kind string, path string, status string, sha256 string"
    rows = [("p", "input", "a", "Processed", "1"), ("p", "input", "b", "Error", ""), ("p", "input", "c", "Skipped", "3"), ("p", "input", "d", "Pending", "4"), ("p", "input", "e", "Processed", "5"), ("p", "output", "o", "Pending", "9")]
    checks = frame(
        spark, [("p", "a", "1", True, "2"), ("p", "b", "", True, "7"), ("p", "c", "3", True, "3"), ("p", "d", "old", True, "4"), ("p", "e", "5", False, ""), ("p", "o", "9", True, "9")],
        "project_uid string, path string, recorded_sha256 string, found boolean, disk_sha256 string",
    )
    once = staleness.apply_disk_checks(frame(spark, rows, schema), checks)
    got = {r.path: (r.status, r.sha256) for r in once.collect()}
    assert got == {"a": ("Modified", "1"), "b": ("Processed", "7"), "c": ("Skipped", "3"), "d": ("Pending", "4"), "e": ("Missing", "5"), "o": ("Done", "9")}
    again = {r.path: (r.status, r.sha256) for r in staleness.apply_disk_checks(once, checks).collect()}
    assert again == got
    several = checks.unionByName(frame(spark, [("p", "a", "0", True, "0"), ("p", "e", "old", True, "5"), ("p", "o", "8", False, "")], checks.schema)).unionByName(checks)
    rows_ = staleness.apply_disk_checks(frame(spark, rows, schema), several).collect()
    assert len(rows_) == len(rows) and {r.path: (r.status, r.sha256) for r in rows_} == got
    projects = frame(spark, [("p",), ("q",)], "project_uid string")
    assert {r.project_uid: r.up_to_date for r in staleness.up_to_date(projects, once).collect()} == {"p": False, "q": True}


def sequential_scan(old, new):
    """The rescan one page at a time: a path keeps its record, a hash renames one not yet consumed."""
    by_path, by_hash = {p: u for u, p, _ in old}, {h: u for u, _, h in old}
    used, out = set(), []
    for order, (path, digest) in enumerate(new):
        if path in by_path:
            used.add(by_path[path])
            out.append((path, by_path[path], order, "kept"))
        elif digest in by_hash and by_hash[digest] not in used:
            used.add(by_hash[digest])
            out.append((path, by_hash[digest], order, "renamed"))
        else:
            out.append((path, None, order, "added"))
    return out + [(p, u, None, "removed") for u, p, _ in old if u not in used]


def test_rescan_agrees_with_the_sequential_model(spark):
    random.seed(11)
    old_rows, new_rows, want = [], [], []
    for case in range(150):
        n = random.randint(0, 6)
        old = [(f"u{i}", f"/p{i}", f"h{random.randint(0, 3)}") for i in range(n)]
        names = [f"/p{i}" for i in range(n)] + [f"/q{i}" for i in range(5)]
        new = [(p, f"h{random.randint(0, 3)}") for p in random.sample(names, random.randint(0, 6) if n > 1 else 3)]
        old_rows += [(f"c{case}", u, p, h, i) for i, (u, p, h) in enumerate(old)]
        new_rows += [(f"c{case}", p, h, i) for i, (p, h) in enumerate(new)]
        want += [(f"c{case}", *r) for r in sequential_scan(old, new)]
    got = scan_merge.merge_file_scan(
        frame(spark, old_rows, "project_uid string, uid string, file_path string, sha256 string, ord long"), frame(spark, new_rows, "project_uid string, file_path string, sha256 string, ord long")
    )
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.project_uid, r.path, r.old_uid, r.ord, r.change_type) for r in got.collect()), key=key) == sorted(want, key=key)


def test_target_claims_step_by_step_where_names_look_numbered(spark):
    rows = [(1, "/s/1/a.png"), (2, "/s/2/A.png"), (3, "/s/3/a (2).png"), (4, "/s/4/a.png"), (5, "/ws/in/b.png"), (6, "/s/5/noext"), (7, "/s/6/noext")]
    refs = frame(spark, [("w", s, p, "inputs", "/ws/", True, 1) for s, p in rows], "ws string, seq long, source string, kind string, folder string, present boolean, bytes long")
    got = {r.seq: r.target for r in packaging.package_target_claim(refs).collect()}
    assert got == {1: "inputs/a.png", 2: "inputs/A (2).png", 3: "inputs/a (2) (2).png", 4: "inputs/a (3).png", 5: "in/b.png", 6: "inputs/noext", 7: "inputs/noext (2)"}


def test_target_claims_against_one_by_one(spark):
    random.seed(4)
    names = [f"{s}{n}{e}" for s in ("a", "A", "b") for n in ("", " (2)", " (3)", " (2) (2)") for e in (".png", ".PNG", "")]
    rows = [("w", k, f"/s/{k}/{random.choice(names)}", "inputs", "/ws/", True, 1) for k in range(60)]
    want, taken = {}, set()
    for _, k, source, *_ in rows:
        raw = source.rsplit("/", 1)[1]
        dot = raw.rfind(".")
        stem, ext = (raw[:dot], raw[dot:]) if dot >= 0 else (raw, "")
        name, n = raw, 2
        while name.lower() in taken:
            name, n = f"{stem} ({n}){ext}", n + 1
        taken.add(name.lower())
        want[k] = f"inputs/{name}"
    refs = frame(spark, rows, "ws string, seq long, source string, kind string, folder string, present boolean, bytes long")
    assert {r.seq: r.target for r in packaging.package_target_claim(refs).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_target_claims_of_random_families(spark, seed):
    """Many names of one stem with numbers in any order, repeats and gaps; no Python worker takes part."""
    rng = random.Random(seed)
    numbers = ["", "", " (1)", " (2)", " (3)", " (4)", " (5)", " (7)", " (03)", " (2) (2)", " (2) (3)", " (3) (2)", " (4) (2) (2)"]
    rows = [(f"w{k % 2}", k, f"/s/{k}/{rng.choice('aA')}{rng.choice(numbers)}.png", "inputs", "/s/1" if k % 9 == 0 else "/ws/", True, 1) for k in range(160)]
    want = {}
    for ws in ("w0", "w1"):
        taken = set()
        for _, k, source, kind, folder, *_ in sorted((r for r in rows if r[0] == ws), key=lambda r: (not r[2].startswith(r[4]), r[1], r[2])):
            raw = source.rsplit("/", 1)[1]
            home = source[len(folder) :].rsplit("/", 1)[0] + "/" if source.startswith(folder) else f"{kind}/"
            stem, n, name = raw[:-4], 2, raw
            while (home, name.lower()) in taken:
                name, n = f"{stem} ({n}).png", n + 1
            taken.add((home, name.lower()))
            want[k] = home + name
    refs = frame(spark, rows, "ws string, seq long, source string, kind string, folder string, present boolean, bytes long")
    claimed = packaging.package_target_claim(refs)
    assert {r.seq: r.target for r in claimed.collect()} == want
    assert "Python" not in claimed._jdf.queryExecution().executedPlan().toString()


def test_duplicate_ids_are_repaired_once(spark):
    rows = frame(spark, [("w", 1, "a", "x"), ("w", 2, "b", "x"), ("w", 3, "c", "y"), ("v", 1, "d", "x")], "workspace_id string, ordinal int, name string, id string")
    once = identity.duplicate_id_repair(rows)
    assert sorted(r.ordinal for r in once.where("old_id <> new_id").collect()) == [2]
    again = identity.duplicate_id_repair(once.select("workspace_id", "ordinal", "name", F.col("new_id").alias("id")))
    assert again.where("old_id <> new_id").isEmpty()


def test_signatures(spark):
    grades = frame(spark, [("p", 0.0, 1.0, 1.0), ("q", 0.1, 1.0, 1.0)], "project_uid string, brightness double, contrast double, saturation double")
    no_points = frame(spark, [], "project_uid string, channel string, seq int, x double, y double")
    schema = "project_uid string, uid string, z int, sha256 string, anchor_input_uid string, x_frac double, y_frac double, w_frac double, blend int, enabled boolean"
    none = frame(spark, [], schema)
    first = frame(spark, [("q", "b"), ("q", "a")], "project_uid string, uid string")
    second = frame(spark, [("q", "a"), ("q", "b")], "project_uid string, uid string")
    sign = lambda x, o: {r.project_uid: r.signature for r in signatures.processing_signature(grades, no_points, x, o).collect()}
    assert sign(first, none)["p"] == "" and sign(first, none) == sign(second, none) and "xa,b}" in sign(first, none)["q"]
    two = [("p", "o1", 1, "s1", "", 0.0, 0.0, 0.1, 0, True), ("p", "o2", 2, "s2", "", 0.0, 0.0, 0.1, 0, True)]
    swapped = [(*r[:2], 3 - r[2], *r[3:]) for r in two]
    assert sign(first, frame(spark, two, schema))["p"] != sign(first, frame(spark, swapped, schema))["p"]
    assert sign(first, frame(spark, [(*r[:9], False) for r in two], schema))["p"] == ""


def test_signature_fields_that_differ(spark):
    rows = frame(spark, [("k", "a=1;b=2", "a=1;b=3;c=4")], "key string, was string, now string")
    got = [(r.seq, r.field, r.was, r.now) for r in profiles.signature_diff(rows).orderBy("seq").collect()]
    assert got == [(1, "b", "2", "3"), (2, "c", "", "4")]


def test_neutral_grade_changes_no_pixel(spark):
    px = frame(spark, [(1, 0, 0, 10, 200, 30, 77)], "image_uid long, x long, y long, r long, g long, b long, a long")
    rows = px.withColumns({"brightness": F.lit(0.0), "contrast": F.lit(1.0), "saturation": F.lit(1.0)} | {f"__c_{c}": F.lit(None).cast("array<struct<x:double,y:double>>") for c in "mrgb"})
    assert pixels.grade_page(rows).select("r", "g", "b", "a").first() == (10, 200, 30, 77)
    wide = pixels.grade_levels(rows.withColumns({"r": F.lit(65535), "contrast": F.lit(0.5)}), 65535).first()
    assert abs(wide.r - 49151) <= 1


def test_opaque_overlay_covers(spark):
    base = frame(spark, [(1, 0, 0, 10, 20, 30, 255), (1, 1, 0, 1, 2, 3, 4)], "image_uid long, x long, y long, r long, g long, b long, a long")
    top = frame(spark, [(1, 0, 0, 5, 0, 100, 110, 120, 255)], "image_uid long, x long, y long, z int, blend int, r long, g long, b long, a long")
    got = {r.x: (r.r, r.g, r.b, r.a) for r in pixels.composite_overlays(base, top).collect()}
    assert got == {0: (100, 110, 120, 255), 1: (1, 2, 3, 4)}


def test_files_are_listed_and_hashed(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt", "d.TIFF"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.png").write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_image_dir(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG", "d.TIFF"]
    (tmp_path / "e 100%.png").write_bytes(b"z" * 3_000_000)
    got = {r.key.rsplit("/", 1)[1]: r.sha256 for r in files.hash_listed(spark, str(tmp_path)).collect()}
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir() if p.is_file()}
    listing = files.list_files(spark, str(tmp_path)).collect()
    assert len(listing) == 5
    (tmp_path / "b.PNG").unlink()
    lost = files.hash_of(spark.createDataFrame(listing)).where("sha256 = ''").collect()
    assert [r.key.rsplit("/", 1)[1] for r in lost] == ["b.PNG"]


def chunk(kind, data):
    return struct.pack(">I4s", len(data), kind) + data + b"crc_"


def exif(order, orientation):
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    return head + struct.pack(order + "HHHIHHI", 1, 274, 3, 1, orientation, 0, 0)


def test_headers_are_read_without_pixels(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 640, 480, 8, 6, 0, 0, 0)) + chunk(b"tEXt", b"x" * 90_000) + chunk(b"eXIf", exif(">", 6)) + chunk(b"IDAT", b"")
    frame_header = b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, 300, 200, 1) + b"\x00" * 3
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10
    turned = jpeg + b"\xff\xe1" + struct.pack(">H", 2 + 6 + len(exif("<", 8))) + b"Exif\0\0" + exif("<", 8) + b"\xff\xff" + frame_header
    tiff = b"II" + struct.pack("<HI", 42, 12) + b"pads" + struct.pack("<H", 4)
    tiff += b"".join(struct.pack("<HHII", *e) for e in ((256, 4, 1, 70), (257, 3, 1, 90), (274, 3, 1, 5), (277, 3, 1, 3))) + b"\0" * 4
    samples = {"a.png": png, "b.jpg": jpeg + frame_header, "c.jpeg": turned, "d.tif": tiff, "e.png": png[:20], "f.png": b"no image", "g.jpg": jpeg, "h.txt": png}
    for name, data in samples.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.bands) for r in files.scan_image_headers(spark, str(tmp_path)).collect()}
    lost = (-1, -1, 0)
    assert got == {"a.png": (480, 640, 4), "b.jpg": (200, 300, 1), "c.jpeg": (300, 200, 1), "d.tif": (90, 70, 3), "e.png": lost, "f.png": lost, "g.jpg": lost}


def test_workspaces_are_read_repaired_and_rejected(spark, tmp_path):
    good = {"version": 2, "projectItems": [{"name": "n", "uid": "p1", "inputs": [{"filePath": "a.png", "width": 3, "height": 4}], "outputs": [{"fileName": "o.png", "sourceMap": [{"sourceFilePath": "a.png", "srcY": 0, "height": 4}]}]}],
            "canvasProfiles": [{"id": "c", "name": "c", "canvasSize": {"width": 1, "height": 2}, "templateInfo": {"path": "/t.psd", "fingerprint": "cw=1"}}]}
    for name, text in {"a": json.dumps(good), "b": json.dumps({"projectItems": []}), "c": "no json", "d": json.dumps({"version": 9, "projectItems": []})}.items():
        (tmp_path / f"{name}.workspace.json").write_text(text)
    tables = documents.read_workspaces(spark, str(tmp_path / "*.json"))
    assert tables["workspaces"].first().version == 3
    page = tables["inputs"].first()
    assert (page.status, page.ord, page.uid, page.width) == ("Pending", 0, "", 3)
    template = tables["templates"].first()
    assert (template.format, template.fingerprint) == ("PSD", "cw=1;dpi=25.4;fmt=PSD")
    assert sorted(r.problem for r in tables["bad_workspaces"].collect()) == ["newer version", "no version", "not a document"]
    documents.write_workspaces(tables, str(tmp_path / "out"))
    back = json.loads(next((tmp_path / "out").glob("part-*")).read_text().strip())
    assert back["projectItems"][0]["outputs"][0]["sourceMap"] == [{"sourceFilePath": "a.png", "srcY": 0, "height": 4}]


def test_bundles_of_other_versions_are_refused(spark):
    rows = frame(spark, [("a", '{"version": 1, "profiles": [{"id": "x", "name": "n"}]}'), ("b", '{"version": 2}'), ("c", "{}")], "bundle_id string, json string")
    good, bad = documents.read_profile_bundles(rows)
    assert [r.id for r in good.collect()] == ["x"] and {r.bundle_id: r.reason for r in bad.collect()} == {"b": "newer version", "c": "no version"}


CHECKS = "project_uid string, path string, recorded_sha256 string, found boolean, disk_sha256 string, checked_at timestamp"
FILES = "project_uid string, kind string, path string, status string, sha256 string"


def one_check(spark, project, path, at, found=True, disk="1", recorded="1"):
    return spark.sql(
        f"SELECT '{project}' AS project_uid, '{path}' AS path, '{recorded}' AS recorded_sha256, {str(found).lower()} AS found, '{disk}' AS disk_sha256, timestamp('2024-01-01 {at}:00') AS checked_at"
    )


def test_stream_of_checks_equals_the_batch(spark, tmp_path):
    table = frame(spark, [("p", "input", f, "Pending", "1") for f in "abc"] + [("q", "output", "a", "Done", "2")], FILES)
    kept = state.State(spark, str(tmp_path / "state"))
    kept.publish({"files": table})
    rows = [one_check(spark, "p", "a", "12:00", disk="9"), one_check(spark, "p", "a", "13:00"), one_check(spark, "p", "b", "09:00", found=False, disk=""), one_check(spark, "q", "a", "11:00", recorded="1")]
    for row in rows:
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.disk_check_stream(source, kept, str(tmp_path / "ck")).awaitTermination(120)
    want = stream.apply_check_batch(table, rows[0].union(rows[1]).union(rows[2]).union(rows[3])).collect()
    assert sorted(tuple(r) for r in kept.read("files").drop("bucket").collect()) == sorted(tuple(r) for r in want)
    assert {(r.project_uid, r.path): r.status for r in want} == {("p", "a"): "Processed", ("p", "b"): "Missing", ("p", "c"): "Pending", ("q", "a"): "Done"}


def test_late_results_still_count(spark, tmp_path):
    kept = state.State(spark, str(tmp_path / "state"))
    kept.publish({"files": frame(spark, [(p, "input", "a", "Pending", "1") for p in "pqr"], FILES)})
    for project, at in [("p", "12:00"), ("q", "15:00"), ("r", "09:00")]:
        one_check(spark, project, "a", at).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.disk_check_stream(source, kept, str(tmp_path / "ck")).awaitTermination(120)
    assert {r.project_uid: r.status for r in kept.read("files").collect()} == {"p": "Processed", "q": "Processed", "r": "Processed"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    kept = state.State(spark, str(tmp_path / "state"))
    kept.publish({"files": frame(spark, [(f"p{i}", "input", "a", "Pending", "1") for i in range(50)], FILES)})
    batch = one_check(spark, "p7", "a", "12:00")
    stream.upsert_checks(kept, batch, "s:0")
    version, first = kept.version(), kept.manifest()
    stream.upsert_checks(kept, one_check(spark, "p7", "a", "13:00", found=False), "s:0")  # the same batch number
    assert kept.version() == version == 1 and kept.manifest() == first
    changed = {b for b, v in first["tables"]["files"].items() if v != kept.manifest(0)["tables"]["files"][b]}
    assert changed == {str(b) for b in kept.touched(batch)}  # other buckets are not written again
    stream.upsert_checks(kept, batch.limit(0), "s:1")
    assert kept.version() == 1


def test_of_two_writers_one_gets_through(spark, tmp_path):
    kept = state.State(spark, str(tmp_path / "state"), buckets=4)
    rows = frame(spark, [(f"p{i}", i) for i in range(20)], "project_uid string, n int")
    kept.publish({"a": rows, "b": rows})
    base = kept.manifest()
    before = kept.read("a", manifest=base)
    kept.publish({"a": rows.withColumn("n", F.col("n") + 100)}, base=base)
    with pytest.raises(state.VersionConflict):
        kept.publish({"a": rows.withColumn("n", F.col("n") + 200)}, base=base)
    assert min(r.n for r in kept.read("a").collect()) == 100 and kept.version() == 1
    assert sorted(r.n for r in before.collect()) == list(range(20))  # a reader keeps the version that it began with
    assert sorted(r.n for r in kept.read("b").collect()) == list(range(20))
    one = kept.touched(rows.where("n = 3"))
    kept.publish({"a": rows.limit(0), "b": rows.limit(0)}, one)
    left = {r.project_uid for r in kept.read("a").collect()}
    assert left == {r.project_uid for r in rows.where(~kept.bucket().isin(one)).collect()} and left == {r.project_uid for r in kept.read("b").collect()}
    with pytest.raises(ValueError):
        kept.publish({"a": rows}, one)


def test_a_run_on_few_projects_reads_few_buckets(spark, tmp_path):
    kept = state.State(spark, str(tmp_path / "state"), buckets=8)
    kept.publish({"outputs": frame(spark, [(f"p{i}", f"f{i}") for i in range(400)], "project_uid string, file_name string")})
    run = frame(spark, [("p3",)], "project_uid string").withColumn("bucket", kept.bucket())
    few = kept.read("outputs").join(F.broadcast(run.where("project_uid = 'p3'")), ["bucket", "project_uid"])
    assert [r.file_name for r in few.collect()] == ["f3"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert len(kept.read("outputs", kept.touched(run)).inputFiles()) == 1 < len(kept.read("outputs").inputFiles())


def test_one_hash_in_all_files(spark):
    """A blank page that very many new files repeat: one claim wins, no window holds them together."""
    old = frame(spark, [("p", "u0", "/a", "blank", 0), ("p", "u1", "/b", "x", 1)], "project_uid string, uid string, file_path string, sha256 string, ord long")
    new = spark.range(20_000).select(F.lit("p").alias("project_uid"), F.concat(F.lit("/n"), F.col("id").cast("string")).alias("file_path"), F.lit("blank").alias("sha256"), (20_000 - F.col("id")).alias("ord"))
    merged = scan_merge.merge_file_scan(old, new)
    assert "Window" not in merged._jdf.queryExecution().executedPlan().toString()
    kinds = {r.change_type: r.n for r in merged.groupBy("change_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"renamed": 1, "added": 19_999, "removed": 1}
    assert merged.where("change_type = 'renamed'").first().ord == 1


def test_files_are_checked_from_plan_to_status(spark, tmp_path):
    contents = {f"f{i}": bytes([i]) * (1 + 400 * (i % 5)) for i in range(20)}
    listing = [(f"{tmp_path}/d/{n}", c) for n, c in contents.items()]
    written = files.write_files(frame(spark, listing, "path string, content binary")).persist()
    assert {r.path: r.length for r in written.collect()} == {p: len(c) for p, c in listing}
    plan = [("p", "input", p, hashlib.sha256(c).hexdigest()) for p, c in listing[:8]] + [("q", "input", listing[0][0], "other"), ("p", "input", f"{tmp_path}/d/none", "1")]
    (tmp_path / "d" / "f1").write_bytes(b"shorter")
    checks = files.check_files(frame(spark, plan, "project_uid string, kind string, path string, recorded_sha256 string"), written, 1000)
    got = {(r.project_uid, r.path.rsplit("/", 1)[1]): (r.found, r.disk_sha256) for r in checks.collect()}
    want = {("p", n): (True, "" if n == "f1" else hashlib.sha256(c).hexdigest()) for n, c in list(contents.items())[:8]}
    assert got == want | {("q", "f0"): (True, hashlib.sha256(contents["f0"]).hexdigest()), ("p", "none"): (False, "")}
    dealt = files.dealt_by_length(written, 1000).withColumn("part", F.spark_partition_id())
    sums = {r.part: (r.n, r.s) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("s")).collect()}
    assert len(sums) > 3 and all(s <= 1000 + 1601 for _, s in sums.values())


def test_names_asked_for(spark):
    rows = frame(spark, [("1", "a"), ("2", "b"), ("3", "a")], "id string, name string")
    kept, unmatched = profiles.only_names(rows, " a ,, c")
    assert sorted(r.id for r in kept.collect()) == ["1", "3"] and [r.name for r in unmatched.collect()] == ["c"]


def curve(points, value):
    below, above = [p for p in points if p[0] <= value], [p for p in points if p[0] > value]
    if not below or not above:
        return points[0][1] if not below else below[-1][1]
    (x0, y0), (x1, y1) = below[-1], above[0]
    return y0 if x1 - x0 <= 1e-9 else y0 + (y1 - y0) * (value - x0) / (x1 - x0)


def test_curves_at_every_byte(spark):
    random.seed(2)
    for points in ([(0.5, 0.4)], [(0.0, 0.0), (0.5, 0.4), (1.0, 1.0)], [(0.25, 0.2), (0.25, 0.7), (0.8, 0.1)], sorted((random.random(), random.random()) for _ in range(9))):
        rows = spark.range(256).select(F.col("id").alias("r"), F.lit(0).alias("g"), F.lit(255).alias("b"))
        array = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])
        rows = rows.withColumns({"__c_m": array, "__c_r": F.lit(None).cast(array_type := "array<struct<x:double,y:double>>"), "__c_g": F.array().cast(array_type), "__c_b": array})
        byte = lambda y: min(255, max(0, int(y * 255 + 0.5)))
        for at, r in enumerate(sorted(pixels.grade_curves(rows.withColumn("k", F.col("r"))).collect(), key=lambda r: r.k)):
            once = byte(curve(points, at / 255))
            assert (r.r, r.g, r.b) == (once, byte(curve(points, 0.0)), byte(curve(points, byte(curve(points, 1.0)) / 255)))


def test_event_counts_by_window(spark):
    rows = spark.sql("SELECT timestamp(t) AS ts, 'p' AS project_uid, 'Done' AS status FROM VALUES ('2024-01-01 00:01:00'), ('2024-01-01 00:59:00'), ('2024-01-01 01:00:00') AS v(t)")
    assert sorted(r.n for r in stream.render_event_counts(rows).collect()) == [1, 2]
