"""Unit and property tests of the operators on small synthetic frames."""

import datetime
import difflib
import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.functions import images, text, timeutil
from casewright.functions.uids import is_valid_uid, new_uid
from casewright.operators import headers, paths, predicates, publish, quality, registry, sessions
from casewright.schemas import INTAKE_FORM, REGISTRY_EXTRAS, SHEET_COLUMNS, registry_schema
from casewright.sources import case_sheet, dicom, listings, png, registry_json


def users(spark, *names):
    return spark.createDataFrame([(n.upper(), f"2_25_{i}", "t", "2_25_0") for i, n in enumerate(names, 1)], registry_schema())


def test_insert_is_idempotent_and_ignores_case(spark):
    base = users(spark, "ann")
    new = spark.createDataFrame([("Bob", "2_25_9", 1), ("BOB", "2_25_8", 2), ("ann", "2_25_7", 3), ("eve", "2_25_01", 4)], "NAME string, UID string, ordinal int")
    once, judged = registry.insert_if_absent(base, new, "2_25_1", F.lit("now"))
    assert {r.NAME for r in once.collect()} == {"ANN", "BOB"}
    assert sorted((r.NAME, r.reason) for r in judged.collect()) == [("BOB", "repeated"), ("Bob", "ok"), ("ann", "exists"), ("eve", "invalid uid")]
    twice, _ = registry.insert_if_absent(once, new, "2_25_1", F.lit("now"))
    assert twice.count() == 2
    with pytest.raises(ValueError, match="unknown extra"):
        registry.insert_if_absent(base, new.withColumn("ODD", F.lit(1)), "x", F.lit("now"))


def test_lookup_require_and_guard(spark):
    probes = spark.createDataFrame([("Ann",), ("zoe",)], "who string")
    found = registry.lookup_uid(probes, "who", users(spark, "ann"))
    assert {(r.who, r.uid) for r in found.collect()} == {("Ann", "2_25_1"), ("zoe", None)}
    with pytest.raises(Exception, match="not registered"):
        registry.require(found, F.col("uid").isNotNull(), "not registered").collect()
    registry.guard("Ann", users(spark, "ann"))
    with pytest.raises(PermissionError):
        registry.guard("zoe", users(spark, "ann"))
    with pytest.raises(PermissionError):
        registry.guard("ann", users(spark, "ann"), users(spark, "bob"))


def test_catalog(spark):
    catalog = registry.Catalog({"users": users(spark, "ann")}).add_table(spark, "sites", "city")
    assert catalog.tables() == ["SITES", "USERS"] and "CITY" in catalog.get("Sites").columns
    with pytest.raises(ValueError):
        catalog.add_table(spark, "SITES")
    with pytest.raises(KeyError):
        catalog.get("none")


@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=12))
@settings(max_examples=8, deadline=None)
def test_duplicates_flag_all_but_the_first(spark, rows):
    data = [(i, "s", str(h), v) for i, (h, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, session string, h string, is_valid boolean")
    got = {r.i: r.is_questionable for r in sessions.flag_duplicates(df, "session", "h", "i").collect()}
    seen, want = set(), {}
    for i, _, h, v in data:
        want[i] = (h in seen) if v else None
        if v:
            seen.add(h)
    assert got == want


def test_file_names(spark):
    df = spark.createDataFrame([("1",), ("10",), ("999",), ("1000",)], "n string")
    assert [r[0] for r in df.select(sessions.file_name(F.col("n"), F.lit("u"))).collect()] == ["0001-u", "0010-u", "0999-u", "1000-u"]
    with pytest.raises(Exception, match="too long"):
        spark.createDataFrame([("10000",)], "n string").select(sessions.file_name(F.col("n"), F.lit("u"))).collect()


_leaf = st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["=", "<", ">=", "!="]), st.integers(0, 3))
_tree = st.recursive(_leaf, lambda kids: st.builds(lambda x, w, y: [x, w, y], kids, st.sampled_from(["AND", "OR"]), kids), max_leaves=5)


def truth(tree, row):
    if isinstance(tree, tuple):
        f, op, v = tree
        return {"=": row[f] == v, "<": row[f] < v, ">=": row[f] >= v, "!=": row[f] != v}[op]
    left, word, right = tree
    return (truth(left, row) and truth(right, row)) if word == "AND" else (truth(left, row) or truth(right, row))


@given(_tree)
@settings(max_examples=12, deadline=None)
def test_constraint_trees(spark, tree):
    rows = [{"a": a, "b": b} for a in range(4) for b in range(4)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r.a, r.b) for r in df.where(predicates.compile_constraints(tree)).collect()}
    assert got == {(r["a"], r["b"]) for r in rows if truth(tree, r)}


def test_constraint_errors():
    for bad in ([], ["OR"], ("a", "~", 1), [("a", "=", 1), "OR", ("a", "=", 2), "AND", ("a", "=", 3)]):
        with pytest.raises(ValueError):
            predicates.compile_constraints(bad)


@given(st.dictionaries(st.from_regex(r"[a-z][a-z0-9]{0,4}", fullmatch=True), st.from_regex(r"[a-z]{1,6}", fullmatch=True), min_size=1, max_size=4))
@settings(max_examples=10, deadline=None)
def test_task_map_round_trip(spark, pairs):
    rendered = "{" + "; ".join(f"{k}: {v}" for k, v in pairs.items()) + "}"
    row = spark.createDataFrame([(rendered,)], "t string").select(text.task_map(F.col("t")).alias("m"), text.task_notices(F.col("t")).alias("n")).first()
    assert row.m == pairs and row.n == []


def test_task_map_notices(spark):
    cases = {"{s1: cut, s2: close}": ["colons"], "s1: cut": ["braces", "shape"], "{s1 cut; s2: close}": ["colons"], "{}": ["colons"]}
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.task_notices(F.col("t")).alias("n"), text.task_map(F.col("t")).alias("m"))
    got = {r.t: (r.n, r.m) for r in df.collect()}
    assert got["s1: cut"] == (["braces", "shape"], None)
    assert got["{s1 cut; s2: close}"][1] is None and "colons" in got["{s1: cut, s2: close}"][0]
    quoted = spark.createDataFrame([("{'S1': \"cut\"; s1: sew}",)], "t string").select(text.task_map(F.col("t")).alias("m")).first()
    assert quoted.m == {"s1": "sew"}


def test_fuzzy_matches_equal_the_library(spark):
    known = ["surgeon_001", "surgeon_002", "smith"]
    values = ["surgeon_01", "smyth", "zzz", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.close_match(known)(F.col("v")).alias("m"))
    assert {r.v: r.m for r in df.collect()} == {v: (next(iter(difflib.get_close_matches(v, known, 1, 0.6)), None) if v else None) for v in values}
    mapped = text.map_headers(["Filer ID", "Op Date"], ["Filer HawkID", "Operation Date", "Filer"])
    assert len({v for v in mapped.values() if v}) == len([v for v in mapped.values() if v])


def test_times(spark):
    cases = {
        "2022-01-01 11:00:00 PST": "2022-01-01 13:00:00", "2022-07-01 11:00:00": "2022-07-01 11:00:00",
        "20240101 101500.123": "2024-01-01 10:15:00", None: "1900-01-01 00:00:00", "nonsense": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", F.date_format(timeutil.central(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("c"))
    assert {r.t: r.c for r in df.collect()} == cases
    odd = spark.createDataFrame([("around 5 May 2020 10:30",), ("?",)], "t string").select(timeutil.fuzzy("t").alias("f"))
    assert [r.f for r in odd.collect()] == [datetime.datetime(2020, 5, 5, 10, 30), None]


def test_header_redaction_removes_every_class(spark):
    tags = {"00100010": ("PN", "Doe"), "50201000": ("US", "1"), "00091001": ("LO", "p"), "60003000": ("OW", "x"), "60023000": ("OW", "x"), "00200010": ("SH", "7"), "00080060": ("CS", "RF"), "60020010": ("US", "1")}
    df = spark.createDataFrame([({k: {"vr": a, "value": b} for k, (a, b) in tags.items()},)], "tags map<string,struct<vr:string,value:string>>")
    got = df.select(headers.redact(F.col("tags")).alias("t")).first().t
    assert set(got) == {"00100010", "00200010", "00080060", "60020010"}
    assert got["00100010"].value == got["00200010"].value == headers.REDACTED and got["00080060"].value == "RF"


def test_dicom_round_trip(spark):
    tags = {"00080060": ("CS", "RF"), "00100010": ("PN", "A^B")}
    raw = dicom.build(tags, 2, 3, bytes(range(6)))
    df = spark.createDataFrame([(raw,)], "content binary").select(dicom.decode(F.col("content")).alias("d")).first().d
    assert (df.rows, df.cols, bytes(df.pixels)) == (2, 3, bytes(range(6)))
    assert {k: (v.vr, v.value) for k, v in df.tags.items() if k in tags} == tags
    assert dicom.parse(b"short")[0] == {}


@given(st.integers(0, 2**31))
@settings(max_examples=10, deadline=None)
def test_image_hash_does_not_depend_on_the_pixel_kind(seed):
    pixels = np.random.default_rng(seed).integers(0, 120, (20, 30, 3))
    hashes = {images.fingerprint(pixels.astype(k)) for k in ("uint8", "int16", "uint32", "int64")}
    assert len(hashes) == 1


def test_images(spark):
    gray = np.random.default_rng(1).integers(0, 255, (40, 40)).astype(np.uint8)
    assert images.fingerprint(gray) == images.fingerprint(np.repeat(gray[:, :, None], 3, 2))
    assert images.similarity(gray, gray) == pytest.approx(1) and images.similarity(gray, np.zeros_like(gray)) == 0
    with pytest.raises(ValueError):
        images.fingerprint(gray.astype(float))
    assert np.array_equal(png.decode_png(png.encode_png(gray))[:, :, 0], gray)
    raw = spark.createDataFrame([(40, 40, 1, gray.tobytes())], "h int, w int, c int, d binary").select(images.image_hash("h", "w", "c", "d").alias("x")).first().x
    assert raw == images.fingerprint(gray)


def test_paths(spark):
    path = paths.build_path(project=F.lit("p"), subject=F.lit("s"), scan=F.lit("0"))
    assert spark.range(1).select(paths.parse_path(path).alias("m")).first().m == {"project": "p", "subject": "s", "scan": "0"}


def test_uids(spark):
    df = spark.range(3).select(new_uid(F.col("id").cast("string")).alias("u"))
    found = [r.u for r in df.select("u", is_valid_uid(F.col("u")).alias("ok")).collect() if r.ok]
    assert len(set(found)) == 3


def test_legacy_summary_hides_warnings(spark):
    df = spark.createDataFrame([(1,)], "row_id int")
    rules = [quality.Rule("a", ("x",), "E", F.lit(True)), quality.Rule("b", ("x",), "W", F.lit(True))]
    judged = quality.with_issues(df, rules)
    assert quality.summary_matrix(judged, ["x"]).first().x == "EW"
    assert quality.summary_matrix(judged, ["x"], legacy_summary=True).first().x == "E"
    with pytest.raises(ValueError):
        quality.rows_where(judged, "odd")


def test_registry_document_round_trip(spark, tmp_path):
    subject = spark.createDataFrame([("S", "2_25_1", "t", None, "2_25_2", None)], registry_schema(*REGISTRY_EXTRAS["SUBJECTS"]))
    registry_json.write_registries({"SUBJECTS": subject, "GROUPS": users(spark)}, str(tmp_path / "r"), "2_25_1", F.lit("now"))
    metadata, tables = registry_json.read_registries(spark, str(tmp_path / "r" / "*.txt"))
    assert tables["SUBJECTS"].collect() == subject.collect() and tables["GROUPS"].count() == 0 and tables["SURGEONS"].count() == 0
    assert metadata.first().TABLE_EXTRA_COLUMNS["SUBJECTS"] == ["ACQUISITION_SITE", "GROUP"]


def test_push_writes_a_backup_and_checks(spark, tmp_path):
    root, at = str(tmp_path), F.lit("2020-01-02 03:04:05").cast("timestamp")
    subjects = spark.createDataFrame([("S", "2_25_1", "t", None, "2_25_2", None)], registry_schema(*REGISTRY_EXTRAS["SUBJECTS"]))
    hashes = spark.createDataFrame([("H", "2_25_7", "t", None, "2_25_1", None)], registry_schema(*REGISTRY_EXTRAS["IMAGE_HASHES"]))
    assert publish.push_registries({"SUBJECTS": subjects, "IMAGE_HASHES": hashes}, root, "config", "2_25_1", at) is None
    read = lambda name: registry_json.read_registries(spark, f"{root}/{name}/*.txt")[1]
    more = subjects.withColumn("NAME", F.lit("T")).withColumn("UID", F.lit("2_25_9"))
    grown = read("config")["SUBJECTS"].unionByName(more)
    backup = publish.push_registries({"SUBJECTS": grown, "IMAGE_HASHES": hashes}, root, "config", "2_25_1", at)
    assert backup == "backups/config-backup-2020_01_02_03_04_05.json"
    assert read("config")["SUBJECTS"].count() == 2 and read(backup)["SUBJECTS"].count() == 1
    later = F.lit("2021-01-02 03:04:05").cast("timestamp")
    with pytest.raises(ValueError):
        publish.push_registries({"SUBJECTS": more, "IMAGE_HASHES": hashes}, root, "config", "2_25_1", later)
    assert read("config")["SUBJECTS"].count() == 2 and len(list((tmp_path / "backups").glob("config*"))) == 1


def test_catalog_takes_items_from_registered_users_only(spark):
    people = spark.createDataFrame([("ANN", "2_25_1", "t", None)], registry_schema())
    catalog = registry.Catalog({"registered_users": people, "groups": people.limit(0)})
    new = spark.createDataFrame([("knee", "2_25_5", 1), ("KNEE", "2_25_6", 2)], "NAME string, UID string, ordinal int")
    grown, outcome = catalog.add_items("Groups", new, "ann", "2_25_1", F.lit("now"))
    assert [tuple(r) for r in grown.get("GROUPS").collect()] == [("KNEE", "2_25_5", "now", "2_25_1")]
    assert sorted(r.reason for r in outcome.collect()) == ["ok", "repeated"]
    with pytest.raises(PermissionError):
        catalog.add_items("groups", new, "eve", "2_25_2", F.lit("now"))


def test_forms_with_a_known_name_become_copies(spark, tmp_path):
    out = str(tmp_path / "forms")
    forms = lambda *rows: spark.createDataFrame(rows, "name string, value string")
    publish.write_form(forms(("a.json", "1"), ("01", "2"), ("b.x.json", "3"), ("b.x.json", "4")), out)
    publish.write_form(forms(("a.json", "5"), ("01", "6")), out)
    got = {tuple(r) for r in spark.read.schema("value string, name string").text(out).select("name", "value").collect()}
    assert got == {("a.json", "1"), ("01", "2"), ("b.x.json", "3"), ("b.x-copy.json", "4"), ("a-copy.json", "5"), ("01-copy", "6")}


def workbook(path, rows):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    shared, cells = [], []
    for y, row in enumerate(rows, 1):
        out = []
        for x, value in enumerate(row):
            if value != "":
                shared.append(value)
                out.append(f'<c r="{chr(65 + x)}{y}" t="s"><v>{len(shared) - 1}</v></c>')
        cells.append(f'<row r="{y}">{"".join(out)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_case_sheet_source(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Filer\nHawkID", "Quality"], ["u1", ""], ["", "Usable"]])
    spark.dataSource.register(case_sheet.CaseSheetSource)
    df = spark.read.format("case_sheet").load(str(tmp_path / "a.xlsx"))
    assert df.columns == ["Filer HawkID", "Quality"] and sorted(map(tuple, df.collect())) == [("", "Usable"), ("u1", "")]
    required = [c for c, need in SHEET_COLUMNS.items() if need == "required"]
    assert len(required) == 9 and text.missing_columns(df.columns, ["Filer HawkID", "Operation Date"]) == ["Operation Date"]


def test_listings(spark, tmp_path):
    for name, body in {"a.dcm": b"1", "b.DCM": b"2", "c": b"3", "d.jpg": b"4", "e.JPEG": b"5", "sub/f.mp4": b"\0\0\0\x18ftypisom", "g.mp4": b"junkjunk"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    base = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert base(listings.dicom_files(spark, str(tmp_path))) == ["a.dcm", "b.DCM", "c"]
    assert [r.type for r in listings.media_files(spark, str(tmp_path)).collect()] == ["JPG", "JPG", "MP4", "MP4"]
    assert sorted(r.is_valid for r in listings.playable_videos(spark, str(tmp_path)).collect()) == [False, True]
    assert "content" not in listings.media_files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_commit_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    with publish.Commit(spark, root) as c:
        c.stage("a", spark.range(2))
    with pytest.raises(RuntimeError):
        with publish.Commit(spark, root) as c:
            c.stage("a", spark.range(5))
            raise RuntimeError("later step failed")
    assert spark.read.parquet(f"{root}/a").count() == 2
    with publish.Commit(spark, root) as c:
        c.stage("a", spark.range(7))
        c.stage("b", spark.range(1).withColumn("subject", F.lit("s")), ("subject",))
    assert spark.read.parquet(f"{root}/a").count() == 7 and (tmp_path / "b" / "subject=s").exists()
    assert not list((tmp_path / "_staging").glob("*"))


def test_zip_payloads_are_reproducible(spark):
    df = spark.createDataFrame([(["b", "a"], [b"2", b"1"])], "n array<string>, c array<binary>").select(publish.zipped("n", "c").alias("z"))
    first, second = bytes(df.first().z), bytes(df.first().z)
    assert first == second and zipfile.ZipFile(io.BytesIO(first)).namelist() == ["a", "b"]


def test_intake_form_reads_both_blocks(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"OPERATION_DATE": "2024-01-01",\n "STORAGE_DEVICE_INFO": {"RELEVANT_FOLDER": "/x"}}')
    row = spark.read.schema(INTAKE_FORM).json(str(tmp_path / "f.json"), multiLine=True).first()
    assert row.STORAGE_DEVICE_INFO.RELEVANT_FOLDER == "/x" and row.SKILLS_ASSESSMENT_INFO is None
    forms = spark.createDataFrame([("case1", "{}")], "name string, value string")
    publish.write_form(forms, str(tmp_path / "out"))
    assert (tmp_path / "out" / "name=case1").exists()


def test_seen_hash_stream(spark, tmp_path):
    from casewright.streaming.seen_hashes import seen_hash_stream

    landing, reg = tmp_path / "in", str(tmp_path / "registry")
    schema = "digest string, path string"
    for i, rows in enumerate(([("a", "1"), ("a", "2"), ("b", "3")], [("b", "4"), ("c", "5")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(landing))
        seen_hash_stream(spark, str(landing), spark.createDataFrame([], schema).schema, reg, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(reg).count() == (2, 3)[i]


def test_user_registration(spark):
    people, librarians = users(spark, "ann", "lib"), users(spark, "lib")
    after = registry.register_user(people, librarians, "lib", "new", "2_25_9", F.lit("now"))
    assert registry.register_user(after, librarians, "lib", "NEW", "2_25_8", F.lit("now")).count() == 3
    with pytest.raises(PermissionError):
        registry.register_user(people, librarians, "ann", "x", "2_25_7", F.lit("now"))


def test_crowd_results(spark, tmp_path):
    import base64

    from casewright.sources import crowd

    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    row = {c: "" for c in crowd.COLUMNS} | {"HITId": "h1", "WorkerId": "w", "AcceptTime": "Tue Jul 05 10:00:00 PDT 2022", "SubmitTime": "Tue Jan 04 10:00:00 PST 2022", "Input.image_url": "s3://x/y.png"}
    row["Answer.task.labeledImage.pngImageData"] = base64.b64encode(png.encode_png(image)).decode()
    path = tmp_path / "Batch_77_batch_results.csv"
    path.write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    found = crowd.read_results(spark, str(path)).withColumn("pixels", png.label_image(F.col("image_base64"), 4)).first()
    assert found.batch == "77" and bytes(found.pixels) == image.tobytes() and found.Input_image_url == "s3://x/y.png"
    assert (found.AcceptTime.hour, found.SubmitTime.hour) == (17, 18)
    path.write_text("HITId\nx\n")
    with pytest.raises(ValueError, match="missing columns"):
        crowd.read_results(spark, str(path))


def test_logs_summaries_and_pairs(spark, tmp_path):
    publish.log_failure(publish.failure_row(spark, "s", "zip", "disk full", F.lit("now")), str(tmp_path / "log"))
    publish.log_failure(publish.failure_row(spark, "t", "zip", "disk full", F.lit("now")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    publish.write_summary(spark.createDataFrame([("b",), ("a",)], "line string"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["a", "b"]
    text.register_task_pairs(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM task_pairs('{S1: cut; s2: \"sew\"}')").collect()] == [("s1", "cut"), ("s2", "sew")]


def test_suggestions_equal_the_library(spark):
    import difflib

    from pyspark.sql import functions as F

    from casewright.operators import quality as Q

    known = ["SURGEON_ONE", "SURGEON_TWO", "OTHER"]
    rows = [(0, ["surgeon_on", "zzz"]), (1, ["othr"]), (2, None), (3, [])]
    issues = spark.createDataFrame(rows, "row_id int, values array<string>").withColumn("message", F.lit("unknown"))
    got = {(r.row_id, r.value): (r.suggestion, r.message) for r in Q.with_suggestions(issues, known).collect()}
    assert set(got) == {(0, "surgeon_on"), (0, "zzz"), (1, "othr")}
    for (_, v), (s, m) in got.items():
        want = next(iter(difflib.get_close_matches(v.upper(), known, 1, 0.6)), None)
        assert s == want and m == ("unknown" if want is None else f"unknown; did you mean {want}?")
