"""Queries over files that Spark writes from the tables: headers with nested sequences, published zips, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import timeutil
from casewright.functions.text import ENCODED, normalise_headers
from casewright.functions.uids import derived_uid
from casewright.operators import headers as H
from casewright.operators import known_ids, templates
from casewright.operators import labels as L
from casewright.operators import publish as P
from casewright.operators.digest import grouped_digests, ordered_digest
from casewright.plans._register import Plans
from casewright.session import kept_in, scratch
from casewright.schemas import INTAKE_FORM
from casewright.sources import crowd, dicom, listings, registry_json
from casewright.sources.case_sheet import CaseSheetSource, write_sheets
from casewright.sources.file_sink import write_each, write_files
from casewright.sources.png import label_image, png_bytes
from casewright.sources.tables import table
from casewright.streaming.new_hashes import new_hash_stream

plans = Plans()


def _tags(supplier: DataFrame):
    """A header of three levels: persons, an identifier, a private and a curve element inside sequences."""
    key, item, deep = F.col("s_suppkey").cast("string"), "00081115", "00081115[0].00081199"
    entries = {
        "00080050": ("SH", key),
        "00080060": ("CS", F.lit("RF")),
        "00080080": ("LO", F.col("n_name")),
        "00091001": ("LO", F.lit("private")),
        "00100010": ("PN", F.col("s_name")),
        f"{item}[0].0020000E": ("UI", F.concat(F.lit("1.2."), key)),
        f"{deep}[0].0040A123": ("PN", F.col("n_name")),
        f"{deep}[0].00080060": ("CS", F.lit("US")),
        f"{deep}[1].0040A123": ("PN", F.col("r_name")),
        f"{deep}[1].50001000": ("LO", F.lit("curve")),
        f"{item}[1].00091001": ("LO", key),
    }
    pairs = (x for path, (kind, value) in entries.items() for x in (F.lit(path), F.struct(F.lit(kind).alias("vr"), value.alias("value"))))
    return F.create_map(*pairs)


def header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header file per supplier, in turn explicit and implicit, with defined and undefined lengths."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    content = dicom.encode(_tags(s), F.lit(1), F.lit(2), F.lit(b"\1\2"), F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0)
    return s.select("s_suppkey", content.alias("content"))


@plans.add("""
SELECT s_suppkey, TRUE AS intact, n_name AS site, '00020010=UI:1.2.840.10008.1.2|' AS form,
  '00080050=SH:REDACTED PYTHON VALUE|00080060=CS:RF|00080080=LO:' || n_name || '|00081115=SQ:2|00081115[0].00081199=SQ:2|00081115[0].00081199[0].00080060=CS:US'
  || '|00081115[0].00081199[0].0040A123=PN:REDACTED PYTHON VALUE|00081115[0].00081199[1].0040A123=PN:REDACTED PYTHON VALUE|00081115[0].0020000E=UI:1.2.' || s_suppkey
  || '|00100010=PN:REDACTED PYTHON VALUE|00280010=US:1|00280011=US:2' AS header, '1_2_' || s_suppkey AS series_uid, 2 AS n_pixels
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 2 <> 0
UNION ALL
SELECT s_suppkey, TRUE, n_name, '',
  '00080050=SH:REDACTED PYTHON VALUE|00080060=CS:RF|00080080=LO:' || n_name || '|00081115=SQ:2|00081115[0].00081199=SQ:2|00081115[0].00081199[0].00080060=CS:US'
  || '|00081115[0].00081199[0].0040A123=PN:REDACTED PYTHON VALUE|00081115[0].00081199[1].0040A123=PN:REDACTED PYTHON VALUE|00081115[0].0020000E=UI:1.2.' || s_suppkey
  || '|00100010=PN:REDACTED PYTHON VALUE|00280010=US:1|00280011=US:2', '1_2_' || s_suppkey, 2
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 2 = 0
""")
def header_files(spark, sf_dir):
    """Files written, listed, read, redacted at every depth, written again and read back."""
    folder = scratch(spark, "headers")
    files = header_bytes(spark, sf_dir)
    write_files(files.select(F.lit(None).cast("string").alias("archive"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".dcm")).alias("name"), "content"), folder)
    read = listings.dicom_files(spark, folder, content=True).select("path", "content", dicom.decode(F.col("content")).alias("h"))
    own = F.element_at("h.tags", F.lit("00080080"))["value"]
    done = read.select(
        F.regexp_extract("path", r"(\d+)\.dcm$", 1).cast("bigint").alias("s_suppkey"),
        (dicom.rewrite(F.col("content"), F.col("h.tags")) == F.col("content")).alias("intact"),
        own.alias("site"),
        dicom.decode(dicom.rewrite(F.col("content"), H.redact(F.col("h.tags")))).alias("r"),
    )
    entries = F.array_sort(F.transform(F.map_entries("r.tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["vr"], F.lit(":"), F.coalesce(e["value"]["value"], F.lit("")))))
    form = F.array_join(F.transform(F.filter(entries, lambda e: e.startswith("0002")), lambda e: F.concat(e, F.lit("|"))), "")
    return done.select(
        "s_suppkey", "intact", "site", form.alias("form"), F.array_join(F.filter(entries, lambda e: ~e.startswith("0002")), "|").alias("header"),
        F.element_at(H.uid_values(F.col("r.tags")), F.lit("00081115[0].0020000E")).alias("series_uid"), F.octet_length("r.pixels").alias("n_pixels"),
    )


@plans.add("""
WITH f AS (
  SELECT source AS subject, CASE WHEN doc_id % 3 = 0 THEN 'mp4' ELSE 'dicom' END AS media, 'f' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name,
    sha256(text) AS digest, doc_id, octet_length(encode(text)) AS size
  FROM documents WHERE n_chars > 300),
h AS (SELECT min_by(subject, (subject, doc_id)) AS subject FROM f WHERE media = 'dicom' GROUP BY digest),
n AS (SELECT subject, count(*) AS n_hashes FROM h GROUP BY subject)
SELECT f.subject, '/project/demo/subject/' || f.subject || '/experiment/SOURCE_DATA-' || f.subject || '/scan/0/resource/SRC/' || f.subject || '-' || media || '.zip' AS archive,
  count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, sha256(string_agg(name || ':' || digest, chr(10) ORDER BY name)) AS members, coalesce(any_value(n_hashes), 0) AS n_hashes, 1 AS n_subjects
FROM f LEFT JOIN n ON n.subject = f.subject GROUP BY f.subject, media
""")
def publish_catalog(spark, sf_dir):
    """Sessions published as zips with their registry rows, then read back from the archive."""
    root = scratch(spark, "archive")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.col("text").cast("binary").alias("content"))
    files = d.select(
        F.col("source").alias("subject"), F.lit("ESV").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "MP4").otherwise("DICOM").alias("media"),
        F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("new_name"), F.sha2("content", 256).alias("digest"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("instance_num"), (F.col("n_chars") > 300).alias("is_valid"),
        F.lit("site").alias("site"), F.lit("group").alias("group"), "content",
    )
    P.publish_sessions(files, root, "demo", "2_25_1", F.lit("2024-01-01"))
    keep = kept_in(scratch(spark, "members"))  # digests are made once
    members = keep(P.published_members(spark, root).withColumn("archive", F.regexp_extract("path", r"/files(/project/.*)$", 1)), "members")
    digests = grouped_digests(members, "archive", F.concat("name", F.lit(":"), "digest"), "position", separator="\n").select("archive", F.col("digest").alias("members"))
    sums = members.groupBy("archive").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes")).join(digests, "archive")
    read = sums.select(F.regexp_extract("archive", "/subject/([^/]*)/", 1).alias("subject"), "archive", "n_files", "n_bytes", "members")
    hashes = P.published(spark, root, "IMAGE_HASHES", P.HASHES_ROW).groupBy(F.col("SUBJECT").alias("subject")).agg(F.count("*").alias("n"))
    subjects = P.published(spark, root, "SUBJECTS", P.SUBJECTS_ROW).groupBy(F.col("NAME").alias("subject")).agg(F.count("*").cast("int").alias("n_subjects"))
    return read.join(hashes, "subject", "left").join(subjects, "subject", "left").select("subject", "archive", "n_files", "n_bytes", "members", F.coalesce("n", F.lit(0)).alias("n_hashes"), "n_subjects")


# --- images --------------------------------------------------------------------------------------------

_SIDE, _SIMILAR = 8, 0.25


def _pixels(embedding):
    """64 numbers as the pixels of an image of 8 x 8."""
    return F.transform(embedding, lambda x: F.floor((F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1) * 127.5).cast("int"))


@plans.add(f"""
WITH p AS (SELECT vec_id, [CAST(floor((greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) + 1) * 127.5) AS INTEGER) FOR x IN embedding] AS a FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT vec_id, CASE WHEN list_max(a) = list_min(a) THEN [0.0::DOUBLE FOR x IN a] ELSE [floor((x - list_min(a)) * 255.0::DOUBLE / (list_max(a) - list_min(a))) FOR x IN a] END AS a,
  CASE WHEN vec_id % 10 = 9 THEN FALSE ELSE TRUE END AS readable FROM p),
t AS (SELECT a AS b FROM s WHERE vec_id = 0),
c AS (SELECT s.vec_id, readable, a, b, list_avg(a) AS ma, list_avg(b) AS mb FROM s, t),
n AS (SELECT vec_id, readable, list_sum([(a[i] - ma) * (b[i] - mb) FOR i IN range(1, 65)]) / sqrt(list_sum([(x - ma) * (x - ma) FOR x IN a]) * list_sum([(x - mb) * (x - mb) FOR x IN b])) AS ncc FROM c)
SELECT vec_id, readable, CASE WHEN readable THEN round(ncc, 4) + 0.0 END AS similarity, readable AND ncc > {_SIMILAR} AS is_template, readable AND vec_id % 7 = 3 AS seen,
  readable AND NOT ncc > {_SIMILAR} AND vec_id % 7 <> 3 AS is_valid FROM n
""")
def template_images(spark, sf_dir):
    """Images written as files, read by the image source, fingerprinted and held against a template and the registry."""
    folder, place = scratch(spark, "images"), scratch(spark, "template")
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == _SIDE * _SIDE).select("vec_id", png_bytes(_pixels(F.col("embedding")), F.lit(_SIDE), F.lit(_SIDE)).alias("content"))
    broken = F.when(F.col("vec_id") % 10 == 9, F.lit(b"no image")).otherwise(F.col("content"))
    none = F.lit(None).cast("string").alias("archive")
    write_files(e.select(none, F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("name"), broken.alias("content")), folder)
    write_files(e.where("vec_id = 0").select(none, F.lit("template.png").alias("name"), "content"), place)
    template = templates.read_template(spark, f"{place}/template.png", _SIDE)
    number = F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("bigint")
    found = listings.images(spark, folder).drop("is_valid")
    measured = kept_in(scratch(spark, "measured"))(templates.measured_images(found, template), "images")  # images are read once
    known = measured.where((number % 7 == 3) & (F.col("height") > 0)).select(F.col("digest").alias("NAME"))
    judged = templates.judged(measured, known, _SIMILAR)
    return judged.select(number.alias("vec_id"), (F.col("height") > 0).alias("readable"), (F.round("similarity", 4) + F.lit(0.0)).alias("similarity"), "is_template", "seen", "is_valid")


@plans.add("""
SELECT vec_id, '1.2.840.10008.5.1.4.1.1.77.1.1.1' AS class, '2.25.' || vec_id AS series, 'Arthro. Diagn. Img. #' || (vec_id % 100) AS description, 'ORIGINAL' || chr(92) || 'PRIMARY' || chr(92) || 'ARTHRO_DIAGN_IMG' AS kind,
  'REDACTED PYTHON VALUE' AS person, '/in/' || vec_id || '.jpg' AS path, 'site ' || label AS site, '8 x 8' AS size,
  sha256(array_to_string([chr(65 + CAST(floor((greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) + 1) * 127.5) AS INTEGER) % 26) FOR x IN embedding], '')) AS pixels
FROM embeddings WHERE len(embedding) = 64 AND label IS NOT NULL
""")
def still_headers(spark, sf_dir):
    """A header for every still image, written and read back in the implicit form."""
    letters = lambda x: F.chr((65 + x % 26).cast("bigint"))
    e = table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & F.col("label").isNotNull())
    key, text = F.col("vec_id").cast("string"), F.lit
    tags = H.still_header(
        F.concat(text("2_25_"), key), text("2_25_7"), F.concat(text("2_25_9"), key), F.col("vec_id") % 100, text("20240305"), text("101112.000"), F.concat(text("site "), F.col("label").cast("string")),
        F.concat(text("/in/"), key, text(".jpg")), text("20250101"), text("000000.000"),
    )
    pixels = F.array_join(F.transform(_pixels(F.col("embedding")), letters), "").cast("binary")
    h = e.select("vec_id", dicom.decode(dicom.encode(tags, F.lit(8), F.lit(8), pixels, F.lit(False))).alias("h"))
    at = lambda tag: F.element_at("h.tags", F.lit(tag))["value"]
    return h.select(
        "vec_id", at("00020002").alias("class"), at("0020000E").alias("series"), at("0008103E").alias("description"), at("00080008").alias("kind"), at("00100010").alias("person"), at("00204000").alias("path"),
        at("00080080").alias("site"), F.concat(F.col("h.rows").cast("string"), F.lit(" x "), F.col("h.cols").cast("string")).alias("size"), F.sha2("h.pixels", 256).alias("pixels"),
    )


# --- sheets, listings, forms -------------------------------------------------------------------------


@plans.add("""
SELECT n_name AS sheet, c_name AS "Filer HawkID", coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS "Institution Name", CAST(c_custkey AS VARCHAR) || ' <&> ' AS "Diagnostic Notes"
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def sheet_scan(spark, sf_dir):
    """Workbooks written, one for each nation, and scanned by the sheet source."""
    folder = scratch(spark, "sheets")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = c.select(
        F.concat("n_name", F.lit(".xlsx")).alias("book"), F.col("c_custkey").alias("line"), F.col("n_name").alias("sheet"), F.col("c_name").alias("Filer\nHawkID"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("Institution Name"), F.concat(F.col("c_custkey").cast("string"), F.lit(" <&> ")).alias("Diagnostic Notes"), F.lit("").alias("Unnamed: 3"),
    )
    write_sheets(rows, "book", "line", folder)
    spark.dataSource.register(CaseSheetSource)
    books = [r.name for r in rows.select(F.regexp_replace("book", " ", " ").alias("name")).distinct().orderBy("name").collect()]  # a list of nations
    return normalise_headers(spark.read.format("case_sheet").load(",".join(f"{folder}/{b}" for b in books)))


@plans.add("""
WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.dcm' WHEN 1 THEN '.DCM' WHEN 2 THEN '' WHEN 3 THEN '.jpg' WHEN 4 THEN '.JPEG' ELSE '.mp4' END AS ext FROM documents)
SELECT doc_id, CASE WHEN ext IN ('.jpg', '.JPEG') THEN 'JPG' WHEN ext = '.mp4' THEN 'MP4' ELSE 'DICOM' END AS type, CASE WHEN ext = '.mp4' THEN doc_id % 12 = 5 END AS playable FROM f
""")
def file_listing(spark, sf_dir):
    """Files of every kind written into folders, then listed by kind; videos by their first bytes."""
    folder = scratch(spark, "listing")
    k = F.col("doc_id") % 6
    ext = F.when(k == 0, ".dcm").when(k == 1, ".DCM").when(k == 2, "").when(k == 3, ".jpg").when(k == 4, ".JPEG").otherwise(".mp4")
    head = F.when(F.col("doc_id") % 12 == 5, F.concat(F.lit(b"\0\0\0\x18ftypisom"), F.col("text").cast("binary"))).otherwise(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), ext).alias("name"), head.alias("content"))
    write_each(d, folder)
    number = F.regexp_extract("path", r"/f(\d+)(\.\w+)?$", 1).cast("bigint").alias("doc_id")
    dicoms = listings.dicom_files(spark, folder).select(number, F.lit("DICOM").alias("type"), F.lit(None).cast("boolean").alias("playable"))
    keep = kept_in(scratch(spark, "media"))  # listed once
    media = listings.at_least_one(keep(listings.media_files(spark, folder), "files"), "MP4").select(number, "type")
    videos = listings.playable_videos(spark, folder).select(number, F.col("is_valid").alias("playable"))
    return dicoms.unionByName(media.join(videos, "doc_id", "left"))


@plans.add("""
SELECT CAST(conv_id AS VARCHAR) || '.json' AS form, min_by(role, turn) AS quality, 'site ' || (conv_id % 3) AS site, CAST(NULL AS VARCHAR) AS title, sha256(min_by(text, turn)) AS notes FROM conversations GROUP BY conv_id
""")
def intake_forms(spark, sf_dir):
    """Forms written as one file each, in the key order of their schema, and scanned with required and optional blocks."""
    folder = scratch(spark, "forms")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), "turn").alias("first"))
    inner = F.struct(F.concat(F.lit("site "), (F.col("conv_id") % 3).cast("string")).alias("INSTITUTION_NAME"), F.col("first.text").alias("DIAGNOSTIC_NOTES"))
    form = F.to_json(F.struct(F.lit("2024-01-01").alias("OPERATION_DATE"), F.col("first.role").alias("SCAN_QUALITY"), inner.alias("SURGICAL_PROCEDURE_INFO")))
    P.write_forms(c.select(F.concat(F.col("conv_id").cast("string"), F.lit(".json")).alias("name"), form.alias("value")), folder)
    read = spark.read.schema(INTAKE_FORM).json(folder, multiLine=True).withColumn("path", F.col("_metadata.file_name"))
    return read.select(
        F.col("path").alias("form"), F.col("SCAN_QUALITY").alias("quality"), F.col("SURGICAL_PROCEDURE_INFO.INSTITUTION_NAME").alias("site"),
        F.col("SKILLS_ASSESSMENT_INFO.ASSESSMENT_TITLE").alias("title"), F.sha2(F.col("SURGICAL_PROCEDURE_INFO.DIAGNOSTIC_NOTES").cast("binary"), 256).alias("notes"),
    )


@plans.add("""
SELECT CAST(vec_id AS VARCHAR) AS hit, '7' AS batch, TIMESTAMP '2022-07-05 17:00:00' + to_seconds(vec_id % 60) AS accepted, 's3://x/' || vec_id || '.png' AS url,
  sha256(array_to_string([repeat(lpad(to_hex(CAST(floor((greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) + 1) * 127.5) AS BIGINT)), 2, '0'), 3) FOR x IN embedding], '')) AS pixels
FROM embeddings WHERE len(embedding) = 64
""")
def crowd_results(spark, sf_dir):
    """Result sheets of crowd labels with their images, written as CSV and scanned."""
    folder = f"{scratch(spark, 'crowd')}/Batch_7_batch_results.csv"
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    second = F.lpad((F.col("vec_id") % 60).cast("string"), 2, "0")
    own = {
        "HITId": F.col("vec_id").cast("string"), "AcceptTime": F.concat(F.lit("Tue Jul 05 10:00:"), second, F.lit(" PDT 2022")),
        "Input.image_url": F.concat(F.lit("s3://x/"), F.col("vec_id").cast("string"), F.lit(".png")),
    }
    image = F.base64(png_bytes(_pixels(F.col("embedding")), F.lit(_SIDE), F.lit(_SIDE)))
    sheet = e.select(*(own.get(c, F.lit("x")).alias(c) for c in crowd.COLUMNS), F.regexp_replace(image, r"\s", "").alias("Answer.task.labeledImage.pngImageData"))
    sheet.write.option("header", "true").csv(folder)
    found = crowd.read_results(spark, folder)
    raw = F.hex(label_image(F.col("image_base64"), _SIDE))  # gray pixels become three equal channels
    return found.select(F.col("HITId").alias("hit"), "batch", F.col("AcceptTime").cast("timestamp_ntz").alias("accepted"), F.col("Input_image_url").alias("url"), F.sha2(raw.cast("binary"), 256).alias("pixels"))


@plans.add("""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
g AS (SELECT conv_id, count(*) AS n_items, string_agg(role || ' ' || turn, '|' ORDER BY turn, role, text) AS notes, string_agg(sha256(text), '' ORDER BY turn, role, text) AS pixels FROM c GROUP BY conv_id)
SELECT conv_id, '2.25.' || conv_id AS uid, CAST(conv_id AS VARCHAR) AS hit, 'SR' AS modality, '20220705 101112' AS at, n_items, notes, n_items || ' x 32' AS size, pixels FROM g
""")
def label_files(spark, sf_dir):
    """A report file per group of labels, written with its items and stacked images, listed and read back."""
    folder = scratch(spark, "labels")
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("o"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    notes = F.transform("o", lambda r: F.concat_ws(" ", r["role"], r["turn"].cast("string")))
    pixels = F.unhex(F.array_join(F.transform("o", lambda r: F.sha2(r["text"].cast("binary"), 256)), ""))
    key = F.col("conv_id").cast("string")
    header = L.report_header(F.concat(F.lit("2_25_"), key), key, F.lit("2022-07-05 10:11:12").cast("timestamp_ntz"), notes)
    content = dicom.encode(header, F.size("o"), F.lit(32), pixels)
    write_files(rows.select(F.lit(None).cast("string").alias("archive"), F.concat(F.lit("hits/"), key).alias("name"), content.alias("content")), folder)
    h = listings.dicom_files(spark, folder, content=True).select(F.regexp_extract("path", r"/hits/(\d+)$", 1).cast("bigint").alias("conv_id"), dicom.decode(F.col("content")).alias("h"))
    at = lambda tag: F.element_at("h.tags", F.lit(tag))["value"]
    n = at("0040A730").cast("int")
    texts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(F.col("h.tags"), F.concat(F.lit("0040A730["), i.cast("string"), F.lit("].0040A160")))["value"])
    return h.select(
        "conv_id", at("00080018").alias("uid"), at("00080050").alias("hit"), at("00080060").alias("modality"), F.concat_ws(" ", at("00080023"), at("00080033")).alias("at"), n.cast("bigint").alias("n_items"),
        F.array_join(texts, "|").alias("notes"), F.concat_ws(" x ", F.col("h.rows").cast("string"), F.col("h.cols").cast("string")).alias("size"), F.lower(F.hex("h.pixels")).alias("pixels"),
    )


# --- text --------------------------------------------------------------------------------------------

#: One date in many spellings, in SQL that both engines read.
SPELT = """
SELECT o_orderkey, d, h, mi, o_orderkey % 9 AS form, CASE o_orderkey % 9
  WHEN 0 THEN concat(mon, ' ', dd, ', ', y, ' ', h12, ':', lpad(CAST(mi AS STRING), 2, '0'), ' ', half)
  WHEN 1 THEN concat(dd, ' ', mon, ' ', y, ' at ', hh, ':', lpad(CAST(mi AS STRING), 2, '0'))
  WHEN 2 THEN concat(m, '/', dd, '/', y, ' ', hh, ':', lpad(CAST(mi AS STRING), 2, '0'))
  WHEN 3 THEN concat(hh, ':', lpad(CAST(mi AS STRING), 2, '0'), ' PST ', mon, '. ', dd, ' ', y)
  WHEN 4 THEN concat(y, '/', m, '/', dd, ' ', hh, ':', lpad(CAST(mi AS STRING), 2, '0'), ':00.5')
  WHEN 5 THEN concat('the ', dd, 'th of ', mon, ' ', y)
  WHEN 6 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(dd, 2, '0'), 'T', hh, ':', lpad(CAST(mi AS STRING), 2, '0'), ':00-07:00 ')
  WHEN 7 THEN concat(mon, ' ', y)
  ELSE concat(mon, ' ', dd, ' ', substr(y, 3, 2), ', ', h12, half) END AS spelt
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 10 + o_orderkey % 8 AS h, o_orderkey % 60 AS mi, CAST(year(o_orderdate) AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m, CAST(day(o_orderdate) AS STRING) AS dd,
  CAST(10 + o_orderkey % 8 AS STRING) AS hh, CASE WHEN o_orderkey % 8 < 3 THEN CAST(10 + o_orderkey % 8 AS STRING) ELSE CAST(o_orderkey % 8 - 2 AS STRING) END AS h12,
  CASE WHEN o_orderkey % 8 < 2 THEN 'am' ELSE 'PM' END AS half,
  substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INTEGER), 3) AS mon FROM orders) o
"""


@plans.add(f"""
SELECT o_orderkey, spelt, strftime(CASE form WHEN 3 THEN d + to_hours(h + 2) + to_minutes(mi) WHEN 4 THEN d + to_hours(h) + to_minutes(mi) + to_milliseconds(500) WHEN 5 THEN CAST(d AS TIMESTAMP)
  WHEN 6 THEN ((d + to_hours(h + 7) + to_minutes(mi)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' WHEN 7 THEN NULL WHEN 8 THEN d + to_hours(h) ELSE d + to_hours(h) + to_minutes(mi) END, '%Y-%m-%d %H:%M:%S.%g') AS central
FROM ({SPELT.replace("STRING", "VARCHAR")}) s
""")
def spelt_dates(spark, sf_dir):
    """Dates in nine spellings, a zone and an offset among them, as Central wall clock."""
    given = spark.sql(SPELT.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return given.select("o_orderkey", "spelt", F.date_format(timeutil.central(F.col("spelt")), "yyyy-MM-dd HH:mm:ss.SSS").alias("central"))


@plans.add("""
WITH i AS (SELECT c_custkey, lower(c_name) AS id FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderkey, 'case of ' || coalesce('HAWKID=2_' || i.c_custkey, lower(c.c_name)) || ', then supplier#' || (o_orderkey % 7) AS encoded, CASE WHEN i.id IS NULL THEN 0 ELSE 1 END AS n_found
FROM orders JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN i ON i.c_custkey = o_custkey
""")
def registry_encode_text(spark, sf_dir):
    """Known names in free text become their uids, by an n-gram join with a registry that grows with the data."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("id"))
    told = F.concat(F.lit("case of "), F.col("id"), F.lit(", then supplier#"), (F.col("o_orderkey") % 7).cast("string"))
    texts = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("row_key"), told.alias("text"))
    ids = c.where("c_custkey % 3 <> 0").select("id", F.concat(F.lit("2_"), F.col("c_custkey").cast("string")).alias("uid"), F.col("c_custkey").alias("place"))
    done = known_ids.encode_known(texts, ids, ENCODED, keep=kept_in(scratch(spark, "known-ids")))
    return done.select(F.col("row_key").alias("o_orderkey"), "encoded", F.size("found").alias("n_found"))


# --- registries ----------------------------------------------------------------------------------------


@plans.add("""
SELECT 'SUBJECTS' AS name, count(*) AS n, sha256(string_agg(upper(c_name) || ':' || c_mktsegment, '|' ORDER BY upper(c_name))) AS digest FROM customer
UNION ALL SELECT 'IMAGE_HASHES', count(*), sha256(string_agg(sha256(CAST(o_orderkey AS VARCHAR)) || ':' || o_custkey, '|' ORDER BY sha256(CAST(o_orderkey AS VARCHAR)))) FROM orders
UNION ALL SELECT 'GROUPS', 0, sha256('')
""")
def registry_document(spark, sf_dir):
    """The registry document written in sorted parts as one file, and read back table by table."""
    stamp = [F.lit("2024-01-01").alias("CREATED_DATE_TIME"), F.lit("2_25_1").alias("CREATED_BY")]
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    subjects = c.select(F.upper("c_name").alias("NAME"), F.col("c_custkey").cast("string").alias("UID"), *stamp, F.col("c_mktsegment").alias("ACQUISITION_SITE"), F.lit(None).cast("string").alias("GROUP"))
    digest = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    hashes = o.select(digest.alias("NAME"), derived_uid(F.col("o_orderkey").cast("string")).alias("UID"), *stamp, F.col("o_custkey").cast("string").alias("SUBJECT"), F.lit("1").alias("INSTANCE_NUM"))
    path = f"{scratch(spark, 'registry')}/config.json"
    groups = subjects.select("NAME", "UID", "CREATED_DATE_TIME", "CREATED_BY").limit(0)
    registry_json.write_document({"SUBJECTS": subjects, "GROUPS": groups, "IMAGE_HASHES": hashes}, path, "2_25_1", F.lit("2024-01-02"))
    _, tables = registry_json.read_registries(spark, path)

    digests = scratch(spark, "digests")

    def row(name: str, value: str) -> DataFrame:
        line = F.concat_ws(":", "NAME", value)
        return ordered_digest(tables[name], line, "NAME", separator="|", folder=f"{digests}/{name}").select(F.lit(name).alias("name"), "n", "digest")

    return row("SUBJECTS", "ACQUISITION_SITE").unionByName(row("IMAGE_HASHES", "SUBJECT")).unionByName(row("GROUPS", "UID"))


@plans.add("""
WITH k AS (SELECT DISTINCT 'h' || p_size AS digest FROM part WHERE p_size % 5 = 0),
e AS (SELECT 'h' || (event_id % 1000) AS digest, lpad(CAST(event_id AS VARCHAR), 12, '0') AS path FROM events)
SELECT digest, min(path) AS path FROM e WHERE digest NOT IN (SELECT digest FROM k) GROUP BY digest
""")
def stream_new_hashes(spark, sf_dir):
    """A stream of hashes against a registry's, by keyed state."""
    folder = scratch(spark, "stream")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), (F.col("event_id") % 1000).cast("string")).alias("digest"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"))
    e.write.parquet(f"{folder}/in")
    table(spark, sf_dir, "part").where("p_size % 5 = 0").select(F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("NAME")).write.parquet(f"{folder}/registry")
    new_hash_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", f"{folder}/registry").awaitTermination()
    return spark.read.schema("digest string, path string").parquet(f"{folder}/out")


QUERIES, ORACLES = plans.queries, plans.oracles
