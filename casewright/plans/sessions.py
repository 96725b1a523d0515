"""Session queries: documents and lineitems stand in for image files."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import headers as H
from casewright.operators import labels as L
from casewright.operators import publish as P
from casewright.operators import sessions as S
from casewright.operators.search import flag_counts
from casewright.plans._register import Plans
from casewright.sources.tables import table

plans = Plans()


def files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.sha2("text", 256).alias("hash_str"), (F.col("n_chars") > 300).alias("is_valid"))


@plans.add("""
WITH f AS (SELECT doc_id, source, sha256(text) AS h, n_chars > 300 AS v FROM documents)
SELECT doc_id, CASE WHEN v THEN row_number() OVER (PARTITION BY source, h, v ORDER BY doc_id) > 1 END AS is_questionable FROM f
""")
def hash_dup_flag(spark, sf_dir):
    return S.flag_duplicates(files(spark, sf_dir), "source", "hash_str", "doc_id").select("doc_id", "is_questionable")


@plans.add("""
WITH f AS (SELECT doc_id, sha256(text) AS h, n_chars > 300 AS v FROM documents)
SELECT doc_id, v AND row_number() OVER (PARTITION BY h, v ORDER BY doc_id) = 1 AS is_valid FROM f
""")
def hash_dup_invalid(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("session", F.lit(0))
    # One archive-wide session: the hash itself spreads the partitions.
    return S.drop_duplicates(f, "session", "hash_str", "doc_id").select("doc_id", "is_valid")


@plans.add("SELECT doc_id, sha256(text) AS hash_str FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AND doc_id % 2 = 1")
def hash_new_only(spark, sf_dir):
    f = files(spark, sf_dir)
    seen = f.where("doc_id % 2 = 0").select(F.col("hash_str").alias("known"))
    return S.only_new(f.where("doc_id % 2 = 1"), "hash_str", seen, "known").select("doc_id", "hash_str")


@plans.add("SELECT doc_id, sha256(text) AS hash_str FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def hash_seen_only(spark, sf_dir):
    f = files(spark, sf_dir)
    seen = f.where("doc_id % 2 = 0").select(F.col("hash_str").alias("known"))
    return S.only_seen(f.where("doc_id % 2 = 1"), "hash_str", seen, "known").select("doc_id", "hash_str")


@plans.add("""
SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS seen,
  NOT sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AND n_chars > 300 AS is_valid FROM documents
""")
def hash_seen_flag(spark, sf_dir):
    """Validity is: not seen before and not like the template (here: long enough)."""
    f = files(spark, sf_dir)
    seen = f.where("doc_id % 3 = 0").select(F.col("hash_str").alias("known"))
    return S.seen_flag(f, "hash_str", seen, "known").select("doc_id", "seen", (~F.col("seen") & F.col("is_valid")).alias("is_valid"))


@plans.add("""
SELECT l_orderkey AS session, bool_or(l_quantity > 40) AS any_valid, bool_and(l_quantity > 40) AS all_valid,
  count(*) FILTER (WHERE l_quantity > 40) AS n_valid,
  bool_or(l_quantity > 40) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS session_valid
FROM lineitem GROUP BY l_orderkey
""")
def session_validity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_quantity") > 40).alias("is_valid"))
    taken = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return S.session_validity(lines, "session", taken, "o_orderkey")


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


@plans.add(f"""
SELECT l_orderkey, CAST(n AS BIGINT) AS instance_num, l_partkey,
  lpad(CAST(n AS VARCHAR), 4, '0') || '-' || '2_25_' || l_orderkey AS new_name
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS n FROM lineitem)
""")
def session_filenames(spark, sf_dir):
    numbered = S.instance_numbers(table(spark, sf_dir, "lineitem"), "l_orderkey", *ORDER)
    uid = F.concat(F.lit("2_25_"), F.col("l_orderkey").cast("string"))
    return numbered.select("l_orderkey", F.col("instance_num").cast("bigint").alias("instance_num"), "l_partkey", S.file_name(F.col("instance_num"), uid).alias("new_name"))


@plans.add("""
SELECT event_id, user_id, CASE WHEN rn = 1 THEN '000' ELSE lpad(CAST(n + rn - 1 AS VARCHAR), 3, '0') END AS video_num
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
""")
def session_video_numbers(spark, sf_dir):
    return S.video_numbers(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "user_id", "video_num")


@plans.add("""
(SELECT o_orderkey, 'head' AS part FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5) UNION ALL
(SELECT o_orderkey, 'tail' FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)
""")
def session_head_tail(spark, sf_dir):
    return S.head_and_tail(table(spark, sf_dir, "orders"), 5, "o_orderdate", "o_orderkey").select("o_orderkey", "part")


@plans.add("""
WITH p AS (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/a.dcm' WHEN 1 THEN '/b.DCM' WHEN 2 THEN '/c.jpeg' WHEN 3 THEN '/d.MP4' ELSE '/e' END AS path FROM pages),
e AS (SELECT *, lower(regexp_extract(path, '\\.[^./]*$', 0)) AS ext FROM p)
SELECT page_id, CASE WHEN ext IN ('.dcm', '') THEN 'dicom' WHEN ext IN ('.jpg', '.jpeg') THEN 'jpg' WHEN ext = '.mp4' THEN 'mp4' ELSE 'other' END AS kind,
  regexp_extract(path, '\\.[^./]*$', 0) = '.dcm' AS is_valid, regexp_extract(path, '[^/]*$', 0) AS file_name FROM e
""")
def session_file_kinds(spark, sf_dir):
    m = F.col("page_id") % 5
    tail = F.when(m == 0, "/a.dcm").when(m == 1, "/b.DCM").when(m == 2, "/c.jpeg").when(m == 3, "/d.MP4").otherwise("/e")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", tail).alias("path"), F.lit(True).alias("is_valid"))
    gated = S.extension_gate(p, "path")
    return gated.select("page_id", X.file_kind(F.col("path")).alias("kind"), "is_valid", X.basename(F.col("path")).alias("file_name"))


@plans.add("""
SELECT source, count(*) FILTER (WHERE toxic = 1) AS n_toxic, count(*) FILTER (WHERE quality = 1) AS n_good, count(*) AS n,
  bool_or(toxic = 1) AS any_toxic, bool_and(quality = 1) AS all_good FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def session_flag_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return flag_counts(joined, "source", {"n_toxic": toxic, "n_good": good}, {"any_toxic": toxic}, {"all_good": good})


@plans.add("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'rf' WHEN 'O' THEN 'esv' WHEN 'P' THEN 'otherDicom' END AS prefix,
  CASE o_orderstatus WHEN 'F' THEN 'DICOM' WHEN 'O' THEN 'DICOM_MP4' WHEN 'P' THEN 'DERIVED' END AS scan FROM orders
""")
def session_classes(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "RF").when(F.col("o_orderstatus") == "O", "ESV").when(F.col("o_orderstatus") == "P", "OTHER")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.session_class(kind).alias("c")).select("o_orderkey", "c.*")


@plans.add("""
SELECT subject, kind, count(*) AS n_files, string_agg(new_name, ',' ORDER BY new_name) AS names,
  '/project/demo/subject/' || subject || '/experiment/SOURCE_DATA-' || subject || '/scan/0/resource/SRC' AS archive_path,
  subject || '-' || lower(kind) || '.zip' AS zip_name
FROM (SELECT source AS subject, CASE WHEN doc_id % 3 = 0 THEN 'MP4' ELSE 'DICOM' END AS kind, 'f' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS new_name FROM documents WHERE n_chars > 300)
GROUP BY subject, kind
""")
def payload_plan(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(
        F.col("source").alias("subject"), F.when(F.col("doc_id") % 3 == 0, "MP4").otherwise("DICOM").alias("kind"),
        F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("new_name"), (F.col("n_chars") > 300).alias("is_valid"),
    )
    return P.payload_plan(f, "demo")


# --- crowd labels ------------------------------------------------------------------------------


@plans.add("""
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids,
  count(*) AS n, min_by(event_type, event_id) AS first_kind FROM events GROUP BY user_id
""")
def label_group_collect(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id").cast("string"))
    lists = L.collect_in_order(e, "user_id", "event_id", "event_type", "id")
    return lists.select("user_id", F.array_join("event_type", ",").alias("kinds"), F.array_join("id", ",").alias("ids"), F.size("id").cast("bigint").alias("n"), F.get("event_type", F.lit(0)).alias("first_kind"))


@plans.add("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS segment, role FROM conversations")
def label_segments(spark, sf_dir):
    c = L.segment_numbers(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return c.select("conv_id", "turn", F.col("segment").cast("bigint").alias("segment"), "role")


@plans.add("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS stacked, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def label_stack(spark, sf_dir):
    """The grouped payloads of a conversation as one ordered stack."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lists = L.collect_in_order(c, "conv_id", "turn", "text")
    return lists.select("conv_id", F.array_join("text", "\n").alias("stacked"), F.aggregate("text", F.lit(0).cast("bigint"), lambda s, t: s + F.length(t)).alias("n_chars"))


@plans.add("""
SELECT l_orderkey, l_linenumber, l_partkey, c_name AS subject_name FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 45
""")
def label_two_hop(spark, sf_dir):
    hashes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("NAME"), F.col("o_custkey").cast("string").alias("SUBJECT"))
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("UID"), F.col("c_name").alias("NAME"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").withColumn("digest", F.col("l_orderkey").cast("string"))
    return L.two_hop(lines, "digest", hashes, subjects).select("l_orderkey", "l_linenumber", "l_partkey", "subject_name")


@plans.add("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS n_bytes FROM documents")
def label_base64(spark, sf_dir):
    """Base64 text back to bytes: the digest proves the round trip."""
    raw = F.unbase64(F.base64(F.col("text").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("bigint").alias("n_bytes"))


@plans.add("SELECT page_id, regexp_extract('/in/Batch_' || page_id || '_batch_results.csv', 'Batch_(\\d+)_batch_results\\.csv', 1) AS batch FROM pages")
def label_batch_id(spark, sf_dir):
    path = F.concat(F.lit("/in/Batch_"), F.col("page_id").cast("string"), F.lit("_batch_results.csv"))
    return table(spark, sf_dir, "pages").select("page_id", L.batch_id(path).alias("batch"))


@plans.add("""
SELECT l_orderkey, count(*) AS n_labels, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS is_valid, count(DISTINCT l_partkey) AS n_images
FROM lineitem GROUP BY l_orderkey
""")
def label_registered(spark, sf_dir):
    """A group of labels is valid if every image of it stands in the registry of hashes."""
    hashes = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("NAME"))
    labels = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return L.group_validity(labels, "l_orderkey", "l_partkey", hashes).select("l_orderkey", "n_labels", "is_valid", "n_images")


@plans.add("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '101010' WHEN o_orderkey % 2 = 0 THEN '090909' WHEN o_orderkey % 5 = 0 THEN '080808' END AS series_time,
 o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 0 AS new_file, o_orderkey % 7 = 0 AND o_orderkey % 4 <> 0 AS known_file FROM orders
""")
def session_times(spark, sf_dir):
    """The last present of three header times; files that are new or known and like no template."""
    k = F.col("o_orderkey")
    header = F.map_filter(
        F.create_map(
            F.lit("SeriesTime"), F.when(k % 5 == 0, "080808"), F.lit("ContentTime"), F.when(k % 2 == 0, "090909"), F.lit("StudyTime"), F.when(k % 3 == 0, "101010")
        ),
        lambda _, v: v.isNotNull(),
    )
    files = table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"), (k % 7 == 0).alias("seen"), (k % 4 == 0).alias("template"))
    return files.select("o_orderkey", H.last_time("header").alias("series_time"), S.valid_new("seen", "template").alias("new_file"), S.valid_known("seen", "template").alias("known_file"))


@plans.add()
def label_sample(spark, sf_dir):
    """One row at random, by a seed: sampling is the operator."""
    return table(spark, sf_dir, "events").orderBy(F.rand(7)).limit(1).select("event_id", "event_type")


@plans.add("""
SELECT conv_id, 'ContentLabel=SEGMENTATION|Modality=SEG|NumberOfFrames=' || count(*) || '|SegmentSequence=' ||
  string_agg(CAST(n AS VARCHAR) || ':' || role, ';' ORDER BY n) || '|SeriesDescription=crowd labels|StudyDescription=' || min_by(role, n) AS header
FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS n FROM conversations) GROUP BY conv_id
""")
def label_headers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("role").alias("title"))
    headers = L.segment_headers(c, "conv_id", "turn", "role", "title")
    entries = F.array_sort(F.transform(F.map_entries("header"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return headers.select("conv_id", F.array_join(entries, "|").alias("header"))


QUERIES, ORACLES = plans.queries, plans.oracles
