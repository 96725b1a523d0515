"""Scalar, time, header, image, path and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import images as I
from casewright.functions import text as X
from casewright.functions import timeutil as T
from casewright.operators import headers as H
from casewright.operators import paths as A
from casewright.operators import positions as P
from casewright.operators import search as Search
from casewright.operators.predicates import compile_constraints
from casewright.plans._register import Plans
from casewright.sources.tables import table

plans = Plans()

# --- time ---------------------------------------------------------------------------------------


@plans.add("""
SELECT event_id, strftime(timezone('America/Chicago', timezone('UTC', ts)), '%Y%m%d') AS date_part,
 strftime(timezone('America/Chicago', timezone('UTC', ts)), '%H%M%S.%g') AS time_part,
 strftime(timezone('America/Chicago', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') || ' US-CST' AS shown FROM events
""")
def central_time_parts(spark, sf_dir):
    local = F.convert_timezone(F.lit("UTC"), F.lit(T.ZONE), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", T.date_part(local).alias("date_part"), T.time_part(local).alias("time_part"), T.display(local).alias("shown"))


@plans.add("""
SELECT o_orderkey, strftime(timezone('America/Chicago', timezone('America/Los_Angeles', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS central,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS naive FROM orders
""")
def central_from_zone_names(spark, sf_dir):
    """A named Pacific time is two hours earlier than Central; a naive time is taken as it stands."""
    shown = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    out = table(spark, sf_dir, "orders").select("o_orderkey", T.central(F.concat(shown, F.lit(" PST"))).alias("a"), T.central(shown).alias("b"))
    return out.select("o_orderkey", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("central"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("naive"))


@plans.add("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) < DATE '1996-01-01' AS early,
 strftime(o_orderdate, '%H:%M') AS hh_mm, (o_orderkey % 24) * 60 + 30 AS minutes, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' AS typed,
 (o_orderkey * 7) % 24 < o_orderkey % 24 AS ends_before_start FROM orders
""")
def time_checks(spark, sf_dir):
    hour = lambda c: F.concat(F.lpad((c % 24).cast("string"), 2, "0"), F.lit("-30"))
    typed, end = T.typed_time(hour(F.col("o_orderkey"))), T.typed_time(hour(F.col("o_orderkey") * 7))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (T.sheet_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")) < F.lit("1996-01-01").cast("date")).alias("early"),
        F.date_format("o_orderdate", "HH:mm").alias("hh_mm"), T.minutes(typed).cast("bigint").alias("minutes"), typed.alias("typed"), (T.minutes(end) < T.minutes(typed)).alias("ends_before_start"),
    )


@plans.add("""
WITH h AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE strftime(ts, '%Y%m%d') END AS cd,
 strftime(ts, '%H%M%S') AS ct, strftime(ts, '%Y%m%d') AS d FROM events)
SELECT event_id, CASE WHEN cd IS NOT NULL THEN CASE WHEN cd <> '' THEN cd || ' ' || ct END ELSE d || ' ' || ct END AS header_time FROM h
""")
def header_dates(spark, sf_dir):
    day, clock = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss")
    m = F.col("event_id") % 4
    content = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, "").otherwise(day)
    return table(spark, sf_dir, "events").select("event_id", H.header_time(content, clock, day, clock).alias("header_time"))


# --- headers ------------------------------------------------------------------------------------

TAGS = (("00100010", "PN", "p_name"), ("50010010", "LO", "p_brand"), ("00091001", "LO", "p_type"), ("60023000", "OW", "p_brand"), ("60020010", "US", "p_type"), ("00080050", "SH", "p_brand"), ("00080060", "CS", "p_type"))


def header_map():
    parts = []
    for tag, kind, column in TAGS:
        parts += [F.lit(tag), F.struct(F.lit(kind).alias("vr"), F.col(column).alias("value"))]
    return F.create_map(*parts)


@plans.add("""
SELECT p_partkey, '00080050=REDACTED PYTHON VALUE|00080060=' || p_type || '|00100010=REDACTED PYTHON VALUE|60020010=' || p_type AS header FROM part
""")
def header_redact(spark, sf_dir):
    entries = F.array_sort(F.transform(F.map_entries(H.redact(header_map())), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, "|").alias("header"))


@plans.add("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS site, 'StudyUID=2_25_' || p_partkey AS uids,
 'ContentTime=' || p_size || '|StudyTime=' || p_size AS times,
 'Modality=RF|OldModality=' || p_type || '|StudyTime=' || p_size AS standardised FROM part
""")
def header_derived(spark, sf_dir):
    size = F.col("p_size").cast("string")
    names = F.create_map(F.lit("StudyUID"), F.concat(F.lit("2.25."), F.col("p_partkey").cast("string")), F.lit("ContentTime"), size, F.lit("StudyTime"), size, F.lit("Modality"), F.col("p_type"))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    site = H.first_filled(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")), F.col("p_brand"))
    some = F.map_filter(names, lambda k, v: k.isin("Modality", "StudyTime"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", site.alias("site"), text(H.uid_elements(names)).alias("uids"), text(H.time_elements(names)).alias("times"),
        text(H.stash_and_set(some, {"Modality": F.lit("RF")})).alias("standardised"),
    )


# --- documents ----------------------------------------------------------------------------------


@plans.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def form_json(spark, sf_dir):
    """A JSON form read with a fixed schema, rendered and read again."""
    return table(spark, sf_dir, "events").select("event_id", Search.json_form(F.col("props"), "k bigint, absent string")["k"].alias("k"))


@plans.add("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS label FROM pages")
def xml_label(spark, sf_dir):
    """The attribute of a root element, by path; the element alone is well formed."""
    root = F.concat(F.regexp_extract("html", "<html[^>]*>", 0), F.lit("</html>"))
    return table(spark, sf_dir, "pages").select("page_id", F.xpath_string(root, F.lit("/html/@lang")).alias("label"))


# --- images -------------------------------------------------------------------------------------


@plans.add("""
WITH t AS (SELECT embedding AS b FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, embedding AS a, b, list_avg(embedding) AS ma, list_avg(b) AS mb FROM embeddings, t)
SELECT vec_id, round(list_sum([(CAST(a[i] AS DOUBLE) - ma) * (CAST(b[i] AS DOUBLE) - mb) FOR i IN range(1, len(a) + 1)]) /
 sqrt(list_sum([(CAST(x AS DOUBLE) - ma) * (CAST(x AS DOUBLE) - ma) FOR x IN a]) * list_sum([(CAST(x AS DOUBLE) - mb) * (CAST(x AS DOUBLE) - mb) FOR x IN b])), 5) + 0.0 AS ncc FROM s
""")
def ncc_template(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    template = e.where("vec_id = 0").select(F.col("embedding").alias("template"))  # one image
    return e.crossJoin(F.broadcast(template)).select("vec_id", (F.round(I.correlation(F.col("embedding"), F.col("template")), 5) + F.lit(0.0)).alias("ncc"))


@plans.add("""
WITH v AS (SELECT vec_id, embedding AS a, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings)
SELECT vec_id, CAST(list_sum([CAST(floor((CAST(x AS DOUBLE) - lo) / (hi - lo) * 255) AS BIGINT) FOR x IN a]) AS BIGINT) AS total, round(list_avg(a), 5) AS gray FROM v
""")
def minmax_normalise(spark, sf_dir):
    total = F.aggregate(Search.levels(F.col("embedding")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", total.alias("total"), F.round(Search.mean(F.col("embedding")), 5).alias("gray"))


@plans.add("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 64 END AS depth FROM orders")
def image_depth(spark, sf_dir):
    m = F.col("o_orderkey") % 4
    kind = F.when(m == 0, "bool").when(m == 1, "uint8").when(m == 2, "int16").otherwise("uint64")
    return table(spark, sf_dir, "orders").select("o_orderkey", I.bit_depth(kind).alias("depth"))


# --- text ---------------------------------------------------------------------------------------


@plans.add("""
SELECT doc_id, upper(source) AS up, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS stripped,
 sha256(replace(text, '"', '''')) AS quoted, sha256(regexp_replace(regexp_replace(text, '\\s''', '''', 'g'), '''\\s', '''', 'g')) AS revised,
 contains(text, 'the') AS has_the, starts_with(text, 'The') AS starts_the FROM documents
""")
def text_functions(spark, sf_dir):
    """Over whole texts; the results are compared by digest."""
    revised = F.regexp_replace(F.regexp_replace("text", r"\s'", "'"), r"'\s", "'")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.upper("source").alias("up"), digest(X.strip(F.col("text"))).alias("stripped"), digest(F.replace("text", F.lit('"'), F.lit("'"))).alias("quoted"),
        digest(revised).alias("revised"), F.contains("text", F.lit("the")).alias("has_the"), F.startswith("text", F.lit("The")).alias("starts_the"),
    )


@plans.add("""
SELECT doc_id, sha256(replace(replace(replace(text, 'tion', 'HAWKID=2_25_1'), 'the', 'HAWKID=2_25_2'), 'HAWK', 'HAWKID=2_25_3')) AS encoded,
 (CASE WHEN contains(text, 'tion') THEN 'tion,' ELSE '' END) || (CASE WHEN contains(text, 'the') THEN 'the,' ELSE '' END) || (CASE WHEN contains(text, 'HAWK') THEN 'HAWK,' ELSE '' END) AS found
FROM documents
""")
def pii_encode(spark, sf_dir):
    """Identifiers replaced one after another: the third meets what the first two wrote."""
    ids = [("tion", "2_25_1"), ("the", "2_25_2"), ("HAWK", "2_25_3")]
    found = F.array_join(F.transform(X.found_ids(F.col("text"), ids), lambda k: F.concat(k, F.lit(","))), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.encode_ids(F.col("text"), ids), 256).alias("encoded"), found.alias("found"))


@plans.add("SELECT p_partkey, p_name, p_size FROM part")
def header_cleanup(spark, sf_dir):
    """Sheet headers with line ends, an unnamed and an optional column."""
    odd = table(spark, sf_dir, "part").select(
        F.lit("x").alias("Case Name [Optional]"), F.col("p_partkey").alias(" p_partkey\n"), F.col("p_name").alias("p_name "), F.lit(1).alias("Unnamed: 3"), F.col("p_size").alias("p_size")
    )
    return X.normalise_headers(odd)


# --- search ---------------------------------------------------------------------------------------


@plans.add("""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')) OR (o_orderstatus = 'P' AND o_totalprice >= 200000)
""")
def predicate_tree(spark, sf_dir):
    tree = [
        [("o_orderstatus", "=", "F"), "AND", [("o_orderpriority", "=", "1-URGENT"), "OR", ("o_orderpriority", "=", "2-HIGH")]], "OR",
        [("o_orderstatus", "=", "P"), "AND", ("o_totalprice", ">=", 200000)],
    ]
    return table(spark, sf_dir, "orders").where(compile_constraints(tree)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@plans.add("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def search_semi_join(spark, sf_dir):
    """Subjects of the matching sessions: a semi join instead of a list of ids."""
    sessions = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return Search.belonging_to(table(spark, sf_dir, "customer"), "c_custkey", sessions, "o_custkey").select("c_custkey", "c_mktsegment")


@plans.add("SELECT o_orderkey AS expt_id, o_custkey AS subject_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS operation_date FROM orders")
def search_projection(spark, sf_dir):
    """Drop, rename and keep lists."""
    names = {"o_orderkey": "expt_id", "o_custkey": "subject_id", "o_orderdate": "operation_date"}
    found = Search.projected(table(spark, sf_dir, "orders"), ("o_totalprice", "o_orderpriority", "o_orderstatus"), names, ("expt_id", "subject_id", "operation_date", "absent"))
    return found.withColumn("operation_date", F.to_date("operation_date").cast("string"))


@plans.add("SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'PROMO') OR contains(lower(p_name), 'ring')")
def search_contains(spark, sf_dir):
    return Search.containing(table(spark, sf_dir, "part"), p_type="PROMO", p_name__any_case="Ring").select("p_partkey", "p_type")


@plans.add("""
WITH n AS (SELECT n_name, contains(lower(n_name), 'a') AS a FROM nation),
r AS (SELECT n_name, a, row_number() OVER (PARTITION BY a ORDER BY n_name) AS rn FROM n)
SELECT n_name, (CASE WHEN a THEN '1' ELSE '2' END) || chr(CAST(64 + rn AS INT)) AS code, CAST(rn AS VARCHAR) AS option FROM r
""")
def procedure_codes(spark, sf_dir):
    """Names split in two classes, each lettered in order."""
    return Search.coded_names(table(spark, sf_dir, "nation"), "n_name", F.contains(F.lower("n_name"), F.lit("a")))


@plans.add("""
SELECT o_orderkey, '/project/demo/subject/' || o_custkey || '/experiment/SOURCE_DATA-' || o_orderkey || '/scan/0' AS path, CAST(o_custkey AS VARCHAR) AS subject
FROM orders WHERE o_orderstatus = 'F'
""")
def path_build(spark, sf_dir):
    """Paths built, parsed back and selected by level; a star matches anything."""
    key, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    path = A.build_path(project=F.lit("demo"), subject=who, experiment=A.source_label(key), scan=F.lit("0"))
    built = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), F.col("o_orderstatus").alias("resource"))
    parsed = built.withColumn("subject", A.parse_path(F.col("path"))["subject"])
    return A.select_paths(parsed, resource="F", subject="*").select("o_orderkey", "path", "subject")


@plans.add("SELECT DISTINCT regexp_extract(url, '://([^/]+)/', 1) AS subject FROM pages")
def distinct_subjects(spark, sf_dir):
    return Search.distinct_values(table(spark, sf_dir, "pages"), F.regexp_extract("url", "://([^/]+)/", 1), "subject")


@plans.add("""
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P'),
b AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
SELECT o_orderkey, c_name FROM a LEFT JOIN b USING (rn)
""")
def positional_zip(spark, sf_dir):
    """Rows paired by position: the literal form of the keyed join."""
    a = P.numbered(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "rn", F.floor(F.col("o_orderkey") / 4096), "o_orderkey")
    b = P.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "rn", F.floor(F.col("c_custkey") / 4096), "c_custkey")
    return a.join(b, "rn", "left").select("o_orderkey", "c_name")


@plans.add("SELECT s_suppkey, 'BY: ' || upper(s_name) || '; AT: 2024-01-01' AS note FROM supplier")
def publish_note(spark, sf_dir):
    from casewright.operators.publish import note

    return table(spark, sf_dir, "supplier").select("s_suppkey", note(F.col("s_name"), F.lit("2024-01-01")).alias("note"))


@plans.add("SELECT 'registry-backup-' || strftime(max(o_orderdate), '%Y_%m_%d_%H_%M_%S') || '.json' AS name FROM orders")
def backup_name(spark, sf_dir):
    from casewright.sources.registry_json import backup_name as name

    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("at")).select(name("registry", F.col("at")).alias("name"))


@plans.add("""
SELECT c_mktsegment AS subject, count(*) AS n_files, '/out/' || c_mktsegment AS target FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment
""")
def download_plan(spark, sf_dir):
    """Filtered files and where they go, counted per subject."""
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return found.groupBy(F.col("c_mktsegment").alias("subject")).agg(F.count("*").alias("n_files")).withColumn("target", F.concat(F.lit("/out/"), "subject"))


QUERIES, ORACLES = plans.queries, plans.oracles
