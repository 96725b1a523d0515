"""Registry queries: customers, suppliers and nations stand in for subjects, surgeons and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.uids import dotted, is_valid_uid, underscored
from casewright.operators import registry as R
from casewright.operators import search as Search
from casewright.plans._register import Plans
from casewright.sources.tables import table

plans = Plans()


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.upper("n_name").alias("NAME"), F.concat(F.lit("2_25_"), F.col("n_nationkey").cast("string")).alias("UID"),
        F.lit("2024-01-01T00:00:00").alias("CREATED_DATE_TIME"), F.lit("2_25_0").alias("CREATED_BY"),
    )


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.upper("c_name").alias("NAME"), F.concat(F.lit("2_25_"), F.col("c_custkey").cast("string")).alias("UID"),
        F.col("c_nationkey"), F.col("c_custkey"), F.col("c_mktsegment"),
    )


@plans.add("""
WITH cand AS (SELECT s_name AS name, '2_25_9' || s_suppkey AS uid, s_suppkey AS ordinal FROM supplier WHERE s_acctbal > 5000
  UNION ALL SELECT lower(n_name), '2_25_8' || n_nationkey, 100000 + n_nationkey FROM nation WHERE n_nationkey < 5
  UNION ALL SELECT upper(s_name), '2_25_7' || s_suppkey, 200000 + s_suppkey FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL SELECT 'bad ' || s_name, '2_25_00' || s_suppkey, 300000 + s_suppkey FROM supplier WHERE s_suppkey % 9 = 0),
first AS (SELECT *, row_number() OVER (PARTITION BY upper(name), NOT (uid LIKE '2_25_00%') ORDER BY ordinal, uid) AS rn FROM cand)
SELECT upper(n_name) AS name, '2_25_' || n_nationkey AS uid, '2_25_0' AS created_by FROM nation
UNION ALL
SELECT upper(name), uid, '2_25_1' FROM first
WHERE rn = 1 AND NOT (uid LIKE '2_25_00%') AND upper(name) NOT IN (SELECT upper(n_name) FROM nation)
""")
def registry_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    make = lambda df, name, prefix, key, base: df.select(name.alias("NAME"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("UID"), (F.col(key) + base).cast("bigint").alias("ordinal"))
    candidates = (
        make(s.where("s_acctbal > 5000"), F.col("s_name"), "2_25_9", "s_suppkey", 0)
        .unionByName(make(n.where("n_nationkey < 5"), F.lower("n_name"), "2_25_8", "n_nationkey", 100000))
        .unionByName(make(s.where("s_suppkey % 7 = 0"), F.upper("s_name"), "2_25_7", "s_suppkey", 200000))
        .unionByName(make(s.where("s_suppkey % 9 = 0"), F.concat(F.lit("bad "), "s_name"), "2_25_00", "s_suppkey", 300000))
    )
    after, _ = R.insert_if_absent(nations(spark, sf_dir), candidates, "2_25_1", F.lit("2024-02-01T00:00:00"))
    return after.select(F.col("NAME").alias("name"), F.col("UID").alias("uid"), F.col("CREATED_BY").alias("created_by"))


@plans.add("""
WITH c AS (SELECT lower(s_name) AS name, '2_25_9' || s_suppkey AS uid, s_suppkey AS ordinal FROM supplier
  UNION ALL SELECT upper(s_name), '2_25_8' || s_suppkey, 900000 + s_suppkey FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT n_name, '2_25_7' || n_nationkey, 1800000 + n_nationkey FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY upper(name) ORDER BY ordinal, uid) AS rn FROM c)
SELECT CASE WHEN upper(name) IN (SELECT upper(n_name) FROM nation) THEN 'exists' WHEN rn > 1 THEN 'repeated' ELSE 'ok' END AS reason,
  count(*) AS n, count(*) FILTER (WHERE rn = 1 AND upper(name) NOT IN (SELECT upper(n_name) FROM nation)) AS n_inserted
FROM r GROUP BY 1
""")
def registry_insert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert results: successes of all tries."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    make = lambda df, name, prefix, key, base: df.select(name.alias("NAME"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("UID"), (F.col(key) + base).cast("bigint").alias("ordinal"))
    candidates = (
        make(s, F.lower("s_name"), "2_25_9", "s_suppkey", 0)
        .unionByName(make(s.where("s_suppkey % 2 = 0"), F.upper("s_name"), "2_25_8", "s_suppkey", 900000))
        .unionByName(make(n, F.col("n_name"), "2_25_7", "n_nationkey", 1800000))
    )
    _, judged = R.insert_if_absent(nations(spark, sf_dir), candidates, "2_25_1", F.lit(""))
    return judged.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("inserted").alias("n_inserted"))


@plans.add("SELECT o_orderkey, '2_25_' || c_custkey AS uid FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0")
def registry_lookup_uid(spark, sf_dir):
    known = customers(spark, sf_dir).where("c_custkey % 5 <> 0")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lower("c_name").alias("who"))
    probes = table(spark, sf_dir, "orders").join(names, F.col("o_custkey") == F.col("k"), "left").select("o_orderkey", "who")
    return R.lookup_uid(probes, "who", known).select("o_orderkey", "uid")


@plans.add("SELECT o_orderkey, upper(c_name) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0")
def registry_lookup_name(spark, sf_dir):
    known = customers(spark, sf_dir).where("c_custkey % 4 <> 0")
    probes = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("2_25_"), F.col("o_custkey").cast("string")).alias("who"))
    return R.lookup_name(probes, "who", known).select("o_orderkey", "name")


@plans.add("""
SELECT 'orders without lines' AS kind, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customers without orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def registry_fk_orphans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = R.orphans(orders.select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")
    b = R.orphans(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders, "o_custkey")
    return a.select(F.lit("orders without lines").alias("kind"), F.col("o_orderkey").alias("key")).unionByName(
        b.select(F.lit("customers without orders").alias("kind"), F.col("c_custkey").alias("key"))
    )


@plans.add("""
SELECT bool_and(upper(s_name) IN (SELECT upper(c_name) FROM customer)) AS all_owners_registered,
  bool_or(lower(s_name) IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey <= 3)) AS caller_is_member,
  count(*) FILTER (WHERE upper(s_name) NOT IN (SELECT upper(c_name) FROM customer)) AS n_missing FROM supplier
""")
def registry_guard(spark, sf_dir):
    """Every owner registered (division), caller among users or owners."""
    owners = table(spark, sf_dir, "supplier").select("s_name", "s_suppkey")
    members = owners.where("s_suppkey <= 3").select(F.col("s_name").alias("NAME"))
    flagged = R.member_flag(owners, "s_name", customers(spark, sf_dir), "registered")
    flagged = R.member_flag(flagged, "s_name", members, "member")
    return flagged.agg(F.bool_and("registered").alias("all_owners_registered"), F.bool_or("member").alias("caller_is_member"), F.count_if(~F.col("registered")).alias("n_missing"))


@plans.add("""
SELECT 'region' AS table_name, count(*) AS n_items, 2 AS n_columns FROM region UNION ALL SELECT 'nation', count(*), 3 FROM nation
UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'supplier', count(*), 4 FROM supplier
UNION ALL SELECT 'part', count(*), 6 FROM part
""")
def registry_report(spark, sf_dir):
    return R.report({n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part")})


@plans.add("""
SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS key, CAST(NULL AS VARCHAR) AS first_name FROM nation
UNION ALL SELECT s_name, s_suppkey, 'given ' || s_suppkey FROM supplier
""")
def registry_evolve(spark, sf_dir):
    """An older table without a column is appended to by a newer one."""
    old = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("key"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.concat(F.lit("given "), F.col("s_suppkey").cast("string")).alias("first_name"))
    return R.evolve(old, "first_name").unionByName(new)


@plans.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def registry_delete(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return R.delete_keys(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", keys, "o_custkey")


@plans.add("""
SELECT c_custkey, r_name AS site, n_name AS grp FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def registry_encode_subjects(spark, sf_dir):
    """A subject row gets its group and its group's site by two lookups."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = Search.encoded_subjects(table(spark, sf_dir, "customer"), "c_nationkey", n, "n_nationkey", "n_regionkey", r, "r_regionkey")
    return out.select("c_custkey", F.col("r_name").alias("site"), F.col("n_name").alias("grp"))


@plans.add("""
WITH probe AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS who FROM customer),
known AS (SELECT c_name FROM customer WHERE c_custkey % 3 <> 0)
SELECT c_custkey, upper(who) IN (SELECT upper(c_name) FROM known) AS any_case, who IN (SELECT c_name FROM known) AS exact_case FROM probe
""")
def registry_membership(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("NAME"))
    probe = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("who"))
    return R.member_flag(R.member_flag(probe, "who", known, "any_case"), "who", known, "exact_case", ignore_case=False).select("c_custkey", "any_case", "exact_case")


@plans.add("""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2_25_' || doc_id WHEN doc_id % 4 = 1 THEN '2.25.0' || doc_id
  WHEN doc_id % 4 = 2 THEN 'x' || doc_id ELSE '2_25_' || repeat('9', 60) || doc_id END AS uid FROM documents)
SELECT doc_id, replace(uid, '_', '.') AS dotted, replace(uid, '.', '_') AS underscored,
  regexp_matches(replace(uid, '_', '.'), '^(0|[1-9][0-9]*)(\\.(0|[1-9][0-9]*))*$') AND length(uid) <= 64 AS valid FROM t
""")
def uid_validate(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 4
    uid = F.when(m == 0, F.concat(F.lit("2_25_"), k)).when(m == 1, F.concat(F.lit("2.25.0"), k)).when(m == 2, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("2_25_" + "9" * 60), k))
    t = table(spark, sf_dir, "documents").select("doc_id", uid.alias("uid"))
    return t.select("doc_id", dotted(F.col("uid")).alias("dotted"), underscored(F.col("uid")).alias("underscored"), is_valid_uid(F.col("uid")).alias("valid"))


@plans.add("SELECT upper(n_name) AS item, 'GROUPS' AS in_table FROM nation UNION ALL SELECT upper(r_name), 'SITES' FROM region")
def registry_items(spark, sf_dir):
    catalog = R.Catalog({"groups": nations(spark, sf_dir), "sites": table(spark, sf_dir, "region").select(F.upper("r_name").alias("NAME"))})
    one, two = (catalog.items(t).select(F.col("NAME").alias("item"), F.lit(t.upper()).alias("in_table")) for t in ("groups", "sites"))
    return one.unionByName(two)


@plans.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def path_conflicts(spark, sf_dir):
    """Planned targets that exist already."""
    from casewright.operators.paths import conflicts

    planned = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    existing = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return conflicts(planned, existing, "o_orderkey")


@plans.add("SELECT s_suppkey, repeat('*', length(s_name)) AS masked, strpos(s_name, '0') > 0 AS has_zero FROM supplier")
def login_mask(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", Search.masked(F.col("s_name")).alias("masked"), F.contains("s_name", F.lit("0")).alias("has_zero"))


@plans.add("""
SELECT 'subject' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)
UNION ALL SELECT 'hash', count(*) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)
""")
def registry_cascade_delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    gone = o.where("o_totalprice > 350000").select(F.col("o_custkey").alias("k"))
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("UID"))
    left, hashes = R.delete_subjects(gone, "k", subjects, o.select(F.col("o_custkey").alias("SUBJECT")))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(left, "subject").unionByName(count(hashes, "hash"))


QUERIES, ORACLES = plans.queries, plans.oracles
