"""Data-quality queries: a batch sheet built from orders and customers, judged by the rule engine."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import quality as Q
from casewright.operators.similar import nearest
from casewright.plans._register import Plans
from casewright.session import kept_in, scratch
from casewright.sources.tables import table

plans = Plans()

#: The test sheet, in SQL that both engines read; it is input, not an operator under test.
SHEET = """
SELECT k AS row_id,
 CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'nobody' ELSE lower(c_name) END AS filer,
 CASE WHEN k % 17 = 0 THEN '' WHEN k % 5 = 0 THEN '2001-05-05' ELSE CAST(d AS STRING) END AS operation_date,
 CASE WHEN k % 23 = 0 THEN ' ' ELSE lower(c_mktsegment) END AS institution,
 CASE WHEN k % 19 = 0 THEN '' ELSE o_orderpriority END AS procedure,
 CASE WHEN k % 29 = 0 THEN '' ELSE lpad(CAST(k % 24 AS STRING), 2, '0') || ':' || lpad(CAST(k % 60 AS STRING), 2, '0') END AS start_time,
 CASE WHEN k % 7 = 0 THEN '' WHEN k % 31 = 0 THEN 'unknown' ELSE lpad(CAST((k * 7) % 24 AS STRING), 2, '0') || ':30:00' END AS end_time,
 CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'Usable' WHEN 2 THEN 'bad' ELSE 'Unknown' END AS quality,
 CASE k % 3 WHEN 0 THEN 'Left' WHEN 1 THEN 'middle' ELSE 'right' END AS side,
 CASE WHEN k % 6 = 0 THEN '' WHEN k % 37 = 0 THEN 'ghost' ELSE 'surgeon_' || CAST(k % 20 AS STRING) END AS supervising,
 CASE WHEN k % 9 = 0 THEN '' WHEN k % 10 = 0 THEN 'unknown' WHEN k % 12 = 0 THEN 'SURGEON_' || CAST(k % 20 AS STRING) ELSE 'surgeon_' || CAST((k + 1) % 20 AS STRING) END AS performing,
 CASE k % 8 WHEN 0 THEN 'x' ELSE CAST(k % 60 AS STRING) END AS years, CAST(k % 700 AS STRING) AS prior_cases,
 CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '' END AS n_surgeons,
 CASE WHEN k % 3 = 1 THEN '{surgeon_' || CAST((k + 1) % 20 AS STRING) || ': cut; Surgeon_' || CAST(k % 20 AS STRING) || ': close}'
   WHEN k % 14 = 0 THEN '{surgeon_1 cut; b: c}' WHEN k % 15 = 0 THEN 'surgeon_2: cut' WHEN k % 22 = 0 THEN '{a: b: c}' ELSE '' END AS tasks,
 CASE WHEN k % 8 = 0 THEN 'seen by surgeon_3 and surgeon_4' ELSE 'none' END AS unusual, 'none' AS diagnostic,
 CASE WHEN k % 21 = 0 THEN 'surgeon_3' ELSE '' END AS comments,
 CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Y' WHEN 2 THEN 'N' ELSE 'Unknown' END AS skills_requested,
 CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'surgeon_2' ELSE 'stranger' END AS assessor,
 CASE WHEN k % 16 = 1 THEN 'ask surgeon_4' ELSE '' END AS assessment_details,
 CASE k % 5 WHEN 0 THEN 'present' WHEN 1 THEN 'Retrospective_Review' WHEN 2 THEN 'rescue' WHEN 3 THEN '' ELSE 'OTHER-SEE_ADDITIONAL_COMMENTS' END AS presence,
 CASE WHEN k % 33 = 0 THEN '' ELSE '/data/' || CAST(k AS STRING) END AS path, k % 34 <> 0 AS path_exists,
 CASE k % 3 WHEN 0 THEN 'Y' WHEN 1 THEN '' ELSE 'N' END AS radiology_contacted,
 CASE WHEN k % 2 = 0 THEN '' ELSE '2001-01-01' END AS radiology_date
FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderpriority, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey) t
"""
IDS = [("surgeon_3", "2_25_3"), ("surgeon_4", "2_25_4")]


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewright.sources.tables import table

    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"dq_{name}")
    return spark.sql(SHEET.replace("FROM orders JOIN customer", "FROM dq_orders JOIN dq_customer"))


def registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    users = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("NAME"))
    sites = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("NAME"))
    groups = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("NAME"))
    surgeons = table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.concat(F.lit("surgeon_"), F.col("n_nationkey").cast("string")).alias("NAME"))
    return users, sites, groups, surgeons


def judged(spark: SparkSession, sf_dir: str, legacy: bool = False) -> DataFrame:
    users, sites, groups, surgeons = registries(spark, sf_dir)
    flagged = Q.with_task_facts(Q.join_registries(Q.spread(sheet(spark, sf_dir)), users, sites, groups, surgeons))
    known = surgeons.agg(F.collect_set(F.lower("NAME")).alias("surgeon_names"))  # one row, the registry
    return Q.with_issues(flagged.crossJoin(known), Q.sheet_rules(IDS, F.col("surgeon_names"), legacy))


@lru_cache
def issue_sql() -> str:
    """The rules once more, as plain SQL: a row per rule, column and severity."""
    e = lambda c: f"({c} IS NULL OR {c} IN ('', ' '))"
    unk = lambda c: f"lower(coalesce({c}, '')) = 'unknown'"
    surgeons = "(SELECT 'surgeon_' || CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey < 15)"
    reg = lambda c: f"lower({c}) IN {surgeons}"
    exact = lambda c: f"{c} IN {surgeons}"
    tasks, parsed = f"NOT {e('tasks')}", "readable"
    minutes = lambda c: f"(TRY_CAST(split_part({c}, ':', 1) AS INT) * 60 + TRY_CAST(split_part({c}, ':', 2) AS INT))"
    has = lambda c: f"list_contains(keys, lower({c}))"
    fits = "coalesce(len(keys) = TRY_CAST(n_surgeons AS INT), FALSE)"
    broken = f"({tasks} AND NOT {parsed})"
    want = f"(NOT {broken} AND NOT {e('skills_requested')} AND NOT {unk('skills_requested')})"
    rules = [
        ("R-01", "filer", "E", f"{e('filer')} OR upper(filer) NOT IN (SELECT upper(c_name) FROM customer WHERE c_custkey % 3 <> 0)"),
        ("R-02", "operation_date", "W", f"NOT {e('operation_date')} AND TRY_CAST(operation_date AS DATE) < DATE '2000-01-01'"),
        ("R-03", "start_time", "E", e("start_time")),
        ("R-04", "institution", "E", f"{e('institution')} OR upper(institution) = 'BUILDING'"),
        ("R-05", "procedure", "E", f"{e('procedure')} OR procedure = '5-LOW'"),
        ("R-06", "path", "E", f"{e('path')} OR NOT path_exists"),
        ("R-07", "quality", "W", e("quality")),
        ("R-08", "supervising", "W", e("supervising")),
        ("R-08", "supervising", "E", f"NOT {e('supervising')} AND NOT {reg('supervising')}"),
        ("R-09", "performing", "W", e("performing")),
        ("R-09", "performing", "E", f"NOT {e('performing')} AND NOT {exact('performing')}"),
        *(("R-10", c, "W", f"contains({c}, '{i}')") for c in ("unusual", "diagnostic", "comments") for i in ("surgeon_3", "surgeon_4")),
        ("R-11", "skills_requested", "W", e("skills_requested")),
        ("R-12", "radiology_contacted", "W", e("radiology_contacted")),
        ("R-13", "end_time", "E", f"NOT {e('end_time')} AND NOT {unk('end_time')} AND {minutes('end_time')} < {minutes('start_time')}"),
        ("R-14", "supervising", "E", f"NOT {e('supervising')} AND NOT {unk('performing')} AND NOT {reg('supervising')}"),
        ("R-15", "performing", "E", f"NOT {e('performing')} AND NOT {unk('performing')} AND NOT {reg('performing')}"),
        *(("R-15", c, "E", f"{unk('performing')} AND {tasks}") for c in ("performing", "tasks")),
        *(("R-16", c, "E", f"{e('n_surgeons')} AND {tasks} AND NOT {unk('performing')}") for c in ("n_surgeons", "tasks")),
        ("R-17", "tasks", "W", f"{tasks} AND NOT (starts_with(tasks, '{{') AND ends_with(tasks, '}}'))"),
        ("R-17", "tasks", "W", f"{tasks} AND NOT shaped"),
        ("R-17", "tasks", "W", f"{tasks} AND len(tasks) - len(replace(tasks, ':', '')) <> len(tasks) - len(replace(tasks, ';', '')) + 1"),
        ("R-17", "tasks", "E", f"{tasks} AND NOT {parsed}"),
        ("R-18", "tasks", "E", f"{parsed} AND ({unk('performing')} OR NOT {has('performing')})"),
        ("R-19", "tasks", "E", f"{parsed} AND NOT {fits}"),
        ("R-20", "tasks", "E", f"{parsed} AND {fits} AND len([x FOR x IN keys IF NOT list_contains(known, x)]) > 0"),
        *(("R-22", c, "E", f"{e('tasks')} AND NOT {e('n_surgeons')} AND coalesce(TRY_CAST(n_surgeons AS INT), 0) <> 1") for c in ("n_surgeons", "tasks")),
        ("R-23", "tasks", "E", f"{parsed} AND NOT {e('performing')} AND lower(performing) NOT IN ('unknown', 'not-applicable') AND NOT {has('performing')}"),
        ("R-24", "tasks", "W", f"{parsed} AND NOT {e('supervising')} AND lower(supervising) NOT IN ('unknown', 'not-applicable') AND NOT {has('supervising')}"),
        ("R-25", "assessor", "W", f"{want} AND {e('assessor')}"),
        ("R-25", "assessor", "E", f"{want} AND NOT {e('assessor')} AND NOT {reg('assessor')}"),
        ("R-26", "skills_requested", "E", f"{want} AND NOT {e('assessor')} AND lower(skills_requested) <> 'y'"),
        *(("R-27", "assessment_details", "W", f"{want} AND contains(assessment_details, '{i}')") for i in ("surgeon_3", "surgeon_4")),
        ("R-28", "radiology_date", "W", f"NOT {broken} AND lower(radiology_contacted) = 'y' AND {e('radiology_date')}"),
    ]
    said = {"R-14": ("supervising", "supervising surgeon not registered"), "R-15": ("performing", "performing surgeon not registered"), "R-20": ("unnest([x FOR x IN keys IF NOT list_contains(known, x)])", "task of an unregistered surgeon"), "R-25": ("assessor", "assessor not registered")}
    first = {r: (c, w) for r, c, s, w in reversed(rules) if s == "E"}
    valued = "\nUNION ALL ".join(f"SELECT row_id, '{r}' AS rule, '{first[r][0]}' AS col, {v} AS value, '{m}' AS message FROM k WHERE {first[r][1]}" for r, (v, m) in said.items())
    unions = "\nUNION ALL ".join(f"SELECT row_id, '{r}' AS rule, '{c}' AS col, '{s}' AS severity FROM k WHERE {w}" for r, c, s, w in rules)
    return f"""
WITH s AS ({SHEET}),
p AS (SELECT *, regexp_replace(regexp_replace(tasks, '^\\{{', ''), '\\}}$', '') AS inside,
  regexp_matches(tasks, '^\\{{(?:\\s*[^{{}}]+:\\s*[^{{}}]+(?:;\\s*[^{{}}]+:\\s*[^{{}}]+)*\\s*)?\\}}$') AS shaped,
  (SELECT list('surgeon_' || CAST(n_nationkey AS STRING)) FROM nation WHERE n_nationkey < 15) AS known FROM s),
k AS (SELECT *, tasks <> '' AND regexp_matches(tasks, '^\\{{.*\\}}$') AND NOT regexp_matches(trim(inside), '(^|;)\\s*[^:;]*(;|$)') AS readable,
  list_distinct([lower(trim(split_part(x, ':', 1))) FOR x IN string_split(inside, ';')]) AS keys FROM p),
valued AS ({valued}),
issues AS ({unions})
"""


@plans.add(issue_sql() + "SELECT * FROM issues")
def dq_issues_long(spark, sf_dir):
    return Q.issues_long(judged(spark, sf_dir)).select("row_id", "rule", F.col("column").alias("col"), "severity")


@plans.add(issue_sql() + "SELECT * FROM issues")
def dq_registry_issues(spark, sf_dir):
    """The same issues with ids and task keys held against registries of any size, by joins."""
    users, sites, groups, surgeons = registries(spark, sf_dir)
    flagged = Q.with_task_facts(Q.join_registries(sheet(spark, sf_dir), users, sites, groups, surgeons))
    known = table(spark, sf_dir, "nation").where("n_nationkey IN (3, 4)")
    ids = known.select(F.concat(F.lit("surgeon_"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("2_25_"), F.col("n_nationkey").cast("string")).alias("uid"), F.col("n_nationkey").cast("bigint").alias("place"))
    facts = Q.with_registry_facts(flagged, ids, surgeons, keep=kept_in(scratch(spark, "registry-facts")))
    return Q.issues_long(Q.with_issues(facts, Q.sheet_rules(joined=True))).select("row_id", "rule", F.col("column").alias("col"), "severity")


MATRIX = ("filer", "operation_date", "supervising", "performing", "tasks", "n_surgeons", "assessor", "skills_requested")


@plans.add(
    issue_sql() + "SELECT s.row_id, " + ", ".join(f"coalesce(max(CASE WHEN col = '{c}' AND severity = 'E' THEN 'E' END), '') || coalesce(max(CASE WHEN col = '{c}' AND severity = 'W' THEN 'W' END), '') AS {c}" for c in MATRIX)
    + " FROM s LEFT JOIN issues i ON i.row_id = s.row_id GROUP BY s.row_id"
)
def dq_summary_matrix(spark, sf_dir):
    return Q.summary_matrix(judged(spark, sf_dir), list(MATRIX))


@plans.add(
    issue_sql() + """SELECT s.row_id, s.row_id + 2 AS sheet_row,
coalesce(string_agg(rule || ':' || col, '|' ORDER BY rule, col) FILTER (WHERE severity = 'E'), '') AS errors,
coalesce(string_agg(rule || ':' || col, '|' ORDER BY rule, col) FILTER (WHERE severity = 'W'), '') AS warnings
FROM s LEFT JOIN issues i ON i.row_id = s.row_id GROUP BY s.row_id"""
)
def dq_row_rollup(spark, sf_dir):
    rows = Q.roll_up(judged(spark, sf_dir))
    return rows.select("row_id", "sheet_row", F.array_join(F.array_sort("errors"), "|").alias("errors"), F.array_join(F.array_sort("warnings"), "|").alias("warnings"))


@plans.add(
    issue_sql() + """SELECT (SELECT count(*) FROM s) AS n_rows, count(*) FILTER (WHERE severity = 'E') AS n_errors, count(*) FILTER (WHERE severity = 'W') AS n_warnings,
count(DISTINCT row_id) FILTER (WHERE severity = 'E') AS rows_with_errors, count(DISTINCT row_id) FILTER (WHERE severity = 'W') AS rows_with_warnings,
count(*) FILTER (WHERE severity = 'E') = 0 AS permitted FROM issues"""
)
def dq_permission(spark, sf_dir):
    return Q.totals(judged(spark, sf_dir))


@plans.add(
    issue_sql() + """SELECT col, severity, count(*) AS n_issues, count(DISTINCT row_id) AS n_rows,
string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM issues GROUP BY col, severity"""
)
def dq_issue_cells(spark, sf_dir):
    issues = Q.issues_long(judged(spark, sf_dir))
    return issues.groupBy(F.col("column").alias("col"), "severity").agg(
        F.count("*").alias("n_issues"), F.countDistinct("row_id").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules")
    )


@plans.add(
    issue_sql() + """SELECT rule || ' ' || severity || ' ' || col || ': ' || CAST(count(*) AS STRING) AS line FROM issues GROUP BY rule, severity, col"""
)
def dq_report_lines(spark, sf_dir):
    issues = Q.issues_long(judged(spark, sf_dir)).groupBy("rule", "severity", "column").agg(F.count("*").alias("n"))
    return issues.select(F.concat(F.concat_ws(" ", "rule", "severity", "column"), F.lit(": "), F.col("n").cast("string")).alias("line"))


@plans.add(
    issue_sql() + """SELECT row_id FROM issues GROUP BY row_id HAVING count(*) FILTER (WHERE severity = 'E') > 0 AND count(*) FILTER (WHERE severity = 'W') > 0"""
)
def dq_rows_with_both(spark, sf_dir):
    return Q.rows_where(judged(spark, sf_dir), "both").select("row_id")


@plans.add(f"""
SELECT row_id, {", ".join(f"CASE WHEN {c} IS NULL OR {c} IN ('', ' ') THEN 'unknown' ELSE {c} END AS {c}" for c in Q.FILLED)},
replace(replace(unusual, 'surgeon_3', 'HAWKID=2_25_3'), 'surgeon_4', 'HAWKID=2_25_4') AS unusual FROM ({SHEET}) s
""")
def dq_filled(spark, sf_dir):
    """The sheet after the rules: blanks filled, identifiers in free text encoded."""
    filled = Q.fill_blanks(sheet(spark, sf_dir))
    return filled.select("row_id", *Q.FILLED, X.encode_ids(F.col("unusual"), IDS).alias("unusual"))


@plans.add(f"""
WITH s AS ({SHEET}),
t AS (SELECT *, (SELECT list('surgeon_' || CAST(n_nationkey AS STRING)) FROM nation WHERE n_nationkey < 15) AS known,
 list_distinct(regexp_extract_all(tasks, '([a-zA-Z0-9_]+)\\s*:\\s*([^,{{}}]+)', 1)) AS keys FROM s)
SELECT row_id, list_aggregate([x FOR x IN [
 CASE WHEN filer NOT IN (SELECT c_name FROM customer WHERE c_custkey % 3 <> 0) THEN 'S-01' END,
 CASE WHEN operation_date = '' THEN 'S-02' END,
 CASE WHEN operation_date <> '' AND NOT regexp_matches(operation_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'S-03' END,
 CASE WHEN lower(quality) NOT IN ('usable', 'unusable', 'questionable', 'unknown', '') THEN 'S-04' END,
 CASE WHEN institution NOT IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'S-05' END,
 CASE WHEN procedure NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW') THEN 'S-06' END,
 CASE WHEN start_time = '' THEN 'S-07' END,
 CASE WHEN end_time <> '' AND end_time < start_time THEN 'S-08' END,
 CASE WHEN upper(side) NOT IN ('RIGHT', 'LEFT', 'BOTH', 'UNKNOWN') THEN 'S-09' END,
 CASE WHEN NOT list_contains(known, lower(supervising)) THEN 'S-10' END,
 CASE WHEN upper(presence) NOT IN ('PRESENT', 'RETROSPECTIVE_REVIEW', 'OTHER-SEE_ADDITIONAL_COMMENTS') THEN 'S-11' END,
 CASE WHEN NOT list_contains(known, lower(performing)) THEN 'S-12' END,
 CASE WHEN NOT coalesce(TRY_CAST(years AS INT) > 0, FALSE) THEN 'S-13' END,
 CASE WHEN NOT coalesce(TRY_CAST(prior_cases AS INT) >= 0, FALSE) THEN 'S-14' END,
 CASE WHEN NOT coalesce(TRY_CAST(n_surgeons AS INT) >= 0, FALSE) THEN 'S-15' END,
 CASE WHEN NOT regexp_matches(tasks, '^\\{{(?:\\s*([a-zA-Z0-9_]+)\\s*:\\s*([^,{{}}]+)\\s*,)*\\s*([a-zA-Z0-9_]+)\\s*:\\s*([^,{{}}]+)\\s*\\}}$') THEN 'S-16' END,
 CASE WHEN len([k FOR k IN keys IF NOT list_contains(known, k)]) > 0 THEN 'S-17' END,
 CASE WHEN NOT coalesce(len(keys) = TRY_CAST(n_surgeons AS INT), FALSE) THEN 'S-18' END] IF x IS NOT NULL], 'string_agg', ',') AS failed FROM t
""")
def dq_form_checks(spark, sf_dir):
    users, sites, groups, surgeons = registries(spark, sf_dir)
    flagged = Q.join_form_registries(Q.spread(sheet(spark, sf_dir)), users, sites, groups, surgeons)
    known = surgeons.agg(F.collect_set("NAME").alias("surgeon_names"))  # one row, the registry
    checked = Q.with_issues(flagged.crossJoin(known), Q.form_checks(F.col("surgeon_names")))
    failed = F.array_join(F.array_distinct(F.transform("issues", lambda i: i["rule"])), ",")
    return checked.select("row_id", F.when(F.size("issues") > 0, failed).alias("failed"))


@plans.add(f"SELECT row_id, coalesce(TRY_CAST(years AS INT) BETWEEN 1 AND 50, FALSE) AS years, coalesce(TRY_CAST(prior_cases AS INT) BETWEEN 0 AND 500, FALSE) AS prior_cases, coalesce(TRY_CAST(n_surgeons AS INT) BETWEEN 1 AND 1000, FALSE) AS n_surgeons FROM ({SHEET}) s")
def dq_prompt_ranges(spark, sf_dir):
    return sheet(spark, sf_dir).select("row_id", *(Q.in_prompt_range(c).alias(c) for c in Q.PROMPT_RANGES))


@plans.add(f"SELECT row_id, CAST(len(tasks) - len(replace(tasks, ':', '')) AS BIGINT) AS colons, CAST(len(tasks) - len(replace(tasks, ';', '')) AS BIGINT) AS semicolons FROM ({SHEET}) s")
def task_char_counts(spark, sf_dir):
    return sheet(spark, sf_dir).select("row_id", X.count_char(F.col("tasks"), ":").cast("bigint").alias("colons"), X.count_char(F.col("tasks"), ";").cast("bigint").alias("semicolons"))


@plans.add(
    issue_sql().split("issues AS")[0].rstrip().rstrip(",") + """
SELECT row_id, CASE WHEN readable THEN array_to_string(list_sort(keys), ',') END AS keys, readable FROM k WHERE tasks <> ''"""
)
def taskmap_semicolon(spark, sf_dir):
    parsed = Q.once(sheet(spark, sf_dir).where("tasks <> ''"), m=X.task_map(F.col("tasks")))
    return parsed.select("row_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.col("m").isNotNull().alias("readable"))


@plans.add(f"""
SELECT row_id, array_to_string([x[1] || '=' || trim(x[2]) FOR x IN [[regexp_extract(y, '(\\w+)\\s*:\\s*([^,{{}}]*)', 1), regexp_extract(y, '(\\w+)\\s*:\\s*([^,{{}}]*)', 2)] FOR y IN regexp_extract_all(tasks, '(\\w+)\\s*:\\s*([^,{{}}]*)')]], '|') AS pairs
FROM ({SHEET}) s WHERE tasks <> ''
""")
def taskmap_comma(spark, sf_dir):
    m = X.task_map_by_comma(F.col("tasks"))
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return sheet(spark, sf_dir).where("tasks <> ''").select("row_id", F.array_join(pairs, "|").alias("pairs"))


def nearest_sql(values: str, names: str, cutoff: float = 0.6) -> str:
    """``value, name, ratio`` of the best name by matching blocks, all pairs compared: the longest common block, the
    first in the name and then in the value, and again on both sides of it."""
    block = (
        "list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(list_filter(range(blo, bhi), lambda j: substr(name, i, 1) = substr(value, j, 1)), lambda j: "
        "struct_pack(k := list_max(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(name, i, n) = substr(value, j, n))), i := -i, j := -j)))))"
    )
    return f"""
WITH RECURSIVE pv AS (SELECT DISTINCT value FROM ({values}) v0 WHERE value IS NOT NULL), pn AS (SELECT DISTINCT name FROM ({names}) n0 WHERE name IS NOT NULL),
blocks AS (
  SELECT value, name, 1 AS alo, length(name) + 1 AS ahi, 1 AS blo, length(value) + 1 AS bhi FROM pv, pn
  UNION ALL
  SELECT value, name, CASE WHEN side = 0 THEN alo ELSE b.k - b.i END, CASE WHEN side = 0 THEN -b.i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE b.k - b.j END, CASE WHEN side = 0 THEN -b.j ELSE bhi END
  FROM (SELECT *, {block} AS b FROM blocks WHERE alo < ahi AND blo < bhi) f, (SELECT unnest([0, 1]) AS side) s WHERE b IS NOT NULL),
found AS (
  SELECT value, name, CASE WHEN length(value) + length(name) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(sum(CASE WHEN alo < ahi AND blo < bhi THEN {block}.k END), 0) / (length(value) + length(name)) END AS ratio
  FROM blocks GROUP BY value, name)
SELECT value, name, ratio FROM found WHERE ratio >= {cutoff} QUALIFY row_number() OVER (PARTITION BY value ORDER BY ratio DESC, name DESC) = 1"""


@plans.add(issue_sql() + f"""
SELECT v.row_id, v.rule, v.col, v.value, n.name AS suggestion, CASE WHEN n.name IS NULL THEN v.message ELSE v.message || '; did you mean ' || n.name || '?' END AS message
FROM valued v LEFT JOIN ({nearest_sql("SELECT upper(value) AS value FROM valued", "SELECT upper('surgeon_' || CAST(n_nationkey AS STRING)) AS name FROM nation WHERE n_nationkey < 15")}) n ON n.value = upper(v.value)""")
def dq_suggestions(spark, sf_dir):
    """Unregistered surgeons with the closest registered one."""
    issues = Q.issues_long(judged(spark, sf_dir))
    return Q.with_suggestions(issues, registries(spark, sf_dir)[3], keep=kept_in(scratch(spark, "suggestions"))).select("row_id", "rule", F.col("column").alias("col"), "value", "suggestion", "message")


#: Part names as they may be misspelt, in SQL that both engines read.
MISSPELT = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN concat(substr(p_name, 1, 3), 'x', substr(p_name, 4))
  WHEN 3 THEN concat(substr(p_name, 4), substr(p_name, 1, 3)) WHEN 4 THEN replace(p_name, 'l', 'll') ELSE concat('zq', substr(p_name, 6, 2)) END AS value FROM part"""


@plans.add(f"SELECT p_partkey, m.value, name, ratio FROM ({MISSPELT}) m LEFT JOIN ({nearest_sql(f'SELECT value FROM ({MISSPELT}) x', 'SELECT p_name AS name FROM part')}) n ON n.value = m.value")
def fuzzy_nearest(spark, sf_dir):
    """Misspelt part names with the closest registered one, by a similarity join on the distinct names."""
    part = table(spark, sf_dir, "part")
    given = spark.sql(MISSPELT.replace("FROM part", "FROM {part}"), part=part)
    return given.join(nearest(given, part.select(F.col("p_name").alias("name")), keep=kept_in(scratch(spark, "nearest"))), "value", "left").select("p_partkey", "value", "name", "ratio")


@plans.add(f"""
SELECT row_id, supervising, name AS suggestion FROM (SELECT row_id, supervising FROM ({SHEET}) s WHERE supervising <> '') o
LEFT JOIN ({nearest_sql(f"SELECT supervising AS value FROM ({SHEET}) s WHERE supervising <> ''", "SELECT 'surgeon_' || CAST(n_nationkey AS STRING) AS name FROM nation WHERE n_nationkey < 15")}) n ON n.value = o.supervising""")
def fuzzy_suggest(spark, sf_dir):
    """The closest identifier of the registry, by matching blocks."""
    odd = sheet(spark, sf_dir).select("row_id", "supervising").where("supervising <> ''")
    found = nearest(odd.select(F.col("supervising").alias("value")), registries(spark, sf_dir)[3].select(F.col("NAME").alias("name")), keep=kept_in(scratch(spark, "suggest")))
    return odd.join(found.select(F.col("value").alias("supervising"), F.col("name").alias("suggestion")), "supervising", "left").select("row_id", "supervising", "suggestion")


QUERIES, ORACLES = plans.queries, plans.oracles
