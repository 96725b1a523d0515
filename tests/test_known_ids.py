"""Known ids in free text by n-grams against the sequential rule."""

import random

import pytest

from casewright.operators import known_ids


def sequential(text, ids, prefix="HAWKID="):
    used = []
    for i, uid in ids:
        if i and text is not None and i in text:
            used.append(i)
            text = text.replace(i, prefix + uid)
    return text, used


def run(spark, texts, ids, **more):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row_key bigint, text string")
    registry = spark.createDataFrame([(i, u, k) for k, (i, u) in enumerate(ids)], "id string, uid string, place bigint")
    return {r.row_key: (r.encoded, r.found) for r in known_ids.encode_known(rows, registry, **more).collect()}


def test_equals_the_sequential_rule(spark):
    r = random.Random(5)
    ids = [("".join(r.choice("abH=2_") for _ in range(r.randint(1, 9))), f"2_{k}") for k in range(60)]
    texts = ["".join(r.choice("abcH=_2 ") for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", " "]
    got = run(spark, texts, ids, size=4)
    # A repeated id is replaced once: its first entry counts.
    first = list({i: (i, u) for i, u in reversed(ids)}.values())[::-1]
    first = sorted(first, key=lambda x: [i for i, _ in ids].index(x[0]))
    for k, t in enumerate(texts):
        assert got[k] == sequential(t, first), (k, t)


@pytest.mark.parametrize(("text", "ids", "want"), [
    ("seen by ann", [("ann", "x_bob"), ("bob", "9")], "seen by HAWKID=x_HAWKID=9"),
    ("seen by ann", [("bob", "9"), ("ann", "x_bob")], "seen by HAWKID=x_bob"),
    ("annann", [("ann", "1"), ("1H", "2")], "HAWKID=HAWKID=2AWKID=1"),
    ("ab", [("a", "1"), ("b", "2"), ("=1HAW", "3")], "HAWKIDHAWKID=3KID=2"),
])
def test_ids_that_come_up_by_a_replacement(spark, text, ids, want):
    assert run(spark, [text], ids)[0][0] == want == sequential(text, ids)[0]


def test_no_ids_and_odd_ids(spark):
    assert run(spark, ["a", None], []) == {0: ("a", []), 1: (None, None)} or run(spark, ["a", None], [])[0] == ("a", [])
    assert run(spark, ["a b"], [("", "1"), (None, "2"), ("a b", "3")])[0] == ("HAWKID=3", ["a b"])


def test_the_plan_does_not_grow_with_the_registry(spark):
    def size(n):
        rows = spark.createDataFrame([(0, "x")], "row_key bigint, text string")
        ids = spark.range(n).selectExpr("concat('surgeon_', id) AS id", "cast(id AS string) AS uid", "id AS place")
        return len(known_ids.encode_known(rows, ids)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(5) - size(100_000)) < 200


def test_a_hundred_thousand_ids(spark):
    r = random.Random(1)
    ids = [(f"surgeon_{k:06d}", f"2_25_{k}") for k in range(100_000)]
    texts = [" and ".join(f"surgeon_{r.randrange(120_000):06d} cut" for _ in range(5)) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row_key bigint, text string")
    registry = spark.range(100_000).selectExpr("concat('surgeon_', lpad(id, 6, '0')) AS id", "concat('2_25_', id) AS uid", "id AS place")
    got = {x.row_key: x.encoded for x in known_ids.encode_known(rows, registry, size=8).collect()}
    import re

    known = dict(ids)
    for k, t in enumerate(texts):
        assert got[k] == re.sub(r"surgeon_\d{6}", lambda m: "HAWKID=" + known[m[0]] if m[0] in known else m[0], t)


def test_rules_by_joins_equal_rules_by_lists(spark):
    from pyspark.sql import functions as F

    from casewright.operators import quality as Q
    from casewright.plans import dq

    sf = "/root/testdata/sf0.001"
    users, sites, groups, surgeons = dq.registries(spark, sf)
    flagged = Q.with_task_facts(Q.join_registries(dq.sheet(spark, sf), users, sites, groups, surgeons))
    ids = spark.createDataFrame([(i, u, n) for n, (i, u) in enumerate(dq.IDS)], "id string, uid string, place bigint")
    joined = Q.with_issues(Q.with_registry_facts(flagged, ids, surgeons), Q.sheet_rules(joined=True))
    listed = dq.judged(spark, sf)
    rows = lambda df: {r.row_id: [(i.rule, i.column, i.severity, i.message, i["values"]) for i in r.issues] for r in df.select("row_id", "issues").collect()}
    assert rows(joined) == rows(listed)

    def size(n):
        many = spark.range(n).select(F.concat(F.lit("name_"), F.col("id").cast("string")).alias("NAME"))
        known = many.select(F.col("NAME").alias("id"), F.lit("u").alias("uid"), F.monotonically_increasing_id().alias("place"))
        return len(Q.with_issues(Q.with_registry_facts(flagged, known, many), Q.sheet_rules(joined=True))._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(3) - size(5000)) < 2000
