"""Source mixing, conversation repair and hard negatives: brute force, SQL twins and edges."""

import functools
import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.llm import hard_negatives, source_mix, turn_repair
from casewright.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    left = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    assert sorted(names) == sorted(got.columns) and left == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr) and left


# --- source mix ------------------------------------------------------------------------------------


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * each > cap * sizes[s]}
        if not over:
            target |= {s: weight[s] * each for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_equals_its_definition(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randint(1, 9) for _ in range(r.choice((0, 1, 5, 60)))), r.choice(["b", "a", "é", "", None, "z"])) for i in range(400)]
    rows += [(1000 + i, "same text", "hot") for i in range(300)] + [(7, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (5, "\t\n\x0b\f\r x", "lone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("key_", F.lit(1)).withColumn("size", F.lit("x"))
    got = [x.asDict() for x in source_mix.mix(df).collect()]
    assert len(got) == len(rows)
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    want, longest = fill(sizes), {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    for s, t in want.items():
        own = [x for x in got if x["source"] == s]
        assert all(abs(x["target"] - t) < 1e-6 and x["source_size"] == sizes[s] and 0 <= x["copies"] <= 2 for x in own)
        assert abs(sum(x["copies"] * x["size"] for x in own) - t) <= longest[s] + 1e-6
    again = source_mix.mix(df.repartition(7)).select("doc_id", "size", "copies")
    assert sorted(map(repr, again.collect())) == sorted(repr(x) for x in source_mix.mix(df).select("doc_id", "size", "copies").collect())
    mixed = source_mix.mix(df)
    assert source_mix.emitted(mixed).count() == sum(x["copies"] for x in got)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert source_mix.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [(x.size, x.target, x.copies) for x in source_mix.mix(blank).collect()] == [(0, 0.0, 0)] * 2


# --- conversation repair -----------------------------------------------------------------------------


def cheapest(initials, faults):
    """Cost and audit by trying every edit of every turn, insertions wherever they may help."""

    @functools.cache
    def best(i, state):
        options = [(0, "")] if i == len(initials) and state in "oa" else []
        after = {"o": "su", "s": "u", "u": "a", "a": "u"}
        for role in "ua":
            if role in after[state]:
                cost, audit = best_inserted(i, role)
                options.append((cost + 2, "I" + audit))
        if i < len(initials):
            cost, audit = best(i + 1, state)
            options.append((cost + 3, "D" + audit))
            if faults[i] not in (1, 2):
                for role in "sua":
                    if role in after[state] and (role == initials[i] or role != "s"):
                        cost, audit = best(i + 1, role)
                        kept = role == initials[i]
                        options.append((cost + (0 if kept else 2) + (faults[i] == 3), ("K" if kept else "R") + audit))
                        if kept and role != "s":
                            options.append((cost + 2 + (faults[i] == 3), "R" + audit))
        return min(options) if options else (10**6, "")

    @functools.cache
    def best_inserted(i, role):
        # Two insertions in a row are enough: what a third one gives, the first one had given.
        options = [(0, "")] if i == len(initials) and role == "a" else []
        other = {"u": "a", "a": "u"}[role]
        cost, audit = after_insert(i, other)
        options.append((cost, audit))
        if i < len(initials):
            cost, audit = best_inserted(i + 1, role)
            options.append((cost + 3, "D" + audit))
        return min(options)

    @functools.cache
    def after_insert(i, role):
        """The next turn is ``role``, retained or inserted."""
        options = []
        if i < len(initials) and faults[i] not in (1, 2):
            cost, audit = best(i + 1, role)
            kept = initials[i] == role
            options.append((cost + (0 if kept else 2) + (faults[i] == 3), ("K" if kept else "R") + audit))
        if i < len(initials):
            cost, audit = after_insert(i + 1, role)
            options.append((cost + 3, "D" + audit))
        if role == "a":
            cost, audit = closing(i)
            options.append((cost + 2, "I" + audit))
        return min(options) if options else (10**6, "")

    @functools.cache
    def closing(i):
        return min([(0, "")] if i == len(initials) else [(3 + closing(i + 1)[0], "D" + closing(i + 1)[1]), after_insert(i, "u")])

    return best(0, "o")


def every_edit(initials, faults):
    """The same by plain enumeration: up to two insertions before each turn and at the end."""
    found = []
    for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(initials) + 1):
        for edits in itertools.product("KDua", repeat=len(initials)):
            if any(f in (1, 2) and e != "D" for f, e in zip(faults, edits)):
                continue
            roles, audit, cost = "", "", 0
            for i, e in enumerate((*edits, None)):
                # Deletions go before insertions, which is the least order of equals.
                roles, audit, cost = roles + inserts[i], audit + "I" * len(inserts[i]), cost + 2 * len(inserts[i])
                if e == "D":
                    audit, cost = audit + "D", cost + 3
                elif e:
                    roles, audit = roles + (initials[i] if e == "K" else e), audit + ("K" if e == "K" else "R")
                    cost += (0 if e == "K" else 2) + (faults[i] == 3)
            body = roles[1:] if roles[:1] == "s" else roles
            if roles == "" or body and body == "ua" * (len(body) // 2):
                found.append((cost, audit))
    return min(found)


def planned(initials, faults):
    plan = turn_repair._Plan(1)
    for i, (x, f) in enumerate(zip(initials, faults)):
        plan.add(i, x, f)
    row = plan.finish()
    return row[6], row[7]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_plan_equals_enumeration(n):
    r = random.Random(n)
    cases = list(itertools.product(itertools.product("suax", repeat=n), itertools.product((0, 1, 3), repeat=n)))
    for initials, faults in r.sample(cases, min(len(cases), 40 if n == 3 else 200)):
        assert planned(initials, faults) == every_edit(initials, faults), (initials, faults)


@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14))
@settings(max_examples=150, deadline=None)
def test_plan_cost_equals_a_recursion(turns):
    initials, faults = tuple(x for x, _ in turns), tuple(f for _, f in turns)
    assert planned(initials, faults)[0] == cheapest(initials, faults)[0]


def test_repair_of_odd_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 2, None, None), (1, None, "system", "Be kind."), (2, 5, "assistant", "no end"), (None, 1, "user", "Q?"), (None, 2, "assistant", "A.")]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("alive", F.lit(True)).withColumn("fault", F.lit("x")).drop("fault")
    got = {r.conv_id: r for r in turn_repair.summary(df).collect()}
    assert (got[1].audit, got[1].cost, got[1].blank, got[1].duplicate, got[1].gaps) == ("KKDDI", 8, 1, 1, 1)
    assert got[1].repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:").hexdigest()
    assert (got[2].audit, got[2].cost, got[2].truncated) == ("D", 3, 1) and (got[None].audit, got[None].cost) == ("KK", 0)
    assert got[3].audit == "K" * 3000 and got[3].illegal == 0
    judged = turn_repair.with_faults(df)
    texts = turn_repair.repaired_turns(judged, turn_repair.plan_repairs(judged)).where("conv_id = 1").orderBy("place").collect()
    assert [(t.role, t.text) for t in texts] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "")]
    assert turn_repair.summary(df.limit(0)).count() == 0


def test_a_dropped_conversation_keeps_its_row(spark):
    import zlib

    k = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(k, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    row = turn_repair.summary(turn_repair.damage(df)).first()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256) == (k, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- hard negatives ----------------------------------------------------------------------------------


def mined(rows):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda i: (i is None, i or 0)
    out = []
    for a, (ai, av, al) in enumerate(ok):
        if ai is None or ai % 100:
            continue
        score = [sum(x * y for x, y in zip(av, bv)) for _, bv, _ in ok]
        ranked = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-score[b], order(ok[b][0])))
        for p in [b for b in ranked if ok[b][2] == al][:5]:
            hard = [b for b in ranked if ok[b][2] != al and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:10]
            out += [(ai, ok[p][0], k + 1, ok[b][0], score[p], score[b]) for k, b in enumerate(hard)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [16, 1024])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", least)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    r = np.random.default_rng(9)
    base = r.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in base[i % 6] + 0.4 * r.normal(size=8)], int(i % 3)) for i in range(0, 300)] + [(100, [float(x) for x in base[4]], 1)] * 2
    rows += [(500, [0.5] * 8, 1), (501, [0.5] * 8, 1), (502, [0.5] * 8, 2), (600, None, 1), (601, [1.0, None], 1), (700, [float("nan")] * 8, 1), (800, [float("inf")], 2), (900, [1.0], None)]
    rows += [(None, [0.4] * 8, 2), (1000, [0.3] * 5, 0), (1100, [], 0), (1200, [-3.0] * 8, 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("q", F.lit(1)).withColumn("row_key", F.lit("x"))
    found = hard_negatives.hard_negatives(hard_negatives.quantised(df.select("vec_id", "embedding", "label")), F.col("vec_id") % 100 == 0)
    assert sorted((tuple(x) for x in found.collect()), key=repr) == mined(rows)
    assert hard_negatives.hard_negatives(hard_negatives.quantised(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


@given(st.integers(0, 2**31), st.integers(1, 12), st.sampled_from([3, 300, 70_000]))
@settings(max_examples=60, deadline=None)
def test_planes_give_the_best_of_every_window(seed, k, reach):
    r = np.random.default_rng(seed)
    rows, asked = r.integers(-reach, reach + 1, (60, 7)), r.integers(-reach, reach + 1, (4, 7))
    ids = r.permutation(60)
    allowed = r.random((4, 60)) < 0.8
    exact = asked @ rows.T
    low = np.sort(r.choice(exact.ravel(), (4, 3)), 1).astype(float)
    high = low + reach * r.integers(0, 9, (4, 3))
    found = list(hard_negatives.best_in_windows(asked, hard_negatives.Planes(rows), allowed, low, high, k, ids))
    for a in range(4):
        for w in range(3):
            want = sorted((i for i in range(60) if allowed[a, i] and low[a, w] <= exact[a, i] <= high[a, w]), key=lambda i: (-exact[a, i], ids[i]))[:k]
            assert [(x[2], x[3]) for x in found if x[:2] == (a, w)] == [(i, int(exact[a, i])) for i in want]


# --- the pipeline on odd rows --------------------------------------------------------------------------


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as pipeline

    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    clean = " ".join(f"plain{i} words{i % 7} about{i * 3} gardens" for i in range(60))
    long_ = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))
    odd = [(1_000_001, None), (1_000_002, ""), (1_000_003, " \t\n"), (None, "one lone text without an id"), (1_000_004, clean), (1_000_004, clean), (1_000_005, clean), (1_000_006, long_)]
    rows = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in odd], columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows).withColumn("key", F.lit(1)).withColumn("body", F.lit("x"))
    given = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        docs = pipeline.staged(stage(spark, docs, SF), f"odd-{name}")
        after = docs.collect()
        assert docs.columns == given and {r.doc_id for r in after} <= {i for i, _ in before}, name
        assert 1_000_006 in {r.doc_id for r in after} and all(r.n_chars == len(r.text) for r in after if r.text and name == "repeated_passages"), name
        if name == "near_duplicates":
            assert sum(r.text == clean for r in after) == 1
        docs = docs.repartition(3)
    tokens = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == docs.count() and all(r.n_tokens == len(r.ids) for r in tokens)
