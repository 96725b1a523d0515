"""The similarity join against comparing all pairs by the library."""

import difflib
import random

import pytest

from casewright.operators import quality, similar


def brute(values, names, cutoff):
    out = {}
    for v in {v for v in values if v is not None}:
        found = difflib.get_close_matches(v, sorted({n for n in names if n is not None}), 1, cutoff)
        if found:
            out[v] = found[0]
    return out


def run(spark, values, names, cutoff):
    left = spark.createDataFrame([(v,) for v in values], "value string")
    right = spark.createDataFrame([(n,) for n in names], "name string")
    return left, right, {r.value: (r.name, r.ratio) for r in similar.nearest(left, right, cutoff).collect()}


@pytest.mark.parametrize("cutoff", [0.25, 0.6, 0.9])
def test_equals_all_pairs(spark, cutoff):
    r = random.Random(int(cutoff * 100))
    word = lambda: "".join(r.choice("abcdé_1") for _ in range(r.randint(1, 14)))
    names = [word() for _ in range(120)] + [None, "", "𝔸b"]
    values = [word() for _ in range(60)] + [n[1:] + "x" for n in names[:40]] + [None, "", "zzz", "𝔸", names[0], names[0]]
    _, _, got = run(spark, values, names, cutoff)
    want = brute(values, names, cutoff)
    assert {v: n for v, (n, _) in got.items()} == want
    assert all(abs(x - difflib.SequenceMatcher(None, n, v).ratio()) < 1e-12 for v, (n, x) in got.items())


def test_candidates_are_few(spark):
    r = random.Random(2)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(6, 16))) for _ in range(400)]
    values = [n[:-2] + "q" for n in names[:50]]
    left, right, got = run(spark, values, names, 0.6)
    assert {v: n for v, (n, _) in got.items()} == brute(values, names, 0.6)
    assert similar.candidate_pairs(left, right, 0.6).count() < 0.2 * 50 * 400


def test_suggestions_from_a_registry(spark):
    rows = [(0, ["surgeon_on", "zzz"]), (1, ["othr"]), (2, None), (3, [])]
    issues = spark.createDataFrame(rows, "row_id int, values array<string>").selectExpr("*", "'unknown' AS message")
    names = ["Surgeon_One", "SURGEON_TWO", "other"]
    registry = spark.createDataFrame([(n,) for n in names], "NAME string")
    by_frame = {(r.row_id, r.value, r.suggestion, r.message) for r in quality.with_suggestions(issues, registry).collect()}
    assert by_frame == {(r.row_id, r.value, r.suggestion, r.message) for r in quality.with_suggestions(issues, names).collect()}
    assert (0, "surgeon_on", "SURGEON_ONE", "unknown; did you mean SURGEON_ONE?") in by_frame
