"""Deduplication, decontamination, fingerprints, language model, pipeline: brute force and edges."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st

from casewright.llm import components, decontaminate, pitman_yor, simhash, suffix_dedup, weighted_fingerprint
from casewright.llm._common import word_hashes
from casewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


@given(st.lists(st.text("aB \n\té.1", max_size=20), max_size=5))
@settings(max_examples=100, deadline=None)
def test_word_hashes(texts):
    h, n = word_hashes(texts)
    flat = [w for t in texts for w in words(t)]
    assert n.tolist() == [len(words(t)) for t in texts] and len(h) == len(flat)
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


# --- components ----------------------------------------------------------------------------------


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 20)] + [(30, 31)], [(5, 4), (4, 5), (6, 6)], []])
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: find(x) for x in root if find(x) != x}
    assert {k: v for k, v in got.items() if k != v} == want


# --- simhash ---------------------------------------------------------------------------------------


def brute_groups(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_simhash(t, width=3):
    w = words(t)
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_simhash(r.text) for r in docs}
    want = brute_groups(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_crowded_blocks_lose_no_link(spark, hot):
    r = random.Random(hot)
    base = [r.getrandbits(64) for _ in range(3)]
    prints = {}
    for i in range(60):
        f = r.choice(base)
        for _ in range(r.randint(0, 5)):
            f ^= 1 << r.randrange(64)
        prints[i] = f
    prints = {i: f for f, i in {f: i for i, f in sorted(prints.items(), reverse=True)}.items()}
    nodes = spark.createDataFrame([(i, f if f < 1 << 63 else f - (1 << 64)) for i, f in prints.items()], "node bigint, fp bigint")
    for distance in (1, 2):
        linked = components.components(simhash.links(nodes, distance, hot))
        got = {i: i for i in prints} | {x.node: x.component for x in linked.collect()}
        assert got == brute_groups(prints, distance)


def test_simhash_edges(spark, frame, odd_rows):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(odd_rows)).collect()]
    assert len(got) == len(odd_rows)
    by = collections.defaultdict(set)
    for i, fp, c in got:
        by[i].add((fp, c))
    assert by[1] == by[2] == {(next(iter(by[1]))[0], 1)} and by[3] == by[4] == by[5] == {(0, 3)} and by[8] == by[7]
    assert by[None] == {(next(iter(by[None]))[0], None)} and simhash.near_duplicates(frame([])).count() == 0


def test_near_copies_leave_one(spark, frame):
    r = random.Random(4)
    rows = []
    for g in range(12):
        w = [f"v{r.randrange(5000)}" for _ in range(300)]
        for c in range(4):
            x = list(w)
            for _ in range(2 * (c > 1)):
                x[r.randrange(300)] = "edited"
            rows.append((g * 10 + c, " ".join(x)))
    kept = simhash.keep_one_of_each(frame(rows + rows[:3] + [(None, "x"), (None, "x")]))
    ids = sorted(x.doc_id for x in kept.collect() if x.doc_id is not None)
    assert ids == [g * 10 for g in range(12)] and kept.where("doc_id IS NULL").count() == 1
    assert simhash.keep_one_of_each(frame([])).count() == 0
    odd = [(1, "p q r s t u"), (1, "another text under that id"), (1, "p q r s t u"), (2, "p q r s t u"), (None, "p q r s t u"), (None, "alone"), (3, None), (4, "")]
    left = simhash.keep_one_of_each(frame(odd, extra=False))
    assert sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == [(0, "alone"), (1, "another text under that id"), (1, "p q r s t u"), (3, "")]


def test_null_ids_link(spark, frame):
    """Two texts that meet only through a row without an id are one class, named by the smaller id."""
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts, r = {}, random.Random(2)
    while len(texts) < 4000:
        w = list(base)
        for _ in range(r.randint(1, 2)):
            w[r.randrange(26)] = r.choice("abcdef")
        texts.setdefault(simhash.fingerprint(" ".join(w)), " ".join(w))
    near = lambda x, y: (x ^ y).bit_count() <= 2
    found = next((x, y, z) for y in texts for x in texts for z in texts if x < z and y not in (x, z) and near(x, y) and near(y, z) and not near(x, z))
    rows = [(5, texts[found[0]]), (None, texts[found[1]]), (3, texts[found[2]])]
    assert {r.component_id for r in simhash.near_duplicates(frame(rows)).collect()} == {3}


@pytest.mark.parametrize("hot", [1, 64])
def test_near_copies_are_those_of_exact_similarity(spark, frame, hot):
    """All pairs at 0.8 or more of scattered and contiguous edits are found, none under 0.8 is linked."""
    r = random.Random(8)
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, want = [], {}
    for g in range(240):
        own = [f"v{r.randrange(5000)}" for _ in range(300)]
        copy, share = list(own), r.uniform(0.03, 0.15)
        if g % 3 == 0:
            for k in r.sample(range(300), int(share * 300 / 5) + 1):
                copy[k] = "edited"
        elif g % 3 == 1:
            at, n = r.randrange(250), int(share * 300)
            copy[at : at + n] = [f"z{r.randrange(5000)}" for _ in range(n)]
        else:
            copy = copy[: int((1 - share * 2) * 300)]
        a, b = shingles(own), shingles(copy)
        want[2 * g + 1] = 2 * g + (len(a & b) < 0.8 * len(a | b))
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(copy))]
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(rows), hot=hot).collect()}
    assert len(set(want) - {k for k, c in want.items() if k == c}) > 100 and sum(k == c for k, c in want.items()) > 20
    assert {k: got[k] for k in want} == want


# --- suffix arrays -----------------------------------------------------------------------------------


def brute_kept(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append(bytes(x for x, y in zip(b, gone) if not y))
    return out


@given(st.binary(min_size=1, max_size=300), st.integers(9, 60))
@settings(max_examples=60, deadline=None)
def test_suffix_order_and_common_prefixes(raw, depth):
    buf = np.frombuffer(bytes((x & 3) + 1 for x in raw), np.uint8)  # shards end in a byte above all others
    text = buf.tobytes()
    sa = suffix_dedup.suffix_array(buf, depth)
    keys = [text[i : i + depth] for i in sa]
    assert keys == sorted(keys) and sorted(sa.tolist()) == list(range(len(buf)))
    shared = suffix_dedup.common_prefixes(buf, sa, depth)
    for a, b in zip(sa, sa[1:]):
        n = 0
        while n < depth and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert shared[b] == n


@given(st.lists(st.integers(1, 3), min_size=1, max_size=200), st.integers(2, 30))
@example([2, 1, 2, 1, 2, 1, 1], 3)
@settings(max_examples=60, deadline=None)
def test_suffix_order_of_words(codes, depth):
    buf = np.array([*codes, 0xFFFFFFFF], np.uint32)
    sa = suffix_dedup.suffix_array(buf, depth)
    keys = [buf[i : i + depth].tolist() for i in sa]
    assert keys == sorted(keys) and sorted(sa.tolist()) == list(range(len(buf)))
    shared = suffix_dedup.common_prefixes(buf, sa, depth, stride=5)
    for a, b in zip(sa, sa[1:]):
        n = 0
        while n < depth and max(a, b) + n < len(buf) and buf[a + n] == buf[b + n]:
            n += 1
        assert shared[b] == n


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 2}, {"shard_rows": 1, "shard_bytes": 100}])
def test_repeated_words_equal_brute_force(spark, frame, sizes):
    r = random.Random(4)
    shared = " ".join(r.choice("abcdef") for _ in range(40))
    rows = [(i, " ".join([*(r.choice("abcdefghij") for _ in range(r.randint(0, 30))), *shared.split()[r.randint(0, 25) :]])) for i in range(40)]
    rows += [(3, rows[3][1]), (50, "x  y\n" * 20), (None, None)]
    words = [(t or "").split() for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + 9]) for w in words for k in range(len(w) - 8))
    want = collections.Counter()
    for (i, _), w in zip(rows, words):
        gone = {j for k in range(len(w) - 8) if seen[tuple(w[k : k + 9])] > 1 for j in range(k, k + 9)}
        want[i, " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    found = suffix_dedup.remove_repeated_words(frame(rows), 9, gram=4, **sizes).collect()
    assert collections.Counter((x.doc_id, " ".join((x.text or "").split())) for x in found) == want


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 2}, {"shard_rows": 1, "shard_bytes": 100}])
def test_repeats_equal_brute_force(spark, frame, sizes):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcé") for _ in range(r.randint(1, 5))) for _ in range(30)]
    shared = " ".join(r.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(50):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))
        t += shared[r.randint(0, 20) :] * (r.random() < 0.5) + "xyz " * r.randint(5, 20) * (r.random() < 0.3)
        rows.append((i, t))
    rows += [(None, None), (5, rows[5][1]), (7, ""), (8, "short"), (None, rows[3][1])]
    want = collections.Counter(zip((i for i, _ in rows), brute_kept([t for _, t in rows], 40)))
    found = suffix_dedup.with_spans(frame(rows, extra=False), length=40, gram=12, **sizes).collect()
    got = collections.Counter((x.doc_id, suffix_dedup.keep(x.body.encode(), suffix_dedup.merge_spans(x.spans))) for x in found)
    assert got == want


def test_suffix_query_equals_brute_force(spark):
    rows = {(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids, texts = zip(*sorted(rows, key=lambda x: x[0]))
    want = {i: (len((t or "").encode()), hashlib.sha256(k).hexdigest()) for i, t, k in zip(ids, texts, brute_kept(texts, 400))}
    got = QUERIES["op3_suffix_dedup"](spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_bytes, r.kept_sha256) for r in got} == want
    assert all(len(r.text.encode()) <= r.n_bytes for r in got)


def test_remove_repeats_keeps_columns_and_characters(spark, frame, odd_rows):
    docs = frame(odd_rows)
    out = suffix_dedup.remove_repeats(docs, length=100)
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[7] == texts[8] == "" and texts[1] == "a b c d"
    assert suffix_dedup.remove_repeats(frame([])).count() == 0
    assert suffix_dedup.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]


def test_repeated_passages_are_counted_in_words(spark, frame, odd_rows):
    """Every passage of 51 words that repeats is cut, however short its words; 50 words stay."""
    import corpus_pipeline as P

    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgé") for _ in range(n))
    passages = {n: " ".join(word(r.randint(1, 4)) for _ in range(n)) for n in (50, 51, 55, 120)}
    assert len(passages[51].encode()) < 300
    rows = []
    for n, p in passages.items():
        other = p.replace(" ", "\n", 3) if n == 55 else p
        rows += [(n, f"head{n} {p} tail{n}"), (1000 + n, f"other{n}  {other}\nend{n}")]
    # Two repeats of 30 words side by side are no passage of 60.
    x, y = (" ".join(word(5) for _ in range(30)) for _ in range(2))
    rows += [(1, f"{x} {y}"), (2, f"p {x} q"), (3, f"p {y} q")]
    docs = frame(rows).selectExpr("*", "0 AS n_chars")
    got = {d.doc_id: d for d in P.cut_repeats(spark, docs, SF).collect()}
    for i, t in rows:
        want = t if i < 4 or i % 1000 == 50 else f"head{i}  tail{i}" if i < 1000 else f"other{i - 1000}  \nend{i - 1000}"
        assert got[i].text == want and got[i].n_chars == len(want)
    out = suffix_dedup.remove_repeated_words(frame(odd_rows), 51)
    texts = {d.doc_id: d.text for d in out.collect()}
    assert out.columns == frame(odd_rows).columns and texts[3] is None and texts[7] == texts[8] == "" and texts[1] == "a b c d"


# --- decontamination ----------------------------------------------------------------------------------


def test_substituted_passages_are_found(spark, frame):
    r = random.Random(5)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([40, 30, 13, 6, 3, 0])] + [(9, None)]
    docs = []
    for k in range(40):
        body = [r.choice(vocabulary) for _ in range(200)]
        if k % 4 == 0:
            passage = items[k // 4 % 5][1].split()
            if len(passage) >= 30:
                for p in range(4, len(passage), 11):
                    passage[p] = "changed"
            body[50:50] = passage
        docs.append((k, " ".join(body).upper() if k == 8 else " ".join(body)))
    want = {(k, k // 4 % 5) for k in range(0, 40, 4)}
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 17, 20):
        got = {(x.doc_id, x.item_id) for x in decontaminate.find_overlaps(frame(docs), table, block_tokens=block).collect()}
        assert want <= got and all(i in (3, 4) for _, i in got - want)
    kept = decontaminate.drop_contaminated(frame(docs), table.where("item_id < 3"))
    assert {x.doc_id for x in kept.collect()} == set(range(40)) - {k for k, i in want if i < 3}


def test_every_allowed_pattern_of_substitutions_is_found(spark, frame):
    """Whole copied items of 1 to 25 tokens with all patterns that leave 0.8 of the tokens equal."""
    r = random.Random(9)
    items, docs, more = [], [], []
    for n in [*range(1, 19), 20, 25]:
        others = n - math.ceil(0.8 * n)
        patterns = list(itertools.combinations(range(n), others))
        patterns = patterns if len(patterns) < 1000 else r.sample(patterns, 1000)
        item = [f"t{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        docs += [(n * 10_000 + i, " ".join(["x y", *("changed" if k in p else item[k] for k in range(n)), "z"])) for i, p in enumerate(patterns)]
        if n >= 5:
            further = itertools.islice(itertools.combinations(range(n), others + 1), 200)
            more += [(n * 10_000 + i, " ".join("changed" if k in p else item[k] for k in range(n))) for i, p in enumerate(further)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_overlaps(frame(docs), table).collect()}
    assert got == {(i, i // 10_000) for i, _ in docs}
    assert decontaminate.find_overlaps(frame(more), table, min_tokens=25).count() == 0


def test_a_full_filter_and_repeated_words_lose_no_hit(spark, frame, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 16)
    r = random.Random(3)
    items = [(i, " ".join(r.choice("abcdefgh") for _ in range(15))) for i in range(6_000)] + [(-1, "a " * 40)]
    docs = [(i, items[i][1]) for i in range(0, 60, 2)] + [(1_000, "a " * 300), (1_001, "k l m n o p q r s t u v w")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = collections.defaultdict(set)
    for x in decontaminate.find_overlaps(frame(docs), table, min_share=1.0).collect():
        got[x.doc_id].add(x.item_id)
    runs = {d: {i for i, t in items if any(t.split()[s : s + 13] == w[p : p + 13] for s in range(max(1, len(t.split()) - 12)) for p in range(len(w) - 12))}
            for d, w in ((d, t.split()) for d, t in docs if d < 20 or d > 999)}
    assert {d: got[d] for d in runs} == runs


def test_longest_stretch_equals_brute_force():
    r = random.Random(9)
    flags = [np.array([r.random() < 0.8 for _ in range(30)]) for _ in range(100)]
    for equal in flags:
        want = max((j - i for i in range(30) for j in range(i + 1, 31) if 5 * equal[i:j].sum() >= 4 * (j - i)), default=0)
        start, length, same = decontaminate.longest_stretch(equal, 0.8)
        assert length == want and same == equal[start : start + length].sum()


def test_decontamination_edges(spark, frame, odd_rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_overlaps(frame(odd_rows), none).count() == 0
    assert decontaminate.drop_contaminated(frame(odd_rows), none).count() == len(odd_rows)
    items = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "zz")], "item_id bigint, text string")
    assert sorted(x.doc_id for x in decontaminate.find_overlaps(frame(odd_rows), items).collect()) == [1, 1, 1, 1, 2, 2]
    assert decontaminate.find_overlaps(frame([]), items).count() == 0


# --- weighted fingerprints ------------------------------------------------------------------------------


def test_fingerprints_estimate_the_likeness(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())[::-1]
    got = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, SF).collect()}
    errors, seen = [], {}
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = collections.Counter(words(t)), collections.Counter(words(edited))
        errors.append(got[i].near_edited - sum((a & b).values()) / max(1, sum((a | b).values())))
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.13


def test_fingerprint_edges(spark, frame, odd_rows):
    rows = weighted_fingerprint.fingerprint_pairs(frame(odd_rows), samples=8, buckets=3).collect()
    assert len(rows) == len(odd_rows)
    empty = [r for r in rows if r.n_chars == 0]
    assert len(empty) == 2 and len({r.fingerprint for r in empty}) == 1
    alone = weighted_fingerprint.fingerprint_pairs(frame([(1, "a b c")])).first()
    assert alone.near_next == 1.0 and weighted_fingerprint.fingerprint_pairs(frame([])).count() == 0
    plan = weighted_fingerprint.fingerprint_pairs(frame(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- language model -----------------------------------------------------------------------------------


def test_base_scores_are_exact_and_the_model_is_better(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: [*words(t), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in QUERIES["op10_pitman_yor"](spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i])
        assert r.base_score == pytest.approx(want) and (r.n_tokens, r.train_tokens, r.held_out) == (len(tokens[i]), n, held[i])
        assert r.n_known == sum(counts[w] > 0 for w in tokens[i])
    out = [i for i in docs if held[i]]
    assert sum(rows[i].score for i in out) > sum(rows[i].base_score for i in out)
    one = pitman_yor.score_documents(spark.createDataFrame([(1, "a b c d e f", True), (2, "a b c d e f", False), (3, "f d b e c a", False)], "doc_id bigint, text string, trains boolean"))
    score = {r.doc_id: r.score for r in one.collect()}
    assert score[1] == score[2] > score[3]  # order counts


def test_closed_form_seating():
    """The weight of t tables at discount 1/2 equals the sum over all seatings, by the recurrence."""
    s = {(1, 1): 1.0}
    for c in range(1, 9):
        for t in range(1, c + 2):
            s[c + 1, t] = s.get((c, t - 1), 0) + (c - 0.5 * t) * s.get((c, t), 0)
    for (c, t), want in s.items():
        if want > 0:
            one = lambda k: np.array([float(k)])
            own = pitman_yor.seating_weight(one(c), one(t), one(0), one(0)) - pitman_yor.seating_weight(one(c), one(c), one(0), one(0))
            rising = lambda k: math.lgamma(2 + k) + k * math.log(0.5)
            assert own[0] == pytest.approx(math.log(want / s[c, c]) + rising(t) - rising(c))


def seated_by_hand(texts, trains):
    """The model with plain dictionaries: log10 probability of a pair, and the vocabulary."""
    end = int(pitman_yor.END_HASH)
    tokens = [[int(h) for h in word_hashes([t or ""])[0]] + [end] for t in texts]
    c = collections.Counter(x for ws, own in zip(tokens, trains) if own for x in zip([end, *ws[:-1]], ws))
    pairs = sorted(c)
    context, word = (np.array([x[k] for x in pairs], np.uint64) for k in (0, 1))
    name = pitman_yor.mix(context * np.uint64(0x9E3779B97F4A7C15) ^ pitman_yor.mix(word))
    of, dishes, first = collections.Counter(), collections.Counter(x[0] for x in pairs), collections.Counter(x[1] for x in pairs)
    for (u, _), n in c.items():
        of[u] += n
    total = len(pairs)
    t = pitman_yor.seat(
        np.array([c[x] for x in pairs]), np.log(np.array([(first[w] - 0.5) / (1 + total) for _, w in pairs])), np.array([dishes[u] - 1.0 for u, _ in pairs]), name
    )
    t = dict(zip(pairs, np.rint(t * 1000) / 1000))
    up, tables = collections.Counter(), collections.Counter()
    for (u, w), x in t.items():
        up[w] += x
        tables[u] += x
    all_ = sum(up.values())
    parent = lambda w: ((up[w] - 0.5) if w in up else 1 + 0.5 * len(up)) / (1 + all_)
    value = lambda u, w: (c[u, w] - 0.5 * t.get((u, w), 0)) / (1 + of[u]) + (1 + 0.5 * tables[u]) / (1 + of[u]) * parent(w)
    return tokens, value, up, of


def test_model_equals_seating_by_hand(spark):
    docs = [(r.doc_id, r.text, r.doc_id % 5 > 0) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    tokens, value, up, of = seated_by_hand([d[1] for d in docs], [d[2] for d in docs])
    for u in list(of)[:30] + [12345]:
        assert sum(value(u, w) for w in up) + value(u, 999) == pytest.approx(1, abs=1e-3)  # 999: any unseen word
    end = int(pitman_yor.END_HASH)
    want = {d[0]: sum(math.log10(value(u, w)) for u, w in zip([end, *ws[:-1]], ws)) for d, ws in zip(docs, tokens)}
    frame_ = spark.createDataFrame(docs, "doc_id bigint, text string, trains boolean")
    sizes = [{"least_buckets": 1}, {"least_buckets": 7, "chunk_docs": 9}, {"bucket_bytes": 2000, "chunk_chars": 5000}]
    for size in sizes:
        got = {r.doc_id: r.score for r in pitman_yor.score_documents(frame_.repartition(3), **size).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-4) for i in want)


def test_language_model_edges(spark, frame, odd_rows):
    from pyspark.sql import functions as F

    docs = frame(odd_rows)
    rows = pitman_yor.score_documents(docs.withColumn("trains", F.col("doc_id") > 1)).collect()
    assert len(rows) == len(odd_rows) and all(math.isfinite(r.score) for r in rows)
    untrained = pitman_yor.score_documents(docs.withColumn("trains", F.lit(False))).collect()
    assert {r.base_score for r in untrained} == {0.0} and {r.n_known for r in untrained} == {0}
    assert pitman_yor.score_documents(frame([]).withColumn("trains", F.lit(True))).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        before = spark.createDataFrame(after.collect(), docs.schema)
    tokens = P.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in tokens} == ids and len(tokens) > 100
    assert P.run(spark, SF).count() == len(tokens)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
