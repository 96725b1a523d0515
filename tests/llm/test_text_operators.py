"""HTML extraction, toxicity, language, chat, tokens: brute force, round trips, held-out accuracy, edges."""

import functools
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.llm import chat_format, html_extract, language_id, sentencepiece_scan, toxicity
from casewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- HTML ------------------------------------------------------------------------------------


def text(source):
    return html_extract.Page(source).text()


def test_blocks_entities_and_dropped_elements():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav>Menu</nav>
    <div class="cookie-notice">We use</div><article><h1>Head &amp; <b>tail</b></h1><p>One<br>two&nbsp;&#233;<p>Three <script>var t="</p>";</script>
    <ul><li>a<li>b</ul><div id="comments"><p>bad</p></div><form><p>f</p></form><aside>x</aside></article><footer>F</footer></body></html>"""
    assert text(page) == "Head & tail\n\nOne two é\n\nThree\n\na\n\nb"


def test_without_article_the_body_counts():
    assert text("<p>a<p>b</p><div>c <span>d</span></div><!-- no -->") == "a\n\nb\n\nc d"
    assert text("") == "" and text("plain\n  words") == "plain words"
    assert text("<p>1 < 2 & 3 <b unclosed") == "1 < 2 & 3 <b unclosed" or text("<p>1 < 2 & 3 <b unclosed").startswith("1 < 2 & 3")


@given(st.text("<>/ap\"'=! -&;", max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_markup_parses(source):
    text(source)
    html_extract.Page(source).subtrees()


def test_recurring_subtrees_go_per_host(spark):
    rows = [(i, f"http://h.example/{i}", f"<p>own {i}</p><section><p>Template</p></section>") for i in range(12)]
    rows += [(100 + i, f"http://other.example/{i}", f"<p>else {i}</p><section><p>Template</p></section>") for i in range(3)]
    rows += [(200, None, None), (200, None, None), (None, "not a url", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    got = {}
    for r in html_extract.extract_main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["own 3"] and got[101] == ["else 1\n\nTemplate"] and got[200] == ["", ""] and got[None] == [""]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post search-result"><p>Kept.</p></article>', '<article id="comment-policy"><p>Kept.</p></article>',
        '<div class="article has-sidebar"><p>Kept.</p></div>', '<div class="share-price"><p>Kept.</p></div>',
        '<div class="sidebar"><article><p>Kept.</p></article></div>', '<div class="promo"><main><p>Kept.</p></main></div>',
        '<div class="cookie-bar">x</div><p>Kept.</p><div id="post-comments">y</div><div role="navigation">z</div>',
    ],
)
def test_articles_are_not_lost_by_class_words(page):
    assert text(page) == "Kept."


def test_repeated_pages_are_one_page(spark):
    rows = [(i, "http://h.example/1", "<article><p>One article.</p></article>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract_main_text(pages).collect()} == {"One article."}


def test_html_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    rows += [(2 * 10**6 + i, f"http://copies.example/{i}", f"<p>n {i}</p><article><p>copied</p></article>" if i < 12 else f"<article><p>{i}</p></article>") for i in range(40)]
    rows += [(10**6 + i, f"http://crowd.example/{i}", f"<body><p>own {i}</p><div><i>every second {i % 2}</i></div></body>") for i in range(40)]
    host = lambda u: m[1].lower() if (m := re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", u or "")) else ""
    seen = {}
    for _, u, h in rows:
        for x in html_extract.Page(h or "").subtrees():
            seen.setdefault((host(u), x), set()).add(h or "")
    pages = {}
    for _, u, h in rows:
        pages.setdefault(host(u), set()).add(h or "")
    template = {}
    for (o, x), found in seen.items():
        if len(found) >= 10 and len(found) >= (0.5 if x & 1 else 0.05) * len(pages[o]):
            template.setdefault(o, set()).add(x)
    want = {i: html_extract.Page(h or "").text(frozenset(template.get(host(u), ()))) for i, u, h in rows}
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want and got[10**6 + 3] == "own 3" and got[2 * 10**6] == "copied"
    n = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op1_html_extraction"](spark, SF).collect()}
    assert all(n[i] == (want[i], len(want[i])) for i in n) and len(n) == len(rows) - 80


# --- toxicity ----------------------------------------------------------------------------------


def corpus(n=400, seed=1):
    r = random.Random(seed)
    words = ["w" + a + b + c for a in "abcdef" for b in "ghijk" for c in "lmnop"]
    for i in range(n):
        body = [r.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                body.insert(r.randrange(40), r.choice(["scumbag", "vilefoo", "vilebar", "vilebaz"]))
        yield " ".join(body), int(toxic)


def test_learned_lexicon_generalises_by_word_beginnings():
    model = toxicity.train(list(corpus()))
    finder = model.finder()
    assert toxicity.score("calm words here", model, finder) < 0.5
    assert toxicity.score("You are vilequx.", model, finder) > 0.7  # a form never seen
    assert toxicity.score("THE SCUMBAG!", model, finder) > 0.7
    assert toxicity.score(None, model, finder) == toxicity.score("", model, finder) == model.rest


def test_copies_and_repetition_are_no_evidence():
    rows = [("unique text about lampshades " * 30, 1)] * 50 + [("other calm text", 0)] * 50
    model = toxicity.train(rows)
    assert not model.words and not model.prefixes


def test_grammar_composes_modifiers():
    model = toxicity.Model({"scum": 1.0}, {}, {t: toxicity.prior(t) for t in toxicity.TAGS}, 0.01)
    found = lambda t: [m for m, _ in toxicity.matches(t, model)]
    assert found("scum. calm.") == ["i"] and found("you are scum") == ["ip"] and found("scum that you are") == ["ip"]
    assert found("he is not scum") == ["ipn"] and found("not really a very big scum") == ["in"]
    assert found("not that it is not scum") == ["i"] and found("it is not nice but scum") == ["i"]
    assert found("we said that was scum") == ["ir"] and found("the word scum in a dictionary") == ["ir"]
    assert found('it reads "scum" there, scum') == ["i"] and found('"scum"') == ["ir"]
    assert found("i will kill you") == ["t"] and found("i will not kill you") == ["tn"] and found("kill the lights") == []
    score = {t: toxicity.matches(t, model)[0][1] for t in ("scum", "you are scum", "he is not scum", "the word scum")}
    assert score["you are scum"] > score["scum"] > score["the word scum"] > 0.5 and score["he is not scum"] == 0.6


def test_factors_follow_the_labels():
    """Where quoted and denied insults are labelled clean and threats toxic, the factors say so."""
    r = random.Random(2)
    calm = lambda n: " ".join(r.choice(["wood", "river", "stone", "cloud", "green", "paper"]) + r.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(60):
        rows += [(f"{calm(8)}. {calm(3)} you are scumbag {calm(2)}.", 1), (f"{calm(8)}. the word scumbag {calm(2)}.", 0) if i % 8 == 0 else (calm(20), 0)]
        rows += [(f"{calm(4)} scumbag {calm(3)}", 1), (f"we will kill you {calm(5)}", 1)]
    model = toxicity.train(rows)
    assert model.factors["ip"] > 0.95 and model.factors["ir"] < 0.3 < 0.9 < model.factors["t"]
    assert toxicity.score(f"{calm(3)} the word scumbag", model, model.finder()) < 0.7 < toxicity.score("you scumbag", model, model.finder())


def test_toxicity_query_beats_chance_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = QUERIES["op2_toxicity"](spark, sf).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    bad, good = [x for x, y in held if y], [x for x, y in held if not y]
    auc = sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good))
    assert auc >= 0.85 and sum(x >= 0.7 for x in good) <= 0.02 * len(good)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_toxicity_edges(spark, frame, odd_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    docs = frame(odd_rows).withColumn("toxic", F.lit(1))
    model = toxicity.fit(docs, labels)
    assert toxicity.score_documents(docs, model).count() == len(odd_rows)
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, empty).collect()} == {0.0}
    kept = toxicity.keep_clean(docs, empty)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows) and toxicity.keep_clean(docs.limit(0), model).count() == 0


# --- language ----------------------------------------------------------------------------------


def test_language_held_out_accuracy_and_edges(spark, frame, odd_rows):
    rows = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, SF).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) / len(held) >= 0.9
    model = language_id.train(["the house and", "la casa y el"] * 20, ["en", "es"] * 20)
    got = language_id.predict([None, "", "123 !", "the and"], model)
    assert got[0] == ["und", "und", "und", "en"] and got[1][0] == 0
    assert language_id.predict(["½ ² ③", "_ 4", "ª"], model)[0][:2] == ["und", "und"]
    long_ = "the house and " * 5000
    whole = language_id.predict([long_], model)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_id, "PIECE", 777)
        cut = language_id.predict([long_, "x"], model)
    assert cut[0][0] == whole[0][0] and cut[1][0] == pytest.approx(whole[1][0], rel=1e-9)
    nothing = language_id.fit(frame([]).withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in language_id.identify(frame(odd_rows), nothing).collect()} == {"und"}
    one = language_id.fit(frame(odd_rows).withColumn("lang", F.when(F.col("doc_id") > 1, "x")))
    assert language_id.identify(frame(odd_rows), one).count() == len(odd_rows)


# --- chat --------------------------------------------------------------------------------------

_piece = st.sampled_from(["<|im_start|>", "<|im_end|>", "<\\|", "<\\\\|", "|", "<", "\n", "a b c", "é", ""])


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "odd\nrole|>"]), st.lists(_piece, max_size=6).map("".join)), min_size=1, max_size=9), st.integers(6, 60))
@settings(max_examples=150, deadline=None)
def test_windows_restore_every_turn(turns, budget):
    writer = chat_format._Writer(1, budget, 0.3)
    windows = [w for t in turns if (w := writer.add(*t))] + [writer.finish()]
    back, targets = [], []
    for _, _, formatted, history, new, spans in windows:
        parsed = chat_format.parse_window(formatted)
        assert len(parsed) == history + new
        back += parsed[history:]
        targets += [chat_format.unescape(formatted[s["start"] : s["stop"]]) for s in spans]
    assert back == turns and targets == [t for r, t in turns if r == "assistant" and t]


def test_windows_keep_the_system_turn_and_budget():
    writer = chat_format._Writer(1, 40, 0.5)
    turns = [("system", "be kind")] + [("user" if i % 2 else "assistant", "one two three four five") for i in range(12)]
    windows = [w for t in turns if (w := writer.add(*t))] + [writer.finish()]
    assert len(windows) > 3 and all(chat_format.parse_window(w[2])[0] == turns[0] for w in windows)
    assert all(sum(chat_format.turn_tokens(t) for _, t in chat_format.parse_window(w[2])) <= 40 for w in windows)


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(chat_format.ORACLE)
    names = [d[0] for d in want.description]
    got = [tuple(r[c] for c in names) for r in QUERIES["op6_chat_formatting"](spark, SF).collect()]
    assert sorted(got) == sorted(want.fetchall())


def test_chat_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, 1, "user", "x"), (2, 1, "assistant", ""), (3, 0, "user", "w " * 60_000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert got[1].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[2].loss_chars == 0
    assert set(got) == {1, 2, 3, None} and chat_format.format_conversations(turns.limit(0)).count() == 0


# --- tokens --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_scan.Vocabulary(sentencepiece_scan.default_model())


def by_chunks(v, body, chunk, fan=3):
    """The scan without Spark: ids from chunks, their matrices combined in blocks."""
    full, parts = " " + body, []
    for at in range(0, len(full), chunk):
        lead = min(at, v.longest)
        parts.append((full[at - lead : at + chunk + v.longest], lead, min(chunk, len(full) - at)))
    matrices = [v.transfer(*p) for p in parts]
    assert sentencepiece_scan.boundary_states(matrices) == _by_blocks(matrices, fan)
    states = sentencepiece_scan.boundary_states(matrices)
    return [i for p, a, b in zip(parts, states, states[1:]) for i in v.trace(*p, a, b)]


def _by_blocks(matrices, fan):
    blocks = [matrices[k : k + fan] for k in range(0, len(matrices), fan)]
    tops = sentencepiece_scan.boundary_states([functools.reduce(sentencepiece_scan.combine, b) for b in blocks])
    return [0] + [s for b, x, y in zip(blocks, tops, tops[1:]) for s in sentencepiece_scan.boundary_states(b, x, y)[1:]]


_bits = st.sampled_from(["a", "b", "the", "er", "in", " ", "   ", "\n", "é", "漢", "☃", "1", "=", "____", "ll", "tion", "wor"])


@given(st.lists(_bits, max_size=60).map("".join), st.integers(32, 50))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_vocabularys_own_for_every_chunk_size(vocabulary, body, chunk):
    want = vocabulary.library.encode(body)
    assert by_chunks(vocabulary, body, chunk) == (want if body else vocabulary._path(" ", (0, 0, -2), 1))
    assert list(np.frombuffer(vocabulary.encode(body), "<u4")) == want
    dense = body.replace(" ", "")
    if dense:
        assert by_chunks(vocabulary, dense, chunk) == vocabulary.library.encode(dense) == vocabulary._path(" " + dense, (0, 0, -2), len(dense) + 1)


@given(st.text(max_size=80), st.integers(32, 50))
@settings(max_examples=80, deadline=None)
def test_any_text_is_restored(vocabulary, body, chunk):
    ids, back = vocabulary.encode_checked(body)
    assert back.decode() == body
    if body:
        assert vocabulary.decode(np.array(by_chunks(vocabulary, body, chunk), "<u4").tobytes()).decode() == body


def test_token_query_equals_the_library(spark, vocabulary):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: hashlib.sha256(np.array(vocabulary.library.encode(t), "<u4").tobytes()).hexdigest() for i, t in texts.items() if "▁" not in t}
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece"](spark, SF).collect()}
    assert len(got) == len(texts) and all(got[i].ids_sha256 == x for i, x in want.items())
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in got.items())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    small = sentencepiece_scan.encode_documents(docs, sentencepiece_scan.default_model(), chunk=64, fan=4)
    assert all(hashlib.sha256(r.ids).hexdigest() == got[r.doc_id].ids_sha256 for r in small.collect())


def test_library_decodes_the_ids(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_scan.default_model())
    body = "Héllo wörld, 12 tokens of text!"

    assert library.decode(np.frombuffer(vocabulary.encode(body), "<u4").tolist()) == body


def test_token_rows_restore_all_texts(spark, frame, odd_rows):
    model = sentencepiece_scan.default_model()
    docs = frame(odd_rows + [(9, "▁ literal  ▁"), (9, "▁ literal  ▁")])
    got = sorted(((r.doc_id or 0), bytes(r.decoded).decode()) for r in sentencepiece_scan.encode_documents(docs, model, chunk=30_000).collect())
    assert got == sorted(((i or 0), t or "") for i, t in odd_rows + [(9, "▁ literal  ▁")] * 2)
    rows = sentencepiece_scan.token_rows(docs, model)
    assert all(len(r.ids) == r.n_tokens for r in rows.collect())
    assert sentencepiece_scan.token_rows(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(("source", "want"), [
    ('<article><p>Main.</p></article><section id="comments"><ol class="comment-list"><li><article class="comment-body">Reader says hi</article></li></ol></section>', "Main."),
    ('<article><p>Main.</p><div id="comments"><article class="comment">Reader</article></div></article>', "Main."),
    ('<main><article><p>Main.</p></article></main><aside class="related"><article class="card">Other</article></aside>', "Main."),
    ("<div><p>Main.</p></div><footer><article>Foot</article></footer>", "Main."),
    ('<div class="header-layout"><article><h1>T</h1><p>Main.</p></article></div>', "T\n\nMain."),
    ('<div class="comments"><article class="comment">x</article></div><p>Main.</p>', "Main."),
    ("<form><p>One.</p><p>Two.</p><p>Three.</p><input></form>", "One.\n\nTwo.\n\nThree."),
    ('<form id="page"><div><article><p>One.</p></article></div></form>', "One."),
    ("<p>One.</p><form><p>Subscribe</p></form>", "One."),
    ("<article><header><h1>Title</h1></header><p>One.</p></article>", "One."),
])
def test_articles_that_are_not_the_pages_go(source, want):
    assert text(f"<html><body>{source}</body></html>") == want
