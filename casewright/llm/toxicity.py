"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns the words of a clause into symbols; five transducers rewrite them, each reading what the one
before wrote: insult (marks an insult), threat (a threatening verb and, soon after, a person make a threat),
target (an insult near a person becomes an aimed one), negation (what lies in its scope is denied; a second
negation lifts it), reported speech (what follows a verb of saying or a word for a word, or stands between
quotes, is reported).  Their composition is one transducer.  A clause scores its strongest match: the learned
weight of its word times the learned factor of its tags (aimed, threat, denied, reported), so the same word
counts differently alone, aimed, denied or quoted; a document's score is the noisy-or of its matched clauses.
The insult lexicon (whole words and word beginnings) and the factors are learned from labelled rows.  A pattern's support is the smaller of its documents and
its distinct contexts (the neighbours of a word), so neither copies of one document nor repetition
within one count as evidence.

Edge cases: null and empty texts, and texts without a match, score the smoothed rate of label 1
among training rows without a match; repeated and conflicting label rows all count as evidence;
without any labelled row the lexicon is empty and every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import fold, table

_WORD = re.compile(r"[^\W\d_]+|[\"“”«»]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = (4, 5, 6, 7)

TARGETS = frozenset("you your yours he she they him her them du dich dir ihr euch sie tu te toi vous ton usted ustedes tú ti ellos".split())
NEGATIONS = frozenset("not no never nobody isn aren wasn don doesn didn nicht kein keine nie pas jamais aucun nunca ni".split())
REPORTS = frozenset("said says say called calls wrote quoted claimed sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
MENTIONS = frozenset("word words term dictionary insult wort begriff mot terme palabra término".split())
CONTRASTS = frozenset("but yet however aber sondern mais cependant pero sino".split())
QUOTES = frozenset('"“”«»')
THREATS = frozenset("kill murder hurt shoot stab burn destroy töte töten umbringen verletzen tuer tuerai frapper matar mataré golpear".split())
#: How many tokens a threat waits for its person, a person reaches an insult, a negation denies, and a mention reports.
REACH = {"threat": 5, "target": 6, "negation": 6, "mention": 4}


class Transducer:
    """A deterministic transducer: a state and a symbol give a state and a symbol."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what ``first`` reads and writes what ``second`` makes of its output."""
    known: dict = {}

    def step(state: tuple, symbol: str):
        key = state, symbol
        if key not in known:
            a, middle = first.step(state[0], symbol)
            b, out = second.step(state[1], middle)
            known[key] = (a, b), out
        return known[key]

    return Transducer((first.start, second.start), step)


# Symbols: I insult word, T threatening verb, P person, N negation, B contrast, R verb of saying, M word for a word,
# Q quote, - any other.  A match is written as its tags: "i" an insult, "t" a threat, then "p", "n", "r".


def _insult() -> Transducer:
    return Transducer(0, lambda state, x: (0, "i" if x == "I" else x))


def _threat(reach: int) -> Transducer:
    def step(left: int, x: str):
        if x == "T":
            return reach, "-"
        if x == "P" and left:
            return 0, "t"
        return max(0, left - 1), x

    return Transducer(0, step)


def _target(reach: int) -> Transducer:
    """State: tokens since a person and since an insult that no person has met yet."""

    def step(state: tuple[int, int], x: str):
        person, insult = state
        if x in ("P", "t"):
            aimed = "ip" if x == "P" and insult else x  # the person after the insult
            return (reach, 0), aimed
        if x == "i":
            return (max(0, person - 1), 0 if person else reach), "ip" if person else "i"
        return (max(0, person - 1), max(0, insult - 1)), x

    return Transducer((0, 0), step)


def _negation(reach: int) -> Transducer:
    def step(left: int, x: str):
        if x == "N":
            return 0 if left else reach, "-"  # a second negation lifts the first
        if x == "B":
            return 0, "-"
        return max(0, left - 1), x + "n" if left and x[0] in "it" else x

    return Transducer(0, step)


def _report(reach: int) -> Transducer:
    """State: whether a verb of saying came before, inside quotes, tokens left after a word for a word."""

    def step(state: tuple[bool, bool, int], x: str):
        said, quoted, left = state
        if x == "Q":
            return (said, not quoted, left), "-"
        if x == "R":
            return (True, quoted, left), "-"
        if x == "M":
            return (said, quoted, reach), "-"
        out = x + "r" if (said or quoted or left) and x[0] in "it" else x
        return (said, quoted, max(0, left - 1)), out

    return Transducer((False, False, 0), step)


def _grammar() -> Transducer:
    whole = _insult()
    for part in (_threat(REACH["threat"]), _target(REACH["target"]), _negation(REACH["negation"]), _report(REACH["mention"])):
        whole = compose(whole, part)
    return whole


GRAMMAR = _grammar()
TAGS = tuple(kind + rest for kind in ("i", "ip", "t") for rest in ("", "n", "r", "nr"))


def prior(tags: str) -> float:
    """The factor of a match before any label is seen."""
    return (0.75 if tags[0] == "t" else 1.0 if "p" in tags else 0.9) * (0.6 if "n" in tags else 1.0) * (0.7 if "r" in tags else 1.0)


class Model:
    """The learned lexicon and weights; plain data, shipped to the executors."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], factors: dict[str, float], rest: float):
        self.words, self.prefixes, self.factors, self.rest = words, prefixes, factors, rest

    def weight(self, word: str) -> float:
        if word in _CLASSES:
            return 0.0
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                found = max(found, self.prefixes.get(word[:n], 0.0))
        return found

    def finder(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for key in {*self.words, *self.prefixes, *THREATS}:
            automaton.add_word(key)
        automaton.make_automaton()
        return automaton


_CLASSES = {w: name for name, words in (("P", TARGETS), ("Q", QUOTES), ("B", CONTRASTS), ("M", MENTIONS), ("R", REPORTS), ("N", NEGATIONS), ("T", THREATS)) for w in words}


def _symbol(word: str, weight: float) -> str:
    if weight:
        return "I"
    return _CLASSES.get(word, "-")


def matches(text: str, model: Model) -> list[tuple[str, float]]:
    """Per matched clause the tags and the weight of its strongest match."""
    found = []
    for clause in _CLAUSE.split(text):
        words = _WORD.findall(clause)
        weights = [model.weight(w) for w in words]
        if not any(weights) and THREATS.isdisjoint(words):
            continue
        state, best, last = GRAMMAR.start, None, 0.0
        for word, weight in zip(words, weights):
            state, tags = GRAMMAR.step(state, _symbol(word, weight))
            last = weight or last
            if tags[0] in "it":
                value = (last if tags[0] == "i" else 1.0) * model.factors.get(tags, prior(tags))
                # A person behind an insult aims that insult: what it said alone is replaced, not added to.
                if best is None or value > best[1]:
                    best = tags, value
        if best:
            found.append(best)
    return found


def score(text: str | None, model: Model, finder: ahocorasick.Automaton | None) -> float:
    low = (text or "").lower()
    if not low or finder is None or next(finder.iter(low), None) is None:
        return model.rest
    miss = 1.0
    for _, value in matches(low, model):
        miss *= 1 - value
    return max(model.rest, 1 - miss)


def _patterns(text: str):
    """Every word and word beginning of a text with a hash of the word's neighbours."""
    words = _WORD.findall(text)
    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
        if len(word) >= 3 and word not in _CLASSES:  # the grammar's own words are no insults
            context = hash((before, after))
            yield word + "$", context
            for n in PREFIXES:
                if len(word) >= n:
                    yield word[:n], context


def train(rows: Iterable[tuple[str | None, int]]) -> Model:
    """Learn from ``(text, toxic)`` rows.

    A pattern joins the lexicon when the log-likelihood ratio of its label rate against the base
    rate beats the number of patterns tried (a Bonferroni bound) and its smoothed rate is 0.9 or more.
    Sets of contexts are kept only for patterns that can still qualify, so that memory stays small.
    """
    texts = [((t or "").lower(), int(y)) for t, y in rows]
    if not texts:
        return Model({}, {}, {}, 0.0)
    documents: Counter = Counter()
    for text, label in texts:
        if label:
            documents.update({key for key, _ in _patterns(text)})
    tried = max(2, len(documents))
    documents = {k: n for k, n in documents.items() if n >= 3}  # fewer never pass the bound
    against: dict[str, tuple[set[int], set[int]]] = {}
    for number, (text, label) in enumerate(texts):
        if not label:
            for key, context in _patterns(text):
                if key in documents:
                    found = against.setdefault(key, (set(), set()))
                    found[0].add(number)
                    found[1].add(context)
                    if min(map(len, found)) * 3 > documents[key]:  # its rate can no longer reach 0.8
                        del documents[key], against[key]
    contexts: dict[str, set[int]] = {}
    for text, label in texts:
        if label:
            for key, context in _patterns(text):
                if key in documents:
                    contexts.setdefault(key, set()).add(context)
    n1 = {k: min(documents[k], len(v)) for k, v in contexts.items()}
    n0 = {k: min(map(len, v)) for k, v in against.items()}
    base = min(0.5, max(0.01, sum(y for _, y in texts) / len(texts)))
    words, prefixes = {}, {}
    for key, a in n1.items():
        b = n0.get(key, 0)
        rate = (a + base) / (a + b + 1)
        if rate >= 0.9 - 0.1 * (a < 12):
            ratio = a * math.log(rate / base) + b * math.log((1 - rate) / (1 - base))
            if ratio > math.log(tried) + 2:
                (words if key.endswith("$") else prefixes)[key.removesuffix("$")] = rate
    model = Model(words, prefixes, {}, 0.0)
    finder = model.finder()
    alone: dict[str, Counter] = {}
    rest = Counter()
    for text, label in texts:
        kinds = {m for m, _ in matches(text, model)} if next(finder.iter(text), None) else set()
        if not kinds:
            rest[label] += 1
        elif len(kinds) == 1:
            alone.setdefault(kinds.pop(), Counter())[label] += 1
    # Each factor starts from its prior and moves to the rate seen in training.
    for tags in TAGS:
        count = alone.get(tags, Counter())
        model.factors[tags] = (count[1] + 2 * prior(tags)) / (count[1] + count[0] + 2)
    model.rest = min(0.6, (rest[1] + 0.5) / (rest[0] + rest[1] + 1))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """Learn from at most ``sample`` labelled rows, taken by hash order; the bound is on the fit alone."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "toxic").limit(sample)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key_text"))
    keys = ["doc_id", "key_text", "toxic"]
    # Repeated documents count once, and of several texts under one id no more than ``sample`` rows are read.
    picked = keyed.join(F.broadcast(own), "doc_id").select(*keys).distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), *keys).limit(sample)
    picked = picked.withColumnsRenamed({k: f"#{k}" for k in keys})
    rows = keyed.join(F.broadcast(picked), (F.col("doc_id") == F.col("`#doc_id`")) & (F.col("key_text") == F.col("`#key_text`")))
    rows = rows.select("doc_id", "text", "key_text", F.col("`#toxic`").alias("toxic")).dropDuplicates(keys).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r.toxic), reverse=True)
    return train((r.text, r.toxic) for r in iter(lambda: rows.pop() if rows else None, None))  # rows go as they are read


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` with ``score`` from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.prefixes, model.factors, model.rest))

    def run(batches):
        model = Model(*shared.value)
        finder = model.finder() if model.words or model.prefixes else None
        for batch in batches:
            values = [score(t, model, finder) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.prefixes, model.factors, model.rest))

    def run(batches):
        model = Model(*shared.value)
        finder = model.finder() if model.words or model.prefixes else None
        for batch in batches:
            yield batch.filter(pa.array([score(t, model, finder) < threshold for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold("doc_id", 3) != 1)
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
