"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Every word is a context restaurant whose dishes are the words (or the end) that follow it; all context
restaurants share one parent, the restaurant of words, whose customers are their tables.  The parent's base
measure is diffuse, so each of its dishes has one table and the mass of a new one is the probability of the
unseen words together, which are one event as in the base score.  The discount is 1/2, so the seating of one
dish has a closed form: with c customers and t tables its weight is
S(c, t) = G(2c - t) 4^(t - c) / (G(c - t + 1) G(t)) (G: gamma).

Seating is sampled in two rounds.  In the first every dish has one table, which fixes the parent's customers
and so the words' probabilities.  In the second Gibbs sweeps draw the tables of every dish of every context given
the parent's probability and the restaurant's current tables (``gibbs``); their averages over the sweeps after
burn-in go up as the parent's customers.  The parent stays as it is during the sweeps.  The predictive probability is
linear in the tables, so the probability of the averages is the average over the sweeps.  Random numbers are hashes
of (context, word, sweep): the result depends on the texts alone, not on partitions or buckets.

Scale.  Nothing is collected but the contexts that are too frequent for one bucket.  A chunk of documents sends
one row to each bucket of contexts that it has words for: its distinct (context, word) pairs and which document
has them how often, so rows are never more than those pairs.  Buckets exchange with parts of the parent one row
each way per part they have words for: customers and tables up, counts and probabilities back.  A context with
more than a quarter of a bucket is split by its words over several buckets, which exchange their tables in the
same way; its sweeps are run in one task, to which every bucket sends the words that follow it more than once, each
once as about 20 bytes whatever its count, and which sends one number per sweep back.  A bucket holds about
``bucket_bytes`` of text, a part as many words.

Edge cases: null and empty texts are one end token; equal rows are all kept and all count; without training
documents every word is unseen and both scores are 0; a null id is scored and trains as the empty text's fold says.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import fold, mix, staged, table, word_hashes

CONCENTRATION, DISCOUNT = 1.0, 0.5
END_HASH = np.uint64(0x0DDC0FFEE0DDF00D)
WORDS, CONTEXTS = 0, 1  # what the rows between buckets and parts are about
DRAWN = 3  # the round of the rows with a split context's variables


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for positive x by Stirling's series after a shift by eight."""
    y = x + 8.0
    shift = x * (x + 1) * (x + 2) * (x + 3)
    shift2 = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift) - np.log(shift2)


def seating_weight(c: np.ndarray, t: np.ndarray, log_parent: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log weight of t tables for c customers of a dish, given the other dishes' tables."""
    stirling = log_gamma(2 * c - t) - log_gamma(c - t + 1) - log_gamma(t) + (t - c) * math.log(4)
    total = other + t
    return stirling + total * math.log(0.5) + log_gamma(2 * CONCENTRATION + total) + t * log_parent


def _uniform(name: np.ndarray, number: int) -> np.ndarray:
    """A number in (0, 1) for every name, anew for every ``number``."""
    h = mix(name + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def gamma_draws(shape: np.ndarray, name: np.ndarray, sweep: int) -> np.ndarray:
    """Gamma variables of these shapes (over 1) by Marsaglia and Tsang, from the names' random numbers of a sweep."""
    out, left, number = np.empty(len(shape)), np.arange(len(shape)), (sweep + 1) << 20
    while len(left):
        d, own = shape[left] - 1 / 3, name[left]
        x = np.sqrt(-2 * np.log(_uniform(own, number))) * np.cos(2 * np.pi * _uniform(own, number + 1))
        v = (1 + x / np.sqrt(9 * d)) ** 3
        ok = (v > 0) & (np.log(_uniform(own, number + 2)) < 0.5 * x * x + d - d * v + d * np.log(np.where(v > 0, v, 1.0)))
        out[left[ok]] = (d * v)[ok]
        left, number = left[~ok], number + 3
    return out


FEW, CELLS = 16, 1 << 20  # customers up to which every number of tables is tried; numbers tried at once


def likely_tables(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where t + 1 tables of c customers become as likely as t: the ratio 4 x (c - t) / ((2 c - t - 1) t) is 1."""
    b = 2 * c - 1 + 4 * x
    return 8 * x * c / (b + np.sqrt(b * b - 16 * x * c))


def draw_tables(c: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Tables t of c > 1 customers, with weight S(c, t) x^t, at the points ``u`` of their distribution.

    ``c`` ascends.  Over ``FEW`` customers the numbers within ten deviations of the likeliest and twenty more are
    tried; less than 1e-15 of the weight is outside.
    """
    out = np.empty(len(c))

    def draw(i, low: np.ndarray, width: int) -> None:
        t = low[:, None] + np.arange(width - 1.0)
        own = c[i][:, None]
        weight = np.ones((len(low), width))
        np.cumprod(np.maximum(4 * x[i][:, None] * (own - t), 0) / ((2 * own - t - 1).clip(1) * t), axis=1, out=weight[:, 1:])
        np.cumsum(weight, axis=1, out=weight)
        out[i] = low + (weight[:, :-1] <= u[i][:, None] * weight[:, -1:]).sum(1)

    edges = np.searchsorted(c, np.arange(2, FEW + 2))
    for count, a, z in zip(range(2, FEW + 1), edges, edges[1:]):
        for at in range(a, z, CELLS // count):
            i = slice(at, min(z, at + CELLS // count))
            draw(i, np.ones(i.stop - i.start), count)
    many = np.arange(edges[-1], len(c))
    if len(many):
        own, best = c[many], likely_tables(c[many], x[many]).clip(1, c[many])
        reach = np.ceil(10 / np.sqrt(1 / best + 1 / (own - best + 0.5) - 1 / (2 * own - best)) + 20)
        low, high = np.maximum(1, np.floor(best) - reach), np.minimum(own, np.ceil(best) + reach)
        width = (high - low + 1).astype(np.int64)
        order, at = np.argsort(width, kind="stable"), 0
        while at < len(many):
            # Of about equal widths, as many as stand in CELLS at the widest.
            stop = max(at + 1, int(np.searchsorted(width[order], width[order[at]] * 1.25 + 1)))
            stop = min(stop, at + max(1, CELLS // int(width[order[stop - 1]])))
            i = order[at:stop]
            draw(many[i], low[i], int(width[i].max()))
            at = stop
    return out


def gibbs(c: np.ndarray, log_parent: np.ndarray, restaurant: np.ndarray, dishes: np.ndarray, name: np.ndarray, burn: int, samples: int, given: dict[int, np.ndarray] | None = None):
    """Mean tables of dishes with c > 1 customers over the sweeps after ``burn``, and every sweep's restaurant variables.

    A restaurant's dishes hang together by G(2 a + T) alone, T being its tables and a the concentration.  That is an
    integral over a variable g ~ Gamma(2 a + T); given g the dishes are independent, each with weight
    S(c, t) (g p / 2)^t, p being the parent's probability.  A sweep draws g of every restaurant given its current
    tables, then the tables of all its dishes given g, both exactly.  ``dishes`` are the restaurants' numbers of
    dishes, those with one customer (and one table) among them; ``given`` has the variables of restaurants that
    stand here in part.  The chain begins near the likeliest tables.
    """
    order = np.argsort(c, kind="stable")
    c, restaurant, name = c[order].astype(np.float64), restaurant[order], name[order]
    x = np.exp(log_parent[order]) / 2
    n = len(dishes)
    fixed = dishes - np.bincount(restaurant, minlength=n)
    key = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(key, restaurant, name)
    total = dishes.astype(np.float64)
    for _ in range(8):
        total = fixed + np.bincount(restaurant, likely_tables(c, x * (2 * CONCENTRATION + total)[restaurant]).clip(1, c), n)
    mean, variables = np.zeros(len(c)), np.empty((burn + samples, n))
    for sweep in range(burn + samples):
        variables[sweep] = gamma_draws(2 * CONCENTRATION + total, key, sweep)
        for r, own in (given or {}).items():
            variables[sweep, r] = own[sweep]
        t = draw_tables(c, x * variables[sweep][restaurant], _uniform(name, sweep))
        total = fixed + np.bincount(restaurant, t, n)
        if sweep >= burn:
            mean += t
    out = np.empty(len(c))
    out[order] = mean / samples
    return out, variables


BURN, SAMPLES = 2, 4


def seat(
    c: np.ndarray, log_parent: np.ndarray, others: np.ndarray, name: np.ndarray, burn: int = BURN, samples: int = SAMPLES,
    restaurant: np.ndarray | None = None, given: dict[int, np.ndarray] | None = None,
) -> np.ndarray:
    """Mean tables per dish over the sweeps after ``burn``, for c >= 1 customers and ``others`` other dishes in the
    restaurant; ``name`` is the hash that a dish's random numbers come from.

    ``restaurant`` numbers the dishes' restaurants; without it the dishes of one stand together and are all here.
    ``given`` has the variables, by sweep, of restaurants of which only some dishes are here.
    """
    t = np.ones(len(c))
    if restaurant is None:
        restaurant, at = np.zeros(len(c), np.int64), 0
        while at < len(c):
            at += int(others[at]) + 1
            restaurant[at:] += 1
    movable = np.flatnonzero(c > 1)
    if len(movable):
        here, own = np.unique(restaurant[movable], return_inverse=True)
        dishes = np.empty(len(here))
        dishes[own] = others[movable] + 1
        inside = {i: given[r] for i, r in enumerate(here.tolist()) if r in given} if given else None
        t[movable], _ = gibbs(c[movable], log_parent[movable], own, dishes, name[movable], burn, samples, inside)
    return t


# --- packed rows ------------------------------------------------------------------------------


def _small(values: np.ndarray) -> bytes:
    """The values as the narrowest of one, two, four or eight byte integers."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _wide(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // count] if count else np.uint8).astype(np.int64)


class _Rows:
    """A row schema as Spark, Arrow and column names."""

    def __init__(self, text: str) -> None:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
        pairs = [x.split() for x in text.split(", ")]
        self.text, self.names, self.types = text, [n for n, _ in pairs], [kinds[t] for _, t in pairs]

    def table(self, rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows)) or [()] * len(self.names)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, self.types)], names=self.names)


#: Of one chunk for one bucket: contexts with their pairs, each pair's word, training count and documents with times.
ASK = _Rows("bucket int, chunk bigint, size int, n_contexts int, pairs int, contexts binary, widths binary, words binary, trained binary, holders binary, owners binary, times binary, ids array<bigint>, tokens array<bigint>")
#: Between a bucket and a part of the parent: keys with customers and tables (thousandths).
UP = _Rows("kind int, part int, bucket int, size int, keys binary, customers binary, tables binary")
#: The sums over all buckets, in the order of the keys that came up, and once per part its totals.
DOWN = _Rows("round int, kind int, part int, bucket int, size int, customers binary, tables binary, n_words bigint, n_customers bigint, n_tables bigint")
#: Of a split context in one bucket: its number of dishes anywhere, and the dishes here with more than one customer.
SHARE = _Rows("context bigint, bucket int, size int, dishes bigint, names binary, customers binary, parents binary")
TELL = _Rows("chunk bigint, train_tokens bigint, owners binary, known binary, base binary, score binary, ids array<bigint>, tokens array<bigint>")
SCALE = 1000.0


def split_of(contexts: np.ndarray, words: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hash by which a pair's bucket is chosen: of the context, and for the heavy ones of a share of its words."""
    h = mix(contexts)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], contexts), len(heavy[0]) - 1)
        hot = heavy[0][at] == contexts
        h[hot] = mix(h[hot] + (mix(words[hot]) >> np.uint64(7)) % heavy[1][at[hot]])
    return h


def _ask(ids: list, trains: np.ndarray, texts: list[str], chunk: int, buckets: int, heavy) -> pa.Table:
    """The rows of one chunk, one per bucket that it has pairs for, and its own row of ids and token counts."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1) - 1
    words = np.empty(len(hashes) + len(texts), np.uint64)
    inner = np.ones(len(words), bool)
    inner[ends] = False
    words[inner], words[ends] = hashes, END_HASH
    contexts = np.concatenate([[END_HASH], words[:-1]])  # a text begins after an end
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts + 1)
    bucket = (split_of(contexts, words, heavy) >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((words, contexts, bucket))
    words, contexts, owner, bucket = words[order], contexts[order], owner[order], bucket[order]
    # One entry per (pair, document) with its times, then one per pair; documents ascend within a pair.
    new_pair = np.ones(len(words), bool)
    new_pair[1:] = (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])
    new_entry = new_pair.copy()
    new_entry[1:] |= owner[1:] != owner[:-1]
    entry, pair = np.flatnonzero(new_entry), np.flatnonzero(new_pair)
    times = np.diff(np.append(entry, len(words)))
    trained = np.add.reduceat(trains[owner].astype(np.int64), pair)
    holders = np.diff(np.append(np.searchsorted(entry, pair), len(entry)))
    edges = np.searchsorted(bucket[pair], np.arange(buckets + 1, dtype=np.uint64)) if buckets < 4 * len(pair) else None
    present = np.unique(bucket[pair]) if edges is None else np.flatnonzero(np.diff(edges))
    rows = [(int(chunk % buckets), chunk, 0, 0, 0, *[b""] * 7, ids, (counts + 1).tolist())]
    first_entry = np.append(np.searchsorted(entry, pair), len(entry))
    owners = owner[entry]
    for b in present.tolist():
        a, z = (edges[b], edges[b + 1]) if edges is not None else np.searchsorted(bucket[pair], np.array([b, b + 1], np.uint64))
        p, q = first_entry[a], first_entry[z]
        own = contexts[pair[a:z]]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows.append((int(b), chunk, int(z - a), len(heads), int(q - p), own[heads].tobytes(), _small(np.diff(np.append(heads, len(own)))), words[pair[a:z]].tobytes(), _small(trained[a:z]), _small(holders[a:z]), _small(owners[p:q]), _small(times[p:q]), None, None))
    return ASK.table(rows)


class _Bucket:
    """The dishes of one bucket's contexts, merged from its chunks."""

    def __init__(self, asked: pa.Table, heavy) -> None:
        self.asked = asked.filter(pc.greater(asked["size"], 0)).sort_by("chunk")
        names = ["chunk", "size", "n_contexts", "pairs", "contexts", "widths", "words", "trained"]
        cols = {c: self.asked[c].to_pylist() for c in names}
        contexts = [np.repeat(np.frombuffer(c, np.uint64), _wide(w, n)) for c, w, n in zip(cols["contexts"], cols["widths"], cols["n_contexts"])]
        empty = np.zeros(0, np.uint64)
        context = np.concatenate([empty, *contexts])
        word = np.concatenate([empty, *(np.frombuffer(w, np.uint64) for w in cols["words"])])
        trained = np.concatenate([np.zeros(0, np.int64), *(_wide(x, n) for x, n in zip(cols["trained"], cols["size"]))])
        self.sizes = cols["size"]
        name = mix(context * np.uint64(0x9E3779B97F4A7C15) ^ mix(word))
        self.name, first, self.inverse = np.unique(name, return_index=True, return_inverse=True)
        self.c = np.bincount(self.inverse, trained, len(self.name))
        self.contexts, self.restaurant = np.unique(context[first], return_inverse=True)
        self.words, self.word = np.unique(word[first], return_inverse=True)
        at = np.minimum(np.searchsorted(heavy[0], self.contexts), max(0, len(heavy[0]) - 1))
        self.split = np.flatnonzero(heavy[0][at] == self.contexts) if len(heavy[0]) else np.zeros(0, np.int64)
        self.known = np.flatnonzero(self.c > 0)

    def up(self, bucket: int, parts: int, tables: np.ndarray, first: bool) -> list[tuple]:
        """Rows for the parent's parts: every word here, and the split contexts, with their tables; keys and
        customers go up in the first round only, and the second keeps their order."""
        rows = []
        for kind, keys, index in ((WORDS, self.words, self.word), (CONTEXTS, self.contexts[self.split], None)):
            if index is None:
                c = np.bincount(self.restaurant, self.c, len(self.contexts))[self.split]
                t = np.bincount(self.restaurant, tables, len(self.contexts))[self.split]
            else:
                c, t = np.bincount(index, self.c, len(keys)), np.bincount(index, tables, len(keys))
            part = (mix(keys) >> np.uint64(13)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(keys) else []
            for a, z in zip(cuts, [*cuts[1:], len(keys)]):
                i = order[a:z]
                amounts = _small(np.rint(t[i] * SCALE).astype(np.int64))
                sent = (keys[i].tobytes(), _small(c[i].astype(np.int64))) if first else (b"", b"")
                rows.append((kind, int(part[i[0]]), bucket, len(i), *sent, amounts))
        return rows

    def down(self, answers: list[dict], parts: int, number: int) -> dict:
        """The parent's sums of one round for the words and split contexts here."""
        found = {k: (np.zeros(n), np.zeros(n)) for k, n in ((WORDS, len(self.words)), (CONTEXTS, len(self.split)))}
        for kind, keys in ((WORDS, self.words), (CONTEXTS, self.contexts[self.split])):
            part = ((mix(keys) >> np.uint64(13)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for r in answers:
                if r["round"] == number and r["kind"] == kind:
                    a, z = np.searchsorted(part[order], [r["part"], r["part"] + 1])
                    i = order[a:z]
                    if r["customers"]:
                        found[kind][0][i] = _wide(r["customers"], r["size"])
                    found[kind][1][i] = _wide(r["tables"], r["size"]) / SCALE
        return found

    def _parents(self, answers: list[dict], parts: int) -> tuple[dict, np.ndarray, np.ndarray]:
        """The first round's sums, and of the dishes with customers the parent's log probability and the
        number of other dishes in the restaurant."""
        first = self.down(answers, parts, 1)
        total = max(1.0, next(r["all_tables"] for r in answers if r["round"] == 1) / SCALE)
        k = self.known
        tables = np.bincount(self.restaurant[k], minlength=len(self.contexts)).astype(np.float64)
        tables[self.split] = first[CONTEXTS][1]
        parent = (first[WORDS][1][self.word[k]] - DISCOUNT) / (CONCENTRATION + total)
        return first, np.log(parent), tables[self.restaurant[k]] - 1.0

    def shares(self, bucket: int, answers: list[dict], parts: int) -> list[tuple]:
        """Of every split context the dishes here with more than one customer."""
        _, log_parent, others = self._parents(answers, parts)
        k, rows = self.known, []
        c, of, name = self.c[k], self.restaurant[k], self.name[k]
        i = np.flatnonzero((c > 1) & np.isin(of, self.split))
        i = i[np.argsort(of[i], kind="stable")]
        cuts = np.flatnonzero(np.append(True, np.diff(of[i]) != 0)) if len(i) else []
        for a, z in zip(cuts, [*cuts[1:], len(i)]):
            j = i[a:z]
            context = int(self.contexts[of[j[0]]].astype(np.int64))
            rows.append((context, bucket, len(j), int(others[j[0]]) + 1, name[j].tobytes(), _small(c[j].astype(np.int64)), log_parent[j].tobytes()))
        return rows

    def seated(self, answers: list[dict], parts: int) -> tuple[np.ndarray, dict]:
        """Mean tables of every dish (0 for those without customers) under the first round's parent."""
        first, log_parent, others = self._parents(answers, parts)
        t, k = np.zeros(len(self.c)), self.known
        drawn = {r["customers"]: np.frombuffer(r["tables"]) for r in answers if r["round"] == DRAWN}
        given = {int(s): drawn[key] for s in self.split if (key := self.contexts[s].tobytes()) in drawn}
        t[k] = seat(self.c[k], log_parent, others, self.name[k], restaurant=self.restaurant[k], given=given)
        return t, first

    def tell(self, answers: list[dict], parts: int, asked: pa.Table) -> list[tuple]:
        """Per chunk the sums over this bucket of each document."""
        t, first = self.seated(answers, parts)
        second = self.down(answers, parts, 2)
        one = next(r for r in answers if r["round"] == 1)
        n, v = one["all_customers"], one["all_words"]
        total = next(r["all_tables"] for r in answers if r["round"] == 2) / SCALE
        customers = np.bincount(self.restaurant, self.c, len(self.contexts))
        tables = np.bincount(self.restaurant, t, len(self.contexts))
        customers[self.split], tables[self.split] = first[CONTEXTS][0], second[CONTEXTS][1]
        count = first[WORDS][0]  # of every word here, over the corpus
        parent = np.where(count > 0, second[WORDS][1] - DISCOUNT, CONCENTRATION + DISCOUNT * v) / (CONCENTRATION + total)
        below = (CONCENTRATION + DISCOUNT * tables) / (CONCENTRATION + customers)
        own = (self.c - DISCOUNT * t) / (CONCENTRATION + customers[self.restaurant])
        score = np.log10(own + below[self.restaurant] * parent[self.word])
        base = (np.log10(count + 1) - math.log10(n + v + 1))[self.word]
        known = (count > 0)[self.word]
        rows, at = [], 0
        for size, pairs, chunk, holders, owners, times in zip(*(self.asked[c].to_pylist() for c in ("size", "pairs", "chunk", "holders", "owners", "times"))):
            dish = np.repeat(self.inverse[at : at + size], _wide(holders, size))
            at += size
            owner, time = _wide(owners, pairs), _wide(times, pairs)
            docs = np.unique(owner)
            sums = [np.bincount(owner, time * x[dish])[docs] for x in (known, base, score)]
            rows.append((chunk, n, docs.astype(np.uint16).tobytes() if docs[-1] < 1 << 16 else docs.astype(np.uint32).tobytes(), _small(sums[0].astype(np.int64)), sums[1].tobytes(), sums[2].astype(np.float32).tobytes(), None, None))
        return rows


def _sum_part(up: pa.Table, number: int, later: pa.Table | None = None) -> pa.Table:
    """One part of the parent: the sums of every key over all buckets, back to each bucket in its own order.

    ``later`` are the tables of the second round for the keys of the first.
    """
    rows = up.sort_by("bucket").to_pylist()
    if not rows:
        return DOWN.table([])
    sent = rows if later is None else later.sort_by("bucket").to_pylist()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    unique, inverse = np.unique(keys, return_inverse=True)
    tables = np.bincount(inverse, np.concatenate([_wide(r["tables"], r["size"]) for r in sent]), len(unique)).astype(np.int64)
    customers = np.bincount(inverse, np.concatenate([_wide(r["customers"], r["size"]) for r in rows]), len(unique)).astype(np.int64)
    words = rows[0]["kind"] == WORDS
    totals = (int((customers > 0).sum()), int(customers.sum()), int(tables.sum())) if words else (0, 0, 0)
    out, at = [], 0
    for r in rows:
        i = inverse[at : at + r["size"]]
        at += r["size"]
        out.append((number, r["kind"], r["part"], r["bucket"], r["size"], _small(customers[i]) if number == 1 else b"", _small(tables[i]), *totals))
        totals = 0, 0, 0
    return DOWN.table(out)


def _draw_split(shares: pa.Table) -> pa.Table:
    """One split context's variables of all sweeps, for every bucket with dishes of it."""
    rows = shares.sort_by("bucket").to_pylist()
    c = np.concatenate([_wide(r["customers"], r["size"]) for r in rows])
    name, log_parent = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in (("names", np.uint64), ("parents", np.float64)))
    _, variables = gibbs(c, log_parent, np.zeros(len(c), np.int64), np.array([float(rows[0]["dishes"])]), name, BURN, SAMPLES)
    key = np.int64(rows[0]["context"]).astype(np.uint64).tobytes()
    return DOWN.table([(DRAWN, CONTEXTS, 0, r["bucket"], 1, key, variables[:, 0].tobytes(), 0, 0, 0) for r in rows])


def _gather(told: pa.Table) -> pa.Table:
    """One chunk's documents with the sums of all buckets."""
    rows = told.to_pylist()
    meta = next(r for r in rows if r["ids"] is not None)
    n = len(meta["ids"])
    known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    parts = sorted((r for r in rows if r["ids"] is None), key=lambda r: (r["owners"], r["base"], r["score"]))
    for r in parts:  # in a fixed order, so that sums do not depend on arrival
        docs = np.frombuffer(r["owners"], np.uint16 if n <= 1 << 16 else np.uint32)
        known[docs] += _wide(r["known"], len(docs))
        base[docs] += np.frombuffer(r["base"])
        score[docs] += np.frombuffer(r["score"], np.float32)
    trained = max(r["train_tokens"] for r in rows)
    arrays = [pa.array(meta["ids"], pa.int64()), pa.array(meta["tokens"], pa.int64()), pa.array(known), pa.array([trained] * n, pa.int64()), pa.array(base), pa.array(score)]
    return pa.table(arrays, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def heavy_contexts(docs: DataFrame, share: float) -> dict[int, float]:
    """Words (hashes) with at least ``share`` of all tokens, and about how large their share is.

    Every batch names the words over half of ``share`` in it; a word over ``share`` of all has more than half its
    tokens in such batches.  At most ``2 / share`` words come back.
    """

    def count(batches):
        for batch in batches:
            hashes, _ = word_hashes([t or "" for t in batch["text"].to_pylist()])
            hashes = np.concatenate([hashes, np.full(batch.num_rows, END_HASH)])
            unique, n = np.unique(hashes, return_counts=True)
            often = n >= share * len(hashes) / 2
            words = np.concatenate([unique[often], [np.uint64(0)]]).astype(np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.append(n[often], len(hashes)).astype(np.int64))], ["word", "n"])

    counted = staged(docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = counted.where("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counted.where((F.col("word") != 0) & (F.col("n") >= share * total / 2)).collect()
    return {r.word: r.n / total for r in rows}


def score_documents(docs: DataFrame, chunk_chars: int = 1 << 23, chunk_docs: int = 20_000, bucket_bytes: int = 12_000_000, least_buckets: int = 32) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text, trains)``; the rows with ``trains`` are learned from."""
    own = docs.select("doc_id", "text", F.coalesce("trains", F.lit(False)).alias("trains"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = parts = max(least_buckets, -(-size // bucket_bytes))
    found = heavy_contexts(own, 0.25 / buckets)
    keys = np.array(sorted(found), np.int64).astype(np.uint64)
    keys.sort()
    splits = np.array([max(2, math.ceil(4 * buckets * found[int(k.astype(np.int64))])) for k in keys], np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((keys, splits))  # at most 8 words a bucket

    def ask(batches):
        ids, flags, texts, total, number = [], [], [], 0, 0
        first = TaskContext.get().partitionId() << 32  # a scan's partitions hold the same rows on every attempt

        def flush():
            nonlocal ids, flags, texts, total, number
            out = _ask(ids, np.array(flags, bool), texts, first + number, buckets, shared.value)
            ids, flags, texts, total, number = [], [], [], 0, number + 1
            return out.to_batches()

        for batch in batches:
            for doc, text, flag in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["trains"].to_pylist()):
                ids.append(doc)
                flags.append(flag)
                texts.append(text or "")
                total += len(text or "")
                if total >= chunk_chars or len(ids) >= chunk_docs:
                    yield from flush()
        if ids:
            yield from flush()

    def first_seats(asked: pa.Table) -> pa.Table:
        b = _Bucket(asked, shared.value)
        return UP.table(b.up(asked["bucket"][0].as_py(), parts, (b.c > 0).astype(np.float64), True) if len(b.c) else [])

    def split_shares(asked: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Bucket(asked, shared.value) if asked.num_rows and len(shared.value[0]) else None
        if b is None or not len(b.split):
            return SHARE.table([])
        return SHARE.table(b.shares(asked["bucket"][0].as_py(), answers.to_pylist(), parts))

    def mean_seats(asked: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Bucket(asked, shared.value) if asked.num_rows else None
        if b is None or not len(b.c):
            return UP.table([])
        return UP.table(b.up(asked["bucket"][0].as_py(), parts, b.seated(answers.to_pylist(), parts)[0], False))

    def tell(asked: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [(r["chunk"], 0, None, None, None, None, r["ids"], r["tokens"]) for r in asked.select(["chunk", "ids", "tokens"]).to_pylist() if r["ids"] is not None]
        b = _Bucket(asked, shared.value) if asked.num_rows else None
        return TELL.table(rows + (b.tell(answers.to_pylist(), parts, asked) if b is not None and len(b.c) else []))

    def with_totals(down: DataFrame) -> DataFrame:
        sums = down.agg(*(F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"all_{c}") for c in ("words", "customers", "tables")))
        return down.crossJoin(F.broadcast(sums)).drop("n_words", "n_customers", "n_tables")  # one row of totals

    asked = own.mapInArrow(ask, ASK.text)
    up = asked.groupBy("bucket").applyInArrow(first_seats, UP.text)
    first = with_totals(up.groupBy("kind", "part").applyInArrow(lambda t: _sum_part(t, 1), DOWN.text))
    shares = asked.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(split_shares, SHARE.text)
    drawn = shares.groupBy("context").applyInArrow(_draw_split, DOWN.text).drop("n_words", "n_customers", "n_tables")
    first = first.unionByName(drawn, allowMissingColumns=True)
    later = asked.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(mean_seats, UP.text)
    second = with_totals(up.groupBy("kind", "part").cogroup(later.groupBy("kind", "part")).applyInArrow(lambda a, b: _sum_part(a, 2, b), DOWN.text))
    told = asked.groupBy("bucket").cogroup(first.unionByName(second).groupBy("bucket")).applyInArrow(tell, TELL.text)
    return told.groupBy("chunk").applyInArrow(_gather, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_documents(docs.withColumn("trains", fold("doc_id", 7) != 2))
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
