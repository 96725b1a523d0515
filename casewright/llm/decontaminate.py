"""Benchmark decontamination by spaced seeds.

Fixed masks select some positions of a token window and ignore the others.  The hashes of the selected
tokens, of test items and of documents, are rows that Spark joins; each match is a hit.  Around each hit
the item is laid over the document on the hit's diagonal and the best stretch, scored +1 per equal token
and -2 per other, is kept: substitutions are tolerated, chance hits on common words are not.  Where that
stretch is too short, the longest one with enough equal tokens counts.

The masks hit every stretch of 13 tokens or more with 0.8 of them equal: one of 26 or more has such a
half, and for those of 13 to 25 every pattern of substitutions leaves some mask untouched.  An item of
under 13 tokens has masks of its own over the whole item, for as many substitutions as are allowed.

Only a filter of the test seeds, two bits a seed and never over ``2 ** FILTER_BITS`` bits, is sent to every
task: a document gives rows for the seeds that pass it.  A filter that fills up lets more rows into the
join and loses none.  Hits are grouped by document and block of test items, at most about ``block_tokens``
tokens each, and joined to the documents for the check, so no row holds more of a test set of any size.

Edge cases: null and empty texts and items have no tokens and match nothing; items shorter than a
mask are sought as a whole; repeated items and repeated documents each give their own rows; a null id is
an id of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import mix, powers, slices, staged, table, word_hashes

#: Selected positions of each mask.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 9), (0, 1, 2, 3, 4, 5))
SHORT = 13
MATCH, OTHER = 1, -2
SCHEMA = "doc_id {}, item_id bigint, first_token int, n_tokens int, n_equal int"
#: Code points hashed together, or one text.
SLICE = 1 << 19
#: The filter's largest size, 16 MB, and the bits of one row of it.
FILTER_BITS = 27
_PART = 1 << 15


def _doc() -> Column:
    """The key by which hits find their document."""
    return F.xxhash64("doc_id", "text")


def _seed(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The masked hash at every position where the mask fits."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.full(n, number + 1, np.uint64)
    for p, w in zip(mask, powers(len(mask) + 1)[1:]):
        value += hashes[p : p + n] * w
    return mix(value)


def _least(n: int, min_share: float) -> int:
    """The fewest equal tokens of ``n`` that are enough."""
    return int(np.ceil(min_share * n - 1e-9))


def _short_masks(n: int, others: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of ``n`` tokens, one of which avoids any ``others`` positions."""
    parts = 2 * others + 1
    return [tuple(p for p in range(n) if p % parts not in left_out) for left_out in combinations(range(parts), others)]


def _masks(lengths: set[int], min_share: float) -> list[tuple[int, int, tuple[int, ...]]]:
    """(number, item length or 0 for all, mask): the common masks and those of the short lengths given.

    A mask's number does not depend on which lengths are given.
    """
    short = [(n, mask) for n in range(1, SHORT) for mask in _short_masks(n, n - _least(n, min_share))]
    every = [*((0, mask) for mask in MASKS), *short]
    return [(k, n, mask) for k, (n, mask) in enumerate(every) if n == 0 or n in lengths]


class SeedFilter:
    """A Bloom filter of the test seeds with two bits a seed, built by Spark and bounded in size."""

    def __init__(self, seeds: DataFrame, number: int) -> None:
        self.bits = int(np.clip(np.ceil(np.log2(number + 1)) + 6, 16, FILTER_BITS))
        first, second = F.shiftrightunsigned("seed", 64 - self.bits), F.col("seed").bitwiseAND((1 << self.bits) - 1)
        bit = seeds.select(F.explode(F.array(first, second)).alias("bit"))
        parts = bit.groupBy(F.expr(f"bit div {_PART}").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % _PART).alias("map"))
        self.map = np.zeros(1 << self.bits >> 3, np.uint8)
        for part, found in parts.collect():  # at most 2 ** (FILTER_BITS - 15) rows of 4 KB
            self.map[part * _PART >> 3 :][: _PART >> 3] = np.frombuffer(found, np.uint8)[: len(self.map)]

    def may_hold(self, seeds: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self._set(seeds >> np.uint64(64 - self.bits)))
        return at[self._set(seeds[at] & np.uint64((1 << self.bits) - 1))]

    def _set(self, bit: np.ndarray) -> np.ndarray:
        return (self.map[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def item_table(items: DataFrame, blocks_of: int) -> DataFrame:
    """Staged: every different (item_id, text) with tokens, its rows, token hashes and block of items."""
    given = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    given = given.groupBy("item_id", "text").agg(F.count("*").alias("n_rows"))

    def run(batches):
        for batch in batches:
            for a, b in slices(texts := batch["text"].to_pylist(), SLICE):
                words, counts = word_hashes(texts[a:b], alnum=True)
                each = [w.tobytes() for w in np.split(words, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a) for c in ("item_id", "item", "n_rows")), pa.array(counts, pa.int64()), pa.array(each, pa.binary())],
                    ["item_id", "item", "n_rows", "n_words", "words"],
                )

    keyed = given.select("item_id", F.xxhash64("item_id", "text").alias("item"), "n_rows", "text")
    made = staged(keyed.mapInArrow(run, "item_id bigint, item bigint, n_rows bigint, n_words bigint, words binary").where("n_words > 0"), "items")
    total = made.agg(F.sum("n_words")).first()[0] or 0
    blocks = 2 * -(-total // blocks_of) if total > blocks_of else 1
    return made.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))


def item_seeds(items: DataFrame, min_share: float) -> DataFrame:
    """Staged: ``seed, item, place`` of every mask position of every item."""

    def run(batches):
        masks = _masks(set(range(SHORT)), min_share)
        for batch in batches:
            for item, raw in zip(batch["item"].to_pylist(), batch["words"].to_pylist()):
                words = np.frombuffer(raw, np.uint64)
                each = [_seed(words, mask, k) for k, n, mask in masks if n in (0, len(words))]
                seeds, places = np.concatenate(each), np.concatenate([np.arange(len(s), dtype=np.int32) for s in each])
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), item, np.int64)), pa.array(places)], ["seed", "item", "place"])

    return staged(items.select("item", "words").mapInArrow(run, "seed bigint, item bigint, place int"), "item-seeds")


def document_seeds(docs: DataFrame, held: SeedFilter, masks: list[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """``seed, doc, place`` of the mask positions of all documents that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            texts, docs_ = [t or "" for t in batch["text"].to_pylist()], batch["doc"].to_numpy(zero_copy_only=False)
            for a, b in slices(texts, SLICE):
                words, counts = word_hashes(texts[a:b], alnum=True)
                owner, begin = np.repeat(np.arange(b - a), counts), np.cumsum(counts) - counts
                for k, _, mask in masks:
                    seeds = _seed(words, mask, k)
                    at = shared.value.may_hold(seeds)
                    at = at[owner[at] == owner[at + mask[-1]]]
                    if len(at):
                        place = (at - begin[owner[at]]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(seeds[at].view(np.int64)), pa.array(docs_[a:b][owner[at]]), pa.array(place)], ["seed", "doc", "place"])

    return docs.select(_doc().alias("doc"), "text").mapInArrow(run, "seed bigint, doc bigint, place int")


def candidates(docs: DataFrame, items: DataFrame, min_share: float, block_tokens: int) -> DataFrame:
    """Staged: per document key and block of items the items hit, with the diagonals of their hits.

    A key that two documents share gives both the other's candidates too, which the check sorts out.
    """
    kept = item_table(items, block_tokens)
    seeds = item_seeds(kept, min_share)
    lengths = {r.n_words for r in kept.where(F.col("n_words") < SHORT).select("n_words").distinct().collect()}  # at most twelve
    found = document_seeds(docs, SeedFilter(seeds, seeds.count()), _masks(lengths, min_share))
    hits = found.alias("d").join(seeds.alias("i"), "seed").select("doc", "item", (F.col("d.place") - F.col("i.place")).alias("diagonal"))
    laid = hits.groupBy("doc", "item").agg(F.collect_set("diagonal").alias("diagonals"))
    each = F.struct("item_id", "n_rows", "words", "diagonals")
    return staged(laid.join(kept, "item").groupBy("doc", "block").agg(F.collect_list(each).alias("hit_items")), "candidates")


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal tokens of the stretch with the highest score."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, MATCH, OTHER))])
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    start = int(np.flatnonzero(gain[: end + 1] == low[end])[0])
    return start, end - start, int(equal[start:end].sum())


def longest_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """Start, length and equal tokens of the longest stretch with ``min_share`` of its tokens equal."""
    gain = np.concatenate([[0.0], np.cumsum(equal - min_share)])
    low = np.minimum.accumulate(gain)
    starts = np.searchsorted(-low, -gain - 1e-9)  # where the gain was first no higher
    end = int(np.argmax(np.arange(len(gain)) - starts))
    start = int(starts[end])
    return start, end - start, int(equal[start:end].sum())


def best_overlap(words: np.ndarray, own: np.ndarray, diagonals: list[int], min_tokens: int, min_share: float) -> tuple[int, int, int] | None:
    """(first token, tokens, equal tokens) of the item's best stretch in the document, the first of equals."""
    best = None
    for diagonal in sorted(diagonals):
        lo, hi = max(diagonal, 0), min(diagonal + len(own), len(words))
        same = words[lo:hi] == own[lo - diagonal : hi - diagonal]
        start, length, equal = best_stretch(same)
        if length < min(min_tokens, len(own)) or equal < _least(length, min_share):
            start, length, equal = longest_stretch(same, min_share)
        if length >= min(min_tokens, len(own)) and (best is None or (equal, -lo - start) > (best[2], -best[0])):
            best = (lo + start, length, equal)
    return best


def find_overlaps(docs: DataFrame, items: DataFrame, min_tokens: int = 13, min_share: float = 0.8, block_tokens: int = 1 << 17) -> DataFrame:
    """One row per document and test item of which it holds ``min_tokens`` aligned tokens (or the whole
    item, if shorter), ``min_share`` of them equal."""
    return _checked(docs, candidates(docs, items, min_share, block_tokens), F.col("doc_id"), "bigint", min_tokens, min_share)


def _checked(docs: DataFrame, hit: DataFrame, name: Column, kind: str, min_tokens: int, min_share: float) -> DataFrame:
    """The overlaps that ``hit``'s candidates really have, with ``name`` of type ``kind`` for the document."""
    held = docs.select(name.alias("doc_id"), "text", _doc().alias("doc")).join(hit, "doc").select("doc_id", "text", "hit_items")

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                words, _ = word_hashes([batch["text"][i].as_py()], alnum=True)
                for item in batch["hit_items"][i].as_py():
                    best = best_overlap(words, np.frombuffer(item["words"], np.uint64), item["diagonals"], min_tokens, min_share)
                    if best:
                        rows += [(batch["doc_id"][i].as_py(), item["item_id"], *best)] * item["n_rows"]
            columns, kinds = list(zip(*rows)) or [()] * 5, (batch["doc_id"].type, pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "first_token", "n_tokens", "n_equal"])

    return held.mapInArrow(run, SCHEMA.format(kind))


def drop_contaminated(docs: DataFrame, items: DataFrame, min_tokens: int = 13, min_share: float = 0.8, block_tokens: int = 1 << 17) -> DataFrame:
    """The rows of ``docs`` that overlap no test item, with all their columns."""
    name = F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    found = _checked(docs, candidates(docs, items, min_share, block_tokens), name, "string", min_tokens, min_share)
    bad = staged(found.select(F.col("doc_id").alias("#name")).distinct(), "contaminated")
    return docs.withColumn("#name", name).join(bad, "#name", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
