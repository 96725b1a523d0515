"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is the multiset of its words (A-Z lowered, split at ASCII white space); a word's weight is
its count.  Per sample and word, r and c are Gamma(2, 1) and beta is uniform, all drawn from hashes of
the word alone: t = floor(ln(weight) / r + beta), ln a = ln c - r (t - beta + 1).  The word with the
smallest a and its t are the sample.  Two documents agree on a sample with probability equal to their
generalised Jaccard similarity, the sum of smaller over the sum of larger counts.

Plan: documents are dealt once, by ranges of ids, into buckets; every later window and grouping is
by bucket first and so needs no further exchange.  A bucket's last document meets the head of the
following bucket through a table of one row per bucket.

Edge cases: null and empty texts have no words, all samples 0, and are alike (1.0); a null id comes
last; equal ids are ordered by text and all kept; a single document is its own next one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm._common import shuffle_partitions, table

SAMPLES = 32
WIDTH = 8  # samples per row: keeps each generated method small enough for the JIT compiler
LOW32 = 0xFFFFFFFF
_LEAST = -(1 << 63)
_SALTS = np.random.default_rng(20200229).integers(-(1 << 63), (1 << 63) - 1, (WIDTH, 4)).tolist()


def _draw(term: Column, salt: int) -> tuple[Column, Column]:
    """Two uniforms in (0, 1) from one hash."""
    h = F.xxhash64(term.bitwiseXOR(F.lit(salt)))
    low = h.bitwiseAND(F.lit(LOW32)).cast("double")
    high = F.shiftrightunsigned(h, 32).cast("double")
    return (low + 0.5) / 4294967296.0, (high + 0.5) / 4294967296.0


def _sample(term: Column, log_weight: Column, i: int) -> Column:
    """ln a in the upper and the identity of (word, t) in the lower 32 bits: the least one wins."""
    u1, u2 = _draw(term, _SALTS[i][0])
    u3, u4 = _draw(term, _SALTS[i][1])
    beta, _ = _draw(term, _SALTS[i][2])
    r = -F.log(u1 * u2)
    level = F.floor(log_weight / r + beta)
    log_a = F.log(-F.log(u3 * u4)) - r * (level - beta + 1.0)
    order = F.floor((F.greatest(F.least(log_a, F.lit(120.0)), F.lit(-120.0)) + 128.0) * 8388608.0)
    name = F.xxhash64(term.bitwiseXOR(F.lit(_SALTS[i][3])), level)
    return F.shiftleft(order, 32).bitwiseOR(name.bitwiseAND(F.lit(LOW32)))


def _terms(hashes: Column) -> Column:
    """(term, count) structs of a sorted array of word hashes."""
    last = F.size(hashes) - 1
    ends = F.filter(F.transform(hashes, lambda x, i: F.when((i == last) | (x != F.get(hashes, i + 1)), i)), lambda e: e.isNotNull())
    return ends


def _buckets(docs: DataFrame, count: int) -> list[int]:
    """Ascending id bounds that deal the documents into about ``count`` even ranges (count is a parameter)."""
    shares = [i / count for i in range(1, count)]
    found = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", shares, 10 * count).alias("p")).first()["p"] if shares else []
    return sorted(set(found or []))


def _bucket_of(bounds: list[int]) -> Column:
    """How many bounds are at most the id, by binary search; a null id counts as the least."""
    if not bounds:
        return F.lit(0)
    sorted_ = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    own = F.coalesce("doc_id", F.lit(_LEAST))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(sorted_, at + step - 1) <= own, F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, place, doc_id, text, next_text, is_last`` in descending id order, the last followed by the first."""
    bucket = _bucket_of(_buckets(docs, buckets))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.alias("bucket"))
    heads = own.groupBy("bucket").agg(F.max(F.coalesce("doc_id", F.lit(_LEAST))).alias("head"))
    rows = sorted(((r.bucket, r.head) for r in heads.collect()), reverse=True)  # one row per bucket
    follow = [(b, *rows[(i + 1) % len(rows)]) for i, (b, _) in enumerate(rows)]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(follow, "follows int, bucket int, head bigint")
    head_texts = (
        own.join(F.broadcast(wanted), (own["bucket"] == wanted["bucket"]) & (F.coalesce(own["doc_id"], F.lit(_LEAST)) == wanted["head"]))
        .groupBy(F.col("follows").alias("bucket"))
        .agg(F.min("text").alias("head_text"))
    )
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    placed = own.withColumns({"place": F.row_number().over(order), "following": F.lead("text").over(order)})
    return placed.join(head_texts, "bucket", "left").select(
        "bucket", "place", "doc_id", "text", F.coalesce("following", "head_text").alias("next_text"), F.col("following").isNull().alias("is_last")
    )


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)``, of its edited text, and their likenesses."""
    if samples % WIDTH:
        raise ValueError(f"samples must be a multiple of {WIDTH}")
    groups = samples // WIDTH
    size = F.char_length("text")
    cut = F.floor(size / 3).cast("int")
    rows = with_next(docs, buckets or 8 * shuffle_partitions(docs.sparkSession))
    rows = rows.select(
        "bucket", "place", "doc_id", size.cast("bigint").alias("n_chars"), "text", "next_text", "is_last",
        F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"),
    )
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
            F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")),
            F.when(F.col("is_last"), F.struct(F.lit(2).alias("kind"), F.col("next_text").alias("body"))),
        )
    )
    keys = ["bucket", "place", "doc_id", "n_chars", "edited_sha256"]
    bodies = rows.select(*keys, F.explode(kinds).alias("b")).select(*keys, "b.kind", "b.body")
    lowered = F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(F.translate(lowered, "\t\n\x0b\x0c\r", "     "), " +")
    hashed = bodies.select(*keys, "kind", F.array_sort(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))).alias("h"))
    ended = hashed.select(*keys, "kind", "h", _terms(F.col("h")).alias("e"))
    term = lambda p, j: F.struct(F.get(F.col("h"), p).alias("term"), (p - F.when(j == 0, F.lit(-1)).otherwise(F.get(F.col("e"), j - 1))).alias("n"))
    terms = ended.select(*keys, "kind", F.explode_outer(F.transform("e", term)).alias("t"))
    terms = terms.select(*keys, "kind", F.col("t.term").alias("term"), F.log(F.col("t.n").cast("double")).alias("log_n"))
    if groups > 1:
        terms = terms.select("*", F.explode(F.array(*map(F.lit, range(groups)))).alias("part"))
    else:
        terms = terms.withColumn("part", F.lit(0))
    mixed = terms.select(*keys, "kind", "part", "log_n", F.when(F.col("term").isNotNull(), F.xxhash64("term", "part")).alias("term"))
    drawn = mixed.groupBy(*keys, "kind", "part").agg(*(F.min(_sample(F.col("term"), F.col("log_n"), i)).alias(f"s{i}") for i in range(WIDTH)))
    signature = F.array(*(F.coalesce(F.col(f"s{i}").bitwiseAND(F.lit(LOW32)), F.lit(0)) for i in range(WIDTH)))
    parts = drawn.select(*keys, F.struct("kind", "part", signature.alias("sig")).alias("s"))
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("all"))
    of = lambda kind: F.flatten(F.transform(F.filter("all", lambda s: s["kind"] == kind), lambda s: s["sig"]))
    found = gathered.select(*keys, of(0).alias("own"), of(1).alias("edited"), of(2).alias("beyond"))
    order = Window.partitionBy("bucket").orderBy("place")
    found = found.withColumn("following", F.coalesce(F.lead("own").over(order), "beyond"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", _text("own").alias("fingerprint"), _text("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "following").alias("near_next"),
    )


def _text(name: str) -> Column:
    return F.array_join(F.transform(name, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of samples on which two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a).cast("double")


def query(spark, sf_dir) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))
