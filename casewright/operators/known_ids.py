"""Known identifiers in free text, for a registry of any size.

The rule is sequential: every known id that the text holds becomes a prefix and its uid, one id after another in the
registry's order; ids are plain substrings, without word boundaries.  The plan does not grow with the registry: ids
and texts meet in an equality join on n-grams.  An id is filed under the gram of it that the fewest ids share (its
whole, where it is shorter than a gram), a text under its distinct grams, and an id is met where the text contains it.
A text has some fifty grams and few of them file an id, so before they are shuffled they pass a bitmap of the index's
hashed grams, of a fixed size whatever the registry: it drops only grams that file nothing.

A replacement may bring up a later id that was not there before.  So the join is repeated over the texts in between, of
the rows that changed, until no further id comes up: then every id that the sequential rule would meet has been met,
and applying the ids of a row in order gives the same text.

Nulls stay null; empty and null ids are never met; of ids that stand in the registry twice the first in order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions.text import ENCODED

GRAM = 6
#: Bits of the map that texts' grams pass: at most 524,288 words of 64.
BITS = 1 << 25
_ROUNDS = 20


def grams(text: Column, size: int) -> Column:
    """All distinct substrings of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def gram_index(ids: DataFrame, size: int = GRAM) -> DataFrame:
    """``gram, id, uid, place`` for ``ids(id, uid, place)``: each id under its rarest gram."""
    first = ids.where(F.length("id") > 0).groupBy("id").agg(F.min(F.struct("place", "uid")).alias("of"))
    own = first.select("id", F.col("of.uid").alias("uid"), F.col("of.place").alias("place"))
    each = own.withColumn("gram", F.explode(F.when(F.length("id") <= size, F.array("id")).otherwise(grams(F.col("id"), size))))
    counted = each.groupBy("gram").agg(F.count("*").alias("n"))
    best = each.join(counted, "gram").groupBy("id", "uid", "place").agg(F.min(F.struct("n", "gram")).alias("of"))
    return best.select(F.col("of.gram").alias("gram"), "id", "uid", "place")


def _bit() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(BITS))


def gram_bits(index: DataFrame) -> DataFrame:
    """``#word, bits``: which hashed grams the index has, 64 to a word."""
    own = index.select(_bit().alias("bit")).select(F.shiftright("bit", 6).alias("#word"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("one"))
    return own.groupBy("#word").agg(F.bit_or("one").alias("bits"))


def _filed_somewhere(filed: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows of ``filed(row_key, gram)`` whose gram the index may have."""
    met = filed.withColumn("#bit", _bit()).join(F.broadcast(bits), F.shiftright("#bit", 6) == F.col("#word"))  # of a fixed size
    return met.where(F.expr("(shiftrightunsigned(bits, CAST(`#bit` % 64 AS INT)) & 1) = 1")).select("row_key", "gram")


def met_ids(texts: DataFrame, index: DataFrame, sizes: list[int], bits: DataFrame | None = None) -> DataFrame:
    """``row_key, id, uid, place`` of the indexed ids that ``texts(row_key, text)`` contain."""
    own = F.array_distinct(F.flatten(F.array(*(grams(F.col("text"), n) for n in sizes)))) if sizes else F.array().cast("array<string>")
    filed = _filed_somewhere(texts.select("row_key", F.explode(own).alias("gram")), gram_bits(index) if bits is None else bits)
    near = filed.join(index, "gram").select("row_key", "id", "uid", "place").distinct()
    return near.join(texts, "row_key").where(F.contains("text", F.col("id"))).select("row_key", "id", "uid", "place").distinct()


def steps(text: Column, found: Column, prefix: str = ENCODED) -> Column:
    """The text after each of ``found`` (array of place, id, uid, in order) has been replaced."""
    start = F.struct(text.alias("now"), F.array().cast("array<string>").alias("seen"))

    def one(state, e):
        now = F.replace(state["now"], e["id"], F.concat(F.lit(prefix), e["uid"]))
        return F.struct(now.alias("now"), F.when(now != state["now"], F.array_append(state["seen"], now)).otherwise(state["seen"]).alias("seen"))

    return F.aggregate(found, start, one)


def encode_known(texts: DataFrame, ids: DataFrame, prefix: str = ENCODED, size: int = GRAM, keep=None) -> DataFrame:
    """``row_key, encoded, found`` for ``texts(row_key, text)`` and ``ids(id, uid, place)``; keys are unique.

    ``found`` lists the ids that were replaced, in order.  ``keep(df, name)`` may write what one round has met and
    read it back, so that a long chain of rounds is not planned anew each time.
    """
    keep = keep or (lambda df, _: df)
    index = keep(gram_index(ids, size), "gram-index")
    sizes = sorted(r.n for r in index.select(F.length("gram").alias("n")).distinct().collect())  # at most ``size`` numbers
    own, bits = texts.select("row_key", "text"), keep(gram_bits(index), "gram-bits")
    met = keep(met_ids(own, index, sizes, bits), "met-0")
    for number in range(1, _ROUNDS):
        between = _applied(own.join(met.select("row_key").distinct(), "row_key", "left_semi"), met, prefix).select("row_key", F.explode("state.seen").alias("text"))
        keyed = between.select(F.struct("row_key", F.xxhash64("text").alias("h")).alias("row_key"), "text")
        more = met_ids(keyed, index, sizes, bits).select(F.col("row_key.row_key").alias("row_key"), "id", "uid", "place").distinct()
        new = keep(more.join(met.select("row_key", "id"), ["row_key", "id"], "left_anti"), f"met-{number}")
        if new.isEmpty():
            break
        met = met.unionByName(new)
    else:
        raise RuntimeError(f"identifiers still come up after {_ROUNDS} rounds")
    done = _applied(own, met, prefix)
    return done.select("row_key", F.col("state.now").alias("encoded"), _used(F.col("text"), F.col("found"), prefix).alias("found"))


def _applied(texts: DataFrame, met: DataFrame, prefix: str) -> DataFrame:
    lists = met.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("place", "id", "uid"))).alias("found"))
    joined = texts.join(lists, "row_key", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<place:bigint,id:string,uid:string>>")))
    return joined.withColumn("state", steps(F.col("text"), F.col("found"), prefix))


def _used(text: Column, found: Column, prefix: str) -> Column:
    """Of the ids that were met somewhere those that were there at their turn."""
    start = F.struct(text.alias("now"), F.array().cast("array<string>").alias("used"))

    def one(state, e):
        there = F.contains(state["now"], e["id"])
        now = F.replace(state["now"], e["id"], F.concat(F.lit(prefix), e["uid"]))
        return F.struct(now.alias("now"), F.when(there, F.array_append(state["used"], e["id"])).otherwise(state["used"]).alias("used"))

    return F.aggregate(found, start, one)["used"]
