"""The most similar registered name, by matching blocks, as a similarity join.

The ratio of two texts is twice the characters in their matching blocks over both lengths (Ratcliff and Obershelp).  It has
no index of its own, but two bounds that are cheap: it is at most what the lengths allow, and at most what the letters
in common allow.  The join finds pairs by them and works the ratio out only where it can still win:

1. A text is a set of letters, each with its occurrence (the second e is another element than the first).  For a ratio of
   ``cutoff`` two texts need a certain number of elements in common, so of each text only the rarest elements (all but
   that number, and one) have to be looked up: an equality join on an element, and on lengths that go together.
2. Pairs whose letters in common are too few are dropped.
3. For each text the name with the best bound is compared; then only names whose bound reaches its ratio are.

The result equals comparing all pairs and taking the best, ties by the greater name.  Distinct texts are compared once.
Null texts find nothing; an empty text finds the empty name.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTOFF = 0.6
_TINY = 1e-9


@F.arrow_udf(T.DoubleType())
def _ratio(value: pa.Array, name: pa.Array) -> pa.Array:
    out, matcher = [], difflib.SequenceMatcher()
    for v, n in zip(value.to_pylist(), name.to_pylist()):
        if v is None or n is None:
            out.append(None)
            continue
        if matcher.b != v:
            matcher.set_seq2(v)
        matcher.set_seq1(n)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def ratio(value: Column, name: Column) -> Column:
    """Similarity by matching blocks, the name's blocks looked for in the value."""
    return _ratio(value, name)


def elements(text: Column) -> Column:
    """The letters of a text, each with its occurrence number."""
    letters = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1))))
    numbered = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))
    return F.when(F.length(text) > 0, numbered).otherwise(F.array().cast("array<string>"))


def _prefix_length(length: Column, cutoff: float) -> Column:
    """How many of a text's elements have to be looked up: all but those that a match needs, and one."""
    shortest = F.ceil(length * (cutoff / (2 - cutoff)) - _TINY)
    needed = F.greatest(F.lit(1), F.ceil((length + shortest) * (cutoff / 2) - _TINY))
    return (length - needed + 1).cast("int")


def candidate_pairs(values: DataFrame, names: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``value, name, bound`` of the pairs of ``values(value)`` and ``names(name)`` whose bound reaches ``cutoff``."""
    own = lambda df, c: df.select(F.col(c).alias(c), F.length(c).alias("n"), elements(F.col(c)).alias("e")).where(F.col(c).isNotNull()).distinct()
    left, right = own(values, "value"), own(names, "name")
    rare = right.select(F.explode("e").alias("x")).groupBy("x").agg(F.count("*").alias("times"))

    def prefixes(df: DataFrame, c: str) -> DataFrame:
        ranked = df.select(c, "n", F.explode("e").alias("x")).join(rare, "x", "left")
        ordered = ranked.groupBy(c, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "x"))).alias("o"))
        return ordered.select(c, F.explode(F.slice("o", F.lit(1), _prefix_length(F.col("n"), cutoff))).alias("o"), "n").select(c, F.col("n").alias(f"n_{c}"), F.col("o.x").alias("x"))

    together = 2.0 * F.least("n_value", "n_name") / (F.col("n_value") + F.col("n_name")) >= cutoff
    met = prefixes(left, "value").join(prefixes(right, "name"), "x").where(together).select("value", "name").distinct()
    common = F.size(F.array_intersect("ev", "en"))
    full = met.join(left.select("value", F.col("e").alias("ev"), F.col("n").alias("nv")), "value").join(right.select("name", F.col("e").alias("en"), F.col("n").alias("nn")), "name")
    empty = left.where("n = 0").select("value").join(right.where("n = 0").select("name"), F.col("value") == F.col("name")).select("value", "name", F.lit(1.0).alias("bound"))
    return full.select("value", "name", (2.0 * common / (F.col("nv") + F.col("nn"))).alias("bound")).where(F.col("bound") >= cutoff).unionByName(empty)


def nearest(values: DataFrame, names: DataFrame, cutoff: float = CUTOFF, keep=None) -> DataFrame:
    """``value, name, ratio``: for each distinct value the most similar name, if its ratio reaches ``cutoff``.

    ``keep(df, name)`` may write the distinct values and names and the pairs and read them back, since they are read
    several times over, and what they come from is worked out anew each time.
    """
    keep = keep or (lambda df, _: df)
    values, names = keep(values.select("value").distinct(), "values"), keep(names.select("name").distinct(), "names")
    pairs = keep(candidate_pairs(values, names, cutoff), "pairs")
    first = pairs.groupBy("value").agg(F.max(F.struct("bound", "name")).alias("top")).select("value", F.col("top.name").alias("name"))
    reached = first.select(F.col("value").alias("of"), ratio(F.col("value"), F.col("name")).alias("reached"))
    open_ = pairs.join(reached, F.col("value") == F.col("of")).where(F.col("bound") >= F.greatest("reached", F.lit(cutoff)))
    exact = open_.select("value", "name", ratio(F.col("value"), F.col("name")).alias("ratio")).where(F.col("ratio") >= cutoff)
    best = exact.groupBy("value").agg(F.max(F.struct("ratio", "name")).alias("best"))
    return best.select("value", F.col("best.name").alias("name"), F.col("best.ratio").alias("ratio"))
