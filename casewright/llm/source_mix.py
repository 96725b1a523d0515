"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (a null source last) weigh by a repeating pattern and share a multiple of all
words.  A target stops at ``cap`` times its source's size and the excess is shared again by weight, which ends at the
level ``max over k of (T - caps before k) / weights from k on``, with sources ordered by cap over weight: each
target is the smaller of its cap and its weight times that level.

Documents: within a source every document expects ``target / source size`` copies.  The prefix sum of these
expectations, in the order of falling size, plus one random offset of the source says how often each document is
emitted: once per integer boundary that its step crosses.  Because sizes fall along the order, the words taken miss
the target by less than the source's longest document, and no document is emitted more than ``cap`` times, rounded up.

The prefix sum is rank times expectation, one rounding instead of one per row.  Ranks come from counts: of
(source, size), of a block of a size, and within a block.  A source or a size with a third of all rows is so spread
over blocks by the hash of its rows, and the counts are combined before they are shuffled; nothing is collected.

Edge cases: a null text has size 0 and expects copies like any other, which take no words; null ids, repeated ids and
repeated rows are documents of their own; sources without words have target 0; an empty table gives an empty result.
The offsets and the order depend on ``seed`` and the rows alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm._common import shuffle_partitions, staged, table

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, 0
_UNIT = 1 << 32
_BLOCK_DIGITS = 2
_BEFORE = (Window.unboundedPreceding, -1)


def count_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with each of ``sums`` totalled over all rows before, in a total order: within ranges, then over ranges."""
    ranges = staged(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("range_", F.spark_partition_id()), name)
    totals = ranges.groupBy("range_").agg(*(F.sum(c).alias(f"of_{k}") for k, c in sums.items()))
    whole = totals.select("range_", *(F.coalesce(F.sum(f"of_{k}").over(Window.orderBy("range_").rowsBetween(*_BEFORE)), F.lit(0)).alias(f"of_{k}") for k in sums))
    own = Window.partitionBy("range_").orderBy(*order).rowsBetween(*_BEFORE)
    added = ranges.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"in_{k}") for k, c in sums.items())).join(whole, "range_")
    return added.select(*df.columns, *((F.col(f"in_{k}") + F.col(f"of_{k}")).alias(k) for k in sums))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``, one row per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.select("source", "source_size", weight.alias("weight")).withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    filled = _running(weighed, [F.col("ratio"), F.col("source").asc_nulls_last()], {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, "mix-levels")
    totals = weighed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (
        filled.crossJoin(F.broadcast(totals))  # one row
        .agg(F.max((F.col("all_size") * share - F.col("size_before") * cap) / (F.col("all_weight") - F.col("weight_before"))).alias("level"))
    )
    target = F.least(F.col("source_size") * cap, F.col("weight") * F.col("level"))
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int = SEED) -> Column:
    """The random offset of a source, in [0, 1)."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") / _UNIT


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """Every row of ``docs(doc_id, text, source)`` as ``doc_id, source, size, source_size, target, copies``."""
    size = count_words(F.col("text")) if size is None else size
    key = _hash(F.col("doc_id"), F.col("text"))
    rows = staged(docs.select("doc_id", "source", size.cast("long").alias("size"), key.alias("key_"), F.substring(key, 1, _BLOCK_DIGITS).alias("block_")), "mix-rows")
    targets = source_targets(rows.select("source", "size"), weights, share, cap)
    known = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # a null source joins as well
    rows = rows.withColumn("source_", known)
    blocks = rows.groupBy("source_", "size", "block_").agg(F.count("*").alias("n"))
    cells = blocks.groupBy("source_", "size").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(*_BEFORE)
    starts = cells.select("source_", "size", F.coalesce(F.sum("n").over(before("source_").orderBy(F.desc("size"))), F.lit(0)).alias("start_"))
    inner = blocks.select("source_", "size", "block_", F.coalesce(F.sum("n").over(before("source_", "size").orderBy("block_")), F.lit(0)).alias("more_"))
    each = targets.withColumn("source_", known).withColumn("offset_", offset(F.col("source"), seed)).drop("source")
    placed = inner.join(starts, ["source_", "size"]).join(each, "source_")
    own = F.row_number().over(Window.partitionBy("source_", "size", "block_").orderBy("key_", F.col("doc_id").asc_nulls_first()))
    found = rows.withColumn("own_", own).join(placed, ["source_", "size", "block_"])
    rank, expected = F.col("start_") + F.col("more_") + F.col("own_"), F.col("target") / F.col("source_size")
    copies = F.floor(rank * expected + F.col("offset_")) - F.floor((rank - 1) * expected + F.col("offset_"))
    return found.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("source_size") > 0, copies).otherwise(0).cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mixed`` once per copy, with ``copy`` from 1 on."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def query(spark, sf_dir) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS size_before, CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weight_before
  FROM s WINDOW b AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT max((t.all_size * 1.5::DOUBLE - size_before * 2.0::DOUBLE) / (t.all_weight - weight_before)) AS level
  FROM o, (SELECT CAST(sum(source_size) AS BIGINT) AS all_size, CAST(sum(weight) AS BIGINT) AS all_weight FROM s) t),
w AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * level) AS target,
    CAST(('0x' || substr(md5('0:' || coalesce('s' || source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM o, l),
r AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.u, w.target / w.source_size AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.k, d.doc_id NULLS FIRST) AS n
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(size * (floor(n * e + u) - floor((n - 1) * e + u)) AS BIGINT) ELSE 0 END AS taken
FROM r
"""
