"""Hard negatives by bit-sliced integer products.

Components become integers, ``floor(scale * x)``, and an anchor's score with a row is their integer inner product.  It is
worked out from the row's bit-planes, the most significant first: after some planes the score is known up to an interval
whose width is ``2**rest - 1`` times the sum of the anchor's absolute components.  Rows whose interval cannot reach the
best ones known so far, or no window of scores that is asked for, are dropped; the last planes are read for the
few rows left, whose scores are then exact.

Anchors are a stated query set against all rows, in blocks: rows are dealt into blocks by the hash of a row number,
anchors too; each block of anchors meets each block of rows once in one task, which holds these two blocks only.
Of every meeting at most ``k`` rows per anchor (and per window) come out, and a ranking over them keeps the best.
A first round finds each anchor's positives, a second one the negatives in the windows that they set.  Labels are
compared inside a block, so that a label with a third of all rows is spread like any other.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; repeated rows and
ids are rows of their own (a row is not its own positive, its repeat is); null ids come after all others; vectors of
different length are compared over the shorter one's components; an anchor without positives gives nothing.
Components beyond ``LIMIT / scale`` count as that bound, so that scores of up to 8,192 components stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm._common import shuffle_partitions, staged, table

SCALE, LIMIT = 256.0, 1 << 20
LEAST_ROWS, MOST_ROWS, ANCHORS = 1024, 1 << 17, 1 << 12
#: Scores in one dense piece of a block: so many eight-byte numbers stand in memory a few times over.
_PIECE = 1 << 19
_NO_ID = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``row_key, vec_id, label, q`` of the rows that take part, written so that the row numbers stay."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    part = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return staged(part.select(F.monotonically_increasing_id().alias("row_key"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("q")), "quantised")


# --- inside a block ----------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Rows of integers, padded with zeros to the longest."""
    lists = column.combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    values = np.asarray(lists.flatten(), np.int64)
    out = np.zeros((len(sizes), max([1, *sizes]) if dims is None else dims), np.int64)
    inside = np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[inside] = values
    return out


class Planes:
    """The bit-planes of a block of rows, two's complement, the sign first."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.low = max(1, int(max(rows.max(initial=0), -rows.min(initial=0) - 1)).bit_length())  # planes under the sign

    def dense(self, anchors: np.ndarray, rest: int) -> np.ndarray:
        """What plane ``rest`` (the sign is plane ``low``) adds to every score of the block."""
        plane = ((self.rows >> rest) & 1).astype(np.float64)
        weight = -float(1 << rest) if rest == self.low else float(1 << rest)
        return (anchors.astype(np.float64) @ plane.T) * weight

    def sparse(self, anchor: np.ndarray, which: np.ndarray, rest: int) -> np.ndarray:
        """The same for one anchor and some rows."""
        weight = -float(1 << rest) if rest == self.low else float(1 << rest)
        return (((self.rows[which] >> rest) & 1) @ anchor).astype(np.float64) * weight


def best_in_windows(anchors: np.ndarray, planes: Planes, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, ids: np.ndarray):
    """Per anchor and window the ``k`` highest scores from ``low`` to ``high``, ties by smaller id.

    ``allowed`` marks the rows (anchors x rows) that may be chosen; windows are anchors x windows.  Yields
    (anchor, window, row, score).  An interval after all planes from ``rest`` on is score + (2**rest - 1) times the sum
    of the anchor's negative components at the least, of its positive ones at the most.
    """
    down, up = np.minimum(anchors, 0).sum(1).astype(np.float64), np.maximum(anchors, 0).sum(1).astype(np.float64)
    scores = np.zeros(allowed.shape)
    alive: list[np.ndarray | None] = [None] * len(anchors)  # the rows left once they are few
    known: list[np.ndarray] = [np.zeros(0)] * len(anchors)
    open_ = np.arange(len(anchors))  # anchors whose rows are still dense
    for rest in range(planes.low, -1, -1):
        if len(open_):
            scores[open_] += planes.dense(anchors[open_], rest)
        width = float((1 << rest) - 1)
        still = []
        for a in range(len(anchors)):
            which = alive[a]
            if which is None:
                own = np.flatnonzero(allowed[a]) if not rest or width * (up[a] - down[a]) < np.ptp(scores[a]) else None
                if own is None:  # an interval wider than the spread of all scores drops nothing
                    still.append(a)
                    continue
                score = scores[a, own]
            else:
                own, score = which, known[a] + planes.sparse(anchors[a], which, rest)
            keep = _may_qualify(score, width * down[a], width * up[a], low[a], high[a], k)
            if which is None and rest and 4 * keep.sum() > len(keep):
                still.append(a)
                continue
            alive[a], known[a] = own[keep], score[keep]
        open_ = np.array(still, np.int64)
    for a, (which, score) in enumerate(zip(alive, known)):
        for w in range(low.shape[1]):
            inside = np.flatnonzero((score >= low[a, w]) & (score <= high[a, w]))
            order = inside[np.lexsort((ids[which[inside]], -score[inside]))][:k]
            yield from ((a, w, int(which[i]), int(score[i])) for i in order)


def _may_qualify(score: np.ndarray, down: float, up: float, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows whose interval, from score + down to score + up, may be among the ``k`` best of some window."""
    keep = np.zeros(len(score), bool)
    for least, most in zip(low, high):
        sure = score[(score + down >= least) & (score + up <= most)]
        bar = np.partition(sure, len(sure) - k)[len(sure) - k] + down if len(sure) >= k else least
        keep |= (score + up >= max(least, bar)) & (score + down <= most)
    return keep


# --- meetings of blocks ------------------------------------------------------------------------------


def _meet(rows: DataFrame, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """``anchor_key, window, vec_id, score`` of the ``k`` best rows of every meeting, for ``anchors(row_key, label, q, low, high)``."""
    spark = rows.sparkSession
    total = rows.count()
    size = min(MOST_ROWS, max(LEAST_ROWS, total // (2 * shuffle_partitions(spark))))
    n_rows, n_anchors = -(-total // size) or 1, -(-anchors.count() // ANCHORS) or 1
    block = lambda n, salt: F.pmod(F.xxhash64("row_key", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(block(n_anchors, 1).cast("int").alias("a_"), *(F.col(c).alias(c) for c in ("row_key", "label", "q", "low", "high"))).withColumn("r_", every(n_rows))
    right = rows.withColumn("r_", block(n_rows, 2).cast("int")).withColumn("a_", every(n_anchors))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if mine.num_rows and theirs.num_rows:
            dims = max(_matrix(mine["q"]).shape[1], _matrix(theirs["q"]).shape[1])
            asked, given = _matrix(mine["q"], dims), _matrix(theirs["q"], dims)
            column = lambda t, c: np.asarray(t[c].combine_chunks().fill_null(_NO_ID), np.int64)
            ask_key, ask_label, ids, keys, labels = column(mine, "row_key"), column(mine, "label"), column(theirs, "vec_id"), column(theirs, "row_key"), column(theirs, "label")
            low, high = (np.array(mine[c].to_pylist(), np.float64) for c in ("low", "high"))
            order = np.lexsort((ids, labels))
            given, ids, keys, labels = given[order], ids[order], keys[order], labels[order]
            by_label = np.argsort(ask_label, kind="stable")
            at = 0
            while at < len(by_label):
                # Positives need the rows of one label only; negatives all rows.
                label = ask_label[by_label[at]]
                end = at + int(np.searchsorted(ask_label[by_label[at:]], label, "right")) if same_label else len(by_label)
                first, last = (np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")) if same_label else (0, len(labels))
                step = max(1, _PIECE // max(1, last - first))
                planes = Planes(given[first:last])
                for begin in range(at, end if last > first else at, step):
                    own = by_label[begin : min(end, begin + step)]
                    allowed = ask_key[own][:, None] != keys[first:last][None, :] if same_label else ask_label[own][:, None] != labels[None, :]
                    for a, w, r, score in best_in_windows(asked[own], planes, allowed, low[own], high[own], k, ids[first:last]):
                        found.append((int(ask_key[own[a]]), w, None if ids[first + r] == _NO_ID else int(ids[first + r]), score))
                at = end
        columns = list(zip(*found)) if found else [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor_key", "window", "vec_id", "score"])

    met = left.groupBy("a_", "r_").cogroup(right.groupBy("a_", "r_")).applyInArrow(run, "anchor_key bigint, window int, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_key", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return met.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """Of ``quantised`` rows, each anchor's positives and, for each, the best other-label rows whose score is from ``least``
    to ``most`` per cent of the positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    anchors = rows.where(is_anchor)
    anywhere = anchors.select("row_key", "label", "q", *(F.array(F.lit(x)).alias(n) for n, x in (("low", float("-inf")), ("high", float("inf")))))
    near = staged(_meet(rows, anywhere, True, positives), "positives")
    share = lambda x: F.col("score") * x / F.lit(100.0)
    chosen = near.groupBy("anchor_key").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", share(least).alias("low"), share(most).alias("high")))).alias("p"))
    asking = anchors.join(chosen, anchors.row_key == chosen.anchor_key).select("row_key", "label", "q", F.col("p.low").alias("low"), F.col("p.high").alias("high"))
    far = _meet(rows, asking, False, negatives)
    named = near.select("anchor_key", (F.col("place") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row_key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"))
    out = far.join(named, ["anchor_key", "window"]).join(ids, "anchor_key")
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(quantised(moved), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH q AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id,
    CAST(coalesce(list_sum(list_transform(generate_series(1, least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM q a JOIN q b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE alike QUALIFY place <= 5),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""
