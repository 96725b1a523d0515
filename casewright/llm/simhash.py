"""SimHash near-duplicates: pigeonhole blocks, block joins, Hamming verification, components.

A fingerprint is split into four blocks of 16 bits; two fingerprints with at most two differing bits
agree on at least two blocks, so they meet under one of the six pairs of blocks and are verified
there.  Equal fingerprints are collapsed first.  A block pair with more than ``hot`` distinct
fingerprints is not paired off: its members emit the fingerprint itself and its 64 one-bit
variants, and sharing a variant means at most two differing bits, so each variant links its (at most
65) members to their smallest.  That is exact and linear however large the group.

Edge cases: null and empty texts have fingerprint 0 and link like any other; fewer words than a
shingle make one shingle of all of them; repeated rows are kept and share their component; rows with a null id
link like any other, and their component is the smallest id reachable, null where there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import WORD, lower_ascii, mix, powers, slices, staged, table, word_hashes
from casewright.llm.components import components

BITS = 64
PAIRS = tuple((i, j) for i in range(4) for j in range(i + 1, 4))
_SHIFTS = np.arange(BITS, dtype=np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, bit 0 first."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def wide_fingerprint(text: str | None, width: int, parts: int) -> list[int]:
    """``parts`` SimHashes of 64 bits each; the first is over the shingles' own hashes, the others over
    hashes of those.  A bit is set in over half of the hashes."""
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return [0] * parts
    digest, totals = xxhash.xxh64_intdigest, np.zeros((parts, BITS), np.int64)
    n = max(1, len(words) - width + 1)
    for at in range(0, n, 1 << 17):  # a bounded number of shingles at a time, however long the text
        part = words[at : at + (1 << 17) + width - 1]
        shingles = map(" ".join, zip(*(part[k : len(part) - width + 1 + k] for k in range(width)))) if len(words) >= width else [" ".join(words)]
        hashes = np.fromiter((digest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles), np.uint64, min(1 << 17, n - at))
        for k in range(parts):
            totals[k] += _bit_counts(hashes if k == 0 else mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))))
    return [int((np.uint64(1) << _SHIFTS)[t * 2 > n].sum(dtype=np.uint64)) for t in totals]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; fewer words make one shingle."""
    return wide_fingerprint(text, width, 1)[0]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) for every row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.astype(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _block_keys(fp: str = "fp"):
    """The six block-pair keys: the pair's number over 32 bits of the fingerprint."""
    part = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.shiftleft(part(i), 16).bitwiseOR(part(j)) + F.lit(n * (1 << 32)) for n, (i, j) in enumerate(PAIRS)]
    return F.array(*keys)


def links(nodes: DataFrame, distance: int = 2, hot: int = 64) -> DataFrame:
    """``a, b`` (node ids) between distinct fingerprints of ``nodes(node, fp)`` at ``distance`` or less.

    Links are complete up to reachability: a hot group is linked by stars instead of all its pairs.
    """
    if not 0 <= distance <= 2:
        raise ValueError("four blocks and one-bit variants serve distances up to 2")
    keyed = nodes.select("node", "fp", F.explode(_block_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(keyed.join(sizes, "key"), "blocks")
    small = met.where(F.col("n") <= hot)
    other = small.select("key", F.col("node").alias("b"), F.col("fp").alias("fp_b"))
    pairs = (
        small.join(other, "key")
        .where((F.col("node") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= distance))
        .select(F.col("node").alias("a"), "b")
    )
    if distance == 0:
        return pairs
    crowd = met.where(F.col("n") > hot).select("node", "fp").distinct()
    flips = F.array(*([F.lit(0).cast("bigint")] if distance == 2 else []), *(F.lit(v if v < 1 << 63 else v - (1 << 64)).cast("bigint") for v in (1 << k for k in range(BITS))))
    if distance == 2:
        variants = crowd.select("node", F.explode(flips).alias("flip"), "fp").select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
        low = variants.groupBy("variant").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
        stars = variants.join(low, "variant").where("node != b").select(F.col("node").alias("a"), "b")
    else:
        probes = crowd.select(F.col("node").alias("a"), F.explode(flips).alias("flip"), "fp").select("a", F.col("fp").bitwiseXOR(F.col("flip")).alias("fp"))
        stars = probes.join(crowd.select("fp", F.col("node").alias("b")), "fp").where("a < b").select("a", "b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, hot: int = 64) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``."""
    prints = staged(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    joined = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance, hot))
    # Written first, so that Spark can split the join below where many copies share a fingerprint.
    classes = staged(_least_ids(nodes, joined), "classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def _least_ids(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """``fp, component_id``: the smallest ``doc`` of each class of ``nodes(fp, doc)`` under ``joined(node, component)``."""
    placed = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "doc", F.coalesce("component", "fp").alias("class"))
    least = placed.groupBy("class").agg(F.min("doc").alias("component_id"))
    return placed.join(least, "class").select("fp", "component_id")


# --- groups at a wider similarity, for the pipeline --------------------------------------------

#: 32 keys of four minima each: a pair at 0.8 shares none with a chance of (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS, WIDTH = 32, 4, 5
_TURN = np.random.default_rng(57).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str]):
    """The sorted distinct hashes of each text's five-word shingles; fewer words make one shingle."""
    for a, b in slices(texts, 1 << 18):
        words, counts = word_hashes(texts[a:b])
        ends = np.cumsum(counts)
        if len(words) >= WIDTH:
            n = len(words) - WIDTH + 1
            joined = np.zeros(n, np.uint64)
            for k, w in enumerate(powers(WIDTH + 1)[1:]):
                joined += words[k : k + n] * w
            joined = mix(joined)
        for end, count in zip(ends.tolist(), counts.tolist()):
            if count >= WIDTH:
                yield np.unique(joined[end - count : end - WIDTH + 1])
            elif count:
                yield mix((words[end - count : end] * powers(count + 1)[1:]).sum(keepdims=True, dtype=np.uint64) + np.uint64(count))
            else:
                yield np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of one set, each over ``ROWS`` of its minima under fixed orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):  # small blocks stay in the cache
        least = np.minimum(least, ((shingles[at : at + 256, None] ^ _TURN[0]) * _TURN[1]).min(0))
    return mix((least.reshape(BANDS, ROWS) * powers(ROWS + 1)[1:]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def alike(shared, size_a, size_b, similarity: float):
    """Whether sets of these sizes with so many elements in common are that similar."""
    return shared >= similarity * (size_a + size_b - shared) - 1e-9


def _crowd_links(sets: list[np.ndarray], nodes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning star per connected part of one crowded key, by the exact similarity of all pairs that
    are not connected yet; pairs are counted from an inverted index, never listed."""
    n = len(nodes)
    root, sizes = np.arange(n), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    del order
    for at in range(n):
        if (root == root[0]).all():
            break
        low, high = np.searchsorted(flat, sets[at]), np.searchsorted(flat, sets[at], "right")
        shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(low, high)]), minlength=n)
        others = np.unique(root[alike(shared, sizes, sizes[at], similarity) & (root != root[at])])
        if len(others):
            root[np.isin(root, np.append(others, root[at]))] = min(int(others[0]), int(root[at]))
    return [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(root) if nodes[i] != nodes[r]]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar_classes(docs: DataFrame, similarity: float = 0.8, hot: int = 16, distance: int | None = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of near copies: the rows with their set's hash (``doc_id, key_text, fp``), the first row of every set
    (``fp, row``), and ``node, component`` over the sets.

    Two relations link, and a class is what either reaches: SimHash fingerprints of three-word shingles that differ by
    ``distance`` bits or fewer (as ``near_duplicates`` links them, by blocks and stars), and sets of five-word shingles
    whose similarity (Jaccard) is ``similarity`` or more, which finds the copies that many edits take further apart.

    Equal sets are collapsed.  Candidates share one of ``BANDS`` keys of minima, and are linked only by the
    exact similarity of their sets, which are made again from the texts of the candidates alone.  A
    key with more than ``hot`` sets is compared in one task, which emits a spanning star.
    """

    def run(batches):
        for batch in batches:
            given = batch["text"].to_pylist()
            sets = list(shingle_sets([t or "" for t in given]))
            fp = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).astype(np.int64)
            sim = np.array([0 if distance is None else fingerprint(t) for t in given], np.uint64).astype(np.int64)
            keys = pa.array([band_keys(s).astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key_text"], pa.array(fp), pa.array(sim), pa.array([len(s) for s in sets], pa.int32()), keys], ["doc_id", "key_text", "fp", "sim", "size", "keys"])

    def remake(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets([t or "" for t in batch["text"].to_pylist()])]
            fp = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(sets, pa.binary())], ["fp", "shingles"])

    def verify(batches):
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "shingles", "shingles_b"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if alike(len(np.intersect1d(x, y, True)), len(x), len(y), similarity):
                    found.append((a, b))
            yield _edges(found)

    def crowds(batches):
        key, nodes, sets = None, [], []
        for batch in batches:
            for k, node, s in zip(*(batch[c].to_pylist() for c in ("key", "fp", "shingles"))):
                if k != key:
                    if nodes:
                        yield _edges(_crowd_links(sets, np.array(nodes), similarity))
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(np.frombuffer(s, np.uint64))
        if nodes:
            yield _edges(_crowd_links(sets, np.array(nodes), similarity))

    texts = docs.select("doc_id", "text", _text_key().alias("key_text"))
    prints = staged(texts.mapInArrow(run, "doc_id bigint, key_text bigint, fp bigint, sim bigint, size int, keys array<bigint>"), "minima")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_text")).alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    keyed = nodes.select("fp", "size", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(keyed.join(sizes, "key"), "bands")
    # One row of each set that meets another: its shingles are made again.
    wanted = nodes.join(met.select("fp"), "fp", "left_semi").select(F.col("row.doc_id").alias("#id"), F.col("row.key_text").alias("#text"))
    again = texts.join(wanted, (F.col("key_text") == F.col("`#text`")) & F.col("doc_id").eqNullSafe(F.col("`#id`")), "left_semi")
    sets = staged(again.mapInArrow(remake, "fp bigint, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")
    small = met.where(F.col("n") <= hot).select("key", "fp", "size")
    other = small.select("key", F.col("fp").alias("fp_b"), F.col("size").alias("size_b"))
    near = (F.col("size") >= F.col("size_b") * similarity - 1e-6) & (F.col("size_b") >= F.col("size") * similarity - 1e-6)
    pairs = small.join(other, "key").where((F.col("fp") < F.col("fp_b")) & near).select("fp", "fp_b").distinct()
    both = pairs.join(sets, "fp").join(sets.select(F.col("fp").alias("fp_b"), F.col("shingles").alias("shingles_b")), "fp_b")
    crowd = met.where(F.col("n") > hot).join(sets, "fp").select("key", "fp", "shingles").repartition("key").sortWithinPartitions("key", "fp")
    edges = "a bigint, b bigint"
    linked = both.select(F.col("fp").alias("a"), F.col("fp_b").alias("b"), "shingles", "shingles_b").mapInArrow(verify, edges).unionByName(crowd.mapInArrow(crowds, edges))
    if distance is not None:
        linked = linked.unionByName(_fingerprint_links(prints, distance))
    joined = components(linked)
    return prints.select("doc_id", "key_text", "fp"), nodes.select("fp", "row"), joined


def _fingerprint_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links between the sets (``fp``) of rows whose fingerprints (``sim``) are equal or ``distance`` bits apart: a set
    to the least of its fingerprint, and those of linked fingerprints to one another."""
    pairs = prints.select("fp", "sim").distinct()
    least = staged(pairs.groupBy("sim").agg(F.min("fp").alias("least")), "least")
    equal = pairs.join(least, "sim").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    met = links(least.select(F.col("sim").alias("node"), F.col("sim").alias("fp")), distance)
    one, other = least.select(F.col("sim").alias("a"), F.col("least").alias("x")), least.select(F.col("sim").alias("b"), F.col("least").alias("y"))
    return equal.unionByName(met.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def similar_groups(docs: DataFrame, similarity: float = 0.8, hot: int = 16) -> DataFrame:
    """``doc_id, component_id``: for every row the smallest id of its class by ``similarity`` alone (null where no row
    has an id)."""
    prints, nodes, joined = similar_classes(docs, similarity, hot, None)
    classes = staged(_least_ids(nodes.select("fp", F.col("row.doc_id").alias("doc")), joined), "classes")
    return prints.join(classes, "fp", "left").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` per class, with all its columns: the smallest id, then the least text hash.

    Rows are told apart by id and text, so several texts under one id are several documents; a row with a null id
    stays only where no row of its class has an id; of equal rows one stays (the least by its other columns).
    """
    from pyspark.sql import Window

    _, nodes, joined = similar_classes(docs, **settings)
    placed = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("row", F.coalesce("component", "fp").alias("class"))
    stays = placed.groupBy("class").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("#id"), F.col("row.key_text").alias("#text"))
    keyed = docs.withColumn("#key", _text_key())
    kept = keyed.join(stays, (F.col("`#key`") == F.col("`#text`")) & F.col("doc_id").eqNullSafe(F.col("`#id`")), "left_semi")
    order = Window.partitionBy("doc_id", "#key").orderBy(F.xxhash64(*(F.col(f"`{n}`") for n in docs.columns)))
    return kept.withColumn("#row", F.row_number().over(order)).where(F.col("#row") == 1).drop("#row", "#key")


def query(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
