"""Exact substring deduplication with suffix arrays.

Every symbol covered by a string of ``length`` symbols that also starts anywhere else is removed.  A symbol
is a byte, or a word (its 32-bit code), so passages can be counted in bytes or in words.

Sharding.  Each window of ``length`` bytes is charged to its minimiser, the k-gram with the least
hash in it; equal windows have equal minimisers.  Consecutive windows with one minimiser form a
segment.  Only minimisers that occur twice or more can hold repeats, and their segments are dealt to
shards by the minimiser's hash, so that equal windows meet.  Identical segments are collapsed with
their count first; a minimiser whose segments are all identical is settled by that count.

Per shard: suffix array by Larsson-Sadakane refinement in numpy (unsorted groups only, doubling up to
``length``), Kasai's common prefixes (a suffix's lower bound from its predecessor in the text, many
blocks at once), and windows with a neighbour at ``length`` or more in suffix order are repeats.

Across shards: a minimiser with more than ``shard_rows`` segments is split over several shards.  Each
shard then lists its distinct windows as sorted 128-bit fingerprints, cut into ranges; a range's lists
meet in one task and are merged by binary search, which finds windows that repeat across shards.

Edge cases: null and empty texts are empty; texts under ``length`` bytes keep everything; rows with
equal id and text are separate documents and so remove each other; nulls among the ids are one id; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import drop_staged, mix, slices, staged, table, word_bounds, word_hashes

LENGTH = 400
GRAM = 64
PASSAGE_WORDS = 51
_PIECE = 1 << 18  # some ten arrays of eight bytes a symbol stand in memory for one piece
_POSITION = np.uint64(_PIECE * 2 - 1)
_BYTE = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9DDFEA08EB382D69
_BASE2 = 0xC2B2AE3D27D4EB4F


#: Symbols are bytes (8 of them to a machine word) or 32-bit word codes (2); the last value separates texts.
END = {np.dtype(np.uint8): b"\xff", np.dtype(np.uint32): b"\xff\xff\xff\xff"}


def _joined(parts: list[bytes], kind) -> np.ndarray:
    """The parts as one run of symbols, a separator behind each."""
    end = END[np.dtype(kind)]
    return np.frombuffer(end.join(parts) + end, kind)


def gram_hashes(buf: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of every k-gram of the symbols, by doubling over the binary digits of k."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, block, done, result = 1, _BYTE[buf] if buf.dtype == np.uint8 else mix(buf.astype(np.uint64) + np.uint64(1)), 0, None
    while True:
        if k & power:
            shift = np.uint64(pow(base, power, 1 << 64))
            result = block[:n].copy() if result is None else result * shift + block[done : done + n]
            done += power
        if done == k:
            return result
        block = block[: len(block) - power] * np.uint64(pow(base, power, 1 << 64)) + block[power:]
        power *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (van Herk: two running minima per block)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: list[np.ndarray], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the minimiser, text, first window, windows) of every segment of the texts."""
    out: list[tuple[np.ndarray, ...]] = []

    def work(parts: list[tuple[int, int, np.ndarray]]) -> None:
        buf = np.concatenate([p[2] for p in parts])
        sizes = np.array([len(p[2]) for p in parts])
        begin = np.cumsum(sizes) - sizes
        h = mix(gram_hashes(buf, gram))
        least = sliding_min((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        count = sizes - length + 1
        window = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = (least[window] & _POSITION).astype(np.int64)
        first = np.ones(len(window), bool)
        first[1:] = (np.diff(at) != 0) | (np.diff(window) != 1)
        rows = np.flatnonzero(first)
        part = np.searchsorted(begin, window[rows], "right") - 1
        text, offset = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        out.append((h[at[rows]], text[part], window[rows] - begin[part] + offset[part], np.diff(np.append(rows, len(window)))))

    pending: list[tuple[int, int, np.ndarray]] = []
    total = 0
    for i, body in enumerate(raw):
        for a in range(0, max(0, len(body) - length + 1), _PIECE):
            piece = body[a : a + _PIECE + length - 1]
            if total and total + len(piece) > _PIECE:
                work(pending)
                pending, total = [], 0
            pending.append((i, a, piece))
            total += len(piece)
    if pending:
        work(pending)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (Larsson-Sadakane: sort by one machine word of
    symbols, then refine only unsorted groups by the rank of the suffix h further on, doubling h)."""
    n = len(buf)
    word = _words(buf)[:n]
    sa = np.argsort(word, kind="stable")
    starts = np.ones(n, bool)
    starts[1:] = word[sa[1:]] != word[sa[:-1]]
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = group, -1
    alone = starts & np.append(starts[1:], True)
    open_ = np.flatnonzero(~alone)
    h = 8 // buf.itemsize
    while h < depth and len(open_):
        s = sa[open_]
        key = rank[s] * (n + 1) + rank[np.minimum(s + h, n)] + 1
        order = np.argsort(key, kind="stable")
        key, s = key[order], s[order]
        sa[open_] = s
        starts = np.ones(len(key), bool)
        starts[1:] = key[1:] != key[:-1]
        rank[s] = open_[np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))]
        alone = starts & np.append(starts[1:], True)
        open_ = open_[~alone]
        h *= 2
    return sa


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes of symbols from every position as one big-endian number."""
    v = np.concatenate([buf, np.zeros(16, buf.dtype)]).astype(np.uint64)
    for step in (1, 2, 4) if buf.itemsize == 1 else (1,):
        v = (v[:-step] << np.uint64(8 * buf.itemsize * step)) | v[step:]
    return v


def common_prefixes(buf: np.ndarray, sa: np.ndarray, limit: int, stride: int = 32) -> np.ndarray:
    """Per position the common prefix with its predecessor in ``sa``, at most ``limit``.

    Kasai: position i + 1 shares at least one symbol less than position i.  That needs the two suffixes to be in
    order, so after a tie at ``limit``, where the order is arbitrary, it holds only if i + 1 follows the successor of
    i's predecessor; otherwise the comparison begins anew.  Blocks of ``stride`` positions are walked side by
    side, each from its own first position.
    """
    n, per, bits = len(buf), 8 // buf.itemsize, 8 * buf.itemsize
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    word = np.concatenate([_words(buf), np.zeros(limit + 8, np.uint64)])
    out = np.zeros(n, np.int64)
    heads = np.arange(0, n, stride)
    have, last = np.zeros(len(heads), np.int64), np.full(len(heads), -2, np.int64)
    for step in range(stride):
        at = heads + step
        at = at[at < n]
        have, last, other = have[: len(at)], last[: len(at)], before[at]
        have = np.where((have < limit) | (other == last + 1), np.maximum(have - 1, 0), 0)
        last = other
        live = np.flatnonzero((other >= 0) & (have < limit))
        have[other < 0] = 0
        while len(live):
            x = word[at[live] + have[live]] ^ word[other[live] + have[live]]
            same = x == 0
            have[live[same]] += per
            rest, y = live[~same], x[~same]
            if len(rest):
                high = y >> np.uint64(32)
                top = np.where(high > 0, high, y & np.uint64(0xFFFFFFFF)).astype(np.float64)
                have[rest] += np.where(high > 0, per // 2, per) - 1 - (np.frexp(top)[1] - 1) // bits
            live = live[same]
            live = live[have[live] < limit]
        reach = n - np.maximum(at, other)
        have = np.minimum(have, np.minimum(reach, limit))
        out[at] = have
    return out


def repeated_windows(parts: list[bytes], counts: list[int], length: int, kind=np.uint8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct segments of a shard: text position of every window, whether it repeats, and
    whether it is the first of its class in suffix order."""
    buf = _joined(parts, kind)
    sizes = np.array([len(p) for p in parts]) // buf.itemsize
    begin = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - length + 1
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    sa = suffix_array(buf, length)
    shared = common_prefixes(buf, sa, length)[sa] >= length
    repeats = np.zeros(len(buf), bool)
    repeats[sa[shared]] = True
    repeats[sa[:-1][shared[1:]]] = True
    leader = np.zeros(len(buf), bool)
    leader[sa[~shared]] = True
    many = np.repeat(np.asarray(counts) > 1, windows)
    return at, repeats[at] | many, leader[at]


def _runs(flags: np.ndarray) -> np.ndarray:
    """Start and end of every run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_SHARD = "h bigint, digest binary, spans array<struct<start:bigint,stop:bigint>>, part int, salt int, prints binary, owners binary, places binary, digests array<binary>"
_SHARD_TYPES = [pa.int64(), pa.binary(), _SPANS, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
_SHARD_NAMES = ["h", "digest", "spans", "part", "salt", "prints", "owners", "places", "digests"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SHARD_TYPES)], _SHARD_NAMES)


def _shard(group: list[tuple], length: int, kind) -> list[tuple]:
    """Decisions and, for split minimisers, window lists of one shard's rows (h, salt, salts, digest, count, segment)."""
    at, repeats, leader = repeated_windows([g[5] for g in group], [g[4] for g in group], length, kind)
    sizes = np.array([len(g[5]) for g in group]) // np.dtype(kind).itemsize
    windows = sizes - length + 1
    ends = np.cumsum(windows)
    rows: list[tuple] = []
    split: dict[tuple[int, int, int], list[int]] = {}
    for i, (h, salt, salts, digest, count, _) in enumerate(group):
        own = repeats[ends[i] - windows[i] : ends[i]]
        if count == 1 and own.any():
            spans = [{"start": int(a), "stop": int(b) - 1 + length} for a, b in _runs(own)]
            rows.append((h, digest, spans, None, None, None, None, None, None))
        if salts > 1:
            split.setdefault((h, salt, salts), []).append(i)
    for (h, salt, salts), members in split.items():
        buf = _joined([group[i][5] for i in members], kind)
        first, second = mix(gram_hashes(buf, length)), mix(gram_hashes(buf, length, _BASE2))
        places = np.concatenate([np.arange(windows[i]) for i in members])
        owners = np.repeat(np.arange(len(members)), windows[members])
        begin = np.cumsum(sizes[members] + 1) - sizes[members] - 1
        where = begin[owners] + places
        index = np.concatenate([np.arange(ends[i] - windows[i], ends[i]) for i in members])
        keep = leader[index] | ~repeats[index]
        open_ = ~repeats[index] & np.repeat([group[i][4] == 1 for i in members], windows[members])
        prints = np.stack([first[where], second[where]], 1)[keep]
        owners, places = np.where(open_, owners, -1)[keep].astype(np.int32), places[keep].astype(np.int32)
        order = np.lexsort((prints[:, 1], prints[:, 0]))
        prints, owners, places = prints[order], owners[order], places[order]
        cuts = np.searchsorted(prints[:, 0], [((p << 64) // salts) for p in range(1, salts)]) if salts > 1 else []
        digests = [group[i][3] for i in members]
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(prints)])):
            if b > a:
                rows.append((h, None, None, part, salt, prints[a:b].tobytes(), owners[a:b].tobytes(), places[a:b].tobytes(), digests))
    return rows


def _merge(found: pa.Table, length: int) -> pa.Table:
    """Windows of one range of a split minimiser that occur in more than one shard."""
    rows = found.to_pylist()
    lists = [np.frombuffer(r["prints"], [("a", "<u8"), ("b", "<u8")]) for r in rows]
    known, times = lists[0], np.ones(len(lists[0]), np.int64)
    for own in lists[1:]:  # each list is sorted, so it is merged by binary search
        at = np.searchsorted(known, own)
        hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own)
        times[at[hit]] += 1
        known = np.insert(known, at[~hit], own[~hit])
        times = np.insert(times, at[~hit], 1)
    out_h, out_digest, out_spans = [], [], []
    for row, own in zip(rows, lists):
        owners, places = np.frombuffer(row["owners"], np.int32), np.frombuffer(row["places"], np.int32)
        again = (times[np.searchsorted(known, own)] > 1) & (owners >= 0)
        for owner in np.unique(owners[again]):
            spots = np.sort(places[again & (owners == owner)]).astype(np.int64)
            stops = np.flatnonzero(np.append(np.diff(spots) != 1, True))
            begins = np.concatenate([[0], stops[:-1] + 1])
            out_h.append(row["h"])
            out_digest.append(row["digests"][owner])
            out_spans.append([{"start": int(spots[a]), "stop": int(spots[b]) + length} for a, b in zip(begins, stops)])
    return pa.table([pa.array(out_h, pa.int64()), pa.array(out_digest, pa.binary()), pa.array(out_spans, _SPANS)], names=["h", "digest", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key that tells them apart: id and text hash."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key_id"), F.xxhash64(text).alias("key_text"), text.alias("body"))


def byte_symbols(texts: list[str]) -> list[np.ndarray]:
    """The UTF-8 bytes of each text."""
    return [np.frombuffer(t.encode(), np.uint8) for t in texts]


def word_symbols(texts: list[str]) -> list[np.ndarray]:
    """The words of each text (between ASCII white space, case kept) as 32-bit codes.

    Two words share a code with a chance of 2**-32, and a false repeat needs that beside an otherwise equal passage.
    """
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        hashes, counts = word_hashes(texts[a:b], fold=False)
        codes = np.minimum(hashes >> np.uint64(32), np.uint64(0xFFFFFFFE)).astype(np.uint32)
        out += np.split(codes, np.cumsum(counts)[:-1])
    return out


SYMBOLS = {"byte": (byte_symbols, np.uint8), "word": (word_symbols, np.uint32)}


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = "byte", shard_rows: int = 1024, shard_bytes: int = 1 << 19) -> DataFrame:
    """``key_id, key_text, spans`` (ranges of symbols, unmerged) of the documents that hold repeats.

    A shard is closed at ``shard_bytes``, a minimiser with more than ``shard_rows`` segments is split: both bound the
    memory of a task (some fifteen machine words a symbol) and change no result.
    """
    if not 1 <= gram <= length or length < 8:
        raise ValueError("the k-gram must fit the window")
    symbols, kind = SYMBOLS[unit]
    size = np.dtype(kind).itemsize
    own = _keyed(docs).select("key_id", "key_text", "body")

    def find(batches):
        for batch in batches:
            h, text, first, n = segments(symbols(batch["body"].to_pylist()), length, gram)
            take = pa.array(text.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.int64)), batch["key_id"].take(take), batch["key_text"].take(take), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int32))],
                ["h", "key_id", "key_text", "first", "n"],
            )

    marks = staged(own.mapInArrow(find, "h bigint, key_id bigint, key_text bigint, first bigint, n int"), "segments")
    # Written first: a join of two plain exchanges is one that Spark can split where a hash is hot.
    again = staged(marks.groupBy("h").agg(F.count("*").alias("members")).where("members > 1"), "repeated")
    # Rows with equal id and text share a key; as a set their cuts stand once for each of them.
    wanted = marks.join(again, "h").groupBy("key_id", "key_text").agg(F.collect_set(F.struct("h", "members", "first", "n")).alias("cuts"))

    def cut(batches):
        for batch in batches:
            rows = []
            for key_id, key_text, body, cuts in zip(*(batch[c].to_pylist() for c in ("key_id", "key_text", "body", "cuts"))):
                raw = symbols([body])[0].tobytes()
                for c in cuts:
                    part = raw[size * c["first"] : size * (c["first"] + c["n"] - 1 + length)]
                    rows.append((c["h"], c["members"], key_id, key_text, c["first"], xxhash.xxh3_128_digest(part), part))
                if len(rows) > 20_000:
                    yield record(rows)
                    rows = []
            if rows:
                yield record(rows)

    def record(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "members", "key_id", "key_text", "first", "digest", "part"])

    parts = staged(own.join(wanted, ["key_id", "key_text"]).select("key_id", "key_text", "body", "cuts").mapInArrow(cut, "h bigint, members bigint, key_id bigint, key_text bigint, first bigint, digest binary, part binary"), "parts")
    drop_staged(marks)
    drop_staged(again)
    distinct = parts.groupBy("h", "digest").agg(F.count("*").alias("n"), F.max("members").alias("members"), F.first("part").alias("part"))
    # A minimiser whose segments are all identical is settled by the count.
    salts = F.greatest(F.lit(1), F.ceil(F.col("members") / F.lit(shard_rows))).cast("int")
    mixed = (
        distinct.where("n < members")
        .select("h", "digest", "n", "part", salts.alias("salts"))
        .withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int"))
    )

    def shard(batches):
        group, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("h", "salt", "salts", "digest", "n", "part"))):
                if size >= shard_bytes and (row[0], row[1]) != last:
                    if rows := _shard(group, length, kind):
                        yield _batch(rows)
                    group, size = [], 0
                group.append(row)
                size += len(row[5])
                last = row[0], row[1]
        if group and (rows := _shard(group, length, kind)):
            yield _batch(rows)

    decided = staged(mixed.repartition("h", "salt").sortWithinPartitions("h", "salt", "digest").mapInArrow(shard, _SHARD), "shards")
    merged = decided.where("part IS NOT NULL").groupBy("h", "part").applyInArrow(lambda t: _merge(t, length), "h bigint, digest binary, spans array<struct<start:bigint,stop:bigint>>")
    copies = parts.groupBy("h", "digest").agg(F.count("*").alias("n"), F.max(F.octet_length("part") / size).alias("size")).where("n > 1")
    whole = copies.select("h", "digest", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("stop"))).alias("spans"))
    decisions = decided.where("digest IS NOT NULL").select("h", "digest", "spans").unionByName(merged).unionByName(whole)
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["stop"] + F.col("first")).alias("stop")))
    return (
        parts.select("h", "digest", "key_id", "key_text", "first")
        .join(decisions, ["h", "digest"])
        .select("key_id", "key_text", F.explode(moved).alias("span"))
        .groupBy("key_id", "key_text")
        .agg(F.collect_list("span").alias("spans"))
    )


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of the given byte ranges."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(b, runs[-1][1])
        else:
            runs.append((a, b))
    return runs


def keep(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs, shortened so that no character is cut."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, **settings) -> DataFrame:
    """Every row of ``docs`` with ``body`` (null text: empty) and ``spans`` (null: none)."""
    return _keyed(docs).join(repeat_spans(docs, **settings), ["key_id", "key_text"], "left").drop("key_id", "key_text")


def remove_repeats(docs: DataFrame, **settings) -> DataFrame:
    """The rows and columns of ``docs`` with repeated passages cut out of ``text``, whole characters only,
    and ``n_chars``, where there is one, counted anew.  Null texts stay null."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["#spans"].to_pylist()):
                if text and spans:
                    raw = text.encode()
                    text = keep(raw, whole_characters(raw, merge_spans(spans))).decode()
                out.append(text)
            columns = {n: batch[n] for n in names} | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"))  # so that no column clashes
    cut = with_spans(packed, **settings).select("row.*", F.col("spans").alias("#spans")).mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else cut


# --- passages counted in words, for the pipeline ---------------------------------------------------

def remove_repeated_words(docs: DataFrame, words: int, gram: int = 10, **settings) -> DataFrame:
    """The rows and columns of ``docs`` without the passages of ``words`` words or more that also stand
    elsewhere, from the first word to the last; ``n_chars``, where there is one, is counted anew.

    A passage repeats when its words do, whatever white space is between them.  Null texts stay null.
    """
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"))

    def run(batches):
        for batch in batches:
            out = [cut_words(t, s) if t else t for t, s in zip(batch["text"].to_pylist(), batch["#spans"].to_pylist())]
            columns = {n: batch[n] for n in names} | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    cut = with_spans(packed, length=words, gram=gram, unit="word", **settings).select("row.*", F.col("spans").alias("#spans")).mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else cut


def cut_words(text: str, spans) -> str:
    """The text without the given ranges of words, each cut from its first word to its last."""
    runs = merge_spans(spans)
    if not runs:
        return text
    raw = text.encode()
    begins, ends = word_bounds(raw)
    return keep(raw, [(int(begins[a]), int(ends[b - 1])) for a, b in runs]).decode()


def query(spark, sf_dir) -> DataFrame:
    """The contract's columns at 400 bytes, then ``text``: the text without passages of over 50 words that repeat."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    spoken = staged(repeat_spans(docs, length=PASSAGE_WORDS, gram=10, unit="word"), "word-spans").withColumnRenamed("spans", "word_spans")

    def digest(batches):
        for batch in batches:
            rows = []
            for body, spans, words in zip(*(batch[c].to_pylist() for c in ("body", "spans", "word_spans"))):
                raw = body.encode()
                runs = merge_spans(spans)
                kept = keep(raw, runs)
                rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), cut_words(body, words)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    keyed = _keyed(docs).join(repeat_spans(docs), ["key_id", "key_text"], "left").join(spoken, ["key_id", "key_text"], "left")
    return keyed.select("doc_id", "body", "spans", "word_spans").mapInArrow(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")
