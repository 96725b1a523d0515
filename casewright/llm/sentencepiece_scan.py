"""SentencePiece encoding and decoding as a parallel scan over chunks.

The pieces of a text are those that the vocabulary's own merges give.  A sequence of pieces is that encoding
exactly if every piece encodes to itself and every two neighbours, joined, encode to the two of them; so it is
the one path through the lattice of pieces whose steps all weigh 0, where a step between neighbours that merging
would not leave side by side weighs minus infinity.

A giant document is split into chunks.  The state at a chunk boundary is the piece that ends at it or crosses it;
a chunk is a max-plus matrix from entry to exit states (weights 0 and minus infinity, kept as booleans).  Matrices
combine associatively, in a tree of ``FAN`` chunks a node, which fixes every boundary state, and each chunk then
traces its own path back, independent of the others.  No piece crosses from a visible character to a space, so a
chunk's matrix has rank one where it holds such a place, and what lies between its first and its last one is
encoded by the library in compiled code.  Texts of up to ``chunk`` code points go to the library as a whole; the
ids are the same for every chunk size.

A literal U+2581 is spelled in bytes, so that it survives decoding.

Edge cases: null and empty texts have no pieces and decode to the empty text; equal rows are all kept; a text of
one unbroken word is split like any other, through the full matrices; null ids are kept.
"""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import environment_path, staged, table

CHUNK = 1 << 15
FAN = 64
START, SPELLED = -2, -1  # the state before a text, and a character without a piece
_FITS = 1 << 17  # pairs kept; the table is begun anew beyond them


def read_model(path: str) -> bytes:
    """The vocabulary file's bytes, read on the driver and shipped with the tasks."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """The library's processor, its pieces with a plain space for U+2581, and which pieces may be neighbours."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        lib = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spelled: list[bytes] = []
        self.texts: list[str] = []
        self.ranks: dict[str, float] = {}
        self.bytes: list[int] = [-1] * 256
        # What a lookup may meet on its way to a piece: a piece, or only the beginning of one.
        self.grow: dict[str, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            plain = ""
            if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.spelled.append(b"")
            elif lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.spelled.append(bytes([int(piece[1:-1], 16)]))
            else:
                plain = piece.replace("▁", " ")
                self.spelled.append(plain.encode())
                self.ranks[plain] = lib.get_score(i)
                self.grow[plain] = i
            self.texts.append(plain)
        if min(self.bytes) < 0:
            raise ValueError("the vocabulary has no byte fallback")
        for plain in self.ranks:
            for n in range(1, len(plain)):
                self.grow.setdefault(plain[:n], -1)
        self.longest = max(map(len, self.ranks), default=1)
        self.breaks = not any(" " in p.lstrip(" ") for p in self.ranks if p.strip(" "))
        self._whole: list[bool | None] = [None] * len(self.texts)
        self._fits: dict[int, bool] = {}

    # --- which pieces merging leaves as they are ------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best-ranked pair merges first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(-self.ranks[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.ranks]
            if not ranked:
                break
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stays(self, piece: int) -> bool:
        if self._whole[piece] is None:
            self._whole[piece] = self._merged(self.texts[piece]) == [self.texts[piece]]
        return self._whole[piece]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces side by side."""
        if left < 0 or right < 0:
            return True
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= _FITS:
                self._fits.clear()
            a, b = self.texts[left], self.texts[right]
            known = self._fits[key] = self._merged(a + b) == [a, b]
        return known

    def pieces(self, text: str, at: int):
        """(end, piece) of all pieces that begin at ``at``."""
        grow, found = self.grow, False
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            piece = grow.get(text[at:end])
            if piece is None:
                break
            if piece >= 0:
                found |= end == at + 1
                if self._stays(piece):
                    yield end, piece
        if not found:
            yield at + 1, SPELLED

    def states(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """(end, begin, piece) of all pieces that begin before ``at`` and end there or later, in a fixed order."""
        if at == 0:
            return [(0, 0, START)]
        first = max(0, at - self.longest)
        return sorted((end, b, p) for b in range(first, at) for end, p in self.pieces(text, b) if end >= at)

    def scan(self, text: str, entries, first: int, last: int) -> dict[int, dict[tuple[int, int], int]]:
        """By end position the (begin, piece) reached and, as bits, from which entries (end, begin, piece, bits);
        pieces begin from ``first`` to before ``last``."""
        nodes: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
        for end, begin, piece, bits in entries:
            nodes[end][begin, piece] = nodes[end].get((begin, piece), 0) | bits
        fits = self.fits
        for at in range(first, last):
            here = nodes.get(at)
            if here:
                for end, piece in self.pieces(text, at):
                    bits = 0
                    for (_, before), reached in here.items():
                        if fits(before, piece):
                            bits |= reached
                    if bits:
                        nodes[end][at, piece] = bits
        return nodes

    def _breaks(self, text: str, first: int, last: int) -> tuple[int, int] | None:
        """The first and the last place in ``first .. last - 1`` where a space follows a visible character."""
        if not self.breaks:
            return None
        low = first
        while (low := text.find(" ", low, last)) >= 0 and (low == 0 or text[low - 1] == " "):
            low += 1
        if low < 0:
            return None
        high = last
        while (high := text.rfind(" ", first, high)) > low and text[high - 1] == " ":
            pass
        return low, max(low, high)

    # --- one chunk ----------------------------------------------------------------------------

    def transfer(self, text: str, lead: int, size: int) -> np.ndarray:
        """Which exit states each entry state reaches; the chunk is ``text[lead : lead + size]``, with up to
        ``longest`` code points of context on either side."""
        stop = lead + size
        entries, exits = self.states(text, lead), self.states(text, stop)
        out = np.zeros((len(entries), len(exits)), bool)
        marked = [(*e, 1 << k) for k, e in enumerate(entries)]
        if places := self._breaks(text, lead, stop):
            reached = 0
            for bits in self.scan(text, marked, lead, places[0])[places[0]].values():
                reached |= bits
            ahead = self.scan(text, [(places[1], places[1], START, 1)], places[1], stop)
            ok = np.array([(b, p) in ahead.get(end, ()) for end, b, p in exits], bool)
            for k in range(len(entries)):
                if reached >> k & 1:
                    out[k] = ok
            return out
        nodes = self.scan(text, marked, lead, stop)
        for x, (end, b, p) in enumerate(exits):
            bits = nodes.get(end, {}).get((b, p), 0)
            for k in range(len(entries)):
                out[k, x] = bits >> k & 1
        return out

    def _path(self, text: str, entry: tuple[int, int, int], leave: tuple[int, int, int] | int) -> list[int]:
        """Ids after ``entry`` up to and with ``leave``, or up to a position."""
        stop = leave if isinstance(leave, int) else leave[0]
        nodes = self.scan(text, [(*entry, 1)], entry[0], stop)
        if isinstance(leave, int):
            at, (begin, piece) = stop, min(nodes[stop])  # one way leads there
        else:
            at, begin, piece = leave
        ids: list[int] = []
        while (at, begin, piece) != entry:
            ids += [piece] if piece >= 0 else [self.bytes[b] for b in reversed(text[begin].encode("utf-8", "surrogatepass"))]
            at, (begin, piece) = begin, min(x for x in nodes[begin] if self.fits(x[1], piece))
        return ids[::-1]

    def _middle(self, text: str) -> list[int]:
        """Ids of a stretch that begins with a space and ends where nothing crosses; the library adds that space."""
        if len(text) > 1 and "▁" not in text:
            return self.library.encode(text[1:], num_threads=1)
        return self._path(text, (0, 0, START), len(text)) if text else []

    def trace(self, text: str, lead: int, size: int, enters: int, leaves: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, between its fixed boundary states."""
        stop = lead + size
        entry, leave = self.states(text, lead)[enters], self.states(text, stop)[leaves]
        if leave[1] < lead:
            return []
        places = self._breaks(text, entry[0], leave[1] + 1)
        if not places:
            return self._path(text, entry, leave)
        head = self._path(text, entry, places[0]) if entry[0] < places[0] else []
        return head + self._middle(text[places[0] : places[1]]) + self._path(text, (places[1], places[1], START), leave)

    # --- whole texts ----------------------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return np.array(self._middle(" " + text) if text else [], "<u4").tobytes()

    def encode_checked(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text and the UTF-8 that they decode to."""
        ids = self.encode(text)
        if (back := self.decode(ids)) != text.encode("utf-8", "surrogatepass"):
            # The library normalises some characters away; the scan keeps every one.
            ids = np.array(self._path(" " + text, (0, 0, START), len(text) + 1), "<u4").tobytes()
            back = self.decode(ids)
        return ids, back

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text behind ``ids``."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices of 0 (true) and minus infinity (false)."""
    return (a.astype(np.int32) @ b.astype(np.int32)) > 0


def boundary_states(matrices: list[np.ndarray], enters: int = 0, leaves: int | None = None) -> list[int]:
    """The state at every boundary of the one path from ``enters`` to ``leaves`` (any, if not given)."""
    ahead = [np.arange(matrices[0].shape[0]) == enters]
    for m in matrices:
        ahead.append(m[ahead[-1]].any(0))
    back = ahead[-1] if leaves is None else np.arange(matrices[-1].shape[1]) == leaves
    states = [int(np.argmax(ahead[-1] & back))]
    for m, reached in zip(matrices[::-1], ahead[-2::-1]):
        states.append(int(np.argmax(reached & m[:, states[-1]])))
    return states[::-1]


def encode_documents(docs: DataFrame, model: bytes, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian 32-bit) and ``decoded`` (UTF-8 bytes) of ``docs(doc_id, text)``."""
    return _encoded(docs, model, chunk, fan, _checked_rows, "doc_id bigint, ids binary, decoded binary")


def _checked_rows(doc_id: pa.Array, ids: list[bytes], decoded: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])


def _token_rows(doc_id: pa.Array, ids: list[bytes], _decoded: list[bytes]) -> pa.RecordBatch:
    sizes = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(sizes.astype(np.int64)), tokens], ["doc_id", "n_tokens", "ids"])


def _encoded(docs: DataFrame, model: bytes, chunk: int, fan: int, rows, schema: str) -> DataFrame:
    """Every text encoded, as ``rows(doc_id, ids, decoded)`` puts it: in the task that encodes it, since a second Python
    function behind the first would take a second Python worker for every task, with a vocabulary of its own."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary file, half a megabyte

    def whole(batches):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [vocabulary.encode_checked(t) for t in part["text"].to_pylist()]
                yield rows(part["doc_id"], [f[0] for f in found], [f[1] for f in found])

    small = own.where(F.char_length("text") <= chunk).mapInArrow(whole, schema)
    return small.unionByName(_encode_giants(own.where(F.char_length("text") > chunk), shared, chunk, fan, rows, schema))


_vocabularies: dict[bytes, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary per worker, kept between tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(model)
    return _vocabularies[key]


def _pack(m: np.ndarray) -> dict:
    return {"rows": m.shape[0], "cells": np.packbits(m).tobytes()}


def _unpack(packed: dict) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(packed["cells"], np.uint8)).astype(bool)
    columns = packed["columns"]
    return bits[: packed["rows"] * columns].reshape(packed["rows"], columns)


_MATRIX = "struct<rows:int,columns:int,cells:binary>"
_MATRIX_TYPE = pa.struct([("rows", pa.int32()), ("columns", pa.int32()), ("cells", pa.binary())])


def _matrices(found: list[np.ndarray]) -> pa.Array:
    return pa.array([_pack(m) | {"columns": m.shape[1]} for m in found], _MATRIX_TYPE)


def _encode_giants(giants: DataFrame, shared, chunk: int, fan: int, rows, schema: str) -> DataFrame:
    longest = _vocabulary(shared.value).longest
    if chunk < 2 * longest:
        raise ValueError(f"a chunk holds {2 * longest} code points at least")

    def cut(batches):
        """Chunks with the code points on either side that a crossing piece may reach."""
        for batch in batches:
            for doc, row, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "text"))):
                full = " " + text
                for k, at in enumerate(range(0, len(full), chunk)):
                    lead = min(at, longest)
                    part = full[at - lead : at + chunk + longest]
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "row": row, "chunk_no": k, "block": k // fan, "lead": lead, "size": min(chunk, len(full) - at), "part": part}], schema=cut_type)

    cut_schema = "doc_id bigint, row bigint, chunk_no int, block int, lead int, size int, part string"
    cut_type = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk_no", pa.int32()), ("block", pa.int32()), ("lead", pa.int32()), ("size", pa.int32()), ("part", pa.string())])
    # Written once, because the row numbers must be the same in both passes.
    chunks = staged(giants.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, cut_schema), "chunks")

    def transfer(batches):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            found = [vocabulary.transfer(*x) for x in zip(*(batch[c].to_pylist() for c in ("part", "lead", "size")))]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["block"], batch["chunk_no"], _matrices(found)], ["row", "block", "chunk_no", "matrix"])

    def product(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk_no")
        found = [_unpack(m) for m in group["matrix"].to_pylist()]
        whole = found[0]
        for m in found[1:]:
            whole = combine(whole, m)
        return pa.table([group["row"].slice(0, 1), group["block"].slice(0, 1), _matrices([whole])], names=["row", "block", "matrix"])

    def top(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        states = boundary_states([_unpack(m) for m in group["matrix"].to_pylist()])
        return pa.table([group["row"], group["block"], pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=["row", "block", "enters", "leaves"])

    def inner(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk_no")
        states = boundary_states([_unpack(m) for m in group["matrix"].to_pylist()], group["enters"][0].as_py(), group["leaves"][0].as_py())
        return pa.table([group["row"], group["chunk_no"], pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=["row", "chunk_no", "enters", "leaves"])

    def trace(batches):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            found = [np.array(vocabulary.trace(*x), "<u4").tobytes() for x in zip(*(batch[c].to_pylist() for c in ("part", "lead", "size", "enters", "leaves")))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["chunk_no"], pa.array(found, pa.binary())], ["doc_id", "row", "chunk_no", "ids"])

    def join(group: pa.Table) -> pa.Table:
        ids = b"".join(group.sort_by("chunk_no")["ids"].to_pylist())
        return pa.Table.from_batches([rows(group["doc_id"].slice(0, 1).combine_chunks(), [ids], [_vocabulary(shared.value).decode(ids)])])

    dealt = chunks.select("row", "block", "chunk_no", "lead", "size", "part").repartition("row", "chunk_no")
    matrices = staged(dealt.mapInArrow(transfer, f"row bigint, block int, chunk_no int, matrix {_MATRIX}"), "matrices")
    blocks = matrices.groupBy("row", "block").applyInArrow(product, f"row bigint, block int, matrix {_MATRIX}")
    tops = blocks.groupBy("row").applyInArrow(top, "row bigint, block int, enters int, leaves int")
    bounds = matrices.join(tops, ["row", "block"]).groupBy("row", "block").applyInArrow(inner, "row bigint, chunk_no int, enters int, leaves int")
    # One group is one document, whose pieces are one row of the result anyway.
    return (
        chunks.join(bounds, ["row", "chunk_no"])
        .select("doc_id", "row", "chunk_no", "lead", "size", "part", "enters", "leaves")
        .mapInArrow(trace, "doc_id bigint, row bigint, chunk_no int, ids binary")
        .groupBy("row")
        .applyInArrow(join, schema)
    )


def default_model() -> bytes:
    return read_model(os.path.join(environment_path(), "piece_bpe_32k.model"))


def token_rows(docs: DataFrame, model: bytes, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_tokens, ids`` with the ids as an array."""
    return _encoded(docs, model, chunk, FAN, _token_rows, "doc_id bigint, n_tokens bigint, ids array<int>")


def query(spark, sf_dir) -> DataFrame:
    done = encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), default_model())
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
