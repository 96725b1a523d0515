"""Language identification: averaged hashed subword embeddings, linear softmax, SGD in numpy.

Every byte n-gram (orders ``ORDERS``, white space squeezed, letters lowered) is hashed to a row of an
embedding table; a document is the average of its rows and a linear softmax reads the average.
Because the model is linear after training, table and softmax fold into one score row per hash.
The temperature is fitted on rows kept out of training and a document whose calibrated top
probability lies under the threshold that keeps ``keep`` of those rows is marked ``rejected``.

Edge cases: null text and texts without a letter (``str.isalpha``) are ``und`` with score 0; with no training
row at all every text is ``und``; other empty or very short texts fall back to the classes' bias; very long
texts are read in pieces that share no n-gram, which gives the same average; repeated rows are learned from once.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import fold, mix, table

ORDERS = (2, 3)
_LETTER = re.compile(r"[^\W\d_]")  # also matches numerals such as ½, which isalpha refuses
PIECE = 1 << 20
_SALT = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def pieces(text: str) -> list[bytes]:
    """The padded bytes of a text in pieces of ``PIECE`` n-gram starts, each with the bytes its last ones reach."""
    raw = b" " + text.encode("utf-8", "surrogatepass") + b" " * max(ORDERS)
    return [raw[at : at + PIECE + max(ORDERS)] for at in range(0, len(raw) - max(ORDERS), PIECE)]


def grams(raw: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every piece, in order, and the number of n-grams per piece."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    h, found, owner = _SALT[buf], [], []
    total = np.zeros(len(raw), np.int64)
    ends = np.cumsum(sizes)
    live = np.ones(len(buf), bool)
    for e in range(max(ORDERS)):
        live[ends - 1 - e] = False
    rows = np.repeat(np.arange(len(raw)), sizes)[live]
    rolled = h
    for order in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * _STEP + h[order - 1 :]
        if order in ORDERS:
            picked = (mix(rolled)[live[: len(rolled)]] >> np.uint64(24)) % np.uint64(buckets)
            found.append(picked.astype(np.int32))
            owner.append(rows)
            total += sizes - max(ORDERS)
    if len(found) == 1:
        return found[0], total
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(found)[order], total


def train(texts: list[str], langs: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 4, rate: float = 0.5, keep: float = 0.99, seed: int = 11) -> dict:
    """SGD over documents in a seeded order; every tenth row is kept out to fit temperature and threshold."""
    classes = sorted(set(langs))
    if not classes:
        return {"classes": [], "table": np.zeros((buckets, 1), np.float32), "bias": np.zeros(1, np.float32), "temperature": 1.0, "threshold": 0.0}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, len(classes)), np.float32)
    bias = np.zeros(len(classes), np.float32)
    y = np.array([classes.index(x) for x in langs])
    rows = []
    for text in texts:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(text):
            total += np.bincount(grams([piece], buckets)[0], minlength=buckets)
        ids = np.flatnonzero(total)
        rows.append((ids.astype(np.int32), (total[ids] / max(1, total.sum())).astype(np.float32)))
    kept_out = np.arange(len(rows)) % 10 == 9
    learn = np.flatnonzero(~kept_out)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(learn):
            ids, w = rows[i]
            mean = w @ emb[ids] if len(ids) else np.zeros(dim, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            if len(ids):
                emb[ids] -= (step * len(ids) ** 0.5) * w[:, None] * back[None, :]
    folded = emb @ out
    check = np.flatnonzero(kept_out) if kept_out.any() else learn
    z = np.array([rows[i][1] @ folded[rows[i][0]] + bias if len(rows[i][0]) else bias for i in check])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(check)), y[check]]))

    temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    s = z / temperature
    s = np.exp(s - s.max(1, keepdims=True))
    top = (s / s.sum(1, keepdims=True)).max(1)
    return {"classes": classes, "table": folded.astype(np.float32), "bias": bias, "temperature": float(temperature), "threshold": float(np.quantile(top, 1 - keep))}


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability per text."""
    classes = model["classes"]
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if classes and t is not None and has_letter(t)]
    sums, counts = np.zeros((len(texts), len(classes))), np.zeros(len(texts), np.int64)
    owners: list[int] = []
    parts: list[bytes] = []

    def add() -> None:
        g, n = grams(parts, len(model["table"]))
        starts = np.cumsum(n) - n
        z = np.stack([np.add.reduceat(model["table"][:, c][g].astype(np.float64), starts) for c in range(len(classes))], 1)
        np.add.at(sums, owners, z)
        np.add.at(counts, owners, n)
        owners.clear()
        parts.clear()

    size = 0
    for i in known:
        for piece in pieces(texts[i]):
            if parts and size + len(piece) > PIECE:
                add()
                size = 0
            owners.append(i)
            parts.append(piece)
            size += len(piece)
    if parts:
        add()
    if known:
        z = (sums[known] / counts[known][:, None] + model["bias"]) / model["temperature"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, b, v in zip(known, p.argmax(1), p.max(1)):
            langs[i], scores[i] = classes[b], v
    return langs, scores


def fit(docs: DataFrame, sample: int = 6000, **settings) -> dict:
    """Train on at most ``sample`` labelled rows of ``docs(doc_id, text, lang)``, taken by hash order.

    Rows are picked by key first, so that no task sends more texts than the sample holds.  The bound keeps
    the driver's share fixed; everything else reads all rows.  The pick is a total order, so a fit is repeatable.
    """
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang", F.xxhash64("text").alias("key_text"))
    keys = ["doc_id", "key_text", "lang"]
    picked = own.select(*keys).distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), *keys).limit(sample).withColumnsRenamed({k: f"#{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"`#{k}`")) for k in keys]
    rows = own.join(F.broadcast(picked), same[0] & same[1] & same[2]).select(*keys, "text").dropDuplicates(keys).collect()  # ``sample`` rows at most
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), -1 if r.doc_id is None else r.doc_id, r.text, r.lang))
    return train([r.text for r in rows], [r.lang for r in rows], **settings)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` with ``lang_pred``, ``score`` and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x classes floats, fixed by parameters

    def run(batches):
        model = shared.value
        for batch in batches:
            langs, scores = predict(batch["text"].to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < model["threshold"])],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
