"""Quality scores by positive-unlabelled learning.

A linear model over hashed byte trigrams and a few shape statistics is fitted by the non-negative unbiased risk:
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic loss, where the
positives are trusted rows of quality 1 and the unlabelled are a sample of all documents, whose labels aren't looked at. When the second
part turns negative, its gradient is followed upwards instead, which keeps the model from fitting the positives alone.
The class prior is estimated from the usable labels.

The fit uses a bounded sample (``max_positives``, ``max_unlabelled``, chosen by a hash of the row); scoring reads every
whole text. Labels, language, source and id are no features.

Defined cases: a null or empty text gets the score of an all-zero feature row; equal texts get equal scores; an
empty table gives an empty table; without any positive label the score is 0.5 for all; of several labels of one id the largest counts; other
columns are not read in training, and in scoring come back as they are, but for ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of texts whose features are made at once: some forty bytes of arrays each.
SLICE = 1 << 20
BUCKETS = 1024
SHAPE = 9
MAX_POSITIVES = 3000
MAX_UNLABELLED = 5000

_CLASS = np.zeros((256, 5), dtype=np.float32)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), 32 < _b < 127 and not _c.isalnum(), _b in b" \t\n\r\x0b\x0c", _b == 10)


def features(texts: list[bytes]) -> np.ndarray:
    """One row per whole text: square roots of trigram shares, then shape statistics."""
    out = np.zeros((len(texts), BUCKETS + SHAPE), dtype=np.float32)
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(x) == 0:
        return out
    row = np.repeat(np.arange(len(texts)), sizes)
    if len(x) >= 3:
        y = x.astype(np.uint32)
        h = y[:-2] * np.uint32(2654435761) + y[1:-1] * np.uint32(2246822519) + y[2:] * np.uint32(3266489917)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(22)
        same = row[:-2] == row[2:]
        at = (row[:-2] * BUCKETS + h)[same]
        grams = np.bincount(at, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32)
        out[:, :BUCKETS] = np.sqrt(grams / np.maximum(1, grams.sum(1, keepdims=True)))
    byte_counts = np.bincount(row * 256 + x, minlength=len(texts) * 256).reshape(len(texts), 256)
    out[:, BUCKETS : BUCKETS + 5] = (byte_counts @ _CLASS) / np.maximum(1, sizes)[:, None]
    for i, text in enumerate(texts):
        if words := text.split():
            out[i, BUCKETS + 5] = len(set(words)) / len(words)
            out[i, BUCKETS + 6] = min(4.0, len(text) / len(words) / 8)
            out[i, BUCKETS + 8] = sum(map(eq, words, words[1:])) / len(words)
    out[:, BUCKETS + 7] = np.log1p(sizes) / 12
    return out


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights (last: bias) that minimise the non-negative risk."""
    rng = np.random.default_rng(seed)
    x = [np.hstack([m, np.ones((len(m), 1), np.float32)]) for m in (pos, unl)]
    w = rng.normal(0, 0.01, x[0].shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        narrow = w.astype(np.float32)  # as the features, which would be widened at every step otherwise
        zp, zu = (x[0] @ narrow).astype(np.float64), (x[1] @ narrow).astype(np.float64)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of = lambda m, weight: (weight.astype(np.float32) @ m).astype(np.float64) / len(m)
        as_negative = of(x[1], sig(zu)) - prior * of(x[0], sig(zp))
        g = as_negative - prior * of(x[0], sig(-zp)) if negative >= 0 else -as_negative
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sample(docs: DataFrame, ids: DataFrame, doc: str, text: str) -> np.ndarray:
    """Feature rows of the documents in the bounded table ``ids``."""
    chosen = docs.select(doc, text).join(F.broadcast(ids), F.col(doc) == F.col("__id"), "left_semi")

    def rows(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([r.tobytes() for r in features(texts)], pa.binary())]

    table = common.map_text(chosen, "x binary", rows, text, keep=[doc], limit=SLICE).toPandas()
    table = table.assign(o=[bytes(x) for x in table["x"]]).sort_values([doc, "o"])
    return np.array([np.frombuffer(x, np.float32) for x in table["o"]]).reshape(-1, BUCKETS + SHAPE)


def train(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality",
    max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
) -> np.ndarray | None:
    """The model's weights. ``labels``: only the rows that may be learnt from. None if there are no positives."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("__id"), F.col(label).alias("__y"))
    known = usable.groupBy("__id").agg(F.max("__y").alias("__y"))
    share = known.agg(F.avg(F.col("__y").cast("double"))).first()[0]
    if not share:
        return None
    prior = float(np.clip(share, 0.05, 0.98))
    order = F.xxhash64(F.lit(11), "__id")
    positives = known.filter(F.col("__y") == 1).orderBy(order, "__id").limit(max_positives).select("__id")
    ids = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("__id"))
    unlabelled = ids.orderBy(F.xxhash64(F.lit(13), "__id"), "__id").limit(max_unlabelled).select("__id").distinct()
    p, u = _sample(docs, positives, doc, text), _sample(docs, unlabelled, doc, text)
    return fit_pu(p, u, prior) if len(p) and len(u) else None


def score(docs: DataFrame, model: np.ndarray | None, text: str = "text", threshold: float = 0.7, otherwise: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        w = held.value
        z = np.full(len(texts), otherwise) if w is None else 1 / (1 + np.exp(-np.clip(features(texts) @ w[:-1] + w[-1], -30, 30)))
        return [pa.array(z, pa.float64()), pa.array((z >= threshold).astype(np.int32))]

    return common.map_text(docs, "score double, predicted int", run, text, limit=SLICE)
