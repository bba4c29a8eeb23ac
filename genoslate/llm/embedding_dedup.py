"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

1. Equal vectors are one class, weighted by its copies.
2. A rotation of the principal axes is learnt on a bounded sample (``max_sample`` classes, by hash) so that signs lose
   least: signs and rotation are fitted to each other in turn. Every class then gets its code, in several codings
   that start from different random rotations.
3. Codes are cut into substrings. A pair of codes that differs by one bit at most in some substring meets in that
   substring's table: one side is entered as it is, the other with each bit turned. How many substrings and codings there
   are follows from ``recall``, whatever the number of classes: more classes need wider substrings, in which fewer pairs
   meet, and so more codings. The width is the one that costs least by the share of bits that turn in pairs at the
   threshold; then codings are added until ``recall`` of such pairs meet. The pairs are made from the sample: a vector,
   and it turned to the threshold's angle towards another one of the sample, or towards a random direction.
4. Of the pairs that meet, those within ``radius`` bits are ranked again by the cosine of the original vectors in double
   precision; from ``threshold`` on they are links. Components follow from the links.

No bucket is capped. Recall on real pairs depends on the data; tests measure it against brute force.

Defined cases: a vector that is null or zero, or holds a null or a component that isn't finite, links with
nothing; vectors of different length never link; rows of one id are one vertex; rows without an id are vertices by their
vector, and are kept unless they reach one with an id; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.9
BITS = 64
#: Codings there are at least.
ROTATIONS = 2
#: Share of the pairs at the threshold that are to meet.
RECALL = 0.995
MAX_SAMPLE = 8192


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): codes are the signs of (x - mean) @ projection."""
    mean = x.mean(axis=0)
    y = x - mean
    _, axes = np.linalg.eigh(y.T @ y / max(1, len(y)))
    w = axes[:, ::-1][:, :bits]
    v = y @ w
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(w.shape[1], w.shape[1])))
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        r = right.T @ left.T
    return mean, w @ r


def _codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    on = ((x - mean) @ projection) >= 0
    return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(rows: DataFrame, vector: str) -> DataFrame:
    """(v, dim, raw): usable vectors as doubles."""

    def run(batches):
        for batch in batches:
            v, raw, dim = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not x or any(c is None for c in x):
                    continue
                y = np.array(x, np.float64) + 0.0  # one zero
                if np.isfinite(y).all() and y.any():
                    v.append(i)
                    raw.append(y.tobytes())
                    dim.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], names=["v", "dim", "raw"])

    return rows.select("v", F.col(vector)).mapInArrow(run, "v long, dim int, raw binary")


def _cuts(bits: int, m: int) -> list[int]:
    return [bits * i // m for i in range(m + 1)]


def _within_one(p: float, width: int) -> float:
    """Probability that at most one of ``width`` bits turns."""
    return (1 - p) ** width + width * p * (1 - p) ** (width - 1)


def _substrings(bits: int, n: int, p: float, recall: float) -> int:
    """Number of substrings by which ``n`` codes meet at least cost, if each bit of a pair turns with probability ``p``."""

    def cost(m: int) -> float:
        widths = np.diff(_cuts(bits, m))
        apart = float(np.prod([1 - _within_one(p, int(w)) for w in widths]))
        codings = ROTATIONS if apart <= 0 else max(ROTATIONS, math.log(1 - recall) / min(-1e-12, math.log(apart)))
        return codings * sum(w + 2 + (w + 1) * n / 2.0**w for w in widths)

    return min(range(1, bits + 1), key=cost)


def _threshold_pairs(x: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors whose cosine is the threshold: turned towards others of ``x``, and towards random directions."""
    rng = np.random.default_rng(0)
    t = max(-1.0, min(1.0, threshold))
    out = []
    for other in (x[rng.permutation(len(x))], rng.normal(size=x.shape)):
        u = other - np.einsum("ij,ij->i", other, x)[:, None] * x
        size = np.linalg.norm(u, axis=1)
        usable = size > 1e-6
        if usable.any():
            out.append((x[usable], t * x[usable] + math.sqrt(1 - t * t) * u[usable] / size[usable, None]))
    return out


def _radius(bits: int, p: float) -> int:
    """The share of the bits that turns, and four standard deviations."""
    return math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def _codings(x: np.ndarray, bits: int, n: int, threshold: float, rotations: int | None, radius: int | None, recall: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """The codings, the number of substrings of each, and the radius; ``rotations``: so many codings, else as many as ``recall`` asks for.

    A radius that is given isn't held against the codings. If learnt codings leave the same pairs apart, further ones are plain
    random rotations about zero, for which any pair's bits turn by its angle alone.
    """
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    pairs = _threshold_pairs(x, threshold)
    apart = [np.ones(len(a), bool) for a, _ in pairs]
    codings: list[tuple[np.ndarray, np.ndarray]] = []
    m, within, learnt = 1, bits, True
    while len(codings) < (rotations or ROTATIONS) or (rotations is None and any(o.mean() > 1 - recall for o in apart)):
        seed = len(codings)
        if learnt:
            one = learn_rotation(x, bits, seed)
        else:
            one = np.zeros(x.shape[1]), np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], bits)))[0]
        turned = [_codes(a, *one) ^ _codes(b, *one) for a, b in pairs]
        if not codings:
            share = max([p, *[float(np.bitwise_count(d).mean()) / bits for d in turned]])
            m = _substrings(bits, n, share, recall)
            within = _radius(bits, share)
        codings.append(one)
        cuts = _cuts(bits, m)
        before = sum(int(o.sum()) for o in apart)
        for o, d in zip(apart, turned, strict=True):
            met = np.zeros(len(d), bool)
            for i, j in zip(cuts, cuts[1:], strict=False):
                met |= np.bitwise_count((d >> np.uint64(i)) & np.uint64((1 << (j - i)) - 1)) <= 1
            o &= ~(met & (np.bitwise_count(d) <= (bits if radius is not None else within)))
        expected = 1 - float(np.prod([1 - _within_one(p, j - i) for i, j in zip(cuts, cuts[1:], strict=False)]))
        learnt = learnt and before - sum(int(o.sum()) for o in apart) >= before * expected / 4
    return codings, m, within if radius is None else radius


def _tables(codes: DataFrame, bits: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(table, key, v, code) as entered and as probed, for ``m`` substrings."""
    cuts = _cuts(bits, m)
    parts = []
    for j in range(m):
        width = cuts[j + 1] - cuts[j]
        key = F.shiftrightunsigned("code", cuts[j]).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1))
        turned = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(width)])
        parts.append(F.struct(F.lit(j).alias("table"), key.alias("key"), turned.alias("turned")))
    entered = codes.select("rotation", "v", "code", F.explode(F.array(*[F.struct(p["table"].alias("table"), p["key"].alias("key")) for p in parts])).alias("t")).select("rotation", "v", "code", "t.*")
    probed = None
    for j, p in enumerate(parts):
        one = codes.select("rotation", "v", "code", F.lit(j).alias("table"), p["key"].alias("key"), F.explode(p["turned"]).alias("x"))
        one = one.select("rotation", "v", "code", "table", F.col("key").bitwiseXOR(F.col("x")).alias("key"))
        probed = one if probed is None else probed.unionByName(one)
    return entered, probed


def _links(classes: DataFrame, dim: int, threshold: float, rotations: int | None, radius: int | None, max_sample: int, recall: float) -> DataFrame:
    bits = min(BITS, dim)
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("raw"), "v").limit(max_sample).select("raw").toPandas()["raw"].map(bytes).tolist()
    x = _unit(sorted(sample)) if sample else np.zeros((1, dim))
    codings, m, radius = _codings(x, bits, n, threshold, rotations, radius, recall)
    held = classes.sparkSession.sparkContext.broadcast(codings)

    def code(batches):
        for batch in batches:
            u = _unit(batch.column(1).to_pylist()) if len(batch) else np.zeros((0, dim))
            for r, (mean, projection) in enumerate(held.value):
                c = _codes(u, mean, projection).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), r, np.int32)), batch.column(0), pa.array(c)], names=["rotation", "v", "code"])

    codes = common.written(classes.select("v", "raw").mapInArrow(code, "rotation int, v long, code long"), "codes")
    entered, probed = _tables(codes, bits, m)
    near = F.bit_count(F.col("code").bitwiseXOR(F.col("other"))) <= radius
    met = entered.join(probed.withColumnRenamed("v", "w").withColumnRenamed("code", "other"), ["rotation", "table", "key"]).filter((F.col("v") < F.col("w")) & near)
    met = common.written(met.select(F.col("v").alias("a"), F.col("w").alias("b")).distinct(), "met-vectors")
    both = met.join(classes.select(F.col("v").alias("a"), F.col("raw").alias("s")), "a").join(classes.select(F.col("v").alias("b"), F.col("raw").alias("t")), "b")

    @F.pandas_udf("double")
    def cosine(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", _unit(list(s)), _unit(list(t))) if len(s) else np.zeros(0))

    return both.filter(cosine("s", "t") >= threshold).select("a", "b")


def near_vectors(
    vectors: DataFrame, vector: str = "embedding", vec: str = "vec_id", threshold: float = THRESHOLD,
    rotations: int | None = None, radius: int | None = None, max_sample: int = MAX_SAMPLE, recall: float = RECALL,
) -> DataFrame:
    """(vec, n_links, component_id, kept) for every row: links to other vectors, smallest id reachable."""
    rows = vectors.select(vec, vector).withColumn("v", F.coalesce(F.col(vec).cast("long"), F.xxhash64(vector).bitwiseOR(F.lit(-(1 << 63)))))
    usable = common.written(_classes(rows, vector), "usable-vectors")
    classes = common.written(usable.groupBy("dim", "raw").agg(F.min("v").alias("v"), F.count("*").alias("copies")), "vector-classes")
    found = None
    for row in classes.select("dim").distinct().orderBy("dim").toLocalIterator():
        own = classes.filter(F.col("dim") == row["dim"]).select("v", "raw")
        one = _links(own, row["dim"], threshold, rotations, radius, max_sample, recall)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = classes.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
    links = common.written(found.distinct(), "vector-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.groupBy("v").agg(F.sum("copies").alias("copies"))
    reached = both.join(copies.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    roots = components(links)
    facts = classes.join(reached.withColumnRenamed("a", "v"), "v", "left").join(roots, "v", "left")
    facts = facts.select("dim", "raw", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "v").alias("root"))
    member = usable.join(facts, ["dim", "raw"]).select("v", "n_links", "root")
    member = common.written(member.groupBy("v").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root")), "vector-members")
    first = member.groupBy("root").agg(F.min(F.when(F.col("v") >= 0, F.col("v"))).alias("first"))
    known = member.join(first, "root")
    out = rows.select(vec, "v").join(known, "v", "left")
    component = F.when(F.col("root").isNull(), F.col(vec).cast("long")).otherwise(F.col("first"))
    kept = F.when(F.col("v") >= 0, F.col("v") == component).otherwise(component.isNull())
    return out.select(vec, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
