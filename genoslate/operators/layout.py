"""A plane layout of vectors by their neighbourhood graph."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vectors import nearest_per_query


def neighbour_graph(vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b): each row's k nearest, in both directions, each pair once a direction (K24). Rows without a neighbour are in no pair."""
    near = nearest_per_query(vectors, vectors, k, key, vector).select(F.col("query").alias("a"), F.col(key).alias("b"))
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


#: Directions that a round chooses from: the two vectors, what they miss, and the steps before.
BASIS = ("x", "y", "rx", "ry", "px", "py")


def _best_two(gram: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Coefficients (len(BASIS), 2) of the two unit combinations with the largest Rayleigh quotients; zeros where there aren't two directions."""
    length = np.sqrt(np.maximum(np.diag(gram), 0))
    unit = np.where(length > 0, 1 / np.where(length > 0, length, 1), 0)
    values, vectors = np.linalg.eigh(gram * np.outer(unit, unit))
    kept = values > 1e-10
    base = unit[:, None] * vectors[:, kept] / np.sqrt(values[kept])
    if not base.shape[1]:
        return np.zeros((len(gram), 2))
    inner = base.T @ image @ base
    top = base @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1][:, :2]
    return np.pad(top, ((0, 0), (0, 2 - top.shape[1])))


def spectral_layout(vectors: DataFrame, k: int = 10, rounds: int = 12, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[float]]:
    """(key, x, y, degree) and two residuals: the second and third eigenvectors of the neighbour graph's normalised adjacency M = D**-0.5 A D**-0.5.

    The first eigenvector, the roots of the degrees, is known and taken out. Each round takes the best two vectors in the span of the last two, their
    residuals and the last steps, as conjugate gradients for eigenvectors do. It is one join of the edges with the residuals of their ends and one grouping with partial
    sums, and is written; the driver gets the inner products of six columns. x and y have a length of 1 each and are at right angles. The residuals
    tell how far each is from an eigenvector: |Mx - (x Mx) x|.

    Keys are unique. A row that has no vector or neighbour is left out; without any the layout is empty and its residuals are 0. In fewer than three
    rows the values that can't be told are 0.
    """
    edges = written(neighbour_graph(vectors, k, key, vector), "edges")
    nodes = written(edges.groupBy("a").agg(F.count("*").alias("degree")).withColumn("root", F.sqrt("degree")), "nodes")
    spread = lambda seed: F.pmod(F.xxhash64("a", F.lit(seed)), F.lit(20_011)) / 20_011 - 0.5
    total = float(nodes.agg(F.sum("degree")).first()[0] or 0)

    def products(df: DataFrame, pairs: list[tuple[str, str]]) -> list[float]:
        return [float(v or 0) for v in df.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"s{i}") for i, (p, q) in enumerate(pairs)]).first()]

    def squared(df: DataFrame) -> DataFrame:
        """``df`` with x and y freed of the first eigenvector and of each other, with a length of 1."""
        xr, yr, xx0, xy, yy0 = products(df, [("x", "root"), ("y", "root"), ("x", "x"), ("x", "y"), ("y", "y")])
        part = 1 / total if total else 0.0
        xx, xy, yy = xx0 - xr * xr * part, xy - xr * yr * part, yy0 - yr * yr * part
        # what is left of a length by rounding alone counts as none
        scale = lambda rest, was: rest**-0.5 if rest > 1e-18 * max(was, 1e-6) else 0.0
        sx = scale(xx, xx0)
        share = xy * sx * sx
        sy = scale(yy - share * xy, yy0)
        free = lambda c, r: F.col(c) - F.lit(r * part) * F.col("root")
        return df.withColumns({"x": free("x", xr) * sx, "y": (free("y", yr) - F.lit(share) * free("x", xr)) * sy})

    def turned(df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with M times each of the columns, as ``m`` and its name."""
        ends = df.select(F.col("a").alias("b"), *[(F.col(c) / F.col("root")).alias(f"__{c}") for c in columns])
        sums = edges.join(ends, "b").groupBy("a").agg(*[F.sum(f"__{c}").alias(f"__{c}") for c in columns])
        return df.join(sums, "a").withColumns({f"m{c}": F.col(f"__{c}") / F.col("root") for c in columns}).drop(*[f"__{c}" for c in columns])

    start = squared(nodes.withColumns({"x": spread(1), "y": spread(2)}))
    state = written(turned(start, "x", "y").withColumns({c: F.lit(0.0) for c in ("px", "py", "mpx", "mpy")}), "layout")
    for _ in range(rounds):
        x, y, xr, yr = products(state, [("x", "mx"), ("y", "my"), ("mx", "root"), ("my", "root")])
        part = 1 / total if total else 0.0
        missed = state.withColumns({"rx": F.col("mx") - F.lit(x) * F.col("x") - F.lit(xr * part) * F.col("root"), "ry": F.col("my") - F.lit(y) * F.col("y") - F.lit(yr * part) * F.col("root")})
        whole = written(turned(missed, "rx", "ry"), "layout")
        n = len(BASIS)
        sums = products(whole, [(p, q) for p in BASIS for q in BASIS] + [(p, f"m{q}") for p in BASIS for q in BASIS])
        gram, image = (np.array(v).reshape(n, n) for v in (sums[: n * n], sums[n * n :]))
        best = _best_two(gram, (image + image.T) / 2)
        step = np.vstack([np.zeros((2, 2)), best[2:]])
        mixed = lambda c, mark="": reduce(add, [F.lit(float(w)) * F.col(f"{mark}{b}") for w, b in zip(c, BASIS)])
        state = whole.select("a", "degree", "root", *[mixed(c[:, i], m).alias(f"{m}{p}{'xy'[i]}") for c, p in ((best, ""), (step, "p")) for i in (0, 1) for m in ("", "m")])
    # twice, since the first leaves rounding behind
    state = written(squared(squared(state.select("a", "degree", "root", "x", "y"))), "layout")
    after = written(turned(state, "x", "y"), "turned")
    x, y = products(after, [("x", "mx"), ("y", "my")])
    off = after.agg(*[F.sqrt(F.sum(F.pow(F.col(f"m{c}") - F.lit(v) * F.col(c), 2))) for c, v in (("x", x), ("y", y))]).first()
    return state.select(F.col("a").alias(key), "x", "y", "degree"), [float(v or 0) for v in off]
