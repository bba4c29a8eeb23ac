"""Connected components of links, by large-star and small-star steps over tables.

Defined cases: links with a null end, and those of a vertex with itself, tie nothing; repeated links count once; no links
give an empty table; other columns of the links are left behind. If ``most_rounds`` don't suffice, RuntimeError is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root): for each vertex of ``links`` (a, b: long), the smallest vertex it reaches.

    Each round hangs larger neighbours on the smallest one, then smaller ones; both are a grouping with partial
    minima and a join. The edges are written to the shared folder after each round.
    """
    edges = common.written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = _mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
