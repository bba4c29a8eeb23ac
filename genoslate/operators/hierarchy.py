"""Forests and chains in logarithmic rounds: ancestors by path doubling, chains by pointer jumping.

Each round joins what is known with itself, so that a path of d steps takes log2(d) rounds. Rounds are written to the shared folder, and only rows whose path
goes on take part in the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


class CycleError(ValueError):
    """A hierarchy in which some entries are their own ancestors."""


def _cyclic(jumps: DataFrame) -> list[str]:
    """Some of the nodes that jumps longer than the number of nodes still reach: those lie on cycles."""
    return sorted(str(r["to"]) for r in jumps.select("to").distinct().limit(10).collect())


def ancestors(parents: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor, steps) of a forest: each child has one parent. CycleError names members of cycles.

    After round k, the pairs of up to 2**k - 1 steps are known, and for each node the ancestor 2**k steps up. A node's next pairs are those of that
    ancestor, so each pair is made once.
    """
    jumps = written(parents.filter(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("n"), F.col(parent).alias("to")), "jumps")
    count = jumps.count()
    known = jumps.select(F.col("n").alias("child"), F.col("to").alias("ancestor"), F.lit(1).cast("long").alias("steps")).limit(0)
    step = 1
    while not jumps.isEmpty():
        if step > count:
            raise CycleError(f"entries that are their own ancestors: {', '.join(_cyclic(jumps))}")
        reached = jumps.select(F.col("n").alias("child"), F.col("to").alias("ancestor"), F.lit(step).cast("long").alias("steps"))
        beyond = jumps.join(known, F.col("to") == F.col("child")).select(F.col("n").alias("child"), "ancestor", (F.col("steps") + step).alias("steps"))
        known = written(known.unionByName(reached).unionByName(beyond), "ancestors")
        over = jumps.select(F.col("n").alias("__n"), F.col("to").alias("__to"))
        jumps = written(jumps.join(over, F.col("to") == F.col("__n")).select("n", F.col("__to").alias("to")), "jumps")
        step *= 2
    return known


def anchors(links: DataFrame) -> DataFrame:
    """(n, anchor, steps) for links (n, to), one per n: the first node that has no link itself, and how many links lead there.

    Nodes whose links end in a cycle are left out.
    """
    active = written(links.select("n", "to", F.lit(1).cast("long").alias("steps")), "links")
    count = active.count()
    done = active.limit(0)
    step = 1
    while step <= 2 * max(1, count) and not active.isEmpty():
        over = active.select(F.col("n").alias("__n"), F.col("to").alias("__to"), F.col("steps").alias("__steps"))
        ended = done.select(F.col("n").alias("__n"), F.col("to").alias("__to"), F.col("steps").alias("__steps"))
        # where the next node has ended, its end is this node's end
        met = active.join(over.withColumn("__open", F.lit(True)).unionByName(ended.withColumn("__open", F.lit(False))), F.col("to") == F.col("__n"), "left")
        to, length = F.coalesce("__to", "to"), F.col("steps") + F.coalesce("__steps", F.lit(0))
        round_ = written(met.select("n", to.alias("to"), length.alias("steps"), F.coalesce("__open", F.lit(False)).alias("open")), "links")
        done = done.unionByName(round_.filter(~F.col("open")).drop("open"))
        active = round_.filter("open").drop("open")
        step *= 2
    return done.select("n", F.col("to").alias("anchor"), "steps")
