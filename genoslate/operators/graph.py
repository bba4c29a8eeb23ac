"""Provenance as edge tables: roots, leaves, depths, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hierarchy
from .shared import written


def edges_of(log: DataFrame) -> DataFrame:
    """(child, parent) of a query log with a parents array."""
    return log.select(F.col("entry_id").alias("child"), F.explode("parents").alias("parent"))


def roots(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes without a known parent."""
    known = edges.join(nodes.select(F.col(node).alias("parent")), "parent", "left_semi")
    return nodes.select(node).join(known.select(F.col("child").alias(node)), node, "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    return nodes.select(node).join(edges.select(F.col("parent").alias(node)), node, "left_anti")


def depths(nodes: DataFrame, edges: DataFrame, node: str = "node", most: int = 10_000) -> DataFrame:
    """(node, depth): 0 for roots, else 1 + the largest depth of a known parent.

    A node with one parent is its parent's depth and one: such chains are contracted first, in rounds that double their length. What is left are
    nodes with several parents, whose parents are replaced by the ends of their chains; of these, each step joins the edges with the last frontier only,
    and carries on how many parents of a waiting node are met. Nodes that only cycles reach get a null depth; RuntimeError after ``most``
    steps. Steps are written to the shared folder.
    """
    known = edges.join(nodes.select(F.col(node).alias("parent")), "parent", "left_semi").select("child", "parent").distinct()
    known = written(known, "edges")
    needs = written(known.groupBy("child").agg(F.count("*").alias("n_parents"), F.min("parent").alias("one")), "parents")
    single = needs.filter("n_parents = 1").select(F.col("child").alias("n"), F.col("one").alias("to"))
    chains = written(hierarchy.anchors(single), "chains")
    merges = needs.filter("n_parents > 1").select("child", "n_parents")
    # nodes in chains that end in a cycle have no anchor, so their edges are never met
    loose = single.join(chains.select("n"), "n", "left_anti").select(F.col("n").alias("parent"))
    short = known.join(merges, "child", "left_semi").join(loose, "parent", "left_anti").join(chains.withColumnRenamed("n", "parent"), "parent", "left")
    short = written(short.select("child", F.coalesce("anchor", "parent").alias("parent"), (F.coalesce("steps", F.lit(0)) + 1).alias("w")), "merges")
    front = written(roots(nodes, edges, node).select(F.col(node).alias("n"), F.lit(0).cast("long").alias("depth")), "depth")
    done, waiting = front, None
    for _ in range(most):
        met = short.join(front.select(F.col("n").alias("parent"), "depth"), "parent").select("child", F.lit(1).cast("long").alias("k"), (F.col("depth") + F.col("w")).alias("depth"))
        met = met if waiting is None else met.unionByName(waiting)
        step = written(met.groupBy("child").agg(F.sum("k").alias("k"), F.max("depth").alias("depth")).join(merges, "child"), "waiting")
        # a node is ready once all its parents are
        front = step.filter(F.col("k") == F.col("n_parents")).select(F.col("child").alias("n"), "depth")
        if front.isEmpty():
            along = chains.join(done.select(F.col("n").alias("anchor"), "depth"), "anchor").select("n", (F.col("depth") + F.col("steps")).alias("depth"))
            found = done.unionByName(along).select(F.col("n").alias(node), F.col("depth").cast("int").alias("depth"))
            return nodes.select(node).join(found, node, "left")
        waiting = step.filter(F.col("k") < F.col("n_parents")).select("child", "k", "depth")
        done = done.unionByName(front)
    raise RuntimeError(f"some path is longer than {most} steps")


def summary(nodes: DataFrame, edges: DataFrame, evidence: DataFrame | None = None, node: str = "node") -> DataFrame:
    """One row: nodes, roots, leaves, largest depth, linked hypotheses."""
    one = lambda d, n: d.agg(F.count("*").alias(n))
    out = one(nodes, "n_nodes").crossJoin(one(roots(nodes, edges, node), "n_roots")).crossJoin(one(leaves(nodes, edges, node), "n_leaves"))
    out = out.crossJoin(depths(nodes, edges, node).agg(F.max("depth").alias("max_depth")))
    if evidence is None:
        return out
    linked = evidence.join(nodes.select(F.col(node).alias("entry_id")), "entry_id", "left_semi")
    return out.crossJoin(linked.agg(F.countDistinct("hypothesis_id").alias("n_hypotheses")))


def evidence_with_steps(evidence: DataFrame, log: DataFrame) -> DataFrame:
    """Evidence with its step's query and summary (K30); a missing step leaves them null and is an integrity error."""
    return evidence.join(log.select("entry_id", "query", "summary"), "entry_id", "left")


def append_log(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with further entries (K33); ids already there are left as they are."""
    return log.unionByName(entries.select(log.columns).join(log.select("entry_id"), "entry_id", "left_anti"))
