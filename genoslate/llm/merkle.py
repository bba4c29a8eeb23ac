"""Merkle manifest of a dataset: one tree per source, one over the sources, with nested-interval labels.

1. A leaf is the SHA-256 of a row's fields, each with its length, so that no two rows read alike. Leaves are written once,
   sorted by range partitions, and numbered within their source by the sizes of the ranges before: no source is sorted in one task.
2. Every node carries the interval of leaf ranks that it covers. Runs of ``fan`` nodes become their parent, ``BAND`` levels in
   one grouping: a bucket of that many levels is one row, which holds its nodes by level. A tree of n leaves takes log(n) / BAND
   groupings, each of fan**BAND times fewer rows. The source's last node is its subroot; the tree over the subroots is built alike.
3. From the top down, buckets are joined with the buckets above them by (source, bucket), where the interval above has to
   contain the one below, and take over the way to the root. Within a bucket, a node's ancestors are those that contain it, and its siblings
   are what its parent's interval holds besides its own.

A leaf's ``path`` lists, level by level up to the root, the digests of the siblings to the left and to the right. ``fold`` recomputes the root from any leaf
digest and such a path, and ``nodes`` lists all nodes with their intervals.

Defined cases: a null field counts as ``-``; rows with a null id come first in their source, equal ids are ordered by their leaf, and equal rows are leaves of
their own; a null source is a source, before all others; an empty table gives an empty manifest; only the named fields are read, so other
columns don't matter, and ``carry`` may not be named like an output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels that one bucket holds.
FAN = 3
BAND = 3


def digest(parts: Column) -> Column:
    """Lowercase hex SHA-256 of a string."""
    return F.sha2(parts.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """The leaf of a row: each field as ``-`` if null, else its UTF-8 length, a colon and its value."""
    text = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def _ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``at`` (rank in the group, from 0) and ``n`` (its size), by range partitions."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, F.asc(group), *order).sortWithinPartitions(F.asc(group), *order)
    # a row's number is its partition and its place there; written, so that every later step sees the same cuts
    ranged = common.written(ranged.withColumn("__at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("__at", 33)
    per = ranged.groupBy(group, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    w = W.partitionBy(group)
    before = F.coalesce(F.sum("__rows").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col(group).alias("__g"), "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(w).alias("n"))
    joined = ranged.join(per, (F.col(group) == F.col("__g")) & (part == F.col("__part")))
    return joined.withColumn("at", F.col("__at") + F.col("__shift")).drop("__at", "__g", "__part", "__shift")


def _depth(n: Column, fan: int) -> Column:
    """Levels above ``n`` leaves: the least k with fan**k >= n."""
    powers = [fan**k for k in range(64) if fan**k < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


def _parents(children: Column, fan: int) -> Column:
    """The nodes (lo, hi, digest) above the nodes ``children``, in order."""
    run = lambda i: F.slice(children, i * fan + 1, fan)
    count = F.ceil(F.size(children) / F.lit(fan)).cast("int")

    def parent(i: Column) -> Column:
        own = run(i)
        return F.struct(
            F.element_at(own, 1)["lo"].alias("lo"), F.element_at(own, -1)["hi"].alias("hi"), digest(F.array_join(F.transform(own, lambda x: x["digest"]), "")).alias("digest")
        )

    return F.transform(F.sequence(F.lit(0), count - 1), parent)


def _bands(leaves: DataFrame, fan: int, payload: list[str]) -> list[DataFrame]:
    """Buckets of BAND levels from the leaves (g, at, n, digest, payload) up: (g, bucket, n, depth, lo, hi, level0, level1, ...).

    Nodes of a level are (lo, hi, digest) in order; those of level0 of the first band also have the payload. Levels above a source's last are null.
    """
    wide = fan**BAND
    most = leaves.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    nodes = leaves.select("g", "at", "n", _depth(F.col("n"), fan).alias("depth"), F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "digest", *payload).alias("node"))
    scale = 1
    while True:
        left = F.col("depth") - BAND * len(out)  # levels that are still to come
        taken = nodes if not out else nodes.filter(left > 0)
        row = taken.groupBy("g", "n", "depth", F.expr(f"at div {wide}").alias("bucket")).agg(F.array_sort(F.collect_list("node")).alias("level0"))
        for k in range(BAND):
            row = row.withColumn(f"level{k + 1}", F.when(left > k, _parents(F.col(f"level{k}"), fan)))
        ends = F.element_at("level0", 1)["lo"].alias("lo"), F.element_at("level0", -1)["hi"].alias("hi")
        band = common.written(row.select("g", "bucket", "n", "depth", *ends, *[f"level{k}" for k in range(BAND + 1)]), "merkle-band")
        out.append(band)
        scale *= wide
        if most <= scale:
            return out
        nodes = band.select("g", F.col("bucket").alias("at"), "n", "depth", F.element_at(f"level{BAND}", 1).alias("node"))


def _top(bands: list[DataFrame]) -> DataFrame:
    """(g, digest): the last node of each group."""
    found = []
    for r, band in enumerate(bands):
        last = F.coalesce(*[F.when(F.col("depth") == BAND * r + k, F.col(f"level{k}")[0]["digest"]) for k in range(BAND + 1)])
        here = (F.col("depth") > BAND * r) if r else F.lit(True)
        found.append(band.filter(here & (F.col("depth") <= BAND * (r + 1))).select("g", last.alias("digest")))
    return reduce(DataFrame.unionByName, found)


def _steps(lo: str, hi: str) -> tuple[list[Column], Column]:
    """Columns for the ancestors of the node [lo, hi) in its bucket, and its path there, by these: siblings left and right of it and of each ancestor.

    An ancestor contains the node; what its parent's interval holds besides itself are siblings.
    """
    low, high = F.col(lo), F.col(hi)
    around = lambda level: F.element_at(F.filter(level, lambda x: (x["lo"] <= low) & (x["hi"] >= high)), 1)
    text = lambda level, held: F.array_join(F.transform(F.filter(level, held), lambda x: x["digest"]), "")

    def step(k: int) -> Column:
        level, own, parent = F.col(f"level{k}"), F.col(f"__own{k}"), F.col(f"__own{k + 1}")
        left = text(level, lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= own["lo"]))
        right = text(level, lambda x: (x["hi"] <= parent["hi"]) & (x["lo"] >= own["hi"]))
        return F.when(parent.isNotNull(), F.struct(left.alias("left"), right.alias("right")))

    return [around(F.col(f"level{k}")).alias(f"__own{k}") for k in range(BAND + 1)], F.filter(F.array(*map(step, range(BAND))), lambda s: s.isNotNull())


def _paths(bands: list[DataFrame], tails: DataFrame, payload: list[str]) -> DataFrame:
    """(g, lo, hi, digest, payload, path, and the other columns of ``tails``) of every leaf; ``tails``: (g, path, ...) above each group's last node."""
    more = [c for c in tails.columns if c not in ("g", "path")]
    over = None
    for r in range(len(bands) - 1, -1, -1):
        band = bands[r]
        top = (F.col("depth") <= BAND * (r + 1)) if r else (F.col("depth") <= BAND)
        held = band.filter(top).join(tails, "g")
        if over is not None:
            above = over.select(F.col("g").alias("__g"), F.col("at").alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "path", *more)
            inside = (F.col("g") == F.col("__g")) & (F.col("bucket") == F.col("__bucket")) & (F.col("__lo") <= F.col("lo")) & (F.col("__hi") >= F.col("hi"))
            held = held.unionByName(band.filter(~top).join(above, inside).drop("__g", "__bucket", "__lo", "__hi"))
        each = held.select("*", F.posexplode("level0").alias("__place", "__node"))
        own, steps = _steps("__lo", "__hi")
        each = each.withColumns({"__lo": F.col("__node.lo"), "__hi": F.col("__node.hi"), "at": F.col("bucket") * FAN**BAND + F.col("__place")})
        path = F.concat(steps, F.col("path")).alias("path")
        fields = payload if r == 0 else []
        over = each.select("*", *own).select("g", "at", F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.col("__node.digest").alias("digest"), *[F.col(f"__node.{p}").alias(p) for p in fields], path, *more)
    return over.drop("at")


def _trees(docs: DataFrame, fields: tuple[str, ...], group: str, order: str, carry: dict[str, Column]) -> tuple[list[DataFrame], list[DataFrame]]:
    """The bands of the trees of all sources, and of the tree over their subroots. A source is told by ``g``, a string in their order."""
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    taken = [F.col(order).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"), *[c.alias(k) for k, c in carry.items()]]
    leaves = common.written(docs.select(g.alias("g"), *taken), "merkle-leaves")
    ranked = _ranked(leaves, "g", [F.asc_nulls_first("id"), F.asc("digest")])
    bands = _bands(ranked, FAN, ["id", *carry])
    tops = _top(bands).withColumnRenamed("g", "source")
    subroots = _bands(_ranked(tops.withColumn("g", F.lit("")), "g", [F.asc("source")]), FAN, ["source"])
    return bands, subroots


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, lo, hi, subroot, root, path, and ``carry``) of every row: its leaf, the interval of its rank in its source, and its path to the root.

    ``carry``: further columns, of ``docs``, that go along with the leaf.
    """
    carry = carry or {}
    bands, subroots = _trees(docs, fields, group, order, carry)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    root = _top(subroots).select("g", empty.alias("path"), F.col("digest").alias("root"))
    tails = _paths(subroots, root, ["source"]).select(F.col("source").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    tails = common.written(tails, "merkle-subroots")
    return _paths(bands, tails, ["id", *carry]).withColumnRenamed("digest", "leaf").drop("g")


def nodes(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """(source, level, lo, hi, digest) of every node below and including the subroots: the interval of leaf ranks that it covers."""
    bands, _ = _trees(docs, fields, group, order, {})
    found = []
    for r, band in enumerate(bands):
        for k in range(BAND + 1):
            if k or not r:  # a band's lowest nodes are the highest of the band below
                found.append(band.filter(F.col(f"level{k}").isNotNull()).select("g", F.lit(BAND * r + k).alias("level"), F.explode(F.transform(f"level{k}", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))).alias("x")))
    every = reduce(DataFrame.unionByName, found)
    return every.select(F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias(group), "level", "x.*")


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def verify(manifested: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``manifested`` with folded_root, from the digests in column ``leaf``, and verified: whether that is the root."""
    folded = manifested.withColumn("folded_root", fold(F.col(leaf), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
