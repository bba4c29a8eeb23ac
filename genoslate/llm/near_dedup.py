"""MinHash near-dedup by chosen-path set similarity join.

A document is the set of its distinct word shingles. In each of several independent trees, documents are branched by
minwise tokens: a node holds the documents that agree in the smallest token of the first hash, then of the second,
and so on. A node of at most ``leaf`` documents is a leaf at once; after ``depth`` levels one of at most ``node`` is. A larger
node branches on by two tokens a level, each chosen by the node, as long as that makes it smaller: what doesn't shrink any more
agrees in most tokens, and is compared exhaustively in blocks. Two sets of similarity s share a node of depth d with
probability s**d, and two tokens a level keep what is above one half, so ``trees`` follows from the recall asked for at the threshold.

1. Documents of equal sets are one class (by a 128-bit fingerprint and the size), and its first stands for it.
2. Leaves are compared exhaustively by minwise tokens, which estimate the similarity: pairs more than five standard deviations
   short of the threshold go. Of the others, a leaf gives only links that connect what they connect, at most one a document.
3. What these links connect is a hub, and every candidate pair lies within one. Links are confirmed on full sets, a hub
   at a time: one document is compared with all of its block, then every document which isn't yet joined to the main component, until
   all that were never compared are connected. So near copies cost few comparisons, and no link between components is lost.
4. Nodes and hubs beyond a block of fixed size are cut into chunks. Only what lies outside a group's main component after that is
   compared with the other chunks (see ``_links``), so a large group of near copies costs about its size, not its square.

Defined cases: null, empty and wordless texts have empty sets and link with nothing; rows of one id are one document; rows
without an id are documents by their text, and are kept unless they reach one with an id; an empty table gives an
empty table; input columns named like an output are replaced, all others come back as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
DEPTH = 3
LEAF = 32
RECALL = 0.99999
#: Documents of a node compared in one block; shingles of a hub held in one block; rows and shingles of a task.
NODE = 4096
BLOCK_SHINGLES = 1 << 20
TASK_ROWS = 200_000
TASK_SHINGLES = 4 << 20
#: Rows of a large group that each of its chunks is compared with.
PIVOTS = 4
#: A node goes on branching while it has at most this share of its parent's documents.
SHRINK = 0.7


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    out = []
    for w in common.word_hashes(texts, lower=True):
        k = min(size, len(w))
        if k == 0:
            out.append(w)
            continue
        h = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
        out.append(np.unique(h))
    return out


def tree_count(depth: int, threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def _factors(n: int) -> np.ndarray:
    return common.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signatures(docs: DataFrame, size: int, trees: int, depth: int, text: str) -> DataFrame:
    """``docs`` (key, v) with n (set size), fa, fb (fingerprint) and sig (minwise tokens, tree by tree)."""
    factors = _factors(trees * depth)

    def run(texts: list[bytes]) -> list[pa.Array]:
        sets = shingle_sets(texts, size)
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        sig = [None] * len(sets)
        fa, fb = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        if len(full):
            u = np.concatenate([sets[i] for i in full])
            starts = np.cumsum(n[full]) - n[full]
            least = np.stack([np.minimum.reduceat(u * f, starts) for f in factors], axis=1)
            fa[full] = common.mix64(np.add.reduceat(u, starts))
            fb[full] = common.mix64(np.add.reduceat(common.mix64(u), starts))
            for i, row in zip(full.tolist(), least, strict=True):
                sig[i] = row.tobytes()
        return [pa.array(n), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), pa.array(sig, pa.binary())]

    return common.map_text(docs, "n long, fa long, fb long, sig binary", run, text, keep=["key", "v"])


def _paths(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(v, p1..pd): the nodes of each class in each tree, level by level."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, trees * depth)
            at = np.repeat(np.arange(len(sig)), trees)
            node = np.tile(np.arange(1, trees + 1, dtype=np.uint64), len(sig))
            levels = []
            for d in range(depth):
                node = common.mix64(node * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, d::depth].reshape(-1))
                levels.append(node.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), *map(pa.array, levels)],
                names=["v", *[f"p{d + 1}" for d in range(depth)]],
            )

    schema = "v long, " + ", ".join(f"p{d + 1} long" for d in range(depth))
    return classes.select("v", "n", "sig").mapInArrow(run, schema)


def _sketches(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(v, sketch): two bytes of each minwise token of a class."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, trees * depth)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sig.astype(np.uint16)], pa.binary())], names=["v", "sketch"])

    return classes.select("v", "sig").mapInArrow(run, "v long, sketch binary")


def _leaves(paths: DataFrame, sketches: DataFrame, depth: int, leaf: int, width: int, most: int) -> DataFrame:
    """(node, v, sketch, m): each class at its leaf in each tree; nodes with one document are left out.

    Sketches join once the rows of nodes with one document are gone, which are most.
    """
    out = None
    rest = paths.withColumn("node", F.col("p1"))
    for d in range(1, depth + 1):
        sizes = rest.groupBy(F.col(f"p{d}").alias("node")).agg(F.count("*").alias("m")).filter("m > 1")
        here = rest.drop("node").withColumn("node", F.col(f"p{d}")).join(sizes, "node")
        small = here.filter(F.col("m") <= (leaf if d < depth else most)).select("node", "v", "m")
        out = small if out is None else out.unionByName(small)
        rest = common.written(here.filter(F.col("m") > (leaf if d < depth else most)).drop("node"), f"branch-{d}")
        if d < depth:
            rest = rest.drop("m").withColumn("node", F.col(f"p{d + 1}"))
    out = out.join(sketches, "v").select("node", "v", "sketch", "m")
    rest = rest.select(F.col(f"p{depth}").alias("node"), "v", "m").join(sketches, "v").select("node", "v", "sketch", "m")
    level = depth
    while not rest.isEmpty():  # each level has SHRINK of the documents a node at most
        level += 1
        token = lambda j: (F.pmod(F.xxhash64("node", F.lit(level), j), F.lit(width)) * 2 + 1).cast("int")  # noqa: E731, B023
        child = rest.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", token(F.col("j")))
        child = child.select(F.xxhash64("node", "j", F.substring("sketch", F.col("at"), F.lit(2))).alias("node"), "v", "sketch", F.col("m").alias("above"))
        child = common.written(child, f"branch-{level}")
        sizes = child.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
        child = child.join(sizes, "node")
        done = (F.col("m") <= most) | (F.col("m") > F.col("above") * SHRINK)
        out = out.unionByName(child.filter(done).drop("above"))
        rest = common.written(child.filter(~done).drop("above"), f"large-{level}")
    return common.written(out, "leaves")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position each of ``n`` reaches by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _probe(n: int, hits, main: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions that connect what all pairs would, where ``hits(x)`` gives the positions linked with x; those in
    ``main`` are known to be connected.

    A position that was compared with all others is probed. The result is exact once all positions never probed are
    connected: a pair across components then has a probed member.
    """
    root = np.arange(n)
    if main.any():
        root[main] = int(main.argmax())
    probed = np.zeros(n, bool)
    links: list[tuple[int, int]] = []
    x = int((~main).argmax()) if n else 0
    while n and not main.all():
        probed[x] = True
        hit = hits(x)
        fresh = hit[root[hit] != root[x]]
        for r in np.unique(root[fresh]).tolist():
            links.append((x, int(fresh[root[fresh] == r][0])))
            root[root == r] = root[x]
        open_ = np.flatnonzero(~probed)
        if not len(open_):
            break
        names, count = np.unique(root[open_], return_counts=True)
        outside = open_[root[open_] != names[count.argmax()]]
        if not len(outside):
            break
        x = int(outside[0])
    return links


def alike(node: np.ndarray, sketch: np.ndarray, least: int, main: np.ndarray | None = None, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) that connect what all pairs of one node with ``least`` like tokens connect; ``node`` is sorted, and rows of a
    node that are in ``main`` are known to be connected."""
    main = np.zeros(len(node), bool) if main is None else main
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(node)))
    found_a, found_b = [], []
    small = np.repeat(size <= leaf, size)
    left = np.flatnonzero(small[:-1] & (node[1:] == node[:-1])) if len(node) > 1 else np.zeros(0, np.int64)
    step = 1
    while len(left):  # neighbours at distance 1, 2, ... within small nodes, all of them at once
        for at in range(0, len(left), 1 << 16):
            k = left[at : at + (1 << 16)]
            k = k[(sketch[k] == sketch[k + step]).sum(axis=1) >= least]
            found_a.append(k)
            found_b.append(k + step)
        step += 1
        left = left[left + step < len(node)]
        left = left[node[left] == node[left + step]]
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    root = _joined(len(node), a, b)
    tied = np.flatnonzero(root != np.arange(len(node)))
    a, b = [root[tied]], [tied]
    for f, n in zip(first[size > leaf].tolist(), size[size > leaf].tolist(), strict=True):
        own = sketch[f : f + n]
        links = _probe(n, lambda x, own=own: np.flatnonzero((own == own[x]).sum(axis=1) >= least), main[f : f + n])
        a.append(f + np.array([x for x, _ in links], np.int64))
        b.append(f + np.array([y for _, y in links], np.int64))
    return np.concatenate(a), np.concatenate(b)


def _links(rows: DataFrame, capacity: int, task: int, compare: Callable, label: str) -> DataFrame:
    """(a, b): links that connect what all pairs of rows of one group connect. ``rows``: g, v, w (weight), total (of the group), payload.

    A group that fits ``capacity`` is one block. A larger one is cut into chunks, each compared by itself together with a few rows of the
    group, its pivots. The rows that their chunks connect with the same pivot, the best one, are the group's main part; what is left
    outside is then compared with every chunk. ``compare(block, payload, main)`` gives positions of links, all blocks of a
    task at once; rows of a block that are in ``main`` are known to be connected.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "v", "pivot"], ascending=[True, True, False], kind="stable").drop_duplicates(["block", "v"])
        v, block, pivot = (pdf[c].to_numpy(np.int64) for c in ("v", "block", "pivot"))
        a, b = compare(block, pdf["payload"].tolist(), pdf["main"].to_numpy(bool))
        pairs = np.unique(np.stack([np.minimum(v[a], v[b]), np.maximum(v[a], v[b])], axis=1), axis=0)
        # which pivots each row of a chunk is connected with
        root, own = _joined(len(v), a, b), np.unique(block, return_inverse=True)[1] if len(v) else block
        mask = np.zeros(len(v), np.int64)
        for i in range(PIVOTS):
            at = np.flatnonzero(pivot == i)
            if len(at):
                of = np.full(int(own.max()) + 1, -1, np.int64)
                of[own[at]] = root[at]
                mask |= (root == of[own]).astype(np.int64) << i
        marked = np.flatnonzero(np.isin(own, own[pivot >= 0]))
        nothing = np.zeros(len(marked), np.int64)
        return pd.DataFrame({"a": np.r_[pairs[:, 0], v[marked]], "b": np.r_[pairs[:, 1], nothing], "mask": np.r_[np.full(len(pairs), -1), mask[marked]]})

    def compared(dealt: DataFrame, amount: float) -> DataFrame:
        buckets = max(64, -(-int(amount or 0) // task))
        some = dealt.select(F.pmod("block", F.lit(buckets)).alias("bucket"), "block", "v", "payload", "main", "pivot")
        return common.written(some.groupBy("bucket").applyInPandas(run, "a long, b long, mask long"), label)

    n = F.when(F.col("total") > capacity, F.ceil(F.col("total") * 2 / capacity)).otherwise(1).cast("int")
    cut = rows.withColumn("n", n).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("n")).cast("int"))
    large = cut.filter("n > 1")
    block, no = F.xxhash64("g", "chunk").alias("block"), F.lit(False).alias("main")
    first = cut.select(block, "v", "payload", no, F.lit(-1).alias("pivot"))
    weight = rows.agg(F.sum("w")).first()[0]
    if large.isEmpty():
        return compared(first, weight).filter("mask < 0").select("a", "b").distinct()
    some = lambda i: F.min_by("v", F.xxhash64(F.lit(i), "v"))
    pivots = large.groupBy("g").agg(F.array_distinct(F.array(F.min("v"), *[some(i) for i in range(1, PIVOTS)])).alias("p"))
    every = large.join(pivots.select("g", F.posexplode("p").alias("pivot", "v")), ["g", "v"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = compared(first.unionByName(every.select(block, "v", "payload", no, "pivot")), weight)
    marks = found.filter("mask >= 0").groupBy(F.col("a").alias("v")).agg(F.bit_or("mask").alias("mask"))
    placed = large.join(marks, "v")
    bit = lambda i: F.shiftright("mask", i).bitwiseAND(F.lit(1))
    sums = F.array(*[F.sum(bit(i)) for i in range(PIVOTS)])
    best = placed.groupBy("g").agg(sums.alias("s")).select("g", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("best"))
    marked = placed.join(best, "g").withColumn("main", F.expr("shiftright(mask, best) & 1") == 1)
    marked = common.written(marked.select("g", "v", "w", "n", "chunk", "payload", "main"), f"{label}-marked")
    left = marked.filter(~F.col("main")).groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.sum("w") * 2 / capacity)).cast("int").alias("r"))
    marked = marked.join(left, "g")
    outside = marked.filter(~F.col("main")).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "v"), F.col("r")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    whole = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    cells = [F.xxhash64("g", "part", "chunk").alias("block"), "v", "payload", "main", F.lit(-1).alias("pivot")]
    amount = marked.agg(F.sum(F.col("w") * F.when(F.col("main"), F.col("r")).otherwise(F.col("r") + F.col("n")))).first()[0]
    rest = compared(outside.select(*cells).unionByName(whole.select(*cells)), amount)
    return found.unionByName(rest).filter("mask < 0").select("a", "b").distinct()


def _candidates(leaves: DataFrame, width: int, least: int, most: int) -> DataFrame:
    """Links that connect what all pairs of like sketches in the leaves connect."""

    def compare(block: np.ndarray, sketches: list[bytes], main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return alike(block, np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, width), least, main)

    rows = leaves.select(F.col("node").alias("g"), "v", F.lit(1).cast("long").alias("w"), F.col("m").alias("total"), F.col("sketch").alias("payload"))
    return _links(rows, most, TASK_ROWS, compare, "near-candidates")


def connect(sets: list[np.ndarray], share: int, main: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect all sets whose inner * 1e6 >= share * union, without comparing all pairs."""
    main = np.zeros(len(sets), bool) if main is None else main
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32) if len(row) else row
    start = np.cumsum(size) - size
    mark = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)

    def hits(x: int) -> np.ndarray:
        own = token[start[x] : start[x] + size[x]]
        mark[own] = True
        inner = np.bincount(row[mark[token]], minlength=len(sets))
        mark[own] = False
        return np.flatnonzero(inner * 1_000_000 >= share * (size + size[x] - inner))

    return _probe(len(sets), hits, main)


def _confirm(texts: DataFrame, hubs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links that connect each hub's documents as all pairs of them would: inner / union >= threshold, in whole numbers."""
    share = round(threshold * 1_000_000)

    def compare(block: np.ndarray, found: list[bytes], main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() if len(block) else []
        out = [(p + x, p + y) for p, q in zip(edge, [*edge[1:], len(block)], strict=True) for x, y in connect(shingle_sets(found[p:q], size), share, main[p:q])]
        both = np.array(out, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    total = hubs.groupBy("hub").agg(F.sum("n").alias("total"))
    rows = texts.join(hubs.select("v", "hub", "n"), "v").join(total, "hub")
    rows = rows.select(F.col("hub").alias("g"), "v", F.col("n").alias("w"), "total", F.col("text").cast("binary").alias("payload"))
    return _links(rows, BLOCK_SHINGLES, TASK_SHINGLES, compare, "near-links")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD,
    depth: int = DEPTH, leaf: int = LEAF, recall: float = RECALL, node: int = NODE,
) -> DataFrame:
    """``docs`` with n_shingles, component_id (smallest id reachable, itself included) and kept."""
    trees = tree_count(depth, threshold, recall)
    width = trees * depth
    # five standard deviations of a binomial count below its mean at the threshold
    least = math.floor(width * threshold - 5 * math.sqrt(width * threshold * (1 - threshold)))
    plain = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    key, vertex = common.fresh(plain, "__key"), common.fresh(plain, "__v")
    keyed = docs.select(*plain).withColumn(key, common.row_key(text, doc)).withColumn(
        vertex, F.coalesce(F.col(doc).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseOR(F.lit(-(1 << 63))))
    )
    own = keyed.select(F.col(key).alias("key"), F.col(vertex).alias("v"), F.col(text).alias("text"))
    sets = common.written(signatures(own, shingle, trees, depth, "text"), "sets")
    classes = sets.filter("n > 0").groupBy("n", "fa", "fb").agg(F.min(F.struct("v", "key", "sig")).alias("r"))
    classes = common.written(classes.select("n", "fa", "fb", "r.*"), "set-classes")
    leaves = _leaves(_paths(classes, trees, depth), _sketches(classes, trees, depth), depth, leaf, width, node)
    hubs = components(_candidates(leaves, width, least, node)).select("v", F.col("root").alias("hub"))
    hubs = hubs.unionByName(hubs.select(F.col("hub").alias("v"), "hub")).distinct()
    hubs = common.written(hubs.join(classes.select("v", "n", "key"), "v").dropDuplicates(["v"]), "hubs")
    stands = hubs.select("v", "key")
    texts = own.join(stands.hint("shuffle_hash"), ["v", "key"], "left_semi")
    texts = common.written(texts.dropDuplicates(["v", "key"]).select("v", "text"), "near-texts")
    roots = components(_confirm(texts, hubs, shingle, threshold))

    member = sets.select("key", "v", F.col("n").alias("n_shingles"), "fa", "fb")
    held = classes.select("n", "fa", "fb", F.col("v").alias("c"))
    member = member.join(held, (F.col("n_shingles") == held["n"]) & (member["fa"] == held["fa"]) & (member["fb"] == held["fb"]), "left")
    member = member.select("key", "v", "n_shingles", F.coalesce("c", "v").alias("c"))
    member = member.join(roots.select(F.col("v").alias("c"), "root"), "c", "left").select("key", "v", "n_shingles", F.coalesce("root", "c").alias("root"))
    member = common.written(member.distinct(), "near-members")
    # rows without an id have negative vertices; the smallest id of a component is its smallest that isn't, so only
    # components with a negative root have to be looked through
    idless = member.filter("root < 0")
    first = idless.groupBy("root").agg(F.min(F.when(F.col("v") >= 0, F.col("v"))).alias("component_id"))
    found = member.filter("root >= 0").select("key", "v", "n_shingles", F.col("root").alias("component_id"))
    found = found.unionByName(idless.join(first, "root").select("key", "v", "n_shingles", "component_id"))
    found = found.withColumnsRenamed({"key": key, "v": vertex})
    out = keyed.join(found, [key, vertex], "left")
    kept = F.when(F.col(vertex) >= 0, F.col(vertex) == F.col("component_id")).otherwise(F.col("component_id").isNull())
    return out.select(*plain, "n_shingles", "component_id", kept.alias("kept"))
