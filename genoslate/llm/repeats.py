"""What the two substring operators share: synchronised phrases of token sequences, and their occurrences in Spark.

A *window* is ``width`` consecutive tokens of one document. Within each window, the ``gram`` tokens with the smallest
rolling hash (leftmost on ties) are its *trigger*; equal windows have equal triggers at equal places. A *phrase* is the
run of windows that share one trigger: its tokens, the trigger's place in it and its number of windows. So the phrases
of a document overlap and hold every window exactly once, and a window occurs twice only in phrases whose triggers are
equal. About 2 / (width - gram + 2) of all positions are triggers.

Rows of the phrase table: key (of the row), ord (order of the document), trigger, phrase (two xxh3 digests of 64 bits, of the
trigger's tokens and of the whole phrase), lo (first token), n (windows), off (trigger - lo), reps. Where a text repeats itself, equal phrases
follow each other at a distance of n; such a run is one row, with their number in reps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Windows of a piece: a longer document is cut into overlapping ones.
PIECE = common.PIECE
#: Rows that a task remembers.
REMEMBERED = 1 << 18
PLACE = np.uint64((1 << 24) - 1)


def slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` neighbours."""
    span = 1
    while 2 * span <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def phrases(x: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """The phrases of token sequences laid end to end: seq (which), lo, n, off, trigger, phrase."""
    n = len(x)
    if n < width:
        empty = np.zeros(0, np.int64)
        return {"seq": empty, "lo": empty, "n": empty, "off": empty, "reps": empty, "trigger": empty.view(np.uint64), "phrase": empty.view(np.uint64)}
    p, inverse = common.prefix_sums(x)
    h = common.mix64((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    place = (slide_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & PLACE).astype(np.int64)
    ends = np.cumsum(lengths)
    seq = np.repeat(np.arange(len(lengths)), lengths)[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= ends[seq])
    trigger = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo, count = at[first], np.diff(np.append(first, len(at)))
    t = trigger[first]
    shape = (t - lo) << 32 | count
    starts = ends - lengths
    # the rolling hash only chooses triggers; names are hashes of all tokens
    held = memoryview(np.ascontiguousarray(x)).cast("B")
    named = lambda a, b, seeds: np.fromiter((xxhash.xxh3_64_intdigest(held[i:j], s) for i, j, s in zip((8 * a).tolist(), (8 * b).tolist(), seeds, strict=True)), np.uint64, len(a))
    name, head_name = named(lo, lo + count - 1 + width, shape.tolist()), named(t, t + gram, [gram] * len(t))
    fresh = np.ones(len(lo), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (head_name[1:] != head_name[:-1]) | (lo[1:] - lo[:-1] != count[:-1]) | (seq[lo][1:] != seq[lo][:-1])
    head = np.flatnonzero(fresh)
    reps = np.diff(np.append(head, len(lo)))
    lo, count, t = lo[head], count[head], t[head]
    return {"seq": seq[lo], "lo": lo - starts[seq[lo]], "n": count, "off": t - lo, "reps": reps, "trigger": head_name[head], "phrase": name[head]}


def phrase_table(docs: DataFrame, tokens: Callable[[list[bytes]], list[np.ndarray]], width: int, gram: int, text: str, doc: str, limit: int) -> DataFrame:
    """The phrases of every whole text."""

    def run(texts: list[bytes], part: pa.RecordBatch) -> dict:
        owner, offset, seqs = [], [], []
        for i, x in enumerate(tokens(texts)):
            for s in range(0, max(1, len(x)), PIECE):
                owner.append(i)
                offset.append(s)
                seqs.append(x[s : s + PIECE + width - 1])
        found = []
        start = 0
        while start < len(seqs):  # neighbours together, up to a piece
            stop, total = start, 0
            while stop < len(seqs) and (stop == start or total + len(seqs[stop]) <= PIECE):
                total += len(seqs[stop])
                stop += 1
            f = phrases(np.concatenate(seqs[start:stop]), np.array([len(s) for s in seqs[start:stop]]), width, gram)
            f["seq"] = f["seq"] + start
            found.append(f)
            start = stop
        f = {k: np.concatenate([x[k] for x in found]) for k in found[0]}
        rows = pa.array(np.array(owner, np.int64)[f["seq"]])
        return {
            "key": part.column(0).take(rows),
            "ord": part.column(1).take(rows),
            "trigger": f["trigger"].view(np.int64),
            "phrase": f["phrase"].view(np.int64),
            "lo": (f["lo"] + np.array(offset, np.int64)[f["seq"]]).astype(np.int32),
            "n": f["n"].astype(np.int32),
            "off": f["off"].astype(np.int32),
            "reps": f["reps"].astype(np.int32),
        }

    keyed = docs.select(common.row_key(text, doc).alias("key"), order_of(doc).alias("ord"), text)
    return common.reduce_text(keyed, "key long, ord long, trigger long, phrase long, lo int, n int, off int, reps int", run, text, ["key", "ord"], limit)


def order_of(doc: str) -> Column:
    """A document's place among the others; those without an id come last."""
    return F.coalesce(F.col(doc).cast("long"), F.lit((1 << 63) - 1))


def shared_phrases(table: Callable[[], DataFrame], repeated: Column) -> DataFrame:
    """Phrases whose trigger is ``repeated`` (a condition on n_all, first, last), as a table in the shared folder.

    The phrases are made twice, which costs less than keeping all of them.
    """
    counts = table().groupBy("trigger").agg(F.sum("reps").alias("n_all"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    # written first, so that both sides of the join are exchanges and Spark may split a skewed trigger
    twice = common.written(counts.filter(repeated).select("trigger"), "shared-triggers")
    return common.written(table().join(twice.hint("shuffle_hash"), "trigger", "left_semi"), "shared-phrases")


def phrase_kinds(shared: DataFrame) -> DataFrame:
    """One row per distinct phrase: copies, first and last document, and one place where it stands."""
    at = F.struct("ord", "key", "lo", "n", "off")
    kinds = shared.groupBy("trigger", "phrase").agg(F.sum("reps").alias("copies"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.min(at).alias("at"))
    return common.written(kinds.select("trigger", "phrase", "copies", "first", "last", "at.*"), "phrase-kinds")


def several(kinds: DataFrame, enough: Column) -> DataFrame:
    """``kinds`` of triggers with several phrases that are ``enough``: the part of the dictionary that has to be looked into."""
    sizes = kinds.groupBy("trigger").agg(F.count("*").alias("variants"), F.min("first").alias("f"), F.max("last").alias("l"))
    some = sizes.filter((F.col("variants") > 1) & enough).select("trigger")
    return common.written(kinds.join(some.hint("shuffle_hash"), "trigger"), "dictionary")


def contexts(docs: DataFrame, kinds: DataFrame, cut: Callable[[bytes, list[dict]], list[dict]], text: str, doc: str, extra: str) -> DataFrame:
    """``kinds`` (trigger, phrase, copies, first, n, group) with what ``cut`` (one dict of ``extra`` per phrase) reads
    from the document where each stands."""
    fields = ("trigger", "phrase", "copies", "first", "lo", "n", "off", "group")
    wanted = kinds.groupBy("key", "ord").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    keyed = docs.select(common.row_key(text, doc).alias("key"), order_of(doc).alias("ord"), F.col(text).alias("text"))
    joined = keyed.join(wanted.hint("shuffle_hash"), ["key", "ord"])
    names = [x.split()[0] for x in extra.split(", ")]
    seen: set[int] = set()

    def run(texts: list[bytes], part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in (*fields, *names)}
        for raw, rows, key in zip(texts, part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if key in seen:  # of equal rows, which meet in one task, one is enough to cut from; what is left over, the groups allow for
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            for k in fields:
                out[k] += [r[k] for r in rows]
            for made in cut(raw, rows):
                for k in names:
                    out[k].append(made[k])
        return out

    schema = f"trigger long, phrase long, copies long, first long, n int, group long, {extra}"
    return common.reduce_text(joined, schema, run, "text", ["wanted", "key"])


def dealt(bodies: DataFrame, total: int, task_bytes: int) -> DataFrame:
    """``bodies`` with ``part``: whole groups together, and phrases without a group (null) anywhere."""
    parts = max(64, -(-total // task_bytes))
    return bodies.withColumn("part", F.pmod(F.xxhash64(F.coalesce("group", F.xxhash64("trigger", "phrase"))), F.lit(parts)))


LEAF = "trigger long, phrase long, from int, to int, a long, b long, copies long, first long"


def settle(leaves: DataFrame, rule: Column) -> DataFrame:
    """(trigger, phrase, from, to): window ranges that repeat.

    Rows of ``leaves`` without names are settled. The others, from split triggers, are suffixes named (a, b): ``rule``
    is asked of all groups' copies (``n_all``) and first document (``all_first``) of that name.
    """
    done = leaves.filter(F.col("a").isNull()).select("trigger", "phrase", "from", "to")
    open_ = leaves.filter(F.col("a").isNotNull())
    names = open_.groupBy("a", "b").agg(F.sum("copies").alias("n_all"), F.min("first").alias("all_first"))
    asked = open_.filter(F.col("phrase").isNotNull()).join(names, ["a", "b"]).filter(rule)
    return done.unionByName(asked.select("trigger", "phrase", "from", "to"))


def covered(docs: DataFrame, ranges: DataFrame, text: str, doc: str) -> tuple[DataFrame, str]:
    """``docs`` with the token ranges (from, to) of each row, overlapping and in any order, and that column's name."""
    key, order, held = (common.fresh(docs.columns, x) for x in ("__key", "__ord", "__ranges"))
    gathered = ranges.groupBy(F.col("key").alias(key), F.col("ord").alias(order)).agg(F.collect_set(F.struct("from", "to")).alias(held))
    keyed = docs.withColumn(key, common.row_key(text, doc)).withColumn(order, order_of(doc))
    return keyed.join(gathered.hint("shuffle_hash"), [key, order], "left").drop(key, order), held


def places(shared: DataFrame, verdict: DataFrame, width: int, holds: Column | None = None) -> DataFrame:
    """(key, ord, from, to): the token ranges of ``verdict`` (trigger, phrase, from, to: windows) wherever the phrases
    stand and ``holds`` is met."""
    held = shared.join(verdict.hint("shuffle_hash"), ["trigger", "phrase"])
    held = held if holds is None else held.filter(holds)
    whole = (F.col("from") == 0) & (F.col("to") == F.col("n"))
    # a whole run of equal phrases is one range
    step = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("reps") - 1))
    length = F.when(whole, F.col("n") * F.col("reps")).otherwise(F.col("to"))
    one = held.withColumn("length", length).withColumn("k", F.explode(step))
    at = F.col("lo") + F.col("k") * F.col("n")
    return one.select("key", "ord", (at + F.col("from")).alias("from"), (at + F.col("length") - 1 + width).alias("to"))


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (from, to) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def mark(n: int, ranges: list[dict] | None) -> np.ndarray | None:
    """True for each of ``n`` tokens that some range covers; None if none is."""
    if not ranges:
        return None
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, [r["from"] for r in ranges], 1)
    np.add.at(depth, [r["to"] for r in ranges], -1)
    return np.cumsum(depth[:-1]) > 0


def rewrite(joined: DataFrame, held: str, keep: list[str], outputs: str, fn: Callable[[bytes, list[dict] | None], tuple], text: str) -> DataFrame:
    """``keep`` columns plus ``outputs``, made by ``fn(whole text, ranges of the column held)``; the text comes back as its result says."""
    made = joined.sparkSession.createDataFrame([], outputs).schema
    names = [c for c in keep if c not in made.names]
    schema = joined.select(*names).schema
    for field in made:
        schema = schema.add(field)
    types = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, len(names) + 1):
                rows = [fn(t, r) for t, r in zip(part.column(len(names) + 1).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[:-2] + arrays, names=names + made.names)

    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias(common.fresh(joined.columns, common.TEXT))
    return joined.select(*names, held, raw).mapInArrow(run, schema)
