"""Byte substring dedup by prefix-free parsing.

Every byte that a string of ``width`` bytes covers, which also starts anywhere else in the corpus, is removed.

1. Parse: rolling-hash triggers cut each text into overlapping phrases (see ``repeats``). The parse of a text is
   the sequence of its phrases, the dictionary the set of distinct phrases; only phrases whose trigger occurs twice
   can hold a repeated string, and only those are kept.
2. Parse: a phrase that the parse holds twice repeats whole, with all its windows. Counting phrase names (a
   grouping with partial sums) settles that without looking at text.
3. Dictionary: other repeats are between different phrases of the same trigger. Their texts are fetched once per
   distinct phrase and dealt out by trigger to tasks of bounded bytes. A task sorts the suffixes of its phrases by their first ``width``
   bytes (a suffix array by prefix doubling, eight bytes first); windows of one rank are equal, and how often a window occurs is the sum
   of what the parse says of its phrases. Under a trigger whose phrases exceed ``group_bytes``, groups are narrowed by more and more bytes
   around the trigger until they fit; parts of phrases that repeat whole are settled on the way, by a grouping (see ``narrow``).
4. The verdicts on phrases go back to where they stand, and the texts lose the covered bytes.

The order of suffixes is that of a task's triggers. It isn't merged into one order of the corpus, nor is the parse sorted: equal windows share
their trigger, so both would only bring together what already is.

Defined cases: a null or empty text has no bytes and loses none; equal rows repeat each other; an empty table gives an
empty table; very long texts are cut into overlapping pieces for hashing only; rows with a null id are documents too; columns
named like an output are replaced, all others come back as they are.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, repeats, suffix_tree

#: Bytes of a trigger; a slice of texts; bytes of phrases under one trigger; bytes of phrases in a task.
GRAM = 40
SLICE = 1 << 20
GROUP_BYTES = 1 << 20
TASK_BYTES = 2 << 20

_BYTES = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _tokens(texts: list[bytes]) -> list[np.ndarray]:
    return [_BYTES[np.frombuffer(raw, np.uint8)] for raw in texts]


def suffix_ranks(raw: np.ndarray, width: int) -> np.ndarray:
    """The rank of each suffix of ``raw`` by its first ``width`` bytes, in byte order."""
    padded = np.append(raw, np.zeros(7, np.uint8)).astype(np.uint64)
    first = np.zeros(len(raw), np.uint64)
    step = min(8, 1 << (width.bit_length() - 1))
    for k in range(step):
        first = first << np.uint64(8) | padded[k : k + len(raw)]
    return suffix_tree.cut_at(suffix_tree.levels(first, width, step), width, step)


def _leaves(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Sorts the suffixes of one task's phrases; the maximal ranges of windows that repeat."""
    pdf = pdf.drop_duplicates(["trigger", "phrase", "from"])  # equal rows bring a phrase twice
    n = pdf["n"].to_numpy(np.int64)
    raw = np.frombuffer(b"".join(pdf["body"]), np.uint8)
    start = np.cumsum(n - 1 + width) - (n - 1 + width)
    row = np.repeat(np.arange(len(pdf)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    kind = suffix_ranks(raw, width)[start[row] + j]
    members = np.bincount(kind, minlength=1)[kind]
    once = pdf["copies"].to_numpy() == 1
    hit = (members > 1) & once[row]
    apart = row[1:] != row[:-1]
    edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | apart]))
    last = np.flatnonzero(hit & np.concatenate([~hit[1:] | apart, [True]]))
    at = pdf["from"].to_numpy(np.int64)[row]
    return pd.DataFrame({"trigger": pdf["trigger"].to_numpy()[row[edge]], "phrase": pdf["phrase"].to_numpy()[row[edge]], "from": at[edge] + j[edge], "to": at[last] + j[last] + 1})


RANGE = "trigger long, phrase long, from int, to int"
_PHRASE = ["trigger", "phrase", "copies", "n", "from", "body"]


def _part(rows: DataFrame, spans: Column, width: int) -> DataFrame:
    """What ``rows`` hold of the windows at each of ``spans`` (an array of places a..b-1)."""
    each = rows.select(*_PHRASE, "head", F.explode(spans).alias("span")).select(*_PHRASE, "head", "span.*")
    far, near = F.least("head", F.col("b") - 1), F.greatest(F.col("head") - F.col("n") + 1, "a")
    each = each.withColumns({"far": far, "count": far - near + 1}).filter("count > 0")
    skip = F.col("head") - F.col("far")
    body = F.col("body").substr(skip + 1, F.col("count") - 1 + width)
    return each.select("trigger", "phrase", "copies", F.col("count").alias("n"), (F.col("from") + skip).alias("from"), body.alias("body"), F.col("far").alias("head"), "a", "b")


def narrow(phrases: DataFrame, width: int, gram: int, group_bytes: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of the ``phrases`` under triggers that don't fit a group: tables of the parts to sort, with their ``group``, and of the ranges that repeat.

    A window's place is the number of its bytes before the trigger; equal windows have equal places. A part is what a
    phrase holds of the windows at the places a..b-1, and its core the bytes that all windows at these places cover, so
    parts with a window in common have equal cores. Equal parts repeat whole: a grouping by their bytes settles them, and one goes on
    for all. Then a core with a single part is done, one whose parts fit ``group_bytes`` is a group, and under the
    others the places are halved, by which cores grow. At a single place a part is its core, so that ends.
    """
    sort, settled = [], []
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    spans = F.array(span(F.lit(0), F.lit(width - gram + 1)))
    rows = phrases.withColumn("from", F.lit(0))
    while True:
        parts = _part(rows, spans, width)
        same = ["trigger", "a", "b", "head", "n", "body"]
        kinds = parts.groupBy(*same).agg(F.sum("copies").alias("copies"), F.min(F.struct("phrase", "from")).alias("one"))
        kinds = common.written(kinds.select(*same, "copies", "one.*"), "parts")
        again = kinds.filter("copies > 1").select(*same)
        whole = parts.filter("copies = 1").join(again.hint("shuffle_hash"), same, "left_semi")
        settled.append(common.written(whole.select("trigger", "phrase", "from", (F.col("from") + F.col("n")).alias("to")), "equal-parts"))
        core = F.col("body").substr(F.col("head") - F.col("a") + 1, width + 1 + F.col("a") - F.col("b"))
        cored = kinds.withColumn("core", core)
        key = ["trigger", "a", "b", "core"]
        cores = cored.groupBy(*key).agg(F.count("*").alias("variants"), F.sum(F.octet_length("body").cast("long")).alias("bytes")).filter("variants > 1")
        cores = common.written(cores.select(*key, (F.col("bytes") <= group_bytes).alias("fits")), "cores")
        held = common.written(cored.join(cores.hint("shuffle_hash"), key).withColumn("group", F.xxhash64(*key)).drop("core"), "narrowed")
        sort.append(held.filter("fits").select(*_PHRASE, "group"))
        rows = held.filter("NOT fits")
        if rows.isEmpty():
            return sort, settled
        half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        spans = F.array(span(F.col("a"), half), span(half, F.col("b")))


def remove_repeats(
    docs: DataFrame, width: int = 200, text: str = "text", doc: str = "doc_id", gram: int = GRAM, group_bytes: int = GROUP_BYTES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """``docs`` with kept (binary: the remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs)."""
    table = lambda: repeats.phrase_table(docs, _tokens, width, gram, text, doc, SLICE)
    shared = repeats.shared_phrases(table, F.col("n_all") > 1)
    kinds = repeats.phrase_kinds(shared)
    dictionary = repeats.several(kinds, F.lit(True))
    held = dictionary.groupBy("trigger").agg(F.sum(F.col("n") + F.lit(width - 1)).alias("bytes"))
    held = common.written(held, "trigger-bytes")
    fits = F.col("bytes") <= group_bytes
    total = held.filter(fits).agg(F.sum("bytes")).first()[0] or 0
    large = held.filter(~fits).select("trigger", F.lit(True).alias("large"))
    group = F.when(F.col("large").isNull(), F.col("trigger"))
    grouped = dictionary.join(large, "trigger", "left").withColumn("group", group).drop("large")
    cut = lambda raw, rows: [{"body": raw[r["lo"] : r["lo"] + r["n"] - 1 + width], "head": r["off"]} for r in rows]
    bodies = repeats.contexts(docs, grouped, cut, text, doc, "body binary, head int")
    settled = [kinds.filter("copies > 1").select("trigger", "phrase", F.lit(0).alias("from"), F.col("n").alias("to"))]
    sort = []
    if not large.isEmpty():
        bodies = common.written(bodies, "phrase-bytes")
        sort, equal = narrow(bodies.filter("group IS NULL").dropDuplicates(["trigger", "phrase"]), width, gram, group_bytes)
        total += sum(t.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0 for t in sort)
        settled += equal
    bodies = bodies.filter("group IS NOT NULL").withColumn("from", F.lit(0)).select(*_PHRASE, "group")
    bodies = functools.reduce(DataFrame.unionByName, sort, bodies)
    leaves = repeats.dealt(bodies, total, task_bytes).groupBy("part").applyInPandas(lambda pdf: _leaves(pdf, width), RANGE)
    verdict = functools.reduce(DataFrame.unionByName, settled, common.written(leaves, "suffix-order"))
    ranges = repeats.places(shared, verdict, width)
    joined, held = repeats.covered(docs, ranges, text, doc)

    def drop(raw: bytes, found: list[dict] | None) -> tuple:
        gone = repeats.mark(len(raw), found)
        if gone is None:
            return raw, len(raw), 0, 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return kept, len(raw), len(raw) - len(kept), len(repeats.runs(gone))

    return repeats.rewrite(joined, held, docs.columns, "kept binary, n_bytes long, n_removed long, n_spans long", drop, text)
