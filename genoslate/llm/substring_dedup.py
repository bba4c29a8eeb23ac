"""Word substring dedup by prefix-partitioned suffix trees.

Every word that a window of ``width`` words covers, whose words also start in a document with a smaller id, is
removed.

1. Each window hangs on a trigger of ``gram`` words (see ``repeats``), so suffixes are only followed where a trigger
   occurs in two documents or more. Copies of a whole phrase are settled by grouping.
2. The distinct phrases of the remaining triggers are dealt out by prefixes of their triggers. Prefixes vary in length: they grow word
   by word, from one word on, until the phrases under a prefix fit ``group_bytes``. A trigger that doesn't fit even with all its words
   is lengthened to the whole window; there, a subtree is a single node, and nodes are settled by a grouping of their names.
3. A group builds the suffix tree of its phrases: suffix order by prefix doubling, common prefixes of neighbours, and the internal
   nodes of depth ``width`` or more (see ``suffix_tree``). The topmost of them are the repeated windows; each passes
   its smallest document down to its leaves. All of them are the repeats that ``repeat_nodes`` lists.
4. The verdicts on phrases go back to where they stand, and the texts lose the covered words.

Defined cases: a null or empty text has no words; documents of one id never remove from each other; rows with a null
id come last in order; equal rows get equal results; an empty table gives an empty table; white space is not kept; columns
named like an output are replaced, all others come back as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats, suffix_tree

#: Words of a trigger; bytes of phrases under one prefix; bytes of phrases in a task.
GRAM = 16
GROUP_BYTES = 1 << 20
TASK_BYTES = 4 << 20


class Tree:
    """The suffix tree of phrases: leaves are their windows, in suffix order; nodes are those of depth ``width`` or more."""

    def __init__(self, bodies: list[list[bytes]], n: np.ndarray, width: int):
        number: dict[bytes, int] = {}
        size = np.array([len(b) for b in bodies], np.int64)
        start, first = np.cumsum(size + 1) - size - 1, np.cumsum(n) - n
        tokens = np.empty(int((size + 1).sum()), np.int64)
        ends = start + size
        tokens[np.setdiff1d(np.arange(len(tokens)), ends, assume_unique=True)] = np.fromiter((number.setdefault(w, len(number)) for b in bodies for w in b), np.int64, int(size.sum()))
        tokens[ends] = len(number) + np.arange(len(bodies))  # no two phrases end alike
        ranks = suffix_tree.levels(tokens, 2 * int(size.max(initial=1)))
        at = np.repeat(start - first, n) + np.arange(int(n.sum()))
        #: Leaves in suffix order, as numbers of windows; the window's phrase and its place there.
        self.order = np.argsort(ranks[-1][at], kind="stable")
        self.row = np.repeat(np.arange(len(bodies)), n)
        self.place = np.arange(len(self.row)) - np.repeat(first, n)
        leaf = at[self.order]
        self.lcp = suffix_tree.common_prefix(ranks, leaf[:-1], leaf[1:])
        self.nodes = suffix_tree.tree_nodes(self.lcp, width)
        #: The word before each leaf; -1 where the phrase begins.
        self.before = np.where(self.place[self.order] > 0, tokens[leaf - 1], -1)

    def smallest(self, value: np.ndarray) -> np.ndarray:
        """For each window, the smallest ``value`` of the windows under the topmost node above it."""
        out = value.copy()
        for _, a, b, parent in self.nodes:
            if parent < 0:
                own = self.order[a:b]
                out[own] = value[own].min()
        return out


def _leaves(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Builds one task's trees; see ``repeats.settle`` for the rows."""
    pdf = pdf.drop_duplicates(["trigger", "phrase"])  # equal rows bring a phrase twice
    n = pdf["n"].to_numpy(np.int64)
    bodies = [b.split() for b in pdf["body"]]
    tree = Tree(bodies, n, width)
    row, j = tree.row, tree.place
    doc = pdf["first"].to_numpy(np.int64)[row]
    hit = tree.smallest(doc) < doc
    whole = pdf["group"].isna().to_numpy()[row]
    trigger, phrase = pdf["trigger"].to_numpy(), pdf["phrase"].to_numpy()
    before = np.concatenate([[True], ~hit[:-1] | (row[1:] != row[:-1])])
    after = np.concatenate([~hit[1:] | (row[1:] != row[:-1]), [True]])
    edge, last = np.flatnonzero(hit & before), np.flatnonzero(hit & after)
    done = pd.DataFrame({"trigger": trigger[row[edge]], "phrase": phrase[row[edge]], "from": j[edge], "to": j[last] + 1})
    # of triggers without a group, the windows that no smaller document settles here: another task may hold one
    asked = np.flatnonzero(whole & ~hit)
    names = [xxhash.xxh3_128_digest(b" ".join(bodies[r][k : k + width])) for r, k in zip(row[asked].tolist(), j[asked].tolist(), strict=True)]
    both = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64)
    named = pd.DataFrame({"trigger": trigger[row[asked]], "phrase": phrase[row[asked]], "from": j[asked], "to": j[asked] + 1, "a": pd.array(both[:, 0], "Int64"), "b": pd.array(both[:, 1], "Int64"), "copies": pd.array(np.ones(len(asked), np.int64), "Int64"), "first": pd.array(doc[asked], "Int64")})
    done = done.assign(**{c: pd.array([pd.NA] * len(done), "Int64") for c in ("a", "b", "copies", "first")})
    return pd.concat([done, named], ignore_index=True)[["trigger", "phrase", "from", "to", "a", "b", "copies", "first"]]


def _grouped(docs: DataFrame, dictionary: DataFrame, width: int, gram: int, text: str, doc: str, group_bytes: int) -> tuple[DataFrame, int]:
    """Phrases with their words (body) and ``group``: the shortest prefix of the trigger under which all phrases fit, null
    if none does; and the bytes of all."""

    def cut(raw: bytes, rows: list[dict]) -> list[dict]:
        words = raw.split()
        spans = [words[r["lo"] : r["lo"] + r["n"] - 1 + width] for r in rows]
        starts = common.word_hashes([b" ".join(s[r["off"] : r["off"] + gram]) for s, r in zip(spans, rows, strict=True)])
        out = []
        for span, h in zip(spans, starts, strict=True):
            held = h.tobytes()
            names = [xxhash.xxh3_64_intdigest(held[: 8 * k]) - (1 << 63) for k in range(1, len(h) + 1)]
            out.append({"body": b" ".join(span), "prefixes": names})
        return out

    plain = dictionary.withColumn("group", F.lit(None).cast("long"))
    bodies = common.written(repeats.contexts(docs, plain, cut, text, doc, "body binary, prefixes array<long>").drop("group"), "phrase-words")
    # a trigger's words are those of all its phrases
    triggers = bodies.groupBy("trigger").agg(F.sum(F.length("body")).alias("bytes"), F.min("prefixes").alias("prefixes"))
    triggers = common.written(triggers, "trigger-bytes")
    grown = triggers.select("trigger", "bytes", F.posexplode("prefixes").alias("level", "prefix"))
    held = grown.groupBy("level", "prefix").agg(F.sum("bytes").alias("held")).filter(F.col("held") <= group_bytes).select("level", "prefix")
    group = grown.join(held, ["level", "prefix"]).groupBy("trigger").agg(F.min_by("prefix", "level").alias("group"))
    total = triggers.agg(F.sum("bytes")).first()[0] or 0
    return bodies.drop("prefixes").join(group, "trigger", "left"), total


def _shared(docs: DataFrame, width: int, gram: int, text: str, doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of triggers in two documents or more, their kinds, and the kinds that trees have to look into."""
    table = lambda: repeats.phrase_table(docs, common.word_hashes, width, gram, text, doc, common.SLICE_BYTES)
    shared = repeats.shared_phrases(table, F.col("first") < F.col("last"))
    kinds = repeats.phrase_kinds(shared)
    return shared, kinds, repeats.several(kinds, F.col("f") < F.col("l"))


def remove_repeats(
    docs: DataFrame, width: int = 50, text: str = "text", doc: str = "doc_id", gram: int = GRAM, group_bytes: int = GROUP_BYTES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """``docs`` with kept (string: the kept words joined by one space), n_words and n_removed."""
    shared, kinds, dictionary = _shared(docs, width, gram, text, doc)
    bodies, total = _grouped(docs, dictionary, width, gram, text, doc, group_bytes)
    leaves = repeats.dealt(bodies, total, task_bytes).groupBy("part").applyInPandas(lambda pdf: _leaves(pdf, width), repeats.LEAF)
    leaves = common.written(leaves, "subtrees")
    within = repeats.settle(leaves, F.col("all_first") < F.col("first")).withColumn("whole", F.lit(False))
    copies = kinds.filter("first < last").select("trigger", "phrase", F.lit(0).alias("from"), F.col("n").alias("to"), F.lit(True).alias("whole"))
    verdict = within.unionByName(copies).join(kinds.select("trigger", "phrase", F.col("first").alias("__first")), ["trigger", "phrase"])
    # the first document keeps its phrase but for the windows found in the tree; later ones lose the whole
    ranges = repeats.places(shared, verdict, width, ~F.col("whole") | (F.col("ord") > F.col("__first")))
    joined, held = repeats.covered(docs, ranges, text, doc)

    def drop(raw: bytes, found: list[dict] | None) -> tuple:
        words = raw.split()
        gone = repeats.mark(len(words), found)
        kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return b" ".join(kept).decode(), len(words), len(words) - len(kept)

    return repeats.rewrite(joined, held, docs.columns, "kept string, n_words long, n_removed long", drop, text)


def repeat_nodes(
    docs: DataFrame, width: int = 50, text: str = "text", doc: str = "doc_id", gram: int = GRAM, group_bytes: int = GROUP_BYTES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """(words, depth, copies, first): word sequences of ``width`` words or more that different phrases share and that can't be
    extended to either side without losing one of them; how many share it, and the smallest document of these.

    These are the deep internal nodes of the subtrees whose leaves differ in the word before. They are maximal within their phrases:
    a longer repeat shows as several nodes that overlap. Of a trigger without a group, the windows of ``width`` words that repeat are given.
    """
    _, _, dictionary = _shared(docs, width, gram, text, doc)
    bodies, total = _grouped(docs, dictionary, width, gram, text, doc, group_bytes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["trigger", "phrase"])
        words = [b.split() for b in pdf["body"]]
        n, doc_of, apart = pdf["n"].to_numpy(np.int64), pdf["first"].to_numpy(np.int64), pdf["group"].isna().to_numpy()
        text_of = lambda row, k, size: b" ".join(words[row][k : k + size]).decode()
        out = [(text_of(r, k, width), width, 1, int(doc_of[r])) for r in np.flatnonzero(apart).tolist() for k in range(n[r])]
        held = np.flatnonzero(~apart)
        words, n, doc_of = [words[r] for r in held.tolist()], n[held], doc_of[held]
        tree = Tree(words, n, width)
        for depth, a, b, _ in tree.nodes:
            if suffix_tree.left_diverse(tree.before, a, b):
                rows = tree.row[tree.order[a:b]]
                k = int(tree.place[tree.order[a]])
                out.append((text_of(rows[0], k, depth), depth, b - a, int(doc_of[rows].min())))
        return pd.DataFrame(out, columns=["words", "depth", "copies", "first"]).astype({"depth": "int64", "copies": "int64", "first": "int64"})

    found = repeats.dealt(bodies, total, task_bytes).groupBy("part").applyInPandas(run, "words string, depth long, copies long, first long")
    # a trigger without a group is in several tasks: its windows are brought together by their words
    return found.groupBy("words", "depth").agg(F.sum("copies").alias("copies"), F.min("first").alias("first")).filter("copies > 1")
