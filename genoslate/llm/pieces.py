"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of a model holds a white-space marker after another character, its merges never cross from one marked
word (a run of markers and what follows up to the next marker) to another. So each distinct marked word is segmented
once and the ids are put back by position:

1. Spark counts marked words; those that make up at least one in ``HEAVY`` of the corpus are at most ``HEAVY``
   by that very bound. They are segmented in one Spark job, once for the whole corpus, and that table is broadcast: ids, ids as text, and
   the text that they decode to within a sentence.
2. A task takes a slice of documents and numbers its distinct words. Those that neither the broadcast table nor the task's own holds
   are segmented and added to the task's table (of ``OWN_WORDS`` words at most, then it starts anew). Ids, their text and the decoded text of
   each document are then gathered from the table by the words' numbers. Nothing but word counts is ever shuffled.

Defined cases: a null or empty text has no ids; equal rows give equal rows; an empty table gives an empty table;
very long texts and words are encoded whole; columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A word of at least one HEAVY-th of all occurrences goes to the broadcast table.
HEAVY = 1 << 15
#: Longest word, in characters, that the broadcast table holds: with HEAVY, this bounds its size.
HEAVY_CHARS = 64
#: Words, and characters of words, that a task's own table holds.
OWN_WORDS = 1 << 17
OWN_CHARS = 4 << 20
MARK = "▁"
_RUN = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def crosses_words(model: str) -> bool:
    """Whether some piece holds a marker after another character; such a model needs whole texts."""
    sp = processor(model)
    return any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def marked_words(text: str) -> list[str]:
    """The marked words of ``text``, each without its first marker."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUN.findall(" " + text)]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All marked words of ``texts`` one after another, and how many each text has."""
    whole = pc.replace_substring(texts, MARK, " ")
    odd = pc.match_substring_regex(whole, "^ |  | $|^$").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(whole, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if not odd.any():
        return lists.flatten(), counts
    # the few with runs of blanks are split by themselves; runs of the others stay as they are
    own = {int(i): marked_words(whole[int(i)].as_py()) for i in np.flatnonzero(odd)}
    parts, at = [], 0
    for i, words in own.items():
        if at < i:
            parts.append(lists.slice(at, i - at).flatten())
        parts.append(pa.array(words, pa.string()))
        counts[i] = len(words)
        at = i + 1
    parts.append(lists.slice(at).flatten())
    return pa.concat_arrays(parts), counts


def segment(model: str, words: list[str]) -> list[list[int]]:
    """Ids of each marked word: the library puts the first marker back itself."""
    sp = processor(model)
    ids = sp.encode(words, num_threads=1)
    return [i if w else [sp.piece_to_id(MARK)] for w, i in zip(words, ids, strict=True)]


def spell(model: str, ids: list[list[int]]) -> list[str]:
    """What each word's ids decode to where another word stands before them."""
    sp = processor(model)
    before = sp.encode("a")
    skip = len(sp.decode(before))
    return [x[skip:] for x in sp.decode([before + i for i in ids])] if ids else []


def heavy_words(docs: DataFrame, text: str, model: str) -> DataFrame:
    """(word, ids, spelt) of the marked words that make up 1 / HEAVY of all, or more."""

    def count(texts: list[bytes], _: pa.RecordBatch) -> dict:
        words, _ = split_words(pa.array(texts, pa.binary()).cast(pa.string()))
        found = words.value_counts()
        n = found.field("counts").to_numpy(zero_copy_only=False)
        # what is that frequent overall is so in some slice, so each slice tells only of those
        some = np.flatnonzero(n * HEAVY >= n.sum())
        held = [(w, k) for w, k in zip(found.field("values").take(pa.array(some)).to_pylist(), n[some].tolist(), strict=True) if len(w) <= HEAVY_CHARS]
        return {"word": [w for w, _ in held] + [None], "n": [k for _, k in held] + [int(n.sum())]}

    counts = common.written(
        common.reduce_text(docs, "word string, n long", count, text).groupBy("word").agg(F.sum("n").alias("n")), "word-counts"
    )
    total = counts.filter(F.col("word").isNull()).agg(F.max("n").alias("total"))
    heavy = counts.filter(F.col("word").isNotNull()).join(F.broadcast(total), F.col("n") * HEAVY >= F.col("total")).select("word")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids = segment(model, pdf["word"].tolist())
            yield pd.DataFrame({"word": pdf["word"], "ids": ids, "spelt": spell(model, ids)})

    return heavy.mapInPandas(encode, "word string, ids array<int>, spelt string")


class Table:
    """Words known to a task, by number: ids one after another, ids as text, and the decoded text."""

    def __init__(self, model: str, rows: list[tuple[str, list[int], str]]):
        self.model, self.rows = model, rows
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {w: i for i, (w, _, _) in enumerate(self.rows)}
        self.ids = [i for _, i, _ in self.rows]
        self.spelt = [x for _, _, x in self.rows]
        self.chars = 0

    def take(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """Of each of the distinct ``words``: number of ids, ids one after another, ids as text, decoded text."""
        if len(self.number) > len(self.rows) + OWN_WORDS or self.chars > OWN_CHARS:
            self._reset()
        new = [w for w in words if w not in self.number]
        if new:
            ids = segment(self.model, new)
            self.number.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.ids += ids
            self.spelt += spell(self.model, ids)
            self.chars += sum(map(len, new))
        at = [self.number[w] for w in words]
        ids = [self.ids[i] for i in at]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        decimal = pc.binary_join(pa.ListArray.from_arrays(_offsets(size), pc.cast(pa.array(flat), pa.string())), ",")
        return size, flat, decimal, pa.array([self.spelt[i] for i in at], pa.string())


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32())


def _gather(size: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the words numbered ``at``, one after another."""
    start = np.cumsum(size) - size
    n = size[at]
    return flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def encode_decode(docs: DataFrame, model: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``docs`` with the chosen of: ids (array<int>), n_tokens, ids_text (ids joined by commas), decoded (text).

    No begin or end ids are added. A model whose pieces cross words is refused: its texts need encoding whole.
    """
    if crosses_words(model):
        raise ValueError("a piece of this model crosses white space; its words can't be segmented apart")
    rows = [(r["word"], list(r["ids"]), r["spelt"]) for r in heavy_words(docs, text, model).toLocalIterator()]
    held = docs.sparkSession.sparkContext.broadcast(rows)
    kinds = {"ids": "array<int>", "n_tokens": "long", "ids_text": "string", "decoded": "string"}
    state: list[Table] = []

    def run(texts: list[bytes]) -> list[pa.Array]:
        if not state:
            state.append(Table(model, held.value))
        words, counts = split_words(pa.array(texts, pa.binary()).cast(pa.string()))
        named = words.dictionary_encode()
        at = named.indices.to_numpy(zero_copy_only=False)
        size, flat, decimal, spelt = state[0].take(named.dictionary.to_pylist())
        ends = np.concatenate([[0], np.cumsum(size[at])])[np.cumsum(counts)]
        tokens = np.diff(np.concatenate([[0], ends]))
        made = {}
        if "ids" in outputs:
            made["ids"] = pa.ListArray.from_arrays(_offsets(tokens), pa.array(_gather(size, flat, at)))
        if "n_tokens" in outputs:
            made["n_tokens"] = pa.array(tokens)
        joined = lambda values, by: pc.binary_join(pa.ListArray.from_arrays(_offsets(counts), values.take(pa.array(at))), by)
        if "ids_text" in outputs:
            made["ids_text"] = joined(decimal, ",")
        if "decoded" in outputs:
            # the library leaves out the marker that it put before the first word
            made["decoded"] = pc.replace_substring_regex(joined(spelt, ""), "^ ", "")
        return [made[k] for k in outputs]

    return common.map_text(docs, ", ".join(f"{k} {kinds[k]}" for k in outputs), run, text)
