"""Ranked lexical search: per-term geometric blocks with exact summary bounds.

Every query row is scored against every document. Queries are taken in blocks of about ``QUERY_BYTES`` of text, of which a job knows one.

1. One pass over the whole texts counts terms: a document becomes the frequencies of the terms that the block asks for, and its length. Documents, lengths and the
   documents of each term are summed up from that table.
2. Segments: a task takes documents in runs of bounded size and works on one run at a time. What a term contributes to a document is its *impact*.
3. A first pass scores in each segment some documents of each query's rarest terms. The best of all segments give each query a score that its last
   result can't fall below.
4. Search: in a segment, the posting list of each term is clustered by the similarity of its documents (pivots from the list, each document to the nearest), and each
   cluster of a list is a block with the coordinatewise maximum of its documents' impacts. A query leaves out its lists whose maxima together stay under the bound.
   In the others it compares the bound with what each block's summary could score at most, and scores the documents of those that reach it.
   All are whole numbers, exact in double precision, so that a block is skipped only if no document in it can be among the results.
5. Tasks keep the best of their documents for each query; these are ranked over all tasks.

Defined cases: a null or empty text has no terms; a query without terms or results has no rows; equal scores are ranked by ascending id, rows without
an id last; equal rows are ranked one by one; a query that stands twice is answered twice; an empty table of either kind gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Text of queries that a job takes at once; queries that a segment looks at together.
QUERY_BYTES = 2 << 20
GROUP = 256
#: Cells of a segment (documents times terms), and documents of it at most.
CELLS = 6 << 20
SEGMENT = 2048
#: Documents in a block, about; rows that are summarised at once; documents scored for the first bound.
BLOCK = 16
ROWS = 1024
PROBED = 32
#: Numbers that a document's place in the similarity space has.
SKETCH = 24

_SPLIT = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _SPLIT[_b] = ord(_c.lower()) if _c.isalnum() else 32
SPLIT = bytes(_SPLIT)


def terms(raw: bytes) -> list[bytes]:
    """The terms of a whole text: ASCII letters (lowered) and digits, and all that isn't ASCII."""
    return raw.translate(SPLIT).split()


@dataclass
class Queries:
    """A block of queries: numbers of the terms and how often each asks for them."""

    asked: list[tuple[np.ndarray, np.ndarray]]
    number: dict[bytes, int]
    #: Once the corpus is known: weights of terms, documents with terms, all terms, and each query's bound.
    weight: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0
    bound: np.ndarray | None = None
    groups: list[Group] = field(default_factory=list)


@dataclass
class Group:
    """Some queries of a block, and the terms that they hold."""

    first: int
    terms: np.ndarray
    #: Of each query: columns of ``terms`` and weights times repeats.
    asked: list[tuple[np.ndarray, np.ndarray]]
    sketch: np.ndarray


def read_queries(texts: list[bytes]) -> Queries:
    number: dict[bytes, int] = {}
    asked = []
    for raw in texts:
        held = Counter(terms(raw))
        asked.append((np.array([number.setdefault(t, len(number)) for t in held], np.int64), np.array(list(held.values()), np.int64)))
    return Queries(asked, number)


def _grouped(block: Queries) -> list[Group]:
    out = []
    for first in range(0, len(block.asked), GROUP):
        own = block.asked[first : first + GROUP]
        held = np.unique(np.concatenate([t for t, _ in own]))
        rows = [(np.searchsorted(held, t), (block.weight[t] * k).astype(np.float64)) for t, k in own]
        turned = np.random.default_rng(first).normal(size=(len(held), SKETCH)) * block.weight[held][:, None]
        out.append(Group(first, held, rows, turned.astype(np.float32)))
    return out


def term_vectors(docs: DataFrame, number: dict[bytes, int], text: str, doc: str) -> DataFrame:
    """(doc, n, terms, tf): length of each document, and how often it holds each of the terms in ``number``."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def count(texts: list[bytes]) -> list[pa.Array]:
        known = held.value
        n, sizes, which, often = [], [0], [], []
        for raw in texts:
            words = terms(raw)
            found = Counter(filter(None.__ne__, map(known.get, words)))
            n.append(len(words))
            which += found.keys()
            often += found.values()
            sizes.append(len(which))
        ends = pa.array(sizes, pa.int32())
        return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(which, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(often, pa.int64()))]

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return common.map_text(rows, "n long, terms array<int>, tf array<long>", count, "text", keep=["doc"])


class Segment:
    """Documents of one group of queries: impacts by document and term, and blocks of the terms' posting lists."""

    def __init__(self, group: Group, m: np.ndarray, row: np.ndarray, column: np.ndarray, tf: np.ndarray):
        self.group = group
        self.impact = np.zeros((len(m), len(group.terms)))
        value = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row])).astype(np.float64)
        self.impact[row, column] = value
        #: The same by documents, which come in order.
        self.column, self.value, self.held = column, value, np.cumsum(np.bincount(row, minlength=len(m)))
        order = np.lexsort((row, column))
        #: Documents of each term, one list after another.
        self.docs = row[order]
        self.ends = np.cumsum(np.bincount(column, minlength=len(group.terms)))
        self.most = self.impact.max(axis=0, initial=0)
        place = self.impact.astype(np.float32) @ group.sketch
        self.place = place / np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)

    def list_of(self, t: int) -> np.ndarray:
        return self.docs[self.ends[t - 1] if t else 0 : self.ends[t]]

    def blocks(self, t: int) -> list[np.ndarray]:
        """The posting list of a term by clusters of similar documents."""
        own = self.list_of(t)
        if len(own) <= BLOCK:
            return [own] if len(own) else []
        pivots = self.place[own[:: BLOCK]]
        near = np.argmax(self.place[own] @ pivots.T, axis=1)
        order = np.argsort(near, kind="stable")
        return np.split(own[order], np.flatnonzero(np.diff(near[order])) + 1)

    def summaries(self, blocks: list[np.ndarray]) -> np.ndarray:
        """The coordinatewise maximum of each block's impacts."""
        width = len(self.group.terms)
        docs = np.concatenate(blocks)
        n = self.held[docs] - np.where(docs > 0, self.held[docs - 1], 0)
        at = np.repeat(self.held[docs] - np.cumsum(n), n) + np.arange(int(n.sum()))
        block = np.repeat(np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]), n)
        most = np.zeros(len(blocks) * width)
        np.maximum.at(most, block * width + self.column[at], self.value[at])
        return most.reshape(len(blocks), width)

    def score(self, q: int, docs: np.ndarray) -> np.ndarray:
        columns, weight = self.group.asked[q]
        return self.impact[np.ix_(docs, columns)] @ weight

    def probe(self, q: int) -> np.ndarray:
        """Some documents of a query's rarest terms."""
        columns, weight = self.group.asked[q]
        out: list[np.ndarray] = []
        left = PROBED
        for t in columns[np.argsort(self.ends[columns] - np.where(columns > 0, self.ends[columns - 1], 0), kind="stable")].tolist():
            own = self.list_of(t)[:left]
            out.append(own)
            left -= len(own)
            if left <= 0:
                break
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def essential(self, q: int, bound: float) -> np.ndarray:
        """The terms of a query of which a document has to hold one to reach ``bound``."""
        columns, weight = self.group.asked[q]
        most = self.most[columns] * weight
        order = np.argsort(most, kind="stable")
        return columns[order[np.cumsum(most[order]) >= bound]]

    def reached(self, bounds: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """For each query, the documents of the blocks whose summaries reach its bound; blocks compared and skipped."""
        wanted: dict[int, list[int]] = {}
        for q, bound in enumerate(bounds.tolist()):
            for t in self.essential(q, bound).tolist():
                wanted.setdefault(t, []).append(q)
        found = np.zeros((len(bounds), len(self.impact)), bool)
        compared = skipped = 0
        todo = sorted(wanted)
        while todo:
            blocks: list[np.ndarray] = []
            of_query: dict[int, list[int]] = {}
            rows = 0
            while todo and rows < ROWS:
                t = todo.pop()
                made = self.blocks(t)
                at = range(len(blocks), len(blocks) + len(made))
                for q in wanted[t]:
                    of_query.setdefault(q, []).extend(at)
                blocks += made
                rows += sum(map(len, made))
            if not blocks:
                continue
            most = self.summaries(blocks)
            for q, at in of_query.items():
                columns, weight = self.group.asked[q]
                live = np.flatnonzero(most[np.ix_(at, columns)] @ weight >= bounds[q])
                compared += len(at)
                skipped += len(at) - len(live)
                for k in live.tolist():
                    found[q, blocks[at[k]]] = True
        return [np.flatnonzero(x) for x in found], compared, skipped


def _segments(batches: Iterator[pa.RecordBatch], block: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, list[Segment]]]:
    """Ids (and whether there is one) of runs of documents, and their segment for each group of queries."""
    widest = max((len(g.terms) for g in block.groups), default=1)
    size = max(1, min(SEGMENT, CELLS // max(1, widest)))
    for whole in batches:
        for start in range(0, whole.num_rows, size):
            batch = whole.slice(start, size)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            m = 25 + (75 * n * block.n_docs) // block.n_terms
            row = np.repeat(np.arange(len(n)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))

            def segment(g: Group, m=m, row=row, term=term, tf=tf) -> Segment:
                column = np.minimum(np.searchsorted(g.terms, term), len(g.terms) - 1)
                own = g.terms[column] == term
                return Segment(g, m, row[own], column[own], tf[own])

            yield doc, none, (segment(g) for g in block.groups if len(g.terms))


class Best:
    """The best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))] * queries

    def least(self, q: int) -> float:
        """What a document has to score to come in."""
        score = self.rows[q][0]
        return score[-1] if len(score) == self.k else 1.0

    def add(self, q: int, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        hit = score >= self.least(q)
        if hit.any():
            parts = [np.concatenate([a, b[hit]]) for a, b in zip(self.rows[q], (score, none, doc), strict=True)]
            order = np.lexsort((parts[2], parts[1], -parts[0]))[: self.k]
            self.rows[q] = tuple(p[order] for p in parts)

    def batch(self) -> pa.RecordBatch:
        q = np.repeat(np.arange(len(self.rows)), [len(s) for s, _, _ in self.rows])
        score, none, doc = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(doc.astype(np.int64), mask=none.astype(bool)), pa.array(score.astype(np.int64))], names=["q", "doc", "score"])


def _over_tasks(vectors: DataFrame, block: Queries, k: int, pick: Callable[[Segment, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(q, doc, score, rank): the best ``k`` of the documents that ``pick`` takes from each segment, over all tasks."""
    held = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        best = Best(len(own.asked), k)
        for doc, none, segments in _segments(batches, own):
            for s in segments:
                first = s.group.first
                bounds = np.array([max(best.least(first + q), own.bound[first + q] if own.bound is not None else 1.0) for q in range(len(s.group.asked))])
                for q, at in enumerate(pick(s, bounds)):
                    if len(at):
                        best.add(first + q, s.score(q, at), none[at], doc[at])
        if own.asked:
            yield best.batch()

    rows = vectors.mapInArrow(run, "q int, doc long, score long")
    w = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _known(block: Queries, vectors: DataFrame) -> Queries:
    """``block`` with what all documents say of its terms."""
    total = vectors.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
    block.n_docs, block.n_terms = total["docs"] or 0, total["terms"] or 0
    df = np.zeros(len(block.number), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # one row per term that is asked for
        df[r["t"]] = r["count"]
    block.weight = np.array([math.floor(1000 * math.log((2 * block.n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    block.groups = _grouped(block)
    return block


def query_blocks(queries: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of the queries, a bounded block at a time."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = common.written(queries.select(F.col(item).alias("item"), whole.cast("binary").alias("text")), "queries")
    size = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        if own:
            yield [r["item"] for r in own], [bytes(r["text"]) for r in own]


def _blocks(docs: DataFrame, queries: DataFrame, k: int, text: str, doc: str, item: str, query_text: str) -> Iterator[tuple[list, Queries, DataFrame]]:
    """Ids of the queries of each block, the block with its bounds, and the documents as its terms see them."""
    for items, texts in query_blocks(queries, item, query_text):
        block = read_queries(texts)
        vectors = common.written(term_vectors(docs, block.number, text, doc), "term-vectors")
        if _known(block, vectors).n_terms:
            probed = _over_tasks(vectors, block, k, lambda s, bounds: [s.probe(q) for q in range(len(bounds))])
            block.bound = np.ones(len(texts))
            for r in probed.filter(F.col("rank") == k).toLocalIterator():  # one row per query of the block
                block.bound[r["q"]] = r["score"]
            yield items, block, vectors


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc: str = "doc_id", item: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item, rank, doc, score): the ``k`` best documents of every query, of those that score above 0."""
    spark = docs.sparkSession
    kind = queries.select(F.col(item).alias("item")).schema["item"].dataType.simpleString()
    found = spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    for items, block, vectors in _blocks(docs, queries, k, text, doc, item, query_text):
        ranked = _over_tasks(vectors, block, k, lambda s, bounds: s.reached(bounds)[0])
        names = spark.createDataFrame(list(enumerate(items)), f"q int, item {kind}")
        found = found.unionByName(common.written(ranked.join(F.broadcast(names), "q").select("item", "rank", "doc", "score"), "ranked"))
    return found


def looked_at(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc: str = "doc_id", item: str = "item_id", query_text: str = "text") -> DataFrame:
    """(postings, compared, skipped, scored): entries of the lists that all queries ask for, blocks compared with a bound, blocks skipped, documents scored."""
    names = ["postings", "compared", "skipped", "scored"]
    kind = ", ".join(f"{n} long" for n in names)
    total = docs.sparkSession.createDataFrame([], kind)
    for _, block, vectors in _blocks(docs, queries, k, text, doc, item, query_text):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for _, _, segments in _segments(batches, own):
                for s in segments:
                    first = s.group.first
                    picked, compared, skipped = s.reached(own.bound[first : first + len(s.group.asked)])
                    size = np.diff(s.ends, prepend=0)
                    row = (sum(int(size[c].sum()) for c, _ in s.group.asked), compared, skipped, sum(map(len, picked)))
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=names)

        total = total.unionByName(vectors.mapInArrow(run, kind))
    return total.agg(*[F.sum(c).alias(c) for c in names])
