"""Line dedup: a sharded minimal perfect hash over all distinct line hashes, which documents probe.

Lines that occur in at least ``min_docs`` rows are dropped everywhere. Spark adds up rows per 128-bit line hash
(each row adds a line once, each task adds up first) and deals the distinct hashes to shards. A shard is one minimal perfect hash over its
hashes: a level table gives each its slot in a fingerprint array and a count array. Hashes that agree in the 64 bits which
choose the slot, but not in the fingerprint, stand in a small exact table beside the arrays.

Documents then look their lines up in the arrays, so no line is ever joined. Where the arrays, with counts cut down to the one bit that is
asked for, fit ``max_index_bytes`` (about five bits a distinct line and eight bytes a frequent one), they are broadcast. Beyond that the
line hashes travel to the shards instead: each task sorts arrays and probes by shard and reads one shard at a time, and the
positions of dropped lines go back to their rows. Lines that make up 1 / HEAVY of all are known beforehand (at most HEAVY by that
very share), so no shard gets a hot one.

Defined cases: a null text is one empty line, never dropped (its key is too short); equal rows count one by one;
an empty table gives an empty table; columns named ``n_lines`` or ``n_dropped`` are replaced; others pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

#: Slots per key in a level of the hash.
GAMMA = 2.0
KEYS_PER_SHARD = 100_000
MAX_INDEX_BYTES = 64 << 20
HEAVY = 1 << 15


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space and with A-Z lowered; other characters stay as they are."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def _level_slots(h: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & common.M64)
    return (common.mix64(h ^ salt) % np.uint64(size)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the levels' bits one after another, and each key's slot in 0..len(h)-1. Keys are distinct."""
    sizes: list[int] = []
    levels: list[np.ndarray] = []
    slot = np.zeros(len(h), dtype=np.int64)
    rest, placed = np.arange(len(h)), 0
    while len(rest):
        size = max(8, int(GAMMA * len(rest)))
        at = _level_slots(h[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        own = alone[at]
        slot[rest[own]] = placed + rank[at[own]]
        placed += int(own.sum())
        sizes.append(size)
        levels.append(alone)
        rest = rest[~own]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool), slot


class Slots:
    """One shard's minimal perfect hash: the slot of each key, -1 for some that are none."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.sizes = sizes

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            if not len(rest):
                break
            at = start + _level_slots(h[rest], level, size)
            own = self.bits[at]
            out[rest[own]] = self.rank[at[own]]
            rest = rest[~own]
        return out


def _beside(extra: dict[tuple[int, int], int], h1: np.ndarray, h2: np.ndarray, out: np.ndarray) -> np.ndarray:
    if extra:
        first = np.array([a for a, _ in extra], np.uint64)
        for i in np.flatnonzero(np.isin(h1, first)).tolist():
            out[i] = extra.get((int(h1[i]), int(h2[i])), out[i])
    return out


class Shard:
    """A shard with its fingerprint and count arrays."""

    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, beside: bytes = b""):
        self.slots = Slots(sizes, bits)
        self.prints, self.counts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<i8")
        self.extra = {(int(a), int(b)): int(n) for a, b, n in np.frombuffer(beside, "<u8").reshape(-1, 3)}

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Rows that hold each line, 0 if the shard lacks it."""
        out = np.zeros(len(h1), np.int64)
        slot = self.slots.of(h1)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.prints[slot[hit]] == h2[hit]]
        out[hit] = self.counts[slot[hit]]
        return _beside(self.extra, h1, h2, out)


class Frequent:
    """A shard whose counts are cut down to whether they reach the bound; fingerprints of those that do."""

    def __init__(self, sizes: list[int], bits: bytes, often: bytes, prints: bytes, beside: bytes):
        self.slots = Slots(sizes, bits)
        self.often = np.unpackbits(np.frombuffer(often, np.uint8)).astype(bool)
        self.at = np.cumsum(self.often, dtype=np.int32) - 1
        self.prints = np.frombuffer(prints, "<u8")
        self.extra = {(int(a), int(b)): 1 for a, b in np.frombuffer(beside, "<u8").reshape(-1, 2)}

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        slot = self.slots.of(h1)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.often[slot[hit]]]
        hit = hit[self.prints[self.at[slot[hit]]] == h2[hit]]
        out[hit] = True
        return _beside(self.extra, h1, h2, out)


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs) for every distinct line key of at least ``min_chars`` code points."""

    def count(texts: list[bytes], _: pa.RecordBatch) -> dict:
        found: Counter[bytes] = Counter()
        for x in texts:
            found.update({k for k in map(line_key, x.split(b"\n")) if len(k) >= min_chars and _code_points(k) >= min_chars})
        a, b = _hashes(list(found))
        return {"h1": a.view(np.int64), "h2": b.view(np.int64), "n": np.fromiter(found.values(), np.int64, len(found))}

    rows = common.reduce_text(docs, "h1 long, h2 long, n long", count, text)
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"))


def line_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: (shard, sizes, bits, prints, counts, beside) over all keys of ``counts``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h1", "h2"])
        h1, h2, n = (pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n_docs"))
        again = np.concatenate([[False], h1[1:] == h1[:-1]])
        key, own = h1[~again].view(np.uint64), ~again
        sizes, bits, slot = build_index(key)
        prints, held = np.zeros(len(key), "<u8"), np.zeros(len(key), "<i8")
        prints[slot], held[slot] = h2[own].view(np.uint64), n[own]
        beside = np.stack([h1[again].view(np.uint64), h2[again].view(np.uint64), n[again].astype(np.uint64)], axis=1)
        row = (int(pdf["shard"].iloc[0]), sizes, np.packbits(bits).tobytes(), prints.tobytes(), held.tobytes(), beside.astype("<u8").tobytes())
        return pd.DataFrame([row], columns=["shard", "sizes", "bits", "prints", "counts", "beside"])

    keyed = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    schema = "shard int, sizes array<long>, bits binary, prints binary, counts binary, beside binary"
    return common.written(keyed.groupBy("shard").applyInPandas(build, schema), "line-index")


def _frequent_index(index: DataFrame, min_docs: int) -> DataFrame:
    """The arrays of ``index`` as far as one bit of each count tells."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                often = np.frombuffer(r.counts, "<i8") >= min_docs
                beside = np.frombuffer(r.beside, "<u8").reshape(-1, 3)
                beside = beside[beside[:, 2] >= min_docs, :2]
                rows.append((r.shard, r.sizes, r.bits, np.packbits(often).tobytes(), np.frombuffer(r.prints, "<u8")[often].tobytes(), beside.tobytes()))
            yield pd.DataFrame(rows, columns=["shard", "sizes", "bits", "often", "prints", "beside"])

    return index.mapInPandas(cut, "shard int, sizes array<long>, bits binary, often binary, prints binary, beside binary")


def _kept(lines: list[list[bytes]], drops: list[np.ndarray]) -> list[pa.Array]:
    """Texts without the dropped lines, and how many lines there were and went."""
    texts = [b"\n".join([x for x, d in zip(doc, drop.tolist(), strict=True) if not d]) if drop.any() else b"\n".join(doc) for doc, drop in zip(lines, drops, strict=True)]
    return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array([len(x) for x in lines], pa.int64()), pa.array([int(x.sum()) for x in drops], pa.int64())]


def _split(texts: list[bytes], min_chars: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and of all lines both hashes and whether the key is long enough."""
    lines = [x.split(b"\n") for x in texts]
    keys = [line_key(x) for doc in lines for x in doc]
    a, b = _hashes(keys)
    return lines, a, b, np.fromiter((len(k) >= min_chars and _code_points(k) >= min_chars for k in keys), bool, len(keys))


def _per_text(values: np.ndarray, lines: list[list[bytes]]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in lines])[:-1]) if lines else []


def drop_frequent_lines(
    docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, max_index_bytes: int = MAX_INDEX_BYTES, doc: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, plus n_lines (before) and n_dropped."""
    plain = docs.drop("n_lines", "n_dropped")
    counts = common.written(line_counts(plain, text, min_chars), "line-counts")
    seen = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("rows")).first()
    # a shard is bounded both in its keys and in the probes that it will get
    shards = max(1, -(-seen["keys"] // KEYS_PER_SHARD), -(-seen["rows"] // (8 * KEYS_PER_SHARD)))
    index = line_index(counts, shards)
    compact = common.written(_frequent_index(index, min_docs), "line-flags")
    size = compact.agg(F.sum(F.length("bits") + F.length("often") + F.length("prints") + F.length("beside"))).first()[0] or 0
    if size <= max_index_bytes:
        return _probe_broadcast(plain, compact, shards, text, min_chars)
    return _probe_routed(plain, counts, index, shards, seen["rows"], text, min_docs, min_chars, doc)


def _probe_broadcast(plain: DataFrame, compact: DataFrame, shards: int, text: str, min_chars: int) -> DataFrame:
    held = plain.sparkSession.sparkContext.broadcast([tuple(r) for r in compact.collect()])
    state: dict[int, Frequent] = {}

    def run(texts: list[bytes]) -> list[pa.Array]:
        if not state:
            state.update({r[0]: Frequent(*r[1:]) for r in held.value})
        lines, a, b, long_enough = _split(texts, min_chars)
        drop = np.zeros(len(a), bool)
        owner = np.mod(a.view(np.int64), shards)
        order = np.argsort(owner, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
            if shard := state.get(int(owner[part[0]])):
                drop[part] = shard.holds(a[part], b[part])
        return _kept(lines, _per_text(drop & long_enough, lines))

    out = common.map_text(plain, f"`{text}` string, n_lines long, n_dropped long", run, text)
    return out.select(*plain.columns, "n_lines", "n_dropped")


def _probe_routed(plain: DataFrame, counts: DataFrame, index: DataFrame, shards: int, rows: int, text: str, min_docs: int, min_chars: int, doc: str) -> DataFrame:
    spark = plain.sparkSession
    key, at = common.fresh(plain.columns, "__key"), common.fresh(plain.columns, "__at")
    keyed = plain.withColumn(key, common.row_key(text, doc))
    hot = counts.filter((F.col("n_docs") >= min_docs) & (F.col("n_docs") * HEAVY >= rows)).select("h1", "h2").collect()
    heavy = spark.sparkContext.broadcast({(r["h1"], r["h2"]) for r in hot})

    def probes(texts: list[bytes], part: pa.RecordBatch) -> dict:
        lines, a, b, long_enough = _split(texts, min_chars)
        doc_of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        place = np.arange(len(a)) - np.repeat(np.cumsum([len(x) for x in lines]) - [len(x) for x in lines], [len(x) for x in lines])
        ask = np.flatnonzero(long_enough)
        x, y = a[ask].view(np.int64), b[ask].view(np.int64)
        known = np.fromiter((p in heavy.value for p in zip(x.tolist(), y.tolist(), strict=True)), bool, len(ask))
        none = pa.nulls(len(ask), pa.binary())
        return {
            # a line known to be hot may go anywhere
            "shard": np.where(known, np.mod(ask, shards), np.mod(x, shards)).astype(np.int32), "kind": np.where(known, 2, 1).astype(np.int32),
            "key": part.column(0).take(pa.array(doc_of[ask])), "at": place[ask], "h1": x, "h2": y,
            "sizes": pa.nulls(len(ask), pa.list_(pa.int64())), "bits": none, "prints": none, "counts": none, "beside": none,
        }

    schema = "shard int, kind int, key long, at long, h1 long, h2 long, sizes array<long>, bits binary, prints binary, counts binary, beside binary"
    asked = common.reduce_text(keyed, schema, probes, text, [key])
    nothing = lambda n: F.lit(None).cast("long").alias(n)
    arrays = index.select("shard", F.lit(0).alias("kind"), *map(nothing, ("key", "at", "h1", "h2")), "sizes", "bits", "prints", "counts", "beside")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        owner = None
        for batch in batches:
            number, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys, place = batch.column(2), batch.column(3)
            h1, h2 = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for i in (4, 5))
            hit = kind == 2
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(number) != 0) | (kind[1:] == 0) | (kind[:-1] == 0)])) if len(kind) else []
            for p, q in zip(edge, [*edge[1:], len(kind)], strict=True):
                if kind[p] == 0:
                    shard, owner = Shard(*[batch.column(i)[int(p)].as_py() for i in (6, 7, 8, 9, 10)]), number[p]
                elif owner == number[p] and shard is not None:
                    hit[p:q] |= (kind[p:q] == 1) & (shard.count(h1[p:q], h2[p:q]) >= min_docs)
            yield pa.RecordBatch.from_arrays([keys, place], names=["key", "at"]).filter(pa.array(hit))

    dealt = asked.unionByName(arrays).repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(answer, "key long, at long")
    gathered = found.groupBy(F.col("key").alias(key)).agg(F.collect_set("at").alias(at))
    joined = keyed.join(gathered.hint("shuffle_hash"), key, "left")
    names = plain.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, len(names) + 1):
                lines = [x.split(b"\n") for x in part.column(len(names) + 1).to_pylist()]
                drops = []
                for doc_lines, gone in zip(lines, part.column(len(names)).to_pylist(), strict=True):
                    drops.append(np.zeros(len(doc_lines), bool))
                    drops[-1][np.array(gone or [], dtype=np.int64)] = True
                made = _kept(lines, drops)
                columns = [made[0] if n == text else part.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns + made[1:], names=[*names, "n_lines", "n_dropped"])

    out = StructType([*plain.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias(common.fresh([*names, at], common.TEXT))
    return joined.select(*names, at, raw).mapInArrow(cut, out)
