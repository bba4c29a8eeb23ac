"""What the training-data operators share: whole texts in bounded slices, and shared scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.shared import written

__all__ = ["fresh", "map_text", "reduce_text", "row_key", "slices", "word_hashes", "written"]

#: A word, as Java and Python regular expressions spell it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a Python task holds at a time; a longer text is a step of its own.
SLICE_BYTES = 2 << 20
#: Rows that it holds at most: short texts have a cost of their own.
SLICE_ROWS = 2048
TEXT = "__text"


def slices(batch: pa.RecordBatch, at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` whose texts (binary column ``at``) hold about ``limit`` bytes, in SLICE_ROWS rows at most."""
    sizes = pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right"))
        stop = max(min(stop, start + SLICE_ROWS), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def map_text(
    df: DataFrame,
    outputs: str,
    fn: Callable[[list[bytes]], list[pa.Array]],
    text: str = "text",
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` columns (all by default) plus ``outputs`` (DDL), computed by ``fn`` from whole UTF-8 texts.

    A null text counts as empty. Input columns named like an output are replaced.
    """
    made = df.sparkSession.createDataFrame([], outputs).schema
    names = [c for c in (df.columns if keep is None else keep) if c not in made.names]
    schema = df.select(*names).schema
    for field in made:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names), limit):
                arrays = fn(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + arrays, names=names + made.names)

    text_bytes = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias(fresh(names, TEXT))
    return df.select(*names, text_bytes).mapInArrow(run, schema)


def reduce_text(
    df: DataFrame,
    outputs: str,
    fn: Callable[[list[bytes], pa.RecordBatch], dict[str, np.ndarray | list]],
    text: str = "text",
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Rows of ``outputs`` (DDL) that ``fn(texts, kept columns)`` makes from each slice of whole texts."""
    made = df.sparkSession.createDataFrame([], outputs).schema
    types = [to_arrow_type(f.dataType) for f in made]
    names = list(keep or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names), limit):
                out = fn(part.column(len(names)).to_pylist(), part)
                columns = [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], t) for n, t in zip(made.names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=made.names)

    text_bytes = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias(fresh(names, TEXT))
    return df.select(*names, text_bytes).mapInArrow(run, made)


def row_key(text: str = "text", doc: str = "doc_id"):
    """A 64-bit key of a row's id and text, used beside the id: equal rows are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(doc).cast("string"), F.lit("∅")), F.coalesce(F.col(text), F.lit("")))


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so: what an operator adds on its way never meets the caller's columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
    return one(np.uint64(BASE)), one(np.uint64(pow(BASE, -1, 1 << 64)))


BASE = 0x9E3779B97F4A7C15 | 1
#: Tokens that are hashed at once; powers are kept for so many.
PIECE = 1 << 20
_kept: list[tuple[np.ndarray, np.ndarray]] = []


def prefix_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P and I with hash(i, j) = (P[j] - P[i]) * I[i] for tokens i..j-1, all modulo 2**64."""
    if len(x) > 2 * PIECE:
        power, inverse = _odd_powers(len(x))
    else:
        if not _kept:
            _kept.append(_odd_powers(2 * PIECE))
        power, inverse = _kept[0]
    p = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * power[: len(x)], out=p[1:])
    return p, inverse


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word up to which all words of a slice are hashed together; a longer one is hashed by itself.
SHORT = 64
_HELD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """A 64-bit hash of each word (see WORD) of each whole text, A-Z lowered if asked for.

    Short words take their bytes, eight at a time, into two states of 64 bits, each mixed by a bijection that isn't linear in any ring; long
    ones take xxh3. Neither has the repetitive texts that agree under a polynomial.
    """
    joined = b" ".join([*texts, b""])
    padded = (joined.lower() if lower else joined) + bytes(8)
    gap = _SPACE[np.frombuffer(padded, np.uint8, len(joined))]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray(len(joined) + 1, "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    a, b = mix64(size.astype(np.uint64) + np.uint64(0x243F6A8885A308D3)), mix64(size.astype(np.uint64) + np.uint64(0x13198A2E03707344))
    open_ = np.flatnonzero(size <= SHORT)
    at = 0
    while len(open_):
        held = eight[start[open_] + at] & _HELD[np.minimum(size[open_] - at, 8)]
        a[open_] = mix64((a[open_] ^ held) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0xA4093822299F31D0))
        b[open_] = mix64((b[open_] + held) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x082EFA98EC4E6C89))
        at += 8
        open_ = open_[size[open_] > at]
    out = mix64(a + mix64(b))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[start[i] : end[i]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(out, np.searchsorted(start, ends)[:-1]) if texts else []
