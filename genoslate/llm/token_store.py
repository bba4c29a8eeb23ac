"""Token-id files: each document is compressed by itself with a Zstandard dictionary that all of them share.

1. Texts are encoded by the tokenizers library. A tokenizer that drops white space is asked once per distinct chunk between ASCII blanks: a
   worker keeps the ids of chunks that it has met (``MEMO`` of them, then it forgets the older half), and ids are put back by position.
2. A dictionary is trained on the serialized id arrays of a bounded sample: ``SAMPLE`` documents of at most ``SAMPLE_BYTES`` of text, by a hash of the row.
   Short documents gain the most by it, long ones hardly need it; every document is compressed with it.
3. Each document's ids become one Zstandard frame. The frames are written to a table first, dealt into ranges of the document order, and
   a task writes its range as files of about ``FILE_BYTES``. A file is listed in the manifest, which Spark writes, only if its task has succeeded: what a lost
   or repeated task leaves behind is never read.
4. ``read_back`` reads the files that the manifest lists, one document at a time; ``read_document`` takes a single one by its offset.

File format, little-endian: MAGIC; width of an id in bytes (uint32); SHA-256 of the dictionary (32 bytes); frames; the index, one entry per document
(``INDEX``: id, whether it is null, offset, bytes, ids before it in the file, ids); offset of the index and number of entries (two uint64), MAGIC. The dictionary lies beside
the files as ``<hash>.dict``.

Defined cases: a null or empty text has the end id alone; documents come by ascending id, those of one id by a hash of their text, those without an id
last; equal rows are documents of their own; an empty table gives no files; with too few samples there is no dictionary and its bytes are empty; other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import file_system, shared_dir
from . import common

MAGIC = b"IDSZSTD1"
INDEX = np.dtype([("doc", "<i8"), ("none", "u1"), ("offset", "<u8"), ("bytes", "<u8"), ("before", "<u8"), ("ids", "<u8")])
HEAD = len(MAGIC) + 4 + 32
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2048, 4096, 64 << 10
#: Bytes of frames in a file; of frames that a reader holds at a time; chunks that a worker remembers, and their characters.
FILE_BYTES = 64 << 20
#: Bytes of texts that are encoded at once: the more, the fewer of their chunks are distinct.
SLICE = 4 << 20
READ_BYTES = 4 << 20
MEMO, MEMO_CHARS = 1 << 19, 8 << 20
LEVEL = 3


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def drops_blanks(path: str) -> bool:
    """Whether chunks between ASCII blanks can be encoded apart: no id holds a blank, and blanks only separate."""
    t = tokenizer(path)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    probes = ["a", "Zz9", "don't", "e\u0301", "<|x|>", "日本", "--"]
    return all(ids(f"{a}{b}{c}") == ids(a) + ids(c) for a in probes for c in probes for b in (" ", "\n", "\t \r\n", "  ")) and ids(" \n") == []


#: A run of letters that normalising only lowers, between ASCII marks; such a run is a word of its own to the tokenizer, and so are the marks.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


@lru_cache(maxsize=2)
def _byte_letters(path: str) -> list[str] | None:
    """The letter that stands for each byte in front of the model; None unless lowered runs of letters reach the model whole."""
    t = tokenizer(path)
    letters = [chr(b) for b in range(256)]
    for c in map(chr, [*range(97, 123), *range(0xDF, 0x250)]):
        shown = [x for x, _ in t.pre_tokenizer.pre_tokenize_str(c)] if c.isalpha() else []
        if len(shown) == 1 and len(shown[0]) == len(c.encode()):
            for raw, x in zip(c.encode(), shown[0], strict=True):
                letters[raw] = x
    probes = ["word", "Straße", "ñandÚ", "ÀÉ", "ĳǆǅ"]
    shown = lambda w: "".join(letters[b] for b in w.lower().encode())
    same = all([x.id for x in t.model.tokenize(shown(w))] == t.encode(w, add_special_tokens=False).ids for w in probes)
    apart = all(t.encode(f"({w}),", add_special_tokens=False).ids == [i for x in ("(", w, "),") for i in t.encode(x, add_special_tokens=False).ids] for w in probes)
    return letters if same and apart else None


class Encoder:
    """Ids of whole texts, by the chunks between blanks where the tokenizer allows."""

    def __init__(self, path: str):
        self.path = path
        #: Ids of chunks as bytes, of those met lately and those met before.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.chars = 0

    def _whole(self, words: list[str]) -> list[bytes]:
        """By the library alone."""
        return [array("I", e.ids).tobytes() for e in tokenizer(self.path).encode_batch_fast(words, add_special_tokens=False)]

    def _mark(self, x: str) -> bytes:
        if x not in self.marks:
            if len(self.marks) > 4096:
                self.marks = {"": b""}
            self.marks[x] = self._whole([x])[0]
        return self.marks[x]

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of chunks: a plain word between marks goes to the library's model at once, any other through all of the library."""
        letters, model = _byte_letters(self.path), tokenizer(self.path).model
        out: list[bytes | None] = [None] * len(words)
        for i, w in enumerate(words if letters else ()):
            before = after = ""
            if not (w.isascii() and w.isalpha()):
                if not (m := PLAIN.fullmatch(w)) or "<|" in w:
                    continue
                before, w, after = m.groups()
            w = w.lower()
            shown = w if w.isascii() else "".join([letters[b] for b in w.encode()])
            own = array("I", [x.id for x in model.tokenize(shown)]).tobytes()
            out[i] = self._mark(before) + own + self._mark(after) if before or after else own
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([words[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _chunks(self, words: list[str]) -> list[bytes]:
        if len(self.young) > MEMO // 2 or self.chars > MEMO_CHARS // 2:
            self.old, self.young, self.chars = self.young, {}, 0
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            if (x := old.get(words[i])) is None:
                new.append(i)
            else:
                out[i] = young[words[i]] = x
                self.chars += len(words[i])
        for i, x in zip(new, self._new([words[i] for i in new]), strict=True):
            out[i] = x
            if len(words[i]) <= 64:  # a longer one is hardly met again
                young[words[i]] = x
                self.chars += len(words[i])
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if not drops_blanks(self.path):
            rows = self._whole([x.decode() for x in texts])
            return np.frombuffer(b"".join(rows), np.uint32), np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        named = lists.flatten().dictionary_encode()
        at = named.indices.to_numpy(zero_copy_only=False)
        ids = self._chunks(named.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        n = size[at]
        start = np.cumsum(size) - size
        out = flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return out, np.diff(np.concatenate([[0], ends]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's own encoder: what one task has met, the next one on the same worker knows."""
    return _encoders.setdefault(path, Encoder(path))


def id_width(path: str, end_id: int) -> int:
    return 2 if max(tokenizer(path).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, end_id: int, text: str = "text") -> bytes:
    """A dictionary from the serialized ids of at most SAMPLE short texts; empty where these are too few."""
    whole = docs.select(F.col(text).cast("string").alias("text")).filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    key = F.xxhash64(F.lit(29), "text")
    sample = whole.orderBy(key, "text").limit(SAMPLE)
    kind = f"<u{id_width(path, end_id)}"

    def ids(texts: list[bytes], _: pa.RecordBatch) -> dict:
        flat, n = encoder(path).encode(texts)
        return {"ids": [np.append(x, end_id).astype(kind).tobytes() for x in np.split(flat, np.cumsum(n)[:-1])]}

    samples = [bytes(r["ids"]) for r in common.reduce_text(sample, "ids binary", ids, "text").collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zstd(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def frames(docs: DataFrame, path: str, end_id: int, dictionary: bytes, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, key, n, frame): the ids of each document, compressed by themselves."""
    kind = f"<u{id_width(path, end_id)}"
    held = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(texts: list[bytes]) -> list[pa.Array]:
        flat, n = encoder(path).encode(texts)
        press = zstandard.ZstdCompressor(level=LEVEL, **_zstd(held.value))
        rows = [press.compress(np.append(x, end_id).astype(kind).tobytes()) for x in np.split(flat, np.cumsum(n)[:-1])]
        return [pa.array(n + 1), pa.array(rows, pa.binary())]

    keyed = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    return common.map_text(keyed, "n long, frame binary", run, "text", keep=["doc", "key"], limit=SLICE)


MANIFEST = "part int, seq int, file string, first_doc long, docs long, tokens long, bytes long"


def write_files(framed: DataFrame, folder: str, dictionary: bytes, width: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (doc, key, n, frame) as files in ``folder`` by document order; the manifest: one row per file with ``start``, the ids in all files before it."""
    spark = framed.sparkSession
    held = common.written(framed.withColumn("at", F.monotonically_increasing_id()), "id-frames")
    total = held.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    order = [F.asc_nulls_last("doc"), F.asc("key"), F.asc("at")]
    ranged = held.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc", "n", "frame")
    name = hashlib.sha256(dictionary).hexdigest()
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}.dict") as f:
        f.write(dictionary)
    head = MAGIC + np.uint32(width).tobytes() + bytes.fromhex(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out = file = None
        part, seq, at, entries, ids = 0, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            index = np.array(entries, INDEX)
            out.write(index.tobytes())
            out.write(np.array([at, len(index)], "<u8").tobytes() + MAGIC)
            out.close()
            first = None if index["none"][0] else int(index["doc"][0])
            row = (part, seq, file, first, len(index), ids, at)
            types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            docs, n, blobs = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i in range(batch.num_rows):
                blob = blobs[i].as_buffer()
                if out is None:
                    part = batch.column(0)[0].as_py()
                    # a name of its own: another attempt at this task never meets it
                    file = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.ids"
                    out = fs.open_output_stream(f"{root}/{file}")
                    out.write(head)
                    at, entries, ids = HEAD, [], 0
                out.write(blob)
                entries.append((docs[i] or 0, docs[i] is None, at, blob.size, ids, n[i]))
                at += blob.size
                ids += n[i]
                if at >= file_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    listed = common.written(ranged.mapInArrow(run, MANIFEST), "id-files")
    # files are as many as there are FILE_BYTES, or shuffle partitions
    before = F.sum("tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    return common.written(listed.withColumn("start", F.coalesce(before, F.lit(0))), "id-manifest")


def store(docs: DataFrame, path: str, end_id: int, folder: str | None = None, text: str = "text", doc: str = "doc_id", file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Encodes ``docs`` into files in ``folder`` (by default a new one in the shared folder); that folder and the manifest."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, path, end_id, text)
    return folder, write_files(frames(docs, path, end_id, dictionary, text, doc), folder, dictionary, id_width(path, end_id), file_bytes)


class Reader:
    """One file: its index, and the ids of any document in it."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(HEAD, 0), self.file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{path} is no whole file of ids")
        self.kind = f"<u{int(np.frombuffer(head, '<u4', 1, len(MAGIC))[0])}"
        at, n = np.frombuffer(tail, "<u8", 2).tolist()
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.name = head[-32:].hex()
        with fs.open_input_stream(f"{path.rsplit('/', 1)[0]}/{self.name}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.name:
            raise ValueError(f"{path} was written with another dictionary")
        self.unpress = zstandard.ZstdDecompressor(**_zstd(dictionary))

    def ids(self, entry: int, raw: bytes | None = None) -> np.ndarray:
        e = self.index[entry]
        raw = self.file.read_at(int(e["bytes"]), int(e["offset"])) if raw is None else raw
        return np.frombuffer(self.unpress.decompress(raw), self.kind)

    def each(self) -> Iterator[tuple[np.void, np.ndarray]]:
        """All documents in order; neighbours are read together."""
        start = 0
        while start < len(self.index):
            base = int(self.index["offset"][start])
            ends = (self.index["offset"] + self.index["bytes"])[start:]
            stop = start + max(1, int(np.searchsorted(ends, base + READ_BYTES, side="right")))
            raw = self.file.read_at(int(ends[stop - start - 1]) - base, base)
            for i in range(start, stop):
                a = int(self.index["offset"][i]) - base
                yield self.index[i], self.ids(i, raw[a : a + int(self.index["bytes"][i])])
            start = stop


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc, start, n, crc32) of each document, from the files that ``manifest`` lists: ids before it, its ids, and their CRC-32 as unsigned 32-bit integers."""
    names = ["doc", "start", "n", "crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(None if e["none"] else int(e["doc"]), start + int(e["before"]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for e, ids in Reader(fs, f"{root}/{file}").each()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    files = manifest.select("file", "start")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "file").mapInArrow(run, "doc long, start long, n long, crc32 long")


def read_document(folder: str, file: str, doc: int) -> list[np.ndarray]:
    """The ids of the documents called ``doc`` in one file, by two small reads each."""
    fs, root = file_system(folder)
    reader = Reader(fs, f"{root}/{file}")
    return [reader.ids(i) for i in np.flatnonzero((reader.index["doc"] == doc) & (reader.index["none"] == 0))]
