"""Matroska media columns: EBML elements, clusters, lacing and cues parsed into packet tables.

``mux`` stores a binary payload as 8-bit PCM samples in a Matroska file; ``parse`` reads any Matroska bytes into
packets (track, cluster, timestamp, byte range, lacing), tracks and cues; ``packet_table`` gives one row per packet;
``track_samples`` joins a track's frames in order. Spark spreads the rows; a task holds one bounded slice of them.

Read: element ids of 1 to 4 bytes and sizes of 1 to 8 bytes, unknown sizes of segments and clusters, SimpleBlock and
BlockGroup, the four kinds of lacing, default durations and those of blocks, timestamp scales, and cues. Unknown elements, Void and
CRC-32 are skipped.

Defined cases: null or empty media has no packets, tracks or cues and the error ``no EBML header``; for broken bytes
``error`` says what is wrong and the packets before it stay; equal media gives equal rows; an empty table gives an
empty table; columns named like an output are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the format: element ids.
EBML, DOC_TYPE, EBML_VERSION, EBML_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4286, 0x42F7
MAX_ID_LENGTH, MAX_SIZE_LENGTH, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x42F2, 0x42F3, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TAGS, ATTACHMENTS, CHAPTERS = 0x1254C367, 0x1941A469, 0x1043A770
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, ATTACHMENTS, CHAPTERS}
LACING = ("none", "xiph", "fixed", "ebml")

#: Samples per frame, frames per lace, frames per cluster, and samples a second of muxed payloads.
FRAME, LACE, CLUSTER_FRAMES, RATE = 512, 8, 64, 8000
SCALE_NS = 1_000_000

PACKET = "struct<track: int, cluster: int, block: int, frame: int, timestamp_ns: long, duration_ns: long, start: long, size: long, keyframe: boolean, lacing: string>"
TRACK = "struct<track: int, uid: long, kind: int, codec: string, rate: double, channels: int, bits: int, default_ns: long>"
CUE = "struct<time_ns: long, track: int, cluster_at: long>"


# --- writing ---------------------------------------------------------------------------------------------------


def _size(n: int, width: int = 0) -> bytes:
    """A size of the fewest bytes (or of ``width``); all ones stay reserved for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _element(ident: int, body: bytes) -> bytes:
    return _id(ident) + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace_sizes(sizes: list[int], kind: int) -> bytes:
    """The lace head: the frame count, then the sizes of all frames but the last."""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == 3:
        out = [head, _size(sizes[0])]
        for before, n in zip(sizes[:-2], sizes[1:-1], strict=True):
            d = n - before
            width = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)))
            out.append(_size(d + (1 << (7 * width - 1)) - 1, width))
        return b"".join(out)
    return head


def mux(payload: bytes) -> bytes:
    """``payload`` as one track of 8-bit samples; blocks take the four kinds of lacing in turn."""
    header = b"".join(
        [_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(MAX_ID_LENGTH, 4), _uint(MAX_SIZE_LENGTH, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_TYPE_VERSION, 4), _uint(DOC_TYPE_READ_VERSION, 2)]
    )
    frame_ns = FRAME * 1_000_000_000 // RATE
    info = _uint(TIMESTAMP_SCALE, SCALE_NS) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(MUXING_APP, b"genoslate") + _element(WRITING_APP, b"genoslate")
    audio = _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, frame_ns) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, audio)
    body = [_element(INFO, info), _element(TRACKS, _element(TRACK_ENTRY, entry))]
    at, cues, turn = sum(map(len, body)), [], 2
    for first in range(0, len(payload), FRAME * CLUSTER_FRAMES):
        chunk = payload[first : first + FRAME * CLUSTER_FRAMES]
        start_ms = first * 1000 // RATE
        parts = [_uint(TIMESTAMP, start_ms)]
        place = 0
        while place < len(chunk):
            kind = turn % 4
            turn += 1
            take = chunk[place : place + FRAME * (LACE if kind else 1)]
            sizes = [min(FRAME, len(take) - i) for i in range(0, len(take), FRAME)]
            if kind and (len(sizes) == 1 or kind == 2 and len(set(sizes)) > 1):
                kind = 0 if len(sizes) == 1 else 1
            block = b"\x81" + struct.pack(">h", place * 1000 // RATE) + bytes([0x80 | kind << 1]) + (_lace_sizes(sizes, kind) if kind else b"") + take
            # every other laced block is a BlockGroup
            parts.append(_element(BLOCK_GROUP, _element(BLOCK, block[:3] + bytes([kind << 1]) + block[4:]) + _uint(BLOCK_DURATION, len(take) * 1000 // RATE)) if turn % 8 == 0 else _element(SIMPLE_BLOCK, block))
            place += len(take)
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start_ms) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _element(EBML, header) + _element(SEGMENT, b"".join(body))


# --- reading ---------------------------------------------------------------------------------------------------


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or data[at] < 0x10:
        raise ValueError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """The number after its length marker (None: unknown, all ones) and where it ends."""
    if at >= end or data[at] == 0:
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut size at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of the children in data[at:end]; one of unknown size ends where its parent's
    next child starts, which ``_unknown_end`` looks up."""
    while at < end:
        ident, body = read_id(data, at, end)
        size, body = read_size(data, body, end)
        if size is None:
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size of element {ident:#x}")
            stop = end if ident == SEGMENT else _unknown_end(data, body, end)
        else:
            stop = body + size
        if stop > end:
            yield ident, body, end
            raise ValueError(f"element {ident:#x} ends after its parent")
        yield ident, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body = read_id(data, at, end)
        if ident in TOP_LEVEL:
            return at
        size, body = read_size(data, body, end)
        if size is None:
            raise ValueError(f"unknown size of element {ident:#x}")
        at = body + size
    return end


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of each frame of a block whose lace head starts at ``at``."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"no lace head at byte {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % count:
            raise ValueError(f"uneven fixed lace at byte {at}")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if kind == 1:
                n = 0
                while True:
                    if at >= end:
                        raise ValueError(f"cut lace at byte {at}")
                    n, at, more = n + data[at], at + 1, data[at] == 255
                    if not more:
                        break
            else:
                from_at = at
                n, at = read_size(data, at, end)
                if n is None:
                    n = (1 << 7 * (at - from_at)) - 1
                if i:
                    n = sizes[-1] + n - ((1 << (7 * (at - from_at) - 1)) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace is longer than its block at byte {at}")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes | None) -> dict:
    """{'packets', 'tracks', 'cues': lists of dicts, 'error': what is wrong, or None}."""
    out: dict = {"packets": [], "tracks": [], "cues": [], "error": None}
    data = data or b""
    try:
        top = list(elements(data, 0, len(data))) if data[:4] == b"\x1a\x45\xdf\xa3" else []
    except ValueError as e:
        out["error"], top = str(e), []
        try:
            for x in elements(data, 0, len(data)):
                top.append(x)
        except ValueError:
            pass
    if not top:
        out["error"] = out["error"] or "no EBML header"
        return out
    try:
        for ident, a, b in top:
            if ident == SEGMENT:
                _segment(data, a, b, out)
    except ValueError as e:
        out["error"] = out["error"] or str(e)
    return out


def _segment(data: bytes, a: int, b: int, out: dict) -> None:
    scale, cluster_no, default_ns = SCALE_NS, 0, {}
    for ident, x, y in elements(data, a, b):
        if ident == INFO:
            for i, p, q in elements(data, x, y):
                if i == TIMESTAMP_SCALE:
                    scale = _number(data, p, q)
        elif ident == TRACKS:
            for i, p, q in elements(data, x, y):
                if i == TRACK_ENTRY:
                    track = _track(data, p, q)
                    out["tracks"].append(track)
                    default_ns[track["track"]] = track["default_ns"]
        elif ident == CLUSTER:
            _cluster(data, x, y, scale, cluster_no, default_ns, out["packets"])
            cluster_no += 1
        elif ident == CUES:
            for i, p, q in elements(data, x, y):
                if i == CUE_POINT:
                    _cue(data, p, q, scale, out["cues"])


def _track(data: bytes, a: int, b: int) -> dict:
    t = {"track": 0, "uid": 0, "kind": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": None, "default_ns": None}
    for i, p, q in elements(data, a, b):
        if i == TRACK_NUMBER:
            t["track"] = _number(data, p, q)
        elif i == TRACK_UID:
            t["uid"] = _number(data, p, q) & (1 << 63) - 1
        elif i == TRACK_TYPE:
            t["kind"] = _number(data, p, q)
        elif i == CODEC_ID:
            t["codec"] = data[p:q].rstrip(b"\0").decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            t["default_ns"] = _number(data, p, q)
        elif i == AUDIO:
            for j, r, s in elements(data, p, q):
                if j == SAMPLING:
                    t["rate"] = _float(data, r, s)
                elif j == CHANNELS:
                    t["channels"] = _number(data, r, s)
                elif j == BIT_DEPTH:
                    t["bits"] = _number(data, r, s)
    return t


def _cue(data: bytes, a: int, b: int, scale: int, cues: list) -> None:
    time = 0
    for i, p, q in elements(data, a, b):
        if i == CUE_TIME:
            time = _number(data, p, q)
        elif i == CUE_POSITIONS:
            at = {j: _number(data, r, s) for j, r, s in elements(data, p, q)}
            cues.append({"time_ns": time * scale, "track": at.get(CUE_TRACK, 0), "cluster_at": at.get(CUE_CLUSTER, 0)})


def _cluster(data: bytes, a: int, b: int, scale: int, cluster_no: int, default_ns: dict, packets: list) -> None:
    base, block_no = 0, 0
    for i, p, q in elements(data, a, b):
        if i == TIMESTAMP:
            base = _number(data, p, q)
        elif i in (SIMPLE_BLOCK, BLOCK_GROUP):
            duration, key, body = None, True, (p, q) if i == SIMPLE_BLOCK else None
            if i == BLOCK_GROUP:
                for j, r, s in elements(data, p, q):
                    if j == BLOCK:
                        body = (r, s)
                    elif j == BLOCK_DURATION:
                        duration = _number(data, r, s)
                    elif j == REFERENCE_BLOCK:
                        key = False
            if body is None:
                raise ValueError(f"group without a block at byte {p}")
            track, at = read_size(data, *body)
            if at + 3 > body[1]:
                raise ValueError(f"cut block at byte {at}")
            (offset,) = struct.unpack(">h", data[at : at + 2])
            flags = data[at + 2]
            key = bool(flags & 0x80) if i == SIMPLE_BLOCK else key
            kind = flags >> 1 & 3
            frames = lace(data, at + 3, body[1], kind)
            each = default_ns.get(track)
            whole = None if duration is None else duration * scale
            if whole is not None and (not each or whole <= (len(frames) - 1) * each):
                each = whole // len(frames)
            # a block's own duration holds: its last frame lasts as long as the others leave
            last = each if whole is None else whole - (len(frames) - 1) * each
            for n, (start, size) in enumerate(frames):
                packets.append({"track": track, "cluster": cluster_no, "block": block_no, "frame": n, "timestamp_ns": (base + offset) * scale + n * (each or 0), "duration_ns": last if n == len(frames) - 1 else each, "start": start, "size": size, "keyframe": key, "lacing": LACING[kind]})
            block_no += 1


# --- columns ---------------------------------------------------------------------------------------------------


def _map_binary(df: DataFrame, column: str, outputs: str, fn) -> DataFrame:
    """All other columns plus ``outputs``, computed by ``fn`` from the binary column, slice by slice."""
    made = df.sparkSession.createDataFrame([], outputs).schema
    names = [c for c in df.columns if c not in made.names]
    schema = df.select(*names).schema
    for field in made:
        schema = schema.add(field)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, len(names)):
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + fn(part.column(len(names)).to_pylist()), names=names + made.names)

    return df.select(*names, F.coalesce(F.col(column), F.lit(b"")).alias(common.fresh(names, common.TEXT))).mapInArrow(run, schema)


def mux_column(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``df`` with ``media``: the payload as a Matroska file (a null payload: an empty one)."""
    return _map_binary(df, payload, f"`{media}` binary", lambda xs: [pa.array([mux(x) for x in xs], pa.binary())])


def parse_column(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with packets, tracks, cues (arrays of structs) and error."""
    schema = f"packets array<{PACKET}>, tracks array<{TRACK}>, cues array<{CUE}>, error string"
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct_type = _parse_datatype_string(schema)
    assert isinstance(struct_type, StructType)
    types = [to_arrow_type(f.dataType) for f in struct_type]

    def rows(xs: list[bytes]) -> list[pa.Array]:
        found = [parse(x) for x in xs]
        return [pa.array([f[n] for f in found], t) for n, t in zip(("packets", "tracks", "cues", "error"), types, strict=True)]

    return _map_binary(df, media, schema, rows)


def packet_table(df: DataFrame, *keep: str, media: str = "media") -> DataFrame:
    """One row per packet: the ``keep`` columns and the packet's fields."""
    return parse_column(df, media).select(*keep, F.explode("packets").alias("p")).select(*keep, "p.*")


def read_samples(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with samples (all frames of the first track, in order of time) and feature (what the file shows)."""

    def rows(xs: list[bytes]) -> list[pa.Array]:
        samples, said = [], []
        for x in xs:
            found = parse(x)
            first = found["tracks"][0] if found["tracks"] else {"track": -1, "codec": "", "rate": 0.0, "bits": 0}
            packets = [p for p in found["packets"] if p["track"] == first["track"]]
            packets.sort(key=lambda p: (p["timestamp_ns"], p["start"]))
            body = b"".join([x[p["start"] : p["start"] + p["size"]] for p in packets])
            samples.append(body)
            said.append(_feature(found, first, packets, body))
        return [pa.array(samples, pa.binary()), pa.array(said, pa.string())]

    again = common.fresh(df.columns, "__media")
    return _map_binary(df.withColumn(again, F.col(media)), again, "samples binary, feature string", rows).drop(again)


def _feature(found: dict, track: dict, packets: list[dict], body: bytes) -> str:
    v = np.frombuffer(body, np.uint8).astype(np.int64) - 128
    kinds = {k: 0 for k in LACING}
    for p in packets:
        kinds[p["lacing"]] += 1
    last = max((p["timestamp_ns"] + (p["duration_ns"] or 0) for p in packets), default=0)
    return ";".join(
        [f"tracks={len(found['tracks'])}", f"codec={track['codec']}", f"rate={int(track['rate'])}", f"bits={track['bits']}", f"clusters={len({p['cluster'] for p in packets})}", f"packets={len(packets)}", *[f"{k}={n}" for k, n in kinds.items()], f"cues={len(found['cues'])}", f"end_ms={last // 1_000_000}", f"sum={int(v.sum())}", f"energy={int((v * v).sum())}", f"crossings={int(((v[1:] < 0) != (v[:-1] < 0)).sum())}", f"error={found['error'] or ''}"]
    )
