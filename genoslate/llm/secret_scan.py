r"""Secret scans through nested encodings.

Each text is the first layer of a worklist. A layer is scanned for secrets, and every piece of it that is
percent-encoded, holds ``\uXXXX`` or ``\xXX`` escapes, or is base64 is decoded to a further layer, until none is left.
Bytes in which gzip, zlib, bzip2 or xz data begin, whatever the encoding they came from, are expanded over all members and
to any depth; bytes that aren't UTF-8 are scanned too, as they are. Base64 is read at all four alignments, as paths or names
may stand before it, line by line as well as joined over line breaks. A layer is left out only if its text came from the same
characters before, so equal pieces are found at each place and cycles end; what an equal text holds is worked out once.
Any range of a layer can be traced to the original text (see ``origins``), and so are the secrets found.

Layers are scanned one at a time, so that memory follows the longest text and its layers, not their number. A decompressed layer longer than
``max_layer_chars`` bytes is read as a stream, in windows of that length which overlap by an eighth, and is also reported by a span of kind
``oversize`` over its piece: only what is longer than the overlap may be found in parts. Streams that break off or are broken are scanned as far as they go and reported
by a span of kind ``truncated`` or ``damaged``. A secret of text that is wrapped over lines may be found both joined and as
far as its line goes.

Defined cases: a null or empty text has no spans; equal texts give equal rows; an empty table gives an empty table;
columns named ``spans`` are replaced; positions are code points of the whole text, end exclusive.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common, origins

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"\S+")
LINE = re.compile(r"[^\n]+")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
UNICODE = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
#: Escapes as bytes, with the short ones that printed byte strings have; a line with HIGH holds more than ASCII.
BYTES = re.compile(UNICODE.pattern + r"""|\\([abfnrtv0'"\\])""")
HIGH = re.compile(r"\\(?:x|u00)[89A-Fa-f][0-9A-Fa-f]")
PLAIN = dict(zip("abfnrtv0'\"\\", (b"%c" % c for c in b"\a\b\f\n\r\t\v\0'\"\\"), strict=True))
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of one base64 text, by true or escaped line breaks.
BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}")
#: Where compressed data may begin inside other bytes: gzip, bzip2, xz, zlib.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
BZIP2 = re.compile(rb"BZh[1-9](?:1AY&SY|\x17rE8P\x90)")
#: Bytes that a decompressor is given at once.
CHUNK = 4096
#: What a slice is first asked, all texts at once, so that most are never looked at in Python.
HINTS = (r"(?i:password|passwd|secret|token|api_?key)", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]", r"[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*(?:\r?\n|\\n|\\r\\n)[ \t]*[A-Za-z0-9+/_-]")
MAX_LAYER_CHARS = 64 << 20
SPANS = "spans array<struct<kind: string, start: int, `end`: int, via: string>>"

#: Characters up to which what a layer holds is remembered; bytes that a decompressor gives at once.
REMEMBERED = 4096
GIVEN = 1 << 20
EVERY = (True,) * 5

Range = tuple[int, int]
Layer = tuple[str | None, object, str]


def base_spans(text: str, hints: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[str, int, int]]:
    """Secrets of one layer: (kind, start, end)."""
    out = []
    if hints[0]:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if hints[1]:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hints[2]:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _digest(text: str | bytes) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, digest_size=16).digest()


def _place(text: str, where) -> tuple:
    """What tells a layer at its place from all others."""
    return _digest(text), len(text), *where.span(0, 1), *where.span(len(text) - 1, len(text))


def _to_text(raw: bytes, where) -> tuple:
    """``raw`` as text and its origin; bytes that aren't UTF-8 are kept as surrogates."""
    text = raw.decode("utf-8", "surrogateescape")
    return text, where if len(text) == len(raw) else origins.within(where, origins.Decoded(text))


def _unescape(piece: str, at: int, pattern: re.Pattern, value) -> tuple:
    """The bytes that ``piece`` stands for, and their origin in the layer; ``value``: bytes for a match."""
    out, held, last = bytearray(), origins.Pieces(), 0

    def literal(a: int, b: int) -> None:
        part = piece[a:b]
        out.extend(part.encode("utf-8", "surrogateescape"))
        if part.isascii():
            held.add(at + a, b - a, 1, 1)
        else:
            for i, c in enumerate(part, at + a):
                n = len(c.encode("utf-8", "surrogateescape"))
                held.add(i, n, int(n == 1), 1)

    for m in pattern.finditer(piece):
        if (got := value(m)) is None:
            continue
        if last < m.start():
            literal(last, m.start())
        out.extend(got)
        size = m.end() - m.start()
        held.add(at + m.start(), len(got), size if len(got) == 1 else 0, size)
        last = m.end()
    if last < len(piece):
        literal(last, len(piece))
    return bytes(out), held


def _percent(m: re.Match) -> bytes:
    return bytes([int(m[0][1:], 16)])


def _code(m: re.Match) -> int | None:
    """The code point of an escape: a pair of surrogates is one, a surrogate by itself is none."""
    if m[1]:
        return 0x10000 + ((int(m[1], 16) & 0x3FF) << 10 | int(m[2], 16) & 0x3FF)
    code = int(m[3] or m[4], 16)
    return None if 0xD800 <= code < 0xE000 else code


def _unicode(m: re.Match) -> bytes | None:
    code = _code(m)
    return None if code is None else chr(code).encode()


def _byte(m: re.Match) -> bytes | None:
    if m[5]:
        return PLAIN[m[5]]
    code = _code(m)
    return None if code is None else bytes([code]) if code < 256 else chr(code).encode()


def _reader(raw: bytes, at: int):
    """(a new decompressor for what begins at ``at``, whether its magic is a long one); None where nothing compressed does."""
    if raw.startswith(b"\x1f\x8b\x08", at):
        return (lambda: zlib.decompressobj(31)), True
    if BZIP2.match(raw, at):
        return bz2.BZ2Decompressor, True
    if raw.startswith(b"\xfd7zXZ\0", at):
        return lzma.LZMADecompressor, True
    head = raw[at : at + 2]
    if len(head) == 2 and head[0] & 0x8F == 8 and not head[1] & 0x20 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj, False
    return None


def _stream(raw: bytes, at: int, make):
    """What one stream holds, piece by piece, as far as it can be read; returns where it ends, and '', 'truncated' or 'damaged'."""

    def read(steps, skip: int):
        d = make()
        for a, b in steps:
            data = raw[a:b]
            while True:
                try:
                    got = d.decompress(data, GIVEN)
                except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                    return a, "damaged"
                if len(got) > skip:
                    yield got[skip:]
                skip = max(0, skip - len(got))
                if d.eof:
                    return b - len(d.unused_data), ""
                data = getattr(d, "unconsumed_tail", b"")
                if not data and (getattr(d, "needs_input", True) or not got):
                    break
        return len(raw), "truncated"

    steps = [(a, min(a + CHUNK, len(raw))) for a in range(at, len(raw), CHUNK)]
    given = 0
    pieces = read(steps, 0)
    while True:
        try:
            piece = next(pieces)
        except StopIteration as stop:
            end, state = stop.value
            break
        given += len(piece)
        yield piece
    if state != "damaged":
        return end, state
    # once more, by single bytes where it broke, for all that comes before
    return (yield from read([x for x in steps if x[0] < end] + [(i, i + 1) for i in range(end, min(end + CHUNK, len(raw)))], given))


def _expanded(raw: bytes, limit: int) -> Iterator[tuple[bytes, int, int, str]]:
    """(content, start, end, state) of the compressed data in ``raw``, wherever it begins; members of one kind that follow each other are one.

    Content beyond ``limit`` comes in windows that overlap, all but the last with the state ``oversize``.
    """
    at = 0
    while at < len(raw):
        if at == 0 and _reader(raw, 0):
            start = 0
        elif m := MAGIC.search(raw, at):
            start = m.start()
        else:
            return
        if not (got := _reader(raw, start)):
            at = start + 1
            continue
        make, sure = got
        held, size, end, state, cut = [], 0, start, "", False
        while end < len(raw) and (now := _reader(raw, end)) and now[1] == sure and (end == start or raw[end] == raw[start]):
            stream = _stream(raw, end, make)
            while True:
                try:
                    piece = next(stream)
                except StopIteration as stop:
                    end, state = stop.value
                    break
                held.append(piece)
                size += len(piece)
                while size > limit:
                    window = b"".join(held)
                    yield window[:limit], start, len(raw), "oversize"
                    cut = True
                    held = [window[limit - limit // 8 :]]
                    size = len(held[0])
            if state:
                break
            if raw[start] == 0xFD:  # an xz stream may be padded with zeros
                end += len(raw[end:]) - len(raw[end:].lstrip(b"\0")) if raw[end:].lstrip(b"\0").startswith(b"\xfd7zXZ\0") else 0
        if inner := b"".join(held):
            yield inner, start, len(raw) if cut else end, state if sure or (state == "truncated" and start == 0) else ""
        at = start + 1 if state else max(end, start + 1)


def _layers(raw: bytes, where, whole: Range, how: str, limit: int) -> Iterator[Layer]:
    """``raw`` as a layer, and what is compressed in it, to any depth; a piece that can't be read in full is also given as None, by what it is."""
    yield *_to_text(raw, where), how
    seen: set[tuple] = set()
    todo = [(_expanded(raw, limit), len(raw), where, whole, how)]
    while todo:
        found, size, where, whole, how = todo[-1]
        if (got := next(found, None)) is None:
            todo.pop()
            continue
        inner, a, b, state = got
        at = whole if (a, b) == (0, size) else where.span(a, b)
        if state:
            yield None, origins.Whole(*at), state
        if (key := (_digest(inner), at)) not in seen:
            seen.add(key)
            own, deeper = origins.Whole(*at), f"{how}>compressed"
            yield *_to_text(inner, own), deeper
            todo.append((_expanded(inner, limit), len(inner), own, at, deeper))


def _base64(runs: list[Range], layer: str, end: int, limit: int) -> Iterator[Layer]:
    """The layers of a base64 run at its four alignments; ``runs``: its lines, ``end``: after the padding."""
    body = "".join(layer[a:b] for a, b in runs).replace("-", "+").replace("_", "/")
    for skip in range(4):
        n = len(body) - skip
        n -= n % 4 == 1
        raw = base64.b64decode(body[skip : skip + n] + "=" * (-n % 4))
        if raw:
            where = origins.Base64(runs, skip)
            yield from _layers(raw, where, (where.span(0, 1)[0], end), "base64", limit)


def scan(text: str, hints: tuple[bool, ...] = EVERY, limit: int = MAX_LAYER_CHARS) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, via) by start and kind; ``via`` names the layers around a secret, '' for none."""
    found = {s: "" for s in base_spans(text, hints[:3])}
    seen: set[tuple] = set()
    known: dict[str, tuple[list, list]] = {}
    todo: list[tuple[Iterator[Layer], object, str]] = [(_decoded(text, hints, limit), None, "")]
    while todo:  # a layer's pieces come one by one, each with all that it holds
        parts, where, via = todo[-1]
        if (got := next(parts, None)) is None:
            todo.pop()
            continue
        piece, inner, how = got
        path = f"{via}>{how}" if via else how
        at = origins.within(where, inner)
        if piece is None:
            found.setdefault((how, *at.span(0, 1)), path)
        elif piece and (place := _place(piece, at)) not in seen:
            seen.add(place)
            if len(piece) > REMEMBERED:
                spans, more = base_spans(piece), _decoded(piece, EVERY, limit)
            else:
                if piece not in known:
                    known[piece] = base_spans(piece), list(_decoded(piece, EVERY, limit))
                spans, more = known[piece][0], iter(known[piece][1])
            for kind, a, b in spans:
                found.setdefault((kind, *at.span(a, b)), path)
            todo.append((more, at, path))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((*s, via) for s, via in found.items()), key=lambda x: (x[1], order.get(x[0], 9), x[2]))


def _decoded(layer: str, hints: tuple[bool, ...], limit: int) -> Iterator[Layer]:
    """What ``layer`` holds in one encoding more: (text or None, origin in ``layer``, how)."""
    if hints[3] and ("%" in layer or "\\" in layer):
        for m in TOKEN.finditer(layer):
            if "%" in m[0] and PERCENT.search(m[0]):
                yield from _layers(*_unescape(m[0], m.start(), PERCENT, _percent), m.span(), "url", limit)
            if "\\" in m[0] and UNICODE.search(m[0]):
                raw, where = _unescape(m[0], m.start(), UNICODE, _unicode)
                yield *_to_text(raw, where), "unicode"
        for m in LINE.finditer(layer) if "\\" in layer else ():
            if HIGH.search(m[0]):
                yield from _layers(*_unescape(m[0], m.start(), BYTES, _byte), m.span(), "unicode", limit)
    if hints[4]:
        wrapped = []
        for m in WRAPPED.finditer(layer):
            runs = [(m.start() + r.start(), m.start() + r.end()) for r in BASE64_LINE.finditer(BREAK.sub(lambda x: " " * len(x[0]), m[0]))]
            if sum(b - a for a, b in runs) >= 16:
                wrapped.append(m.span())
                yield from _base64(runs, layer, m.end(), limit)
        at = 0
        for m in BASE64.finditer(layer):
            while at < len(wrapped) and wrapped[at][1] <= m.start():
                at += 1
            line = at < len(wrapped) and wrapped[at][0] <= m.start()  # that a stream ends with its line says nothing
            for got in _base64([(m.start(), m.start() + len(m[0].rstrip("=")))], layer, m.end(), limit):
                if not (line and got[2] in ("truncated", "damaged")):
                    yield got


def find_secrets(docs: DataFrame, text: str = "text", max_layer_chars: int = MAX_LAYER_CHARS) -> DataFrame:
    """``docs`` with spans: all secrets of the whole text and of the layers inside it."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("via", pa.string())]))

    def run(texts: list[bytes]) -> list[pa.Array]:
        column = pa.array(texts, pa.binary())
        hints = list(zip(*[pc.match_substring_regex(column, h).to_pylist() for h in HINTS], strict=True))
        rows = [scan(x.decode(), h, max_layer_chars) if any(h) else [] for x, h in zip(texts, hints, strict=True)]
        return [pa.array([[{"kind": k, "start": a, "end": b, "via": v} for k, a, b, v in r] for r in rows], kind)]

    return common.map_text(docs, SPANS, run, text)
