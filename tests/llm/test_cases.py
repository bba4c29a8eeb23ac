"""Nulls, empty and long values, repeated rows, empty tables and clashing columns, with their exact results."""

import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoslate.llm import components, matroska, near_dedup, quality, secret_scan, suffix_dedup

from .test_llm import docs, odd  # noqa: F401


def test_matroska_columns(spark):
    rows = [(1, b"\x80" * 64, "a"), (2, None, "b"), (3, b"", None), (4, b"\x80" * 64, "a"), (5, bytes(range(256)) * 3000, "c")]
    df = spark.createDataFrame(rows, "id int, payload binary, feature string")
    clash = df.withColumns({n: F.lit(n) for n in ("samples", "packets", "__media", "__raw", "__text")})
    media = matroska.mux_column(clash)
    assert [c for c in media.columns if c != "media"] == clash.columns
    read = {r.id: r for r in matroska.read_samples(media).collect()}
    for i, raw, _ in rows:
        r = read[i]
        assert bytes(r.samples) == (raw or b"") and (r["packets"], r["__media"], r["__raw"], r["__text"]) == ("packets", "__media", "__raw", "__text")
    assert read[1].feature == read[4].feature and bytes(read[1].media) == bytes(read[4].media) and read[1].feature.endswith("error=")
    v = np.frombuffer(rows[4][1], np.uint8).astype(int) - 128
    said = dict(x.split("=", 1) for x in read[5].feature.split(";"))
    assert (int(said["sum"]), int(said["energy"]), int(said["bits"])) == (v.sum(), (v * v).sum(), 8)
    assert int(said["crossings"]) == ((v[1:] < 0) != (v[:-1] < 0)).sum() and int(said["packets"]) == sum(int(said[k]) for k in matroska.LACING)
    assert matroska.read_samples(matroska.mux_column(df.limit(0))).count() == 0 and matroska.parse_column(matroska.mux_column(df.limit(0))).count() == 0


def elements(data, at, end):
    """(id, body's start, body's end) of the EBML elements in a range, told from the format alone: leading zeros give lengths."""
    while at < end:
        n = 9 - data[at].bit_length()
        ident, at = data[at : at + n].hex(), at + n
        n = 9 - data[at].bit_length()
        size, at = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1), at + n
        yield ident, at, at + size
        at += size
    assert at == end


def frames(data, at, end):
    """(lacing, time within the cluster, frame) of a block's frames."""
    assert data[at] == 0x81
    time, kind, at = int.from_bytes(data[at + 1 : at + 3], "big", signed=True), data[at + 3] >> 1 & 3, at + 4
    if kind == 0:
        return [("none", time, data[at:end])]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for i in range(n - 1):
            w = 9 - data[at].bit_length()
            v = int.from_bytes(data[at : at + w], "big") - (1 << 7 * w)
            sizes.append(sizes[-1] + v - ((1 << 7 * w - 1) - 1) if i else v)
            at += w
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        out.append((("", "xiph", "fixed", "ebml")[kind], time, data[at : at + size]))
        at += size
    return out


def plain_feature(media):
    """The samples of a file with one track, and the feature, by a reader of its own."""
    header, segment = elements(media, 0, len(media))
    assert header[0] == "1a45dfa3" and segment[0] == "18538067"
    got, cues, clusters, starts = [], [], 0, set()
    number = lambda a, b: int.from_bytes(media[a:b], "big")
    for ident, a, b in elements(media, *segment[1:]):
        if ident == "1654ae6b":
            ((_, x, y),) = elements(media, a, b)
            entry = {i: (p, q) for i, p, q in elements(media, x, y)}
            audio = {i: (p, q) for i, p, q in elements(media, *entry["e1"])}
            codec, each_ns, bits = media[slice(*entry["86"])].decode(), number(*entry["23e383"]), number(*audio["6264"])
            rate = int(struct.unpack(">d", media[slice(*audio["b5"])])[0])
        elif ident == "1f43b675":
            starts.add(a - segment[1] - 4 - next(n for n in range(1, 9) if (b - a) < (1 << 7 * n) - 1))
            clusters += 1
            for i, p, q in elements(media, a, b):
                if i == "e7":
                    base = number(p, q)
                blocks = [(p, q)] if i == "a3" else [(r, s) for j, r, s in elements(media, p, q) if j == "a1"] if i == "a0" else []
                whole = [number(r, s) for j, r, s in elements(media, p, q) if j == "9b"] if i == "a0" else []
                for r, s in blocks:
                    found = frames(media, r, s)
                    for k, (kind, time, body) in enumerate(found):
                        end = whole[0] * 10**6 if whole else len(found) * each_ns
                        got.append((kind, (base + time) * 10**6 + k * each_ns, each_ns if k < len(found) - 1 else end - k * each_ns, body))
        elif ident == "1c53bb6b":
            for _, p, q in elements(media, a, b):
                point = {i: (r, s) for i, r, s in elements(media, p, q)}
                cues.append(number(*{i: (r, s) for i, r, s in elements(media, *point["b7"])}["f1"]))
    assert set(cues) == starts and len(cues) == clusters
    body = b"".join(x for *_, x in got)
    v = [x - 128 for x in body]
    kinds = Counter(k for k, *_ in got)
    feature = {
        "tracks": 1, "codec": codec, "rate": rate, "bits": bits, "clusters": clusters, "packets": len(got), **{k: kinds[k] for k in ("none", "xiph", "fixed", "ebml")}, "cues": len(cues),
        "end_ms": max(t + d for _, t, d, _ in got) // 10**6, "sum": sum(v), "energy": sum(x * x for x in v), "crossings": sum((x < 0) != (y < 0) for x, y in zip(v, v[1:])), "error": "",
    }
    return body, ";".join(f"{k}={x}" for k, x in feature.items())


def test_media_are_what_another_reader_finds(spark, docs):  # noqa: F811
    rng = np.random.default_rng(6)
    bodies = [t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64)) for _, t in docs[:150]] + [rng.integers(0, 256, n, np.uint8).tobytes() for n in (64, 512, 513, 4096, 5120, 40_000, 300_032)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, payload binary")
    rows = {r.id: r for r in matroska.read_samples(matroska.mux_column(df)).collect()}
    for i, body in enumerate(bodies):
        assert (bytes(rows[i].samples), rows[i].feature) == plain_feature(bytes(rows[i].media)), i
        assert bytes(rows[i].samples) == body


def test_secrets_of_awkward_rows(spark, odd):  # noqa: F811
    more = spark.createDataFrame([(20, "password=abcdef"), (21, "password=abcdef"), (22, "x" * 300_000 + " secret: 123456"), (None, "token=abcdefg")], "doc_id long, text string")
    clash = odd.select("doc_id", "text").unionByName(more).withColumns({"spans": F.lit("s"), "__text": F.lit("t")})
    got = secret_scan.find_secrets(clash).collect()
    assert all(r["__text"] == "t" for r in got)
    found = sorted((r.doc_id or -1, s.kind, s.start, s.end, s.via) for r in got for s in r.spans)
    assert found == [(-1, "assign", 0, 13, ""), (20, "assign", 0, 15, ""), (21, "assign", 0, 15, ""), (22, "assign", 300_001, 300_015, "")]


def test_byte_dedup_of_awkward_rows(spark, odd):  # noqa: F811
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(odd).collect())
    raw = [(str(r.doc_id), (r.text or "").encode()) for r in odd.collect()]
    count = {}
    for _, b in raw:
        for p in range(len(b) - 199):
            count[b[p : p + 200]] = count.get(b[p : p + 200], 0) + 1
    want = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        hit = np.cumsum(gone[:-1]) > 0
        want.append((i, len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())))
    assert got == sorted(want)


def test_features_are_counts(spark):
    texts = [b"abcabc  X9!", b"", b"a", "é é\n".encode()]
    got = quality.features(texts)
    for row, x in zip(got, texts):
        grams = {}
        for i in range(len(x) - 2):
            h = (x[i] * 2654435761 + x[i + 1] * 2246822519 + x[i + 2] * 3266489917) % 2**32
            h = ((h ^ (h >> 15)) * 2246822519 % 2**32) >> 22
            grams[h] = grams.get(h, 0) + 1
        want = np.zeros(quality.BUCKETS)
        for h, n in grams.items():
            want[h] = np.sqrt(n / (len(x) - 2))
        assert np.allclose(row[: quality.BUCKETS], want, atol=1e-6)
        if x:
            shares = [sum(65 <= c <= 90 for c in x), sum(48 <= c <= 57 for c in x), sum(32 < c < 127 and not chr(c).isalnum() for c in x), sum(c in b" \t\n\r\x0b\x0c" for c in x), x.count(b"\n")]
            assert np.allclose(row[quality.BUCKETS : quality.BUCKETS + 5], np.array(shares) / len(x), atol=1e-6)
    many = quality.features(texts * 3000)
    assert many.dtype == np.float32 and (many[:4] == got).all() and (many[-4:] == got).all()


def test_fit_lowers_the_non_negative_risk():
    rng = np.random.default_rng(2)
    pos = rng.normal(1.0, 1.0, (400, 5)).astype(np.float32)
    unl = np.concatenate([rng.normal(1.0, 1.0, (300, 5)), rng.normal(-1.0, 1.0, (300, 5))]).astype(np.float32)

    def risk(w):
        zp, zu = pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1]
        soft = lambda z: np.logaddexp(0, z)
        return 0.5 * soft(-zp).mean() + max(0.0, soft(zu).mean() - 0.5 * soft(zp).mean())

    w = quality.fit_pu(pos, unl, 0.5)
    assert risk(w) < 0.75 * risk(np.zeros(6))
    truth = np.r_[np.ones(300), np.zeros(300)]
    assert ((unl @ w[:-1] + w[-1] > 0) == truth).mean() > 0.95
    # no small step does better, up to the decay
    assert all(risk(w + d) > risk(w) - 2e-3 for d in 0.02 * rng.normal(size=(50, 6)))


def test_near_recall_at_the_threshold():
    """Pairs of sets at a similarity of 0.8: how many share a node of some tree, and pass the estimate."""
    rng = np.random.default_rng(12)
    trees = near_dedup.tree_count(3, 0.8, 0.99999)
    factors = near_dedup._factors(trees * 3)
    least = int(np.floor(trees * 3 * 0.8 - 5 * np.sqrt(trees * 3 * 0.16)))
    met = passed = 0
    pairs = 20_000
    for _ in range(pairs):
        u = rng.integers(0, 1 << 63, 180, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = u[:162], u[18:]  # 144 of 180
        x, y = ((s[:, None] * factors).min(axis=0) for s in (a, b))
        same = (x == y).reshape(trees, 3).all(axis=1).any()
        like = (x.astype(np.uint16) == y.astype(np.uint16)).sum() >= least
        met += same
        passed += same and like
    assert met >= 0.9999 * pairs - 3 and passed >= 0.9999 * pairs - 5
    print("recall at 0.8:", passed / pairs)


def test_components_of_awkward_links(spark):
    links = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (3, 3, "z"), (None, 4, "n"), (5, None, None), (2, 6, "w"), (2, 6, "w")], "a long, b long, root string")
    assert {(r.v, r.root) for r in components.components(links).collect()} == {(2, 1), (6, 1)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 64)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(chain, most_rounds=1)
