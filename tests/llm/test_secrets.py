"""Base secrets by a scanner written from the contract, origins of layers by plain ranges, long layers by windows."""

import base64
import gzip
import hashlib
import random
import subprocess
import sys

from pyspark.sql import functions as F

from genoslate.llm import origins, queries, secret_scan

WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
UPPER = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def run(text, at, held):
    end = at
    while end < len(text) and text[end] in held:
        end += 1
    return end


def assigned(text, at):
    """The end of an assignment that begins at ``at``, and whether its value is long enough; None if none does."""
    low = "".join(c.lower() if c.isascii() else c for c in text[at : at + 8])
    for word in WORDS:
        if low.startswith(word):
            p = at + len(word)
            p += text[p : p + 1] in ("'", '"') and p < len(text)
            while text[p : p + 1] == " ":
                p += 1
            if text[p : p + 1] not in (":", "=") or p >= len(text):
                continue
            p += 1
            while text[p : p + 1] == " ":
                p += 1
            p += text[p : p + 1] in ("'", '"') and p < len(text)
            end = run(text, p, VALUE)
            if end > p:
                return end, end - p >= 6
    return None


def plain_base(text):
    out, at = [], 0
    while at < len(text):
        if hit := assigned(text, at):
            if hit[1]:
                out.append((at, 0, "assign", hit[0]))
            at = hit[0]
        else:
            at += 1
    at = text.find("AKIA")
    while at >= 0:
        end = run(text, at + 4, UPPER)
        if end - at >= 20:
            out.append((at, 1, "access", end))
        at = text.find("AKIA", max(end, at + 1) if end > at + 4 else at + 1)
    at = 0
    while at < len(text):
        end = run(text, at, set("0123456789abcdef"))
        if end - at >= 24:
            out.append((at, 2, "hex", end))
        at = max(end, at + 1)
    return [(k, a, b) for a, _, k, b in sorted(out)]


def made_text(rng):
    bits = [*WORDS, "Password", "API_KEY", "apıkey", "ſecret", "token", "'", '"', "=", ":", " ", "  ", "\n", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeefdeadbeefdeadbeef", "é", "hunter2xyz", "a.b-c=", "/+_", "short"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))


def test_base_spans_are_those_of_the_contract(spark):
    rng = random.Random(9)
    for _ in range(6000):
        text = made_text(rng)
        assert sorted(secret_scan.base_spans(text)) == sorted(plain_base(text)), text


def test_base_columns_of_the_query(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in queries.op3_secret_scan(spark, path).collect():
        want = plain_base(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[0] for x in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= {*r.spans.split(","), ""}


def test_origins_are_plain_ranges():
    rng = random.Random(1)
    for _ in range(300):
        runs, at = [], 0
        for _ in range(rng.randrange(1, 5)):
            at += rng.randrange(0, 3)
            runs.append((at, at + rng.randrange(1, 30)))
            at = runs[-1][1]
        letters = [i for a, b in runs for i in range(a, b)]
        for skip in range(4):
            n = (len(letters) - skip) * 6 // 8
            o = origins.Base64(runs, skip)
            for i in range(n):
                for j in range(i + 1, n + 1):
                    assert o.span(i, j) == (letters[skip + 8 * i // 6], letters[skip + (8 * (j - 1) + 7) // 6] + 1)
    text = "a%41%42é%C3%A9%43z日%20"
    raw, where = secret_scan._unescape(text, 100, secret_scan.PERCENT, secret_scan._percent)
    layer, chars = secret_scan._to_text(raw, where)
    assert layer == "aABééCz日 "
    assert [chars.span(i, i + 1) for i in range(len(layer))] == [(100, 101), (101, 104), (104, 107), (107, 108), (108, 114), (114, 117), (117, 118), (118, 119), (119, 122)]
    assert chars.span(2, 5) == (104, 114)


def test_long_layers_are_read_in_windows():
    noise = "".join(random.Random(2).choice("ghijklmnop \n") for _ in range(300_000))
    for at in (10, 99_990, 100_000, 187_000, 299_900):
        inner = noise[:at] + " password=hunter2xyz " + noise[at:]
        text = "x " + base64.b64encode(gzip.compress(inner.encode())).decode()
        got = secret_scan.scan(text, limit=100_000)
        kinds = {k for k, *_ in got}
        assert {"assign", "oversize"} <= kinds, at
        assert all((a, b) == (2, len(text)) for k, a, b, _ in got if k == "assign")
        assert "oversize" not in {k for k, *_ in secret_scan.scan(text)}


def test_a_long_base64_text_takes_bounded_memory():
    code = """
import base64, resource, sys
sys.path.insert(0, %r)
from genoslate.llm import secret_scan
inner = "password=hunter2xyz " + "plain words and more of them " * 640_000
text = base64.b64encode(inner.encode()).decode()
del inner
assert len(text) > 24_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = secret_scan.scan(text)
assert ("assign", 0, 26, "base64") in got, got[:3]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
""" % "/".join(__file__.split("/")[:-3])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-800:]
    assert int(out.stdout) < 500


def test_many_layers_of_awkward_rows(spark):
    deep = "password=hunter2xyz"
    for _ in range(6):
        deep = base64.b64encode(gzip.compress(deep.encode())).decode()
    rows = [(1, deep), (2, None), (3, ""), (4, "%70assword%3Dhunter2xyz"), (5, deep + "\n" + deep)]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumn("via", F.lit("v"))
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.find_secrets(d).collect()}
    assert got[2] == got[3] == [] and got[4] == ["assign"] and "assign" in got[1] and got[5].count("assign") >= 2
