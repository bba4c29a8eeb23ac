"""The pipeline's stages against plain calculations, and on the awkward cases."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from genoslate.llm import pieces, pipeline, quality
from genoslate.llm.queries import PIECE_MODEL, held_out

from .test_llm import D, brute_near, docs, odd, sha  # noqa: F401


def kept_lines(rows, least=10):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    out = []
    for r in rows:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if not (key(x) and seen[key(x)] >= least))
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def mixed(rows, weights=(3, 1, 2), budget=1.5):
    """Each row as often as the mix takes it: levels by bisection, then Pareto ranks."""
    size = lambda r: len(r["text"].encode().split())
    names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None] * any(r["source"] is None for r in rows)
    own = {s: [r for r in rows if r["source"] == s] for s in names}
    total = {s: sum(map(size, own[s])) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * total[s], mid * weight[s]) for s in names) < budget * sum(total.values()) else (low, mid)
    out = []
    for s in names:
        target = min(2 * total[s], high * weight[s])
        a, b = 0.0, 1e12
        classes = [(r, size(r), max(1, size(r).bit_length())) for r in own[s]]
        for _ in range(300):
            mid = (a + b) / 2
            a, b = (mid, b) if sum(n * min(2.0, mid * w) for _, n, w in classes) < target else (a, mid)
        ranked, rest = [], target
        for r, n, w in classes:
            times = min(2.0, b * w)
            whole = int(times + 1e-9)
            out += [r] * whole
            rest -= n * whole
            pi = times - whole
            if pi > 1e-9:
                u = (int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (pi / (1 - pi)), n, r))
        upto = 0
        for _, n, r in sorted(ranked, key=lambda x: x[0]):
            upto += n
            if upto <= rest or (rest > upto - n and rest - (upto - n) >= n / 2):
                out.append(r)
    return out


def test_pipeline_equals_plain_calculation(spark):
    """Every stage but the fitted one by a plain calculation on what the one before it kept."""
    table = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet").filter(~held_out())
    model = quality.train(table.select("doc_id", "text"), labels)
    good = quality.score(table, model).filter("predicted = 1").select(*pipeline.COLUMNS)
    rows = kept_lines([r.asDict() for r in good.collect()])
    near = brute_near([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = mixed([r for r in rows if near[r["doc_id"]][2]])
    sp = pieces.processor(PIECE_MODEL)
    want = []
    for r in rows:
        ids = sp.encode(r["text"])
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else "")))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, D).collect()]
    assert sorted(got) == sorted(want) and len({g[0] for g in got}) > 20


def test_stages_on_awkward_rows(spark, odd, tmp_path):  # noqa: F811
    labels = spark.createDataFrame([(8, 1), (12, 1), (10, 1), (6, 0), (7, 0)], "doc_id long, quality int, toxic int".replace(", toxic int", ""))
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    clash = odd.withColumns({n: F.lit(n) for n in ("score", "predicted", "__key", "v", "bin", "row", "n_tokens", "ids")})
    for name, stage in pipeline.STAGES:
        for rows in (clash, clash.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            n = out.count()
            if name != "tokens":
                assert out.columns == pipeline.COLUMNS
            if rows is not clash:
                assert n == 0
            elif name in ("lines", "tokens"):
                assert n == odd.count()
    lines = {r.doc_id: r for r in dict(pipeline.STAGES)["lines"](spark, clash, str(tmp_path)).collect()}
    assert lines[1].text == "" and lines[1].n_chars == 0 and lines[2].text == ""
    near = dict(pipeline.STAGES)["near"](spark, clash, str(tmp_path)).collect()
    assert sum(r.doc_id == 5 for r in near) == 2 and not any(r.doc_id == 7 for r in near)


@pytest.mark.parametrize("name", ["quality", "lines", "near", "mix", "tokens"])
def test_the_entry_lists_the_stages(name):
    import corpus_pipeline

    assert name in dict(corpus_pipeline.STAGES) and corpus_pipeline.run is pipeline.run
