"""Ranks without a sort, neighbours without all pairs, texts by their trigrams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoslate.functions import expressions as X
from genoslate.operators import grams, layout, vectors, windows


@pytest.fixture
def small_rounds(monkeypatch):
    monkeypatch.setattr(windows, "SORTED_ROWS", 5)
    monkeypatch.setattr(windows, "CUTS", 6)
    monkeypatch.setattr(windows, "DRAWN", 24)


def test_keys_at_ranks_with_ties_and_nulls(spark, small_rounds):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.5, 1.5, 1.5, -2.0, float(rng.randrange(40))]), rng.choice(["x", "y", None])) for _ in range(400)]
    d = spark.createDataFrame(rows, "a double, b string")
    low = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    order = sorted(rows, key=low)
    ranks = [1, 2, 77, 200, 201, 399, 400]
    got = windows.keys_at_ranks(d, ["a", "b"], [0, *ranks, 401])
    assert [x.rank for x in got] == ranks
    for x in got:
        key = order[x.rank - 1]
        assert tuple(x.key) == key
        assert (x.below, x.equal) == (sum(low(r) < low(key) for r in rows), rows.count(key))
    assert windows.keys_at_ranks(d.limit(0), ["a"], [1]) == []


@pytest.mark.parametrize("values", [list(range(103)), [7] * 41, [1] * 30 + [2] * 50 + [None] * 9 + [5], [3, 1, 2], []])
def test_equal_parts_by_rank(spark, small_rounds, values):
    values = random.Random(1).sample(values, len(values))
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x int").repartition(3)
    got = windows.split_by_rank(d, ["x"], 4).collect()
    size = max(len(values) // 4, 1)
    want = [(v, min(r // size, 3) + 1) for r, v in enumerate(sorted(values, key=lambda v: (v is not None, v)))]
    assert sorted(r.i for r in got) == list(range(len(values)))
    assert sorted(((r.x is not None, r.x or 0), r.part) for r in got) == sorted(((v is not None, v or 0), p) for v, p in want)


def test_rows_at_fractions(spark, small_rounds):
    d = spark.createDataFrame([(i, i % 5) for i in range(90)], "i int, x int")
    assert [r.i for r in windows.at_fractions(d, ["x", "i"], [0.0, 0.5, 0.99, 1.0]).orderBy("x", "i").collect()] == [0, 47, 89]
    assert sorted(r.x for r in windows.at_fractions(d, ["x"], [0.0, 0.02, 0.25, 1.0]).collect()) == [0, 0, 1, 4]
    assert windows.at_fractions(d.limit(0), ["x"], [0.5]).count() == 0


def test_parts_are_not_shuffled(spark):
    d = spark.range(1000).withColumn("x", F.col("id") % 97)
    plan = windows.split_by_rank(d, ["x", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def plain_neighbours(rows, k):
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    return {(i, j) for i, v in unit.items() for j in sorted((j for j in unit if j != i and len(unit[j]) == len(v)), key=lambda j: (-round(float(v @ unit[j]), 9), j))[:k]}


@pytest.mark.parametrize("spread", [0.01, 3.0])
def test_neighbours_by_clusters(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + spread * rng.normal(size=8)).tolist()) for i in range(360)]
    rows += [(400, [0.0] * 8), (401, rows[0][1]), (402, rows[0][1]), (403, [1.0, 2.0]), (404, [2.0, 1.0])]
    d = spark.createDataFrame([*rows, (500, None), (501, [None, 1.0])], "vec_id long, embedding array<double>")
    tried = []
    got = vectors.nearest_per_query(d, d, 5, block_bytes=4096, tried=tried).collect()
    want = plain_neighbours(rows, 5)
    assert {(r["query"], r.vec_id) for r in got if r["query"] != 400} == {p for p in want if p[0] != 400}
    # a vector of zeros is as near to all
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == 400] == [0, 1, 2, 3, 4]
    compared, pairs = tried
    assert pairs == 363 * 363 + 4
    if spread < 1:
        assert compared < pairs / 3, tried


def test_no_queries_ask_no_clusters(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert vectors.nearest_per_query(d, d.limit(0), 3, block_bytes=64).count() == 0
    assert vectors.nearest_per_query(d.limit(0), d, 3, block_bytes=64).count() == 0


def test_texts_by_trigrams(spark, tmp_path):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abAB c") for _ in range(rng.choice([0, 2, 3, 30, 200]))) for _ in range(300)] + [None, "Straße 100%_x", "STRASSE", "a\\%b"]
    d = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "id int, t string")
    grams.write_index(d, "id", "t", str(tmp_path / "index"), buckets=5)
    index = grams.read_index(spark, str(tmp_path / "index"), "int")
    for patterns in (["abA"], ["CAB", "bbbb"], ["%ab%ba%"], ["ab"], ["straße"], ["%Stra_e%"], ["zzz", "aaaa"], ["%a\\%b%"]):
        want = [r.id for r in d.filter(F.exists(F.array(*[X.contains_text(F.col("t"), p) for p in patterns]), lambda x: F.coalesce(x, F.lit(False)))).collect()]
        got = [r.id for r in grams.search(d, index, "id", "t", patterns, buckets=5).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), patterns
    checked = grams.candidates(index, ["bbbb", "acaca"], 5).count()
    assert 0 < checked < 200
    assert grams.candidates(index, ["ab"], 5) is None and grams.search(d, index, "id", "t", [], 5).count() == 0
    grams.write_index(d.limit(0), "id", "t", str(tmp_path / "none"), buckets=5)
    assert grams.search(d, grams.read_index(spark, str(tmp_path / "none"), "int"), "id", "t", ["abc"], 5).count() == 0


def test_layout_tells_clusters_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.array([1.0, 0, 0] if i % 2 else [0, 1.0, 0]) + 0.05 * rng.normal(size=3)).tolist()) for i in range(40)]
    d = spark.createDataFrame([*rows, (90, None)], "vec_id long, embedding array<double>")
    found, off = layout.spectral_layout(d, 4, 20)
    at = {r.vec_id: (r.x, r.y, r.degree) for r in found.collect()}
    assert set(at) == set(range(40))
    odd, even = ([at[i][0] / at[i][2] ** 0.5 for i in range(40) if i % 2 == p] for p in (1, 0))
    assert max(odd) < min(even) or max(even) < min(odd)
    # against the eigenvectors of the whole matrix
    edges = [(r.a, r.b) for r in layout.neighbour_graph(d, 4).collect()]
    m = np.zeros((40, 40))
    for a, b in edges:
        m[a, b] = 1
    root = np.sqrt(m.sum(1))
    m /= np.outer(root, root)
    x, y = np.array([at[i][0] for i in range(40)]), np.array([at[i][1] for i in range(40)])
    for v, r in ((x, off[0]), (y, off[1])):
        assert abs(np.linalg.norm(v) - 1) < 1e-9 and abs(v @ root) < 1e-9
        assert abs(np.linalg.norm(m @ v - (v @ m @ v) * v) - r) < 1e-9
    assert abs(x @ y) < 1e-9 and off[0] < 1e-6 and (x @ m @ x) > 1 - 1e-6


def test_layout_of_few_rows(spark):
    d = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(2)], "vec_id long, embedding array<double>")
    found, off = layout.spectral_layout(d, 3, 2)
    rows = found.orderBy("vec_id").collect()
    assert abs(rows[0].x + rows[1].x) < 1e-9 and [r.y for r in rows] == [0.0, 0.0] and max(off) < 1e-6
    found, off = layout.spectral_layout(d.limit(0), 3, 1)
    assert found.count() == 0 and off == [0.0, 0.0]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_pairs_by_projections_keep_their_recall(spark, threshold):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    # a partner of each row somewhat over the threshold, where pairs are hardest to find
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = threshold + 0.002
    all_ = np.concatenate([base, (c * base + np.sqrt(1 - c * c) * off) * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(all_)] + [(900, None), (901, [0.0] * 32), (902, [0.0] * 32)]
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(cos >= threshold, 1)), strict=True)}
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = {(r.a, r.b): r.score for r in vectors.similar_pairs_lsh(df, threshold).collect()}
    assert len(want) >= 300 and set(got) <= want and len(got) >= 0.97 * len(want)
    assert all(abs(s - cos[p]) < 1e-9 for p, s in got.items())
    assert vectors.similar_pairs_lsh(df.filter("vec_id >= 900"), threshold).count() == 0


def test_low_thresholds_miss_no_pair(spark, monkeypatch):
    """All pairs by blocks; rows without a direction or with another length don't disturb it."""
    monkeypatch.setattr(vectors, "PAIR_ROWS", 90)
    all_ = np.random.default_rng(3).normal(size=(600, 16))
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    want = {(f"{a:03}", f"{b:03}") for a, b in np.argwhere(np.triu(unit @ unit.T >= 0.45, 1))}
    rows = [(f"{i:03}", v.tolist()) for i, v in enumerate(all_)]
    odd = [("x0", None), ("x1", [0.0] * 16), ("x2", [None] + [1.0] * 15), (None, [1.0] * 16), ("x3", [float("nan")] * 16), ("y0", [1.0, 0.0]), ("y1", [2.0, 0.1]), ("y2", [-1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id string, embedding array<float>")
    got = [(r.a, r.b) for r in vectors.similar_pairs_lsh(df, 0.45).select("a", "b").collect()]
    assert len(want) > 5000 and len(got) == len(set(got)) and set(got) == want | {("y0", "y1")}


def test_pairs_by_buckets_are_told_once(spark, monkeypatch):
    """Where buckets are chosen, small ones share groups and large ones are cut into parts."""
    monkeypatch.setattr(vectors, "ALL_PAIRS", 0)
    monkeypatch.setattr(vectors, "MOVED", 1)
    monkeypatch.setattr(vectors, "PAIR_ROWS", 40)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 32))
    near = base + 0.3 * rng.normal(size=base.shape)
    all_ = np.concatenate([base, near, np.repeat(base[:1], 130, axis=0)])
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    want = {(a, b) for a, b in np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))}
    n, far = len(all_), 0.2**0.5
    wide, k, tables = vectors._bucket_plan(n, 32, far, 0.99, 1.0)
    assert k > 1 and tables > 1 and 1 - (1 - vectors.meet_chance(wide) ** k) ** tables >= 0.99
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)] + [(900, None), (901, [0.0] * 32), (902, [1.0])], "vec_id int, embedding array<double>")
    got = [(r.a, r.b) for r in vectors.similar_pairs_lsh(df, 0.9).select("a", "b").collect()]
    same = {(a, b) for a, b in want if b >= 600 and (a == 0 or a >= 600)}
    assert len(got) == len(set(got)) and set(got) <= want and same <= set(got) and len(same) == 131 * 130 // 2
    assert len(want - same) > 100 and len(set(got) - same) >= 0.97 * len(want - same)


def test_buckets_pay_only_where_few_vectors_share_them():
    assert vectors._bucket_plan(10**7, 64, (2 - 2 * 0.45) ** 0.5, 0.99, 1.0) is None
    assert vectors._bucket_plan(10**7, 64, (2 - 2 * 0.95) ** 0.5, 0.99, 1.0) is not None


def test_buckets_meet_as_often_as_said():
    x = np.random.default_rng(4).normal(size=200_000)
    place = np.random.default_rng(5).random(200_000)
    for ratio in (0.3, 1.0, 4.0):
        met = np.floor(place) == np.floor(place + x / ratio)
        assert abs(met.mean() - vectors.meet_chance(ratio)) < 0.005
