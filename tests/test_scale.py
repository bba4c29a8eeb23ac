"""What keeps its cost bounded on awkward input: long intervals, deep hierarchies, many patterns, large files, tables that others read."""

import hashlib
import random
import re
import resource

import pytest
from pyspark.sql import functions as F

from genoslate.functions import expressions as X
from genoslate.operators import filters, graph, hierarchy, intervals, joins, matching, registry, tags
from genoslate.sources import fasta, sinks, versions


def test_long_and_short_intervals_meet_once(spark):
    rng = random.Random(4)
    make = lambda n: [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 5, 40, 700, 9000, 200_000])) for i in range(n) for s in [rng.randrange(-500, 100_000)]]
    a, b = make(250) + [(900, "a", -5_000_000, 50_000_000), (901, None, 1, 9), (902, "a", None, 4)], make(250) + [(903, "a", 0, 40_000_000), (904, "b", 7, 7)]
    schema = "i int, k string, s long, e long"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for pad, inclusive in ((0, False), (30, True)):
        got = [(r.l_i, r.r_i) for r in joins.overlap_join(da, db, "k", "s", "e", 10, pad, inclusive).select("l_i", "r_i").collect()]
        hit = (lambda x, y: x[2] <= y[3] + pad and x[3] >= y[2] - pad) if inclusive else (lambda x, y: x[2] < y[3] and x[3] > y[2])
        want = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and None not in (x[1], x[2], y[2]) and hit(x, y)]
        assert sorted(got) == sorted(want)


def test_a_long_interval_is_written_a_few_times(spark):
    short = spark.range(100_000).select(F.lit("c").alias("k"), (F.col("id") * 500).alias("s"), (F.col("id") * 500 + 300).alias("e"))
    long = spark.createDataFrame([("c", 0, 50_000_000)], "k string, s long, e long")
    sizes = intervals.widths(5000)
    ends = F.col("s"), F.col("e")
    placed = lambda d: d.withColumn("__level", intervals.level_of(*ends, sizes))
    on_long, on_short = intervals._levels(placed(long), "__level"), intervals._levels(placed(short), "__level")
    rows = lambda d, other: intervals._binned(placed(d), *ends, 1, sizes, other, ["h", "g"], ["h"]).count()
    assert rows(long, on_short) <= 4 and rows(short, on_long) <= 6 * 100_000
    assert joins.overlap_join(short, long, "k", "s", "e", 5000).count() == 100_000


def test_a_deep_hierarchy_and_a_cycle(spark):
    n = 1200
    chain = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(n)] + [("x", None), ("b", "t5"), ("b", "a")], "predicate_id string, parent string")
    got = tags.hierarchy_closure(chain)
    assert got.count() == n * (n + 1) // 2 + (n - 5) + 1
    assert {r.ancestor for r in got.filter("child = 't1195'").collect()} == {f"t{i}" for i in range(1196, n + 1)}
    assert {(r.steps) for r in hierarchy.ancestors(chain.filter("parent IS NOT NULL AND parent <> 'a'"), "predicate_id", "parent").filter("child = 't3' AND ancestor = 't1003'").collect()} == {1000}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "predicate_id string, parent string")
    with pytest.raises(hierarchy.CycleError, match="a, b, c$"):
        tags.hierarchy_closure(ring)
    assert tags.hierarchy_closure(chain.limit(0)).count() == 0


def test_depth_of_a_long_chain_takes_few_jobs(spark):
    n = 5000
    nodes = spark.range(n + 4).select(F.col("id").alias("node"))
    edges = spark.range(n - 1).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    # two chains meet behind it, and a ring hangs beside
    more = spark.createDataFrame([(n, n - 1), (n, 17), (n + 1, n), (n + 2, n + 3), (n + 3, n + 2)], "child long, parent long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("depths", "depths")
    found = graph.depths(nodes, edges.unionByName(more))
    jobs = len(tracker.getJobIdsForGroup("depths"))
    spark.sparkContext.setJobGroup("other", "other")
    assert {r.node: r.depth for r in found.collect()} == {**{i: i for i in range(n + 2)}, n + 2: None, n + 3: None}
    assert jobs < 120, jobs


def plain_depths(nodes, edges):
    parents = {v: {p for c, p in edges if c == v and p in nodes} for v in nodes}
    out = {v: 0 for v in nodes if not parents[v]}
    while True:
        more = {v: 1 + max(out[p] for p in parents[v]) for v in nodes if v not in out and parents[v] <= out.keys()}
        if not more:
            return {v: out.get(v) for v in nodes}
        out |= more


def test_depths_of_random_graphs(spark):
    rng = random.Random(8)
    for _ in range(3):
        nodes = list(range(60))
        edges = [(c, p) for c in nodes for p in rng.sample(range(-2, 60), rng.choice([0, 1, 1, 1, 2, 3])) if p < c or rng.random() < 0.02]
        got = graph.depths(spark.createDataFrame([(v,) for v in nodes], "node int"), spark.createDataFrame(edges, "child int, parent int"))
        assert {r.node: r.depth for r in got.collect()} == plain_depths(nodes, edges)


def test_literals_are_needed_by_every_match():
    cases = {
        "abc": ["abc"], "ab": None, "a|abcd": None, "abcd|Xyzw": ["abcd", "xyzw"], "foo(bar)?baz": ["foo"], "abcd*ef": ["abc"], "ab+cdef": ["cdef"], "[abc]def.ghij": ["ghij"],
        r"\bkinase\b": ["kinase"], r"a\.bcd": ["a.bcd"], r"x{2,3}yzab": ["yzab"], "(abc|def)": None, "^tail-(spike|fiber)$": ["tail-"], r"\Qabc\E": None, "(?i)Nitrogen": ["nitrogen"], "abc[": None, r"\d+ ring": [" ring"], "abcd??efg": ["abc"], "é+tat": ["tat"],
    }
    assert {p: matching.literals(p) for p in cases} == cases
    rng = random.Random(3)
    atoms = ["a", "b", "cd", "(ab|c)", "[abc]", "a*", "b?", "(cd)+", ".", "d{1,2}", "bcd", r"\.", "a|b", "dab"]
    for _ in range(3000):
        p = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 7)))
        need = matching.literals(p)
        if need:
            for _ in range(20):
                t = "".join(rng.choice("abcd.") for _ in range(12))
                if re.search(p, t):
                    assert any(x in t for x in need), (p, t, need)


def test_many_patterns_are_tried_where_a_literal_stands(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    texts = [(rng.choice(["s", "t", None]), f"A{i}", rng.choice([None, " ".join(rng.sample(words, 3)).upper()]), " ".join(rng.sample(words, rng.randrange(0, 4))) or None) for i in range(300)]
    rules = [(rng.choice("st"), w if i % 3 else f"{w}.*{rng.choice(words)}|^{rng.choice(words)}", [f"tag{i % 50}"], rng.choice([None, None, "name", "accession"]), rng.choice([None, None, None, "a"])) for i, w in enumerate(rng.choices(words, k=10_000))]
    rules += [("s", "^.{2}b", ["short"], None, None), ("t", "A1", ["acc"], "accession", None)]
    d = spark.createDataFrame(texts, "source string, accession string, name string, description string")
    r = spark.createDataFrame(rules, "source string, pattern string, tags array<string>, field string, unless string")
    by = {}
    for s, p, t, f, u in rules:
        by.setdefault(s, []).append((re.compile(p, re.I), t[0], f, u and re.compile(u, re.I)))
    want = {}
    for s, a, n, x in texts:
        whole = " ".join(v for v in (n, x) if v is not None)
        seen = {t for p, t, f, u in by.get(s, []) if p.search({"accession": a, "name": n or ""}.get(f, whole)) and not (u and u.search(x or ""))}
        want[a] = sorted(seen)
    got = {y.accession: y.pattern or [] for y in tags.pattern_tags(d, r).collect()}
    assert got == want
    numbered = r.select(F.col("source").alias("__s"), F.col("pattern").alias("__p"), F.col("field").alias("__field"), F.monotonically_increasing_id().alias("__n"))
    tried = tags.tried_patterns(tags._keyed(d), numbered).count()
    assert tried < 0.05 * sum(len(by.get(s, [])) for s, *_ in texts)
    assert tags.pattern_tags(d, r.limit(0)).filter("pattern IS NOT NULL").count() == 0


def test_a_large_file_is_hashed_in_chunks(spark, tmp_path):
    want = {}
    for name, size in (("large.fna", 600 << 20), ("small.fna", 1000)):
        digest = hashlib.md5()
        with open(tmp_path / name, "wb") as f:
            for at in range(0, size, 1 << 20):
                chunk = (b"ACGT%012d" % at) * ((1 << 20) // 16)
                chunk = chunk[: size - at]
                f.write(chunk)
                digest.update(chunk)
        want[name[:-4]] = (size, digest.hexdigest())
    assert {r.genome_id: (r.length, r.md5) for r in fasta.file_inventory(spark, str(tmp_path)).collect()} == want
    assert {r.genome_id: (r.length, r.md5) for r in fasta.file_inventory(spark, str(tmp_path), "*l*.fna", whole=0).collect()} == {k: want[k] for k in ("large", "small")}
    # and in the memory of some chunks
    import pyarrow as pa

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    batch = pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}/large.fna"])], names=["path"])
    assert next(fasta._digests(iter([batch]))).column(1)[0].as_py() == want["large"][1]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    (tmp_path / "large.fna").unlink()


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        versions.current(spark, path)
    make = lambda rows: spark.createDataFrame(rows, "vec_id int, v string, at int")
    sinks.upsert_table(make([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", 1), (None, "n", 1)]), path, order=["at"])
    old = versions.current(spark, path)
    assert sorted(map(str, old.collect())) == sorted(map(str, make([(1, "b", 3), (2, "d", 1), (None, "n", 1)]).collect()))
    sinks.upsert_table(make([(2, "e", 1), (2, "f", 0), (3, "g", 1), (None, "m", 2)]), path, order=["at"])
    # what was opened before stays readable
    assert old.count() == 3 and sorted((r.vec_id or 0, r.v) for r in versions.current(spark, path).collect()) == [(0, "m"), (1, "b"), (2, "e"), (3, "g")]
    broken = make([(9, "x", 1)]).withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        versions.replace(broken, path)
    assert versions.current(spark, path).count() == 4
    versions.drop_old(spark, path)
    assert versions.current(spark, path).count() == 4 and len(versions._versions(spark, path)) == 1


def test_rules_that_look_at_other_rows_are_refused(spark):
    d = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 > 0, F.col("id")))
    assert filters.keep(d, lambda p: p["x"] < 10).count() == 8
    r = registry.Registry()
    r.register(registry.Predicate("mean", function=lambda p: p["id"] > p["id"].mean()))
    for run in (lambda: filters.keep(d, lambda p: p["id"] > p["id"].mean()).count(), lambda: r.ids("mean", d, "id").count()):
        with pytest.raises(Exception, match="by itself"):
            run()


def test_sql_rules_of_two_callers_dont_meet(spark):
    one, two = spark.range(3).withColumnRenamed("id", "x"), spark.range(5).withColumnRenamed("id", "x")
    a = registry.sql(spark, "SELECT * FROM {own} WHERE x >= :least", {"own": one}, least=1)
    b = registry.sql(spark, "SELECT * FROM {own} WHERE x >= :least", {"own": two}, least=1)
    assert (a.count(), b.count()) == (2, 4) and not spark.catalog.tableExists("own")


def test_windows_on_circles(spark):
    rows = spark.createDataFrame([(1, "c", 95, 105), (2, "c", 5, 9), (3, "c", 40, 50), (4, "c", -6, -2)], "protein_id int, contig_id string, start int, end_coord int")
    got = joins.circular_window(rows, rows.filter("protein_id = 2"), 12, F.lit(100))
    assert sorted(r.l_protein_id for r in got.collect()) == [1, 2, 4]
    assert [r.p for r in spark.createDataFrame([(-3,), (0,), (10,), (23,)], "x int").select(X.circular(F.col("x"), F.lit(10)).alias("p")).collect()] == [7, 0, 0, 3]
