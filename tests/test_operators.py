"""Operators on the seeded dataset, and range joins against their naive forms."""

import random

import numpy as np
from pyspark.sql import functions as F

from genoslate.functions import expressions as X
from genoslate.operators import aggregates, cards, classify, filters, graph, joins, pages, registry, sets, tags, validate, vectors, windows


def ids(df, c="protein_id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_registry_rules(spark, genomes):
    r = registry.Registry()
    registry.defaults(r)
    for n, t in genomes.items():
        t.createOrReplaceTempView(n)
    assert ids(r.ids("giant", genomes["proteins"])) == ["p04", "p07"]
    assert ids(r.ids("massive", genomes["proteins"])) == ["p07"]
    assert ids(r.ids("tiny", genomes["proteins"])) == ["p05"]
    assert ids(r.ids("unannotated", genomes["proteins"])) == ["p04", "p05", "p07", "p10"]
    assert ids(r.ids("confident_hit", genomes["proteins"], only=genomes["proteins"].filter("contig_id = 'c1'"))) == ["p01", "p02"]
    r.register(registry.Predicate("odd", function=lambda pdf: pdf["gene_index"] % 2 == 1))
    assert len(ids(r.ids("odd", genomes["proteins"]))) == 5
    assert r.categories() == ["annotation", "composition", "general", "size"] and r.get("nope") is None


def test_searches(genomes):
    p, a, b = genomes["proteins"], genomes["annotations"], genomes["bins"]
    assert ids(cards.search_proteins(p, a, b, accession="PF00142")) == ["p01"]
    assert len(ids(cards.search_proteins(p, a, b, taxonomy="archaea"))) == 5
    assert ids(cards.search_proteins(p, a, b, min_length=2000, max_length=3000)) == ["p04"]
    assert ids(filters.hypothetical(a)) == ["p03"]
    assert ids(filters.keyword_search(a, ["transporter", "hydrogenase"])) == ["p02", "p06", "p08"] or ids(filters.keyword_search(a, ["transporter", "hydrogenase"])) == ["p02", "p08"]
    assert ids(filters.annotated(p, a, False)) == ["p04", "p05", "p07", "p10"]
    assert [r.bin_id for r in cards.list_genomes(b).collect()] == ["b1", "b2", "b3"]
    assert {r.bin_id: r.rank_name for r in cards.list_genomes(b).collect()}["b1"] == "Asgard"
    assert pages.page_info(p, 5).first().truncated


def test_best_label_order_and_nulls(genomes):
    label = {r.protein_id: r.label for r in windows.best_label(genomes["annotations"]).collect()}
    assert label["p01"] == "NifH (PF00142)" and label["p08"] is None and label["p09"] == "a (PF00001)"


def test_cards_and_summaries(genomes):
    t = genomes
    card = {r.protein_id: r for r in cards.protein_cards(t["proteins"], t["annotations"]).collect()}
    assert card["p09"].domains == ["PF00001", "PF00002"] and card["p10"].is_hypothetical and card["p10"].length == 500
    g = {r.bin_id: r for r in cards.genome_cards(t["bins"], t["contigs"], t["proteins"], t["annotations"]).collect()}
    assert g["b1"].contigs == 2 and g["b2"].by_source == {"kegg": 2, "pfam": 1}
    assert aggregates.dataset_totals(t["bins"], t["contigs"], t["proteins"], t["annotations"]).first().n_annotated == 6
    assert {r.phylum: r.n for r in aggregates.phylum_counts(t["bins"]).collect()} == {"Asgard": 1, "Proteo": 1, "Unknown": 1}
    s = aggregates.set_summary(t["proteins"], t["annotations"], t["bins"]).first()
    assert s.n == 10 and "long_member" in s.notable and "contamination" in s.warnings
    by = {r.protein_id: r.by_source for r in aggregates.annotations_by_source(t["annotations"]).collect()}
    assert len(by["p09"]["pfam"]) == 3
    w = {r.protein_id: r.warnings for r in validate.reliability_warnings(t["proteins"], t["annotations"], t["bins"]).collect()}
    assert w["p10"] == ["contaminated_genome", "no_annotation"]
    made = aggregates.derive_bins(aggregates.derive_contigs(t["proteins"]), t["bins"].filter("bin_id <> 'b3'"))
    assert {r.bin_id: r.taxonomy for r in made.collect()}["b3"] == "unknown"


def test_tag_generation(spark, genomes):
    t = genomes
    exact = spark.createDataFrame([("pfam", "PF00374", ["nife"]), ("pfam", "PF00142", ["nitrogenase"])], "source string, accession string, tags array<string>")
    patterns = spark.createDataFrame([("pfam", "transport", ["transporter"])], "source string, pattern string, tags array<string>")
    ec = spark.createDataFrame([("1.1", ["oxidoreductase"]), ("1", ["enzyme"])], "prefix string, tags array<string>")
    vocabulary = spark.createDataFrame([("nife", "hydrogenase"), ("hydrogenase", "redox")], "predicate_id string, parent string")
    out = {r.protein_id: r.tags for r in tags.generate_tags(t["proteins"], t["annotations"], exact, patterns, vocabulary, ec).collect()}
    assert len(out) == 10 and "unannotated" in out["p10"]
    assert {"nife", "hydrogenase", "redox", "pfam:PF00374", "pfam_annotated", "multi_source"} <= set(out["p08"])
    assert "oxidoreductase" in out["p06"] and "enzyme" not in out["p06"] and "transporter" in out["p02"]
    assert {"giant", "massive"} <= set(out["p04"]) and "tiny" in out["p05"] and "hypothetical" in out["p03"]
    lost = tags.drop_conflicts(spark.createDataFrame([("p02", ["nife", "x"])], "protein_id string, tags array<string>"), t["annotations"], "nife", ["PF00374"], ["PF00005"], ["nife"])
    assert lost.first().tags == ["x"]
    top = tags.topology_tags(spark.createDataFrame([("a", "iiMMMooMMi"), ("b", None)], "id string, topology string")).collect()
    assert [(h.start, h.end) for h in top[0].helices] == [(3, 5), (8, 9)] and "multi_pass_membrane" in top[0].tags and top[1].tags == ["soluble_predicted"]


def test_neighborhood_and_context(spark, genomes):
    p = genomes["proteins"]
    hood = joins.position_neighborhood(p, p.filter("protein_id = 'p01'"), 2)
    assert [(r.protein_id, r.offset) for r in hood.orderBy("pos").collect()] == [("p01", 0), ("p02", 1), ("p03", 2)]
    assert joins.region_bounds(hood).first().strand_break
    labelled = hood.join(windows.best_label(genomes["annotations"]), "protein_id", "left").withColumn("tags", F.array(F.lit("abc")))
    expected = spark.createDataFrame([("p01", "ABC"), ("p01", "nothing")], "anchor string, keyword string")
    v = validate.context_validation(labelled, expected).first()
    assert (v.n_expected, v.n_found, v.nearest, v.is_valid) == (2, 1, 1, True)
    systems = classify.array_systems(genomes["loci"], p.join(windows.best_label(genomes["annotations"]), "protein_id", "left"), genomes["contigs"])
    assert {r.locus_id: (r.at_edge, r.is_orphan) for r in systems.collect()} == {"l1": (True, True), "l2": (False, True)}
    assert ids(classify.overlap_flags(p, genomes["loci"])) == ["p01", "p07"]


def test_overlap_join_equals_naive(spark):
    rng = random.Random(3)
    make = lambda n: [(i, rng.randrange(3), s := rng.randrange(500), s + rng.randrange(1, 80)) for i in range(n)]
    a, b = make(150), make(150)
    s = "id int, k int, s int, e int"
    da, db = spark.createDataFrame(a, s), spark.createDataFrame(b, s)
    for pad, inc in ((0, False), (7, True)):
        want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and ((x[2] <= y[3] + pad and x[3] >= y[2] - pad) if inc else (x[3] > y[2] and x[2] < y[3])))
        for width in (None, 10, 64, 1000):
            got = joins.overlap_join(da, db, "k", "s", "e", width, pad, inc)
            assert sorted((r.l_id, r.r_id) for r in got.collect()) == want


def test_distance_and_rank_join_equal_naive(spark):
    rng = random.Random(4)
    rows = [(i, i % 4, rng.randrange(2000)) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, k int, s int")
    got = sorted((r.l_id, r.r_id) for r in joins.distance_join(d, d, 30, "k", "s").collect())
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and abs(x[2] - y[2]) < 30)
    r = windows.rank_in_group(d, "k", ["s", "id"], "rank")
    flat = r.collect()
    got = sorted((x.anchor, x.id) for x in joins.rank_neighborhood(r, r.filter("id % 5 = 0"), "k", "rank", "id", 3).collect())
    assert got == sorted((a.id, x.id) for a in flat if a.id % 5 == 0 for x in flat if a.k == x.k and abs(a["rank"] - x["rank"]) <= 3)


def test_systems_and_pathways(spark):
    genes = spark.createDataFrame([(f"g{i}", "b", "c", i * 1000, i * 1000 + 900) for i in range(6)] + [("far", "b", "c", 90_000, 91_000)], "protein_id string, bin_id string, contig_id string, start int, end_coord int")
    hits = spark.createDataFrame([("g0", "cas1_TypeI", 50.0, 1e-9), ("g0", "cas9_TypeII", 90.0, 1e-9), ("g1", "m2", 80.0, 1e-9), ("g2", "m2", 80.0, 1e-9), ("g3", "Cas2_core", 10.0, 1e-9), ("far", "m1", 5.0, 1e-9)], "protein_id string, hmm_name string, score double, evalue double")
    table = spark.createDataFrame([("m1", "I", "I-A", "backbone", 1), ("m1", "III", "III-A", "effector", 2), ("m2", "I", "I-E", "backbone", 3), ("cas9_typeii", "II", "II-A", "effector", 4)], "model string, system string, subtype string, role string, position int")
    arrays = spark.createDataFrame([("a", "c", 7000, 8000)], "locus_id string, contig_id string, start int, end_coord int")
    placed, loci = classify.classify_systems(hits, genes, arrays, table, [("cas1|cas2", "adaptation")])
    got = {r.locus: (r.system, r.n_proteins, r.is_complete, r.near_array) for r in loci.collect()}
    assert got == {1: ("II", 4, True, True), 2: ("III", 1, False, False)}
    rules = spark.createDataFrame([("P", "s1", "K1"), ("P", "s1", "K2"), ("P", "s2", "K3"), ("Q", "s1", "K9")], "pathway string, step string, accession string")
    have = spark.createDataFrame([("b1", "K2"), ("b1", "K3"), ("b2", "K3"), (None, "K9")], "bin_id string, accession string")
    c = {(r.bin_id, r.pathway): (r.percent, r.status, r.missing) for r in classify.pathway_completeness(have, rules).collect()}
    assert c[("b1", "P")] == (100.0, "COMPLETE", []) and c[("b2", "P")] == (50.0, "INCOMPLETE", ["s1"]) and c[("b2", "Q")][0] == 0.0 and len(c) == 4
    sub = spark.createDataFrame([("p1", "x|y|[NiFe]_Group_1a", 1e-9)], "protein_id string, subject string, evalue double")
    call = classify.subgroup_calls(sub, spark.createDataFrame([("p1", "PF00001")], "protein_id string, accession string"), spark.createDataFrame([("1a", ["uptake"])], "subgroup string, tags array<string>"), [("NiFe", ["PF00374"])]).first()
    assert call.needs_curation and call.tags == ["hyddb_needs_curation", "hyddb_subgroup:1a", "uptake"]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    d = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = [r.vec_id for r in vectors.nearest_to_id(d, 5, 7).collect()]
    assert got == list(np.argsort(-s[5])[:7])
    per = vectors.nearest_per_query(d, d.filter("vec_id < 10"), 4).orderBy("query", "rank").collect()
    assert [r.vec_id for r in per] == [j for i in range(10) for j in np.argsort(-s[i])[:4]]
    assert all(r.vec_id >= 5 for r in vectors.nearest_to_set(d, d.filter("vec_id < 5"), 6, 0.0).collect())
    assert vectors.nearest_to_vector(d, x[0].tolist(), 1).first().vec_id == 0


def test_nearest_with_more_ties_than_places(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 16))
    ids = rng.permutation(400).tolist()
    d = spark.createDataFrame([(i, x[i % 8].tolist()) for i in ids], "vec_id long, embedding array<double>")
    for parts in (1, 7):
        per = vectors.nearest_per_query(d.repartition(parts), d.filter("vec_id < 20"), 5).orderBy("query", "rank").collect()
        assert [r.vec_id for r in per] == [j for q in range(20) for j in [j for j in range(q % 8, 400, 8) if j != q][:5]]


def test_sets_graph_and_scalars(spark):
    empty = spark.createDataFrame([], "set_name string, id int")
    two = spark.createDataFrame([(1,), (2,)], "id int")
    s = sets.set_add(sets.set_add(empty, "X", two), "x", two)
    assert s.count() == 2 and sets.set_remove(s, "X").count() == 0 and sets.set_list(s).first().n == 2
    assert sets.set_members(sets.set_remove(s, "x", two.filter("id = 1")), "X").first().id == 2
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("e", "f"), ("f", "e"), ("d", "zz")], "child string, parent string")
    assert {r.node: r.depth for r in graph.depths(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None}
    assert graph.summary(nodes, edges).first().n_roots == 2
    t = spark.createDataFrame([("Crystal structure of the lysozyme in complex with X", "K [EC:1.2.3.4 2.7.-.-] [EC:9]", 1500)], "t string, e string, n int")
    r = t.select(X.clean_title(F.col("t")).alias("t"), X.ec_numbers(F.col("e")).alias("e"), X.base_pairs(F.col("n")).alias("n"), X.clean_residues(F.lit("mXk*"), "X").alias("c"), X.genome_id(F.lit("/a/My genome-1.fna.gz")).alias("g"), X.circular(F.lit(-3), F.lit(10)).alias("m"), X.confidence(F.lit(1e-30)).alias("h")).first()
    assert tuple(r) == ("Lysozyme", ["1.2.3.4", "2.7.-.-"], "1.5 kb", "MXKX", "My_genome_1", 7, "high")
    merged = sets.merge_tag_maps(*[spark.createDataFrame([("k", [x])], "key string, tags array<string>") for x in "ba"])
    assert merged.first().tags == ["a", "b"]
    ev = spark.createDataFrame([("h", "e1", True, 0.9), ("h", "e2", False, 0.1)], "hypothesis_id string, entry_id string, supports boolean, confidence double")
    assert aggregates.evidence_confidence(ev).first().status == "supported"


def test_runs_and_clusters(spark):
    rows = [(i, "c", s, s + 5, k) for i, (s, k) in enumerate([(0, "a"), (3, "a"), (100, "a"), (104, "b"), (300, "a")])]
    d = spark.createDataFrame(rows, "id int, c string, s int, e int, k string")
    assert [r.cluster for r in windows.gap_clusters(d, ["c"], "s", "e", 10, ["id"]).orderBy("id").collect()] == [1, 1, 2, 2, 3]
    run = windows.consecutive_runs(d, ["c"], ["s"], F.col("k") == "a", 3).first()
    assert (run.first_rank, run.last_rank, run.run_length) == (0, 2, 3)
    parts = windows.split_by_rank(spark.range(10).withColumnRenamed("id", "x"), ["x"])
    assert [r.part for r in parts.orderBy("x").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 4, 4]


def test_large_groups_are_cut_into_ranges(spark, monkeypatch):
    """Ranks, clusters and runs are the same whether a group is sorted in one task or in ranges."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "hot", "x", None]), s := rng.randrange(900), s + rng.randrange(30), rng.choice("ab")) for i in range(600)]
    d = spark.createDataFrame(rows, "id int, c string, s int, e int, k string")

    def made():
        rank = windows.rank_in_group(d, "c", ["s", "id"], "r").orderBy("id").collect()
        cluster = windows.gap_clusters(d, ["c"], "s", "e", 4, ["id"]).orderBy("id").collect()
        runs = windows.consecutive_runs(d, ["c"], ["s", "id"], F.lit(True), 3, ["k"]).orderBy("c", "first_rank").collect()
        return [r.r for r in rank], [r.cluster for r in cluster], [tuple(r) for r in runs]

    whole = made()
    monkeypatch.setattr(windows, "SEGMENT_ROWS", 50)
    assert made() == whole and max(whole[1]) > 5 and len(whole[2]) > 5


def test_titles_of_structures(spark):
    cases = {
        "6abc_A Crystal structure of the lysozyme": "Lysozyme", "Electron microscopy structure of the ribosome": "Ribosome", "Apo form of kinase from E. coli": "Kinase",
        "Model of the capsid with RNA": "Capsid", "7F0N-ASSEMBLY1_A X-ray crystal structure of an  enzyme, long": "Enzyme", "NMR solution structure of DNA-bound repressor apo": "Repressor",
        "RNA-free helicase bound to ATP": "Helicase", "123": "?", "": "?", None: "?", "the Crystal structure of a thing": "Thing",
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in d.select("t", X.clean_title(F.col("t")).alias("c")).collect()} == cases


def test_titles_beyond_ascii(spark):
    """Words, ends and capitals are SQL's, which has one capital a letter."""
    cases = {
        "\u00dfheit": "\u1e9eheit", "the \u00e9lastase": "\u00c9lastase", "\u1fb3 x": "\u1fbc x", "\u1fb6 x": "\u1fb6 x", "\ufb01x": "\ufb01x", "\u01c6x": "\u01c4x", "\u019bx": "\u019bx",
        "Kinase w\u0130th X": "Kinase", "Kinase\u00a0": "Kinase", "Kinase\u3000 apo": "Kinase", "a\x0bkinase of": "A\x0bkinase of", "6abc_A\u2028 kinase": "6abc_A\u2028 kinase", "Kinase apo\u0085": "Kinase apo\u0085",
        "the an " * 9 + "kinase": "Kinase", "a crystal structure of " * 5 + "the " * 12 + "kinase": "Kinase", "the " * 30: "?",
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in d.select("t", X.clean_title(F.col("t")).alias("c")).collect()} == cases


def test_nearest_with_nulls_and_no_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.9, 0.1]), (3, [None, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query"], r.vec_id) for r in vectors.nearest_per_query(d, d, 1).collect()}
    assert got == {(0, 2), (2, 0), (5, 0)}
    assert vectors.nearest_per_query(d, d.limit(0), 3).count() == 0 and vectors.nearest_per_query(d.limit(0), d, 3).count() == 0
    assert vectors.nearest_to_set(d, d.filter("vec_id = 1"), 3).count() == 0


def test_depths_of_a_long_chain_end_in_an_error(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node int")
    edges = spark.createDataFrame([(i + 1, i) for i in range(7)] + [(i + 2, i) for i in range(6)], "child int, parent int")
    assert {r.node: r.depth for r in graph.depths(nodes, edges).collect()} == {i: i for i in range(8)}
    try:
        graph.depths(nodes, edges, most=3)
    except RuntimeError:
        return
    raise AssertionError("a path longer than allowed went unnoticed")


def test_error_scan_asks_for_indicators(spark, genomes):
    a = spark.createDataFrame([("p1", "Cas12f1-like_TNB", None, 1), ("p1", "tnpB protein", None, 2), ("p2", "Cas12f1-like_TNB", "x", 3), ("p3", "HTH_17", None, 4), ("p4", None, "IS605 family", 5), ("p4", "Cas12f1-like_TNB", None, 6)], "protein_id string, name string, description string, annotation_id int")
    problems = spark.createDataFrame([("Cas12f1-like_TNB", ["transposase", "tnpA", "tnpB", "IS605"]), ("HTH_17", [])], "domain string, indicators array<string>")
    out = validate.error_scan(a, genomes["proteins"], genomes["loci"], problems).collect()
    assert sorted((r.protein_id, r.detail) for r in out if r.kind == "problem_domain") == [("p1", "Cas12f1-like_TNB: tnpB protein"), ("p4", "Cas12f1-like_TNB: IS605 family")]
    assert sorted(r.protein_id for r in out if r.kind == "overlaps_array") == ["p01", "p07"]
    few = validate.error_scan(a, genomes["proteins"], genomes["loci"], problems, limit=1).collect()
    assert sorted((r.kind, r.protein_id) for r in few) == [("overlaps_array", "p01"), ("problem_domain", "p1")]


def test_arrays_count_csx_and_need_an_effector(spark):
    arrays = spark.createDataFrame([("a", "c", 5000, 6000), ("b", "c", 90_000, 91_000)], "locus_id string, contig_id string, start int, end_coord int")
    genes = spark.createDataFrame([("c", 5500, "Csx1"), ("c", 5600, "cas1"), ("c", 5700, "CAS2"), ("c", 5800, "csm5"), ("c", 5900, "cse2")], "contig_id string, start int, label string")
    contigs = spark.createDataFrame([("c", 91_500)], "contig_id string, length int")
    got = {r.locus_id: r for r in classify.array_systems(arrays, genes, contigs).collect()}
    assert got["a"].neighbors == ["cas1", "cas2", "csm5", "csx1"] and got["a"].system == "III" and not got["a"].is_complete and not got["a"].at_edge
    assert got["b"].is_orphan and got["b"].at_edge
