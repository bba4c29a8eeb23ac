"""Readers and writers on small files, each with something malformed."""

import gzip
import json

from pyspark.sql import functions as F

from genoslate.operators import pages
from genoslate.sources import fasta, sinks, tables
from genoslate.streaming import hits as stream


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    one = put(tmp_path / "x/a.faa", ">p1|c9|g1 # 10 # 40 # -1\nMKV\nLL*\n>c1_2 some words\nMM\n\n>c1_1 # 5 # 11 # 1\nMA\n")
    (tmp_path / "x/b.faa.gz").write_bytes(gzip.compress(b">z_1\nMKK\n"))
    put(tmp_path / "x/empty.faa", "")
    got = {r.protein_id: r for r in fasta.read_proteins(spark, [str(tmp_path / "x")]).collect()}
    assert set(got) == {"p1", "c1_2", "c1_1", "z_1"}
    p = got["p1"]
    assert (p.contig_id, p.bin_id, p.start, p.end_coord, p.strand, p.sequence) == ("c9", "g1", 10, 40, "-", "MKVLL")
    assert (got["c1_2"].contig_id, got["c1_2"].start, got["c1_2"].end_coord, got["c1_2"].gene_index) == ("c1", 1, 6, 0)
    assert {r.n_sequences for r in fasta.count_entries(spark, one).collect()} == {3}
    put(tmp_path / "g/bin7/bin7.faa", ">k_1 # 0 # 9 # 1\nMMM\n")
    assert fasta.read_gene_calls(spark, str(tmp_path / "g")).first().bin_id == "bin7"
    assert fasta.read_for_embedding(spark, str(tmp_path / "g")).first().genome == "bin7"
    n = put(tmp_path / "n/My gen-1.fna", ">c1 x\nACGT\nGG\n>c1\nAC!T\n")
    c = fasta.read_contigs(spark, n).orderBy("length").collect()
    assert [r.length for r in c] == [4, 6] and abs(c[1].gc_content - 4 / 6) < 1e-9
    q = fasta.quality_report(fasta.read_entries(spark, n)).first()
    assert (q.n_sequences, q.duplicate_ids, q.invalid_letters) == (2, 1, ["!"])
    assert not q.data_before_header
    junk = put(tmp_path / "j/junk.fna", "ACGT\n>c1\nAC\n")
    assert fasta.quality_report(fasta.read_entries(spark, junk)).first().data_before_header
    inv = fasta.file_inventory(spark, str(tmp_path / "n")).first()
    assert inv.genome_id == "My_gen_1" and len(inv.md5) == 32


def test_hits_and_maps(spark, tmp_path):
    a = put(tmp_path / "pfam_hits/h.tsv", "sequence_id\thmm_name\te_value\tbit_score\tali_from\tali_to\np1\tPF1\t1e-200\t50\t1\t9\np2\tPF2\tbad\t5\t2\t8\n")
    h = tables.read_hits(spark, a)
    r = {x.protein_id: x for x in h.collect()}
    assert r["p1"].source == "pfam" and r["p1"].evalue == 1e-200 and r["p2"].evalue is None and r["p1"].end_aa == 9
    ref = tables.read_reference(spark, put(tmp_path / "d.tsv", "PF1\tNifH\tnitrogenase\n"), "domain")
    assert {x.accession: x.name for x in tables.describe_hits(h, ref).collect()} == {"PF1": "NifH", "PF2": "PF2"}
    numbered = tables.with_annotation_ids(h)
    assert numbered.select("annotation_id").distinct().count() == 2
    known = spark.createDataFrame([("p1",)], "protein_id string")
    add = tables.addon_hits(h.withColumn("accession", F.lit("sys__comp")), known, "padloc", True).collect()
    assert [(x.description, x.name) for x in add] == [("sys", "comp")]
    tag = tables.read_tag_map(spark, put(tmp_path / "t.tsv", "#c\nPF1\ta, b\nPF2\n")).collect()
    assert [(x.key, x.tags) for x in tag] == [("PF1", ["a", "b"])]
    k = tables.read_reference(spark, put(tmp_path / "k.tsv", "knum\tdefinition\tsimplified_definition\nK1\tlong [EC:1.1]\tshort\n"), "ortholog").first()
    assert (k.ref_name, k.ref_description) == ("short", "long [EC:1.1]")
    v = tables.read_reference(spark, put(tmp_path / "v.tsv", "id\tn\ts\tcat\tdesc\nV1\t1\t2\tXr\ttail\n"), "viral").first()
    assert (v.accession, v.ref_name, v.ref_description) == ("V1", "Xr", "tail")
    f = tables.read_structural_hits(spark, put(tmp_path / "s.tsv", "gene\tprotein_id\tdatabase\ttarget\tevalue\tseq_identity\tdescription\ng\tp\tpdb\tt1\t\t90\td\ng\tp\tpdb\tt2\tx\t1\td\n")).collect()
    assert [(x.evalue, x.identity) for x in f] == [(1.0, 0.9)]
    best = tables.first_defense_hit(spark.createDataFrame([("p", "a__b", 1e-3), ("p", "c__d", 1e-9)], "protein_id string, accession string, evalue double"))
    assert best.first().label == "c d"
    top = pages.merge_hits(*[spark.createDataFrame([(e, t, 50.0)], "evalue double, target string, identity double") for e, t in ((None, "x"), (1e-5, "y"))], k=2).collect()
    assert [x.target for x in top] == ["y", "x"] and top[0].identity == 0.5


def test_loci_and_manifests(spark, tmp_path):
    c = put(tmp_path / "c.json", json.dumps({"clusters": [{"cluster_id": "k", "contig": "c", "start": 1, "end": 9, "bgc_type": "t", "protein_list": ["a", "b"]}]}))
    loci, members = tables.read_clusters_json(spark, c)
    assert loci.first().locus_type == "bgc" and [(r.protein_id, r.position) for r in members.collect()] == [("a", 0), ("b", 1)]
    t = tables.read_clusters_tsv(spark, put(tmp_path / "s1.tsv", "sequence_id\tstart\tend\ttype\tproteins\taverage_p\nc\t5\t20\tnrp\ta;b\t0.5\n")).first()
    assert (t.cluster_id, t.length, t.proteins, t.average_p, t.max_p) == ("s1_cluster_1", 15, ["a", "b"], 0.5, 0.0)
    g = tables.read_repeat_gff(spark, put(tmp_path / "a.gff", "##gff\nc\tm\trepeat_region\t5\t50\t1\t.\t.\trpt_family=CRISPR;ID=A1\nc\tm\trepeat_region\t5\t60\t1\t.\t.\trpt_family=CRISPR\nc\tm\tgene\t1\t2\t.\t.\t.\tx\n"))
    assert sorted(r.locus_id for r in g.collect()) == ["A1", "c_5_60"]
    j = tables.read_repeat_json(spark, put(tmp_path / "a.json", json.dumps({"arrays": [{"id": "x", "contig": "c", "startCoordinate": 1, "endCoordinate": 2, "metadata": {"n": "3"}}]})))
    assert j.first().locus_type == "crispr_array"
    m = tables.read_manifest(spark, put(tmp_path / "m.json", json.dumps({"genomes": [{"genome_id": "g", "taxonomy": {"completeness": 91.0}}]}))).first()
    assert (m.taxonomy, m.completeness, m.n_contigs) == ("unknown", 91.0, 0)
    q = tables.read_taxonomy_checks(spark, put(tmp_path / "q.json", json.dumps({"taxonomy": {"genus": "G"}, "completeness": 95.0}))).first()
    assert (q.label, q.is_complete) == ("G", True)
    w = tables.read_metrics(spark, put(tmp_path / "r.tsv", "N50\t1,234\nGC (%)\t50\n"), ["N50", "GC (%)"]).first()
    assert (w["N50"], w["GC (%)"]) == (1234.0, 0.5)
    lg = tables.read_log_metrics(spark, put(tmp_path / "l.txt", "found 1,200 genes\nmean 300.5\n"), {"genes": r"found ([\d,]+) genes", "mean": r"mean ([\d.]+)"}).first()
    assert (lg.genes, lg.mean) == (1200.0, 300.5)
    f = tables.read_findings(spark, put(tmp_path / "f.jsonl", '{"id":"1","title":"t","summary":"has {n} of {m}","evidence":"{\\"n\\": \\"3\\"}","genes":["a"]}\n{"id":"2","description":"d","evidence":"plain"}\n')).orderBy("id").collect()
    assert [r.description for r in f] == ["has 3 of {m}", "d"]
    z = tables.read_cazy_overview(spark, put(tmp_path / "o.tsv", "Gene ID\tEC#\tdbCAN_hmm\tDIAMOND\np\t-\tGH5_2(3-90)+CBM6(95-120)\t-\n")).orderBy("family").collect()
    assert [(r.family, r.start_aa, r.end_aa, r.family_class, r.ec_number) for r in z] == [("CBM6", 95, 120, "Carbohydrate-Binding Module", None), ("GH5_2", 3, 90, "Glycoside Hydrolase", None)]
    y = tables.read_cazy_json(spark, put(tmp_path / "z.json", json.dumps({"annotations": [{"protein_id": "p", "cazyme_family": "GH1", "start_position": 4}]})), spark.createDataFrame([("p",)], "protein_id string")).first()
    assert (y.accession, y.start_aa) == ("GH1", 4)


def test_sinks(spark, genomes, tmp_path):
    lines = [r.value for r in sinks.fasta_lines(genomes["proteins"]).collect()]
    assert len(lines) == 9 and lines[0].split("\n")[0] == ">p01" and len(lines[0].split("\n")[1]) == 80
    sinks.write_text(sinks.fasta_lines(genomes["proteins"]), str(tmp_path / "f"))
    assert fasta.read_entries(spark, str(tmp_path / "f")).count() == 9
    sinks.write_tsv(spark.createDataFrame([(1, ["a", "b"])], "x int, t array<string>"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first().t == "a,b"
    sinks.replace_tags(spark.createDataFrame([("p", ["a"])], "protein_id string, predicates array<string>"), str(tmp_path / "tags"))
    assert "updated_at" in sinks.read_tags(spark, str(tmp_path / "tags")).columns
    sinks.locus_view(spark, genomes["loci"], "crispr_array", "arrays_view")
    assert spark.table("arrays_view").count() == 2
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id int, v string"), spark.createDataFrame([(2, "c")], "vec_id int, v string")
    assert sorted((r.vec_id, r.v) for r in sinks.upsert(old, new).collect()) == [(1, "a"), (2, "c")]


def test_stream_counts_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder / "1.tsv", "sequence_id\thmm_name\tevalue\tbitscore\tenv_from\tenv_to\np1\tm\t1e-5\t3\t1\t2\nzz\tm\t1\t3\t1\t2\n")
    known = spark.createDataFrame([("p1",)], "protein_id string")
    for _ in range(2):
        q = stream.append(stream.stream_hits(spark, str(folder), known, "padloc"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert [r.protein_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["p1"]


def test_hits_are_read_by_column_name(spark, tmp_path):
    one = put(tmp_path / "a b/pfam.tsv", "sequence_id\thmm_name\tevalue\tscore_x\tbitscore\np1\tPF1\t1e-5\t7\t50\n")
    two = put(tmp_path / "a b/kofam.tsv", "bitscore\tevalue\thmm_name\tsequence_id\n77\t1e-9\tK1\tp2\n")
    put(tmp_path / "a b/other.tsv", "x\ty\n1\t2\n")
    for paths in ([one, two], str(tmp_path / "a b")):
        got = {r.protein_id: (r.source, r.accession, r.evalue, r.score) for r in tables.read_hits(spark, paths).collect()}
        assert got == {"p1": ("pfam", "PF1", 1e-5, 50.0), "p2": ("kegg", "K1", 1e-9, 77.0)}
    assert tables.read_hits(spark, str(tmp_path / "a b/other.tsv")).count() == 0


def test_gene_calls_are_numbered_in_file_order(spark, tmp_path):
    put(tmp_path / "g/b1/x.faa", ">c_9\nMA\n>c_1\nMA\n>d_5 # 4 # 9 # -1\nMA\n>c_4\nMA\n")
    put(tmp_path / "g/b2/y.faa", ">c_2\nMA\n")
    got = {(r.bin_id, r.protein_id): r.gene_index for r in fasta.read_gene_calls(spark, str(tmp_path / "g")).collect()}
    assert got == {("b1", "c_9"): 0, ("b1", "c_1"): 1, ("b1", "c_4"): 2, ("b1", "d_5"): 0, ("b2", "c_2"): 0}
