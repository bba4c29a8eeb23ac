"""Readers and writers, over files that are first written from the standard tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards, filters, grams, joins, sets, windows
from ..operators.shared import shared_dir
from ..sources import fasta, sinks
from ..sources import tables as S
from . import roles as R
from .roles import query, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}/{name}"


def text(*parts) -> F.Column:
    """The parts as one text; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def put(df: DataFrame, path: str, key: str, value, *order) -> str:
    """Text files of ``value``, one for each value of ``key`` in a folder of its own (``k=value``), in ``order``."""
    rows = df.withColumn("__k", F.col(key)).withColumn("value", value)
    rows.repartition("__k").sortWithinPartitions("__k", *order).select(F.col("__k").alias("k"), "value").write.partitionBy("k").text(path)
    return path


def put_json(df: DataFrame, path: str, key: str, name: str, row) -> str:
    """One JSON object for each value of ``key``: an array ``name`` of its rows."""
    whole = df.groupBy(F.col(key).alias("chunk")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias(name))).alias("value"))
    return put(whole, path, "chunk", F.col("value"))


def folder_key(column: str = "file"):
    return F.regexp_extract(column, "/k=([^/]*)/", 1)


_PROTEINS_SQL = """p AS (SELECT p_partkey, 'c' || p_partkey % 20 || '_' || p_partkey AS protein_id, 'c' || p_partkey % 20 AS contig_id, (p_partkey * 7 % 1000 + 1)::INTEGER AS start,
 repeat(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 12) AS s FROM part)"""


def _proteins(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    seq = F.repeat(F.regexp_replace(F.upper("p_name"), "[^A-Z]", ""), 12)
    start = (k * 7 % 1000 + 1).cast("int")
    return p.select(k, text("c", k % 20, "_", k).alias("protein_id"), text("c", k % 20).alias("contig_id"), start.alias("start"), (start + 3 * F.length(seq)).alias("end_coord"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), seq.alias("sequence"))


@query(
    "fasta_proteins",
    f"""WITH {_PROTEINS_SQL} SELECT protein_id, contig_id, start, start + 3 * length(s) AS end_coord, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
(row_number() OVER (PARTITION BY contig_id ORDER BY start, protein_id) - 1)::INTEGER AS gene_index, length(s) AS sequence_length, md5(s) AS sequence_md5 FROM p""",
)
def fasta_proteins(spark, d):
    """Export with wrapped lines and headers, and load again."""
    p = _proteins(spark, d)
    place = F.concat_ws(" ", F.lit("#"), "start", F.lit("#"), "end_coord", F.lit("#"), F.when(F.col("strand") == "+", "1").otherwise("-1"))
    path = folder(spark, "proteins")
    sinks.write_text(sinks.fasta_lines(p.withColumn("place", place), "place"), path)
    out = fasta.read_proteins(spark, path)
    return out.select("protein_id", "contig_id", "start", "end_coord", "strand", "gene_index", "sequence_length", F.md5("sequence").alias("sequence_md5"))


@query(
    "gene_calls",
    """WITH g AS (SELECT p_partkey, 'k=g' || p_partkey % 4 AS bin_id, 'c' || p_partkey % 3 AS contig_id, length(p_name) AS n FROM part)
SELECT contig_id || '_' || p_partkey AS protein_id, contig_id, bin_id, 0 AS start, 3 * n AS end_coord, '+' AS strand, (row_number() OVER (PARTITION BY bin_id, contig_id ORDER BY p_partkey DESC) - 1)::INTEGER AS gene_index FROM g""",
)
def gene_calls(spark, d):
    """Files without coordinates: the index is the place in the file (A2)."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("genome", text("g", k % 4))
    value = text(">c", k % 3, "_", k, "\n", F.translate("p_name", " ", "-"), "*")
    path = put(p, folder(spark, "calls"), "genome", value, F.desc("p_partkey"))
    return fasta.read_gene_calls(spark, path, "*.txt").select("protein_id", "contig_id", "bin_id", "start", "end_coord", "strand", "gene_index")


_DNA_SQL = "translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGN')"


def _dna():
    return F.translate(F.md5("c_name"), "0123456789abcdef", "ACGTACGTACGTACGN")


@query("contig_fasta", f"WITH c AS (SELECT c_custkey, {_DNA_SQL} AS s FROM customer) SELECT 'ctg' || c_custkey AS contig_id, s AS sequence, length(s) AS length, round(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s), 6) AS gc_content FROM c")
def contig_fasta(spark, d):
    c = table(spark, d, "customer").select(text(">ctg", F.col("c_custkey"), " some words\n", _dna()).alias("value"))
    path = folder(spark, "contigs")
    sinks.write_text(c, path)
    return fasta.read_contigs(spark, path).withColumn("gc_content", F.round("gc_content", 6))


@query("embedding_fasta", f"SELECT 'p' || c_custkey AS protein_id, {_DNA_SQL} AS sequence, 'k=' || c_nationkey AS genome FROM customer")
def embedding_fasta(spark, d):
    c = table(spark, d, "customer")
    path = put(c, folder(spark, "models"), "c_nationkey", text(">p", F.col("c_custkey"), " words\n", _dna(), "**"), "c_custkey")
    return fasta.read_for_embedding(spark, path, "*.txt")


def _checked(spark, d) -> str:
    c = table(spark, d, "customer")
    return put(c, folder(spark, "checked"), "c_nationkey", text(">s", F.col("c_custkey") % 7, " x\n", F.col("c_mktsegment")), "c_custkey")


@query(
    "fasta_quality",
    """SELECT c_nationkey::VARCHAR AS genome, count(*) AS n_sequences, sum(length(c_mktsegment))::BIGINT AS total_length, count(*) - count(DISTINCT c_custkey % 7) AS duplicate_ids,
array_to_string(list_sort(list_distinct(flatten(list(list_filter(string_split(regexp_replace(c_mktsegment, '[ACGTUNRYSWKMBDHV]', '', 'g'), ''), lambda x: x <> ''))))), ',') AS invalid_letters, false AS data_before_header FROM customer GROUP BY 1""",
)
def fasta_quality(spark, d):
    q = fasta.quality_report(fasta.read_entries(spark, _checked(spark, d)))
    return q.select(folder_key().alias("genome"), "n_sequences", "total_length", "duplicate_ids", F.array_join("invalid_letters", ",").alias("invalid_letters"), "data_before_header")


@query("entry_counts", "SELECT c_nationkey::VARCHAR AS genome, count(*) AS n_sequences FROM customer GROUP BY 1")
def entry_counts(spark, d):
    return fasta.count_entries(spark, _checked(spark, d)).select(folder_key().alias("genome"), "n_sequences")


@query("file_checksums", "WITH f AS (SELECT c_nationkey::VARCHAR AS genome, string_agg('>s' || c_custkey % 7 || ' x' || chr(10) || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS x FROM customer GROUP BY 1) SELECT genome, length(x) AS length, md5(x) AS md5 FROM f")
def file_checksums(spark, d):
    return fasta.file_inventory(spark, _checked(spark, d), "*.txt").select(folder_key().alias("genome"), "length", "md5")


@query(
    "hit_tables",
    """WITH h AS (SELECT l_partkey::VARCHAR AS protein_id, CASE l_returnflag WHEN 'A' THEN 'pfam' ELSE 'kegg' END AS source, 'S' || l_suppkey AS accession,
 CASE WHEN l_returnflag = 'A' THEN l_extendedprice WHEN l_linenumber % 2 = 0 THEN l_tax ELSE l_discount END AS evalue, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS score, l_linenumber AS start_aa, l_linenumber + 50 AS end_aa, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R'))
SELECT protein_id, source, accession, coalesce(s_name, accession) AS name, s_nationkey::VARCHAR AS description, evalue, score, start_aa, end_aa FROM h LEFT JOIN supplier ON s_suppkey = h.l_suppkey AND s_suppkey % 3 = 0""",
)
def hit_tables(spark, d):
    """Two files with other columns in another order, told apart by their paths, named from a reference list."""
    li = table(spark, d, "lineitem")
    of = lambda flag, *cols: li.filter(F.col("l_returnflag") == flag).select(*cols)
    ident, model = F.col("l_partkey").alias("sequence_id"), text("S", F.col("l_suppkey")).alias("hmm_name")
    line, root = F.col("l_linenumber"), folder(spark, "hits")
    sinks.write_tsv(of("A", ident, model, F.col("l_extendedprice").alias("evalue"), F.col("l_quantity").alias("bit_score"), line.alias("ali_from"), (line + 50).alias("ali_to")), f"{root}/pfam_hits")
    odd = F.when(line % 2 == 0, F.col("l_tax"))
    sinks.write_tsv(of("R", (line + 50).alias("env_to"), odd.alias("i_evalue"), F.col("l_discount").alias("c_evalue"), model, line.alias("env_from"), ident), f"{root}/kegg_hits")
    hits = S.read_hits(spark, [f"{root}/pfam_hits", f"{root}/kegg_hits"])
    names = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(text("S", F.col("s_suppkey"), "\t", F.col("s_name"), "\t", F.col("s_nationkey")).alias("value"))
    sinks.write_text(names, f"{root}/names")
    return S.describe_hits(hits, S.read_reference(spark, f"{root}/names", "domain"))


@query(
    "annotation_ids",
    "SELECT count(*) AS n, count(*) AS n_ids, true AS above FROM lineitem",
)
def annotation_ids(spark, d):
    """Ids are unique and above those that are there."""
    a = R.annotations(spark, d).drop("annotation_id")
    there = spark.createDataFrame([(1000,)], "annotation_id long")
    return S.with_annotation_ids(a, there).agg(F.count("*").alias("n"), F.countDistinct("annotation_id").alias("n_ids"), (F.min("annotation_id") > 1000).alias("above"))


@query("addon_hits", "SELECT l_partkey AS protein_id, 'padloc' AS source, 'sys' || l_suppkey % 5 || '__comp' || l_linenumber AS accession, 'sys' || l_suppkey % 5 AS description, 'comp' || l_linenumber AS name FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 25)")
def addon_hits(spark, d):
    li = table(spark, d, "lineitem")
    hits = li.select(F.col("l_partkey").alias("protein_id"), F.lit("?").alias("source"), text("sys", F.col("l_suppkey") % 5, "__comp", F.col("l_linenumber")).alias("accession"))
    return S.addon_hits(hits, R.proteins(spark, d).filter("sequence_length >= 25"), "padloc", True).select("protein_id", "source", "accession", "description", "name")


def _chunk():
    return F.floor(F.col("c_custkey") / 100)


@query("cazy_json", "SELECT c_custkey::VARCHAR AS protein_id, 'cazy' AS source, 'GH' || c_nationkey AS accession, c_mktsegment AS description, c_acctbal AS evalue, c_nationkey AS start_aa, c_nationkey + 9 AS end_aa FROM customer WHERE c_custkey % 2 = 0")
def cazy_json(spark, d):
    c = table(spark, d, "customer").withColumn("part", _chunk())
    row = F.struct(F.col("c_custkey").cast("string").alias("protein_id"), text("GH", F.col("c_nationkey")).alias("cazyme_family"), F.col("c_acctbal").alias("evalue"), F.col("c_nationkey").alias("start_position"), (F.col("c_nationkey") + 9).alias("end_position"), F.col("c_mktsegment").alias("substrate_prediction"))
    path = put_json(c, folder(spark, "cazy"), "part", "annotations", row)
    known = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("protein_id"))
    return S.read_cazy_json(spark, path, known).select("protein_id", "source", "accession", "description", "evalue", "start_aa", "end_aa")


@query(
    "cazy_overview",
    """WITH c AS (SELECT p_partkey::VARCHAR AS protein_id, p_size, p_partkey % 4 AS m FROM part), f AS (
SELECT protein_id, 'GH' || p_size AS family, 3 AS start_aa, 3 + p_size AS end_aa, m FROM c WHERE m <> 1 UNION ALL SELECT protein_id, 'CBM' || p_size, 100, 120, m FROM c WHERE m <> 1 UNION ALL SELECT protein_id, 'GT2', NULL, NULL, m FROM c WHERE m = 1)
SELECT protein_id, family, start_aa, end_aa, CASE WHEN m = 2 THEN '3.2.1.4' END AS ec_number, CASE left(family, 2) WHEN 'GH' THEN 'Glycoside Hydrolase' WHEN 'GT' THEN 'Glycosyltransferase' ELSE 'Carbohydrate-Binding Module' END AS family_class,
CASE WHEN family = 'GT2' THEN 'cellulose' END AS substrate FROM f""",
)
def cazy_overview(spark, d):
    p = table(spark, d, "part")
    m, size = F.col("p_partkey") % 4, F.col("p_size")
    call = text("GH", size, "(3-", size + 3, ")+CBM", size, "(100-120)")
    rows = p.select(F.col("p_partkey").alias("Gene ID"), F.when(m == 2, "3.2.1.4").otherwise("-").alias("EC#"), call.alias("dbCAN_hmm"), F.when(m == 1, "GT2").otherwise("-").alias("DIAMOND"))
    path = folder(spark, "overview")
    sinks.write_tsv(rows, path)
    substrates = spark.createDataFrame([("GT2", "cellulose")], "family string, substrate string")
    return S.read_cazy_overview(spark, path, substrates).select("protein_id", "family", "start_aa", "end_aa", "ec_number", "family_class", "substrate")


def _clusters(spark, d) -> str:
    members = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"].cast("string")).alias("protein_list"))
    o = table(spark, d, "orders").join(members, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("part", F.floor(F.col("o_orderkey") / 1000))
    row = F.struct(text("r", F.col("o_orderkey")).alias("cluster_id"), text("c", F.col("o_custkey")).alias("contig"), F.col("o_orderkey").cast("int").alias("start"), (F.col("o_orderkey") + 50).cast("int").alias("end"), F.col("o_orderstatus").alias("bgc_type"), F.col("o_orderpriority").alias("product"), "protein_list")
    return put_json(o, folder(spark, "clusters"), "part", "clusters", row)


@query("cluster_loci", "SELECT 'r' || o_orderkey AS locus_id, 'bgc' AS locus_type, 'c' || o_custkey AS contig_id, o_orderkey AS start, o_orderkey + 50 AS end_coord, o_orderstatus AS bgc_type FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def cluster_loci(spark, d):
    """Loci of a JSON file, with a key of their metadata."""
    loci, _ = S.read_clusters_json(spark, _clusters(spark, d))
    return loci.select("locus_id", "locus_type", "contig_id", "start", "end_coord", F.get_json_object("metadata", "$.bgc_type").alias("bgc_type"))


@query("cluster_members", "SELECT 'r' || l_orderkey AS locus_id, l_partkey::VARCHAR AS protein_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS \"position\" FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def cluster_members(spark, d):
    return S.read_clusters_json(spark, _clusters(spark, d))[1]


@query("cluster_table", "SELECT 'c' || c_nationkey AS contig_id, c_custkey::INTEGER AS start, c_custkey + 30 AS end_coord, 30 AS length, c_mktsegment AS bgc_type, c_name || ',' || c_custkey AS proteins, c_acctbal AS average_p, 0.0 AS max_p FROM customer")
def cluster_table(spark, d):
    """A table with members in one field and most probabilities missing."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    rows = c.select(text("c", F.col("c_nationkey")).alias("sequence_id"), k.alias("start"), (k + 30).alias("end"), F.col("c_mktsegment").alias("type"), text(F.col("c_name"), ";", k).alias("proteins"), F.col("c_acctbal").alias("average_p"))
    path = folder(spark, "table")
    sinks.write_tsv(rows, path)
    return S.read_clusters_tsv(spark, path).select("contig_id", "start", "end_coord", "length", "bgc_type", F.array_join("proteins", ",").alias("proteins"), "average_p", "max_p")


@query(
    "repeat_gff",
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'A' || event_id ELSE 'u' || user_id || '_' || event_id || '_' || event_id + 40 END AS locus_id, 'crispr_array' AS locus_type, 'u' || user_id AS contig_id, event_id AS start, event_id + 40 AS end_coord
FROM events WHERE event_type = 'error'""",
)
def repeat_gff(spark, d):
    """Repeat regions among other rows and comments, with and without an id."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    attributes = text("rpt_family=", F.when(F.col("event_type") == "error", "CRISPR").otherwise("other"), F.when(k % 3 == 0, text(";ID=A", k)).otherwise(F.lit("")))
    line = text("u", F.col("user_id"), "\tm\t", F.when(F.col("event_type") == "view", "gene").otherwise("repeat_region"), "\t", k, "\t", k + 40, "\t1\t.\t.\t", attributes)
    path = folder(spark, "gff")
    sinks.write_text(e.select(F.explode(F.array(F.lit("##comment"), line)).alias("value")), path)
    return S.read_repeat_gff(spark, path).select("locus_id", "locus_type", "contig_id", "start", "end_coord")


@query("repeat_json", "SELECT 'a' || c_custkey AS locus_id, 'crispr_array' AS locus_type, 'n' || c_nationkey AS contig_id, c_custkey AS start, c_custkey + 5 AS end_coord, c_mktsegment AS repeats FROM customer")
def repeat_json(spark, d):
    c = table(spark, d, "customer").withColumn("part", _chunk())
    k = F.col("c_custkey").cast("int")
    keys = F.struct(F.col("c_mktsegment").alias("repeats"))
    row = F.struct(text("a", k).alias("id"), text("n", F.col("c_nationkey")).alias("contig"), k.alias("startCoordinate"), (k + 5).alias("endCoordinate"), keys.alias("metadata"))
    loci = S.read_repeat_json(spark, put_json(c, folder(spark, "arrays"), "part", "arrays", row))
    return loci.select("locus_id", "locus_type", "contig_id", "start", "end_coord", F.get_json_object("metadata", "$.repeats").alias("repeats"))


@query(
    "reference_lists",
    """SELECT 'K' || s_suppkey AS accession, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || ' [EC:1.1]' END AS ref_name, s_name || ' [EC:1.1]' AS ref_description FROM supplier
UNION ALL SELECT 'V' || n_nationkey, 'Xr', n_name FROM nation""",
)
def reference_lists(spark, d):
    """The ortholog list, whose short names may be missing, and the viral list."""
    k, full = F.col("s_suppkey"), text(F.col("s_name"), " [EC:1.1]")
    one, two = folder(spark, "ortholog"), folder(spark, "viral")
    sinks.write_tsv(table(spark, d, "supplier").select(text("K", k).alias("knum"), full.alias("definition"), F.when(k % 2 == 0, F.col("s_name")).alias("simplified_definition")), one)
    sinks.write_tsv(table(spark, d, "nation").select(text("V", F.col("n_nationkey")).alias("group"), F.lit(1).alias("proteins"), F.lit(2).alias("species"), F.lit("Xr").alias("category"), F.col("n_name").alias("about")), two)
    return S.read_reference(spark, one, "ortholog").unionByName(S.read_reference(spark, two, "viral"))


@query(
    "tag_maps",
    """WITH m AS (SELECT c_mktsegment AS key, 'n' || c_nationkey AS tag FROM customer UNION SELECT c_mktsegment, 'x' FROM customer UNION SELECT 'BUILDING', 'house')
SELECT key, string_agg(tag, ',' ORDER BY tag) AS tags FROM m GROUP BY key""",
)
def tag_maps(spark, d):
    """A tag map with comments, merged with another."""
    c = table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()
    path = folder(spark, "map")
    sinks.write_text(c.select(F.explode(F.array(F.lit("# key, tags"), text(F.col("c_mktsegment"), "\tn", F.col("c_nationkey"), " , x"))).alias("value")), path)
    other = spark.createDataFrame([("BUILDING", ["house", "x"])], "key string, tags array<string>")
    return sets.merge_tag_maps(S.read_tag_map(spark, path), other).select("key", F.array_join("tags", ",").alias("tags"))


@query("genome_manifest", "SELECT c_name AS bin_id, c_acctbal AS completeness, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'd__x' ELSE 'unknown' END AS taxonomy, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END AS n_contigs FROM customer")
def genome_manifest(spark, d):
    c = table(spark, d, "customer").withColumn("part", _chunk())
    k = F.col("c_custkey")
    lineage = F.struct(F.when(k % 3 == 0, F.col("c_mktsegment")).alias("name"), F.when(k % 3 == 1, "d__x").alias("taxonomy"), F.col("c_acctbal").alias("completeness"))
    row = F.struct(F.col("c_name").alias("genome_id"), lineage.alias("taxonomy"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("n_contigs"))
    return S.read_manifest(spark, put_json(c, folder(spark, "manifest"), "part", "genomes", row)).select("bin_id", "completeness", "taxonomy", "n_contigs")


@query("taxonomy_checks", "SELECT n_nationkey::VARCHAR AS genome, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'genus' ELSE 'unknown' END AS label, n_nationkey * 5.0 AS completeness, n_nationkey * 5.0 > 90 AS is_complete FROM nation")
def taxonomy_checks(spark, d):
    k = F.col("n_nationkey")
    lineage = F.struct(F.when(k % 3 == 0, F.col("n_name")).alias("species"), F.when(k % 3 == 1, "genus").alias("genus"))
    path = put(table(spark, d, "nation"), folder(spark, "checks"), "n_nationkey", F.to_json(F.struct(lineage.alias("taxonomy"), (k * 5.0).alias("completeness"))))
    return S.read_taxonomy_checks(spark, path).select(folder_key().alias("genome"), "label", "completeness", "is_complete")


@query("assembly_metrics", "SELECT c_nationkey::VARCHAR AS genome, count(*)::DOUBLE * 1000 AS n50, count(*) / 100 AS gc FROM customer GROUP BY 1")
def assembly_metrics(spark, d):
    """Metric and value rows with thousands commas and a percentage, one wide row a file."""
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    value = text("N50\t", F.format_number(F.col("n") * 1000, 0), "\nGC (%)\t", F.col("n"))
    path = put(n, folder(spark, "metrics"), "c_nationkey", value)
    return S.read_metrics(spark, path, ["N50", "GC (%)"]).select(folder_key().alias("genome"), F.col("N50").alias("n50"), F.col("GC (%)").alias("gc"))


@query("log_metrics", "SELECT c_nationkey::VARCHAR AS genome, count(*)::DOUBLE * 1000 AS genes, max(c_acctbal) AS mean FROM customer GROUP BY 1")
def log_metrics(spark, d):
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("m"))
    value = text("started\nfound ", F.format_number(F.col("n") * 1000, 0), " genes\nmean: ", F.col("m"), "\n")
    path = put(n, folder(spark, "logs"), "c_nationkey", value)
    return S.read_log_metrics(spark, path, {"genes": r"found ([\d,]+) genes", "mean": r"mean: (-?[\d.]+)"}).select(folder_key().alias("genome"), "genes", "mean")


@query("findings_file", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'plain' WHEN o_orderkey % 3 = 1 THEN 'has ' || o_custkey || ' of {m}' ELSE 'has {n} of {m}' END AS description, 1 AS n_genes FROM orders")
def findings_file(spark, d):
    """Findings with summaries for descriptions and names filled in from their evidence, which may be plain text."""
    k = F.col("o_orderkey")
    evidence = F.when(k % 3 == 1, text('{"n": "', F.col("o_custkey"), '"}')).otherwise(F.lit("seen"))
    rows = table(spark, d, "orders").select(k.cast("string").alias("id"), F.when(k % 3 == 0, "plain").alias("description"), F.lit("has {n} of {m}").alias("summary"), evidence.alias("evidence"), F.array(F.lit("g")).alias("genes"))
    path = folder(spark, "findings")
    sinks.write_json(rows, path)
    return S.read_findings(spark, path).select("id", "description", F.size("genes").alias("n_genes"))


@query("structural_hits", "SELECT event_id::VARCHAR AS protein_id, 't' || user_id AS target, CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE value END AS evalue, CASE WHEN event_id % 2 = 0 THEN 0.9 ELSE 0.25 END AS identity FROM events WHERE event_id % 7 <> 0 OR event_id % 5 = 0")
def structural_hits(spark, d):
    """Empty e-values count as 1, unreadable ones go, percentages become shares."""
    k = F.col("event_id")
    value = F.when(k % 5 == 0, "").when(k % 7 == 0, "bad").otherwise(F.col("value").cast("string"))
    rows = table(spark, d, "events").select(k.cast("string").alias("protein_id"), F.lit("pdb").alias("database"), text("t", F.col("user_id")).alias("target"), value.alias("evalue"), F.when(k % 2 == 0, 90.0).otherwise(0.25).alias("seq_identity"), F.lit("x").alias("description"))
    path = folder(spark, "structures")
    sinks.write_tsv(rows, path)
    return S.read_structural_hits(spark, path).select("protein_id", "target", "evalue", "identity")


@query("defense_labels", "SELECT l_partkey AS protein_id, 'sys' || (arg_min(l_suppkey, (l_extendedprice, 'sys' || l_suppkey))) || ' part' AS label FROM lineitem GROUP BY 1")
def defense_labels(spark, d):
    """The best hit of each protein, its name in words."""
    li = table(spark, d, "lineitem")
    return S.first_defense_hit(li.select(F.col("l_partkey").alias("protein_id"), text("sys", F.col("l_suppkey"), "__part").alias("accession"), F.col("l_extendedprice").alias("evalue")))


@query("embedding_store", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, len(embedding) AS dim FROM embeddings")
def embedding_store(spark, d):
    """Vectors written and loaded again."""
    path = folder(spark, "vectors")
    table(spark, d, "embeddings").write.mode("overwrite").parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return S.load_embeddings(spark, path).select("vec_id", F.round(total, 5).alias("total"), F.size("embedding").alias("dim"))


@query(
    "neighborhood_fasta",
    f"""WITH {R.GENES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY t_us, protein_id) - 1 AS i FROM g)
SELECT '>' || r.protein_id || ' pos=' || CASE WHEN r.i >= a.i THEN '+' ELSE '' END || (r.i - a.i) || ' strand=' || r.strand || CASE WHEN r.protein_id = a.protein_id THEN ' [ANCHOR]' ELSE '' END || ' ' || r.label || chr(10) || repeat('M', 80) || CASE WHEN r.protein_id % 2 = 0 THEN chr(10) || 'MM' ELSE '' END AS value
FROM r JOIN r a ON r.contig_id = a.contig_id AND abs(r.i - a.i) <= 1 WHERE a.label = 'signup'""",
)
def neighborhood_fasta(spark, d):
    """Headers with place, strand and anchor, wrapped letters."""
    g = windows.rank_in_group(R.genes(spark, d), "contig_id", ["t_us", "protein_id"])
    g = g.withColumn("sequence", F.repeat(F.lit("M"), F.when(F.col("protein_id") % 2 == 0, 82).otherwise(80)))
    return sinks.neighborhood_fasta_lines(joins.rank_neighborhood(g, g.filter("label = 'signup'"), "contig_id", "gene_index", "protein_id", 1))


@query("table_files", "SELECT p_partkey::VARCHAR AS protein_id, replace(p_name, ' ', ',') AS tags, p_retailprice AS score FROM part")
def table_files(spark, d):
    """A tag table as TSV and its scores as JSON, read again."""
    p = table(spark, d, "part")
    one, two = folder(spark, "tsv"), folder(spark, "json")
    sinks.write_tsv(p.select(F.col("p_partkey").alias("protein_id"), F.split("p_name", " ").alias("tags")), one)
    sinks.write_json(p.select(F.col("p_partkey").cast("string").alias("protein_id"), F.col("p_retailprice").alias("score")), two)
    tags = spark.read.csv(one, sep="\t", header=True)
    return tags.join(spark.read.schema("protein_id string, score double").json(two), "protein_id")


@query("tag_store", f"WITH {R.TAGS_SQL} SELECT protein_id, array_to_string(tags, ',') AS tags, true AS dated FROM t")
def tag_store(spark, d):
    """The tag table replaced as a whole, with its time."""
    path = folder(spark, "tags")
    sinks.replace_tags(R.part_tags(spark, d).limit(1), path)
    sinks.replace_tags(R.part_tags(spark, d), path)
    return sinks.read_tags(spark, path).select("protein_id", F.array_join("tags", ",").alias("tags"), F.col("updated_at").isNotNull().alias("dated"))


@query("typed_view", f"WITH {R.GENES_SQL} SELECT protein_id AS locus_id, start FROM g WHERE label = 'purchase'")
def typed_view(spark, d):
    """A view of one type of loci."""
    loci = R.genes(spark, d).withColumnRenamed("protein_id", "locus_id").withColumnRenamed("label", "locus_type")
    name = f"loci_{uuid.uuid4().hex}"
    sinks.locus_view(spark, loci, "purchase", name)
    return spark.table(name).select("locus_id", "start")


@query("loaded_integrity", "SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def loaded_integrity(spark, d):
    """Labels of documents that aren't there (B9, K30's error)."""
    return filters.orphans(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id", "doc_id").agg(F.count("*").alias("n"))


# --- an index of trigrams --------------------------------------------------------------------------------------------


def _indexed(spark, df, key, column):
    path = folder(spark, "grams")
    grams.write_index(df, key, column, path)
    return grams.read_index(spark, path, dict(df.dtypes)[key])


@query("gram_keywords", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'e.g. (c)') OR contains(lower(text), 'onthere')")
def gram_keywords(spark, d):
    """Whole texts with any of some keywords, by an index of trigrams."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return grams.search(docs, _indexed(spark, docs, "doc_id", "text"), "doc_id", "text", ["License", "e.g. (C)", "onthere"]).select("doc_id")


@query(
    "gram_share",
    """SELECT count(*) AS n_texts, count(*) FILTER (WHERE contains(lower(text), 'lic') AND contains(lower(text), 'ice') AND contains(lower(text), 'cen') AND contains(lower(text), 'ens') AND contains(lower(text), 'nse')) AS n_checked,
count(*) FILTER (WHERE contains(lower(text), 'license')) AS n_found FROM documents""",
)
def gram_share(spark, d):
    """How many texts the index leaves to be checked, and how many of those have the keyword."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = _indexed(spark, docs, "doc_id", "text")
    kept = grams.narrowed(docs, index, "doc_id", ["license"]).agg(F.count("*").alias("n_checked"), F.count_if(F.lower("text").contains("license")).alias("n_found"))
    return docs.agg(F.count("*").alias("n_texts")).join(kept, F.lit(True)).select("n_texts", "n_checked", "n_found")


@query("gram_annotations", "SELECT p_partkey AS protein_id, p_name AS name, p_type AS accession FROM part WHERE p_name ILIKE '%ed%ring%' AND p_brand = 'Brand#1'")
def gram_annotations(spark, d):
    """Annotations by a LIKE pattern on the name, by the index, then by the search itself."""
    notes = table(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_brand").alias("source"), F.col("p_type").alias("accession"), F.col("p_name").alias("name"))
    near = grams.narrowed(notes, _indexed(spark, notes, "protein_id", "name"), "protein_id", ["%ed%ring%"])
    return cards.search_annotations(near, source="Brand#1", name="%ed%ring%").select("protein_id", "record.name", "record.accession")
