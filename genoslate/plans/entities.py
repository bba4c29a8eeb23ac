"""Lookups, registry predicates, set algebra, summaries, pages and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import aggregates, cards, filters, graph, joins, pages, registry, sets, validate, vectors, windows
from . import roles as R
from .roles import query, table


def text(*parts) -> F.Column:
    """The parts as one text; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- lookups and filters ---------------------------------------------------------------------------------------


@query("id_lookup", "SELECT 'list' AS how, o_orderkey FROM orders WHERE o_custkey IN (3, 5, 8) UNION ALL SELECT 'table', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def id_lookup(spark, d):
    """By a short list and by a table (B2)."""
    o = table(spark, d, "orders")
    ids = table(spark, d, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    one = filters.by_ids(o, [3, 5, 8], "o_custkey").select(F.lit("list").alias("how"), "o_orderkey")
    return one.unionByName(filters.by_ids(o, ids, "o_custkey").select(F.lit("table").alias("how"), "o_orderkey"))


@query("unknown_tags", f"WITH {R.TAGS_SQL}, r AS (SELECT DISTINCT unnest(tags) AS tag FROM t UNION SELECT 'source:' || p_size FROM part) SELECT tag FROM r WHERE NOT contains(tag, ':') AND tag NOT IN ('tiny', 'giant', 'ring', 'bolt')")
def unknown_tags(spark, d):
    """Requested tags that are neither in the vocabulary nor registered."""
    own = R.part_tags(spark, d).select(F.explode("tags").alias("tag"))
    asked = own.unionByName(table(spark, d, "part").select(text("source:", F.col("p_size")).alias("tag"))).distinct()
    return filters.unknown_tags(asked, spark.createDataFrame([("ring",), ("bolt",)], "predicate_id string"), registered=["tiny", "giant"])


@query("window_filter", f"WITH {R.GENES_SQL} SELECT protein_id FROM g WHERE contig_id = 8 AND end_coord > 1704100000 AND start < 1705000000")
def window_filter(spark, d):
    return filters.in_window(R.genes(spark, d), 8, 1_704_100_000, 1_705_000_000).select("protein_id")


def _sized(spark, d) -> tuple[DataFrame, DataFrame]:
    p = R.proteins(spark, d).withColumn("sequence_length", F.when(F.col("protein_id") % 3 != 0, F.col("sequence_length") * 120)).withColumn("end_coord", F.col("end_coord") * 60)
    about = F.when(F.col("score") == 7, "Uncharacterized protein").otherwise(F.col("description"))
    return p, R.annotations(spark, d).withColumn("evalue", F.col("evalue") * 1e-14).withColumn("description", about)


@query(
    "registry_rules",
    """WITH p AS (SELECT p_partkey AS protein_id, p_brand AS bin_id, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 120 END AS n, p_size * 3 * 60 AS end_coord, p_retailprice AS gc FROM part),
g AS (SELECT bin_id, avg(gc) AS m, stddev_samp(gc) AS s FROM p GROUP BY 1)
SELECT 'giant' AS predicate, protein_id FROM p WHERE n > 2000 OR end_coord / 3 > 2000 UNION ALL SELECT 'massive', protein_id FROM p WHERE n > 5000 OR end_coord / 3 > 5000
UNION ALL SELECT 'tiny', protein_id FROM p WHERE coalesce(n, end_coord / 3) < 200 UNION ALL SELECT 'unannotated', protein_id FROM p WHERE protein_id NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT DISTINCT 'hypothetical', l_partkey FROM lineitem WHERE l_quantity = 7 UNION ALL SELECT DISTINCT 'confident_hit', l_partkey FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_extendedprice * 1e-14 < 1e-10
UNION ALL SELECT 'gc_outlier', protein_id FROM p JOIN g USING (bin_id) WHERE s > 0 AND abs(gc - m) > 2 * s UNION ALL SELECT 'odd_small', protein_id FROM p WHERE protein_id % 2 = 1 AND protein_id < 500
UNION ALL SELECT 'brands', p_partkey FROM part WHERE p_brand = 'Brand#3' AND p_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)""",
)
def registry_rules(spark, d):
    """Every kind of registered predicate: SQL, column, function of a frame, restricted to a set."""
    p, a = _sized(spark, d)
    r = registry.Registry()
    registry.defaults(r)
    r.register(registry.Predicate("tiny", "size", column=filters.tiny(200)))
    r.register(registry.Predicate("odd_small", "test", function=lambda pdf: (pdf["protein_id"] % 2 == 1) & (pdf["protein_id"] < 500)))
    r.register(registry.Predicate("brands", "test", column=F.col("bin_id") == "Brand#3"))
    large = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("protein_id"))
    names = [x.name for c in r.categories() for x in r.list(c) if x.name != "multi_domain"]
    found = [r.ids(n, p, only=large if n == "brands" else None, tables={"proteins": p, "annotations": a}).select(F.lit(n).alias("predicate"), "protein_id") for n in names]
    return reduce(DataFrame.unionByName, found)


@query("confident_ids", "SELECT 'confident' AS kind, l_partkey AS protein_id FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_extendedprice * 1e-14 < 1e-10 GROUP BY ALL UNION ALL SELECT 'hypothetical', l_partkey FROM lineitem WHERE l_quantity = 7 GROUP BY ALL")
def confident_ids(spark, d):
    _, a = _sized(spark, d)
    return filters.confident(a).select(F.lit("confident").alias("kind"), "protein_id").unionByName(filters.hypothetical(a).select(F.lit("hypothetical").alias("kind"), "protein_id"))


@query("kept_rows", "SELECT 'column' AS how, p_partkey AS protein_id FROM part WHERE p_size > 45 UNION ALL SELECT 'function', p_partkey FROM part WHERE p_size < 3")
def kept_rows(spark, d):
    """A set filtered by a column and by a function of a frame."""
    p = R.proteins(spark, d).select("protein_id", "sequence_length")
    one = filters.keep(p, F.col("sequence_length") > 45).select(F.lit("column").alias("how"), "protein_id")
    return one.unionByName(filters.keep(p, lambda pdf: pdf["sequence_length"] < 3).select(F.lit("function").alias("how"), "protein_id"))


@query("keyword_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'e.g. (c)') OR contains(lower(text), 'ering')")
def keyword_search(spark, d):
    return filters.keyword_search(table(spark, d, "documents"), ["License", "e.g. (C)", "ering"], "text").select("doc_id")


@query("active_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def active_rows(spark, d):
    return filters.with_status(table(spark, d, "orders"), ["F", "P"], "o_orderstatus").select("o_orderkey")


@query("dictionary_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def dictionary_lookup(spark, d):
    """A table with one row a key, joined."""
    n = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(table(spark, d, "customer"), n, "c_nationkey").select("c_custkey", "n_name")


@query("domain_in_taxon", "SELECT p_partkey AS protein_id FROM part WHERE p_brand LIKE 'Brand#1%' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)")
def domain_in_taxon(spark, d):
    p = R.proteins(spark, d)
    bins = p.select("bin_id").distinct().withColumn("taxonomy", F.col("bin_id"))
    return joins.with_domain_in_taxon(p, R.annotations(spark, d), bins, "S3", "Brand#1").select("protein_id")


@query("flagged_annotations", f"WITH {R.ANNOTATIONS_SQL} SELECT f.l_orderkey AS flagged, f.name AS flagged_name, o.accession FROM a f JOIN a o ON o.protein_id = f.protein_id WHERE f.name = 'sup12'")
def flagged_annotations(spark, d):
    """All annotations of proteins with a flagged one."""
    out = joins.all_annotations_of_flagged(R.annotations(spark, d), "^sup12$")
    return out.select(F.col("flagged_id.l_orderkey").alias("flagged"), "flagged_name", "accession")


# --- summaries -------------------------------------------------------------------------------------------------


@query(
    "findings_summary",
    """SELECT 'category' AS kind, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'high', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 2
UNION ALL SELECT 'genes', NULL, count(DISTINCT g) FROM (SELECT unnest([o_custkey, o_custkey + 1]) AS g FROM orders)""",
)
def findings_summary(spark, d):
    """Counts by category, the urgent ones, and genes told of."""
    k = F.col("o_custkey")
    f = table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "P", "High").otherwise("low").alias("priority"), F.array(k, k + 1).alias("genes"))
    by, high, genes = aggregates.findings_summary(f)
    out = by.select(F.lit("category").alias("kind"), F.col("category").alias("value"), "n")
    out = out.unionByName(high.groupBy("category").agg(F.count("*").alias("n")).select(F.lit("high").alias("kind"), F.col("category").alias("value"), "n"))
    return out.unionByName(genes.select(F.lit("genes").alias("kind"), F.lit(None).cast("string").alias("value"), F.col("n_genes").alias("n")))


@query("annotations_by_source", "SELECT l_partkey AS protein_id, l_returnflag AS source, count(*)::INTEGER AS n, arg_min('S' || l_suppkey, (l_extendedprice, 'S' || l_suppkey)) AS first FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_suppkey % 11 <> 0 GROUP BY 1, 2")
def annotations_by_source(spark, d):
    """A map from source to records for each protein, opened again."""
    a = R.annotations(spark, d).filter("evalue IS NOT NULL AND name IS NOT NULL")
    by = aggregates.annotations_by_source(a).select("protein_id", F.explode("by_source").alias("source", "records"))
    return by.select("protein_id", "source", F.size("records").alias("n"), F.col("records")[0]["accession"].alias("first"))


@query(
    "set_summary",
    f"""WITH {R.ANNOTATIONS_SQL}, p AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 10 AND p_partkey % 2 = 0),
j AS (SELECT p.*, b.label, CASE WHEN p_brand LIKE '%1' THEN 'One' ELSE 'Unknown' END AS phylum, length(p_brand) * 1.0 AS contamination, p_size * 3.0 AS completeness FROM p LEFT JOIN b ON b.protein_id = p_partkey)
SELECT count(*) AS n, count(DISTINCT p_brand) AS n_bins, (SELECT phylum FROM j GROUP BY 1 ORDER BY count(*) DESC, phylum LIMIT 1) AS top_phylum, (SELECT label FROM j WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) AS top_label,
round(avg(p_size), 4) AS mean_length, max(p_size)::DOUBLE AS max_length, count(*) FILTER (WHERE label IS NULL) AS n_hypothetical, count(*) FILTER (WHERE contamination > 5) AS n_contaminated, (SELECT max(k) FROM (SELECT count(*) AS k FROM p GROUP BY p_brand)) AS largest_bin,
concat_ws(',', CASE WHEN max(p_size) > 2 * avg(p_size) THEN 'long_member' END, CASE WHEN count(*) FILTER (WHERE label IS NULL) > count(*) / 2 THEN 'mostly_hypothetical' END, CASE WHEN (SELECT max(k) FROM (SELECT count(*) AS k FROM p GROUP BY p_brand)) > count(*) / 2 THEN 'mostly_one_bin' END) AS notable,
concat_ws(',', CASE WHEN count(*) FILTER (WHERE contamination > 5) > 0 THEN 'contamination' END) AS warnings FROM j""",
)
def set_summary(spark, d):
    """One row on a set: size, genomes, most common phylum and label, what stands out."""
    p = R.proteins(spark, d).filter("sequence_length > 10 AND protein_id % 2 = 0")
    bins = R.proteins(spark, d).select("bin_id").distinct()
    bins = bins.select("bin_id", F.when(F.col("bin_id").endswith("1"), "d__x;p__One;c__").otherwise("d__x").alias("taxonomy"), F.lit(99.0).alias("completeness"), (F.length("bin_id") * 1.0).alias("contamination"))
    s = aggregates.set_summary(p, R.annotations(spark, d), bins).drop("n_incomplete")
    return s.withColumns({"mean_length": F.round("mean_length", 4), "notable": F.array_join("notable", ","), "warnings": F.array_join("warnings", ",")})


@query("family_counts", "SELECT c_nationkey AS bin_id, c_mktsegment AS family, count(*) AS n FROM customer GROUP BY 1, 2 UNION ALL SELECT c_nationkey, NULL, count(*) FROM customer GROUP BY 1")
def family_counts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("bin_id"), F.col("c_mktsegment").alias("family"))
    per, totals = aggregates.family_counts(c)
    return per.unionByName(totals.select("bin_id", F.lit(None).cast("string").alias("family"), "n"))


@query("derived_bins", "SELECT c_nationkey AS bin_id, count(*)::INTEGER AS n_contigs, sum(c_custkey)::BIGINT AS total_length, 'unknown' AS taxonomy FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1 UNION ALL SELECT n_nationkey, 1, 2, n_name FROM nation WHERE n_regionkey = 1")
def derived_bins(spark, d):
    """Bins from contigs where the table lacks them."""
    contigs = table(spark, d, "customer").select(F.col("c_nationkey").alias("bin_id"), F.col("c_custkey").alias("length"))
    known = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("bin_id"), F.lit(None).cast("double").alias("completeness"), F.lit(None).cast("double").alias("contamination"), F.col("n_name").alias("taxonomy"), F.lit(1).alias("n_contigs"), F.lit(2).cast("long").alias("total_length"))
    return aggregates.derive_bins(contigs, known).select("bin_id", "n_contigs", "total_length", "taxonomy")


@query("hit_totals", "SELECT count(*) AS n_rows, (SELECT sum(k) FROM (SELECT count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY l_returnflag))::BIGINT AS sum_of_proteins, count(DISTINCT l_partkey) AS distinct_proteins FROM lineitem")
def hit_totals(spark, d):
    """The sum over databases and the true distinct number."""
    return aggregates.hits_by_database(R.annotations(spark, d))[1]


@query("fraction_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE rn IN (1, n // 4 + 1, n // 2 + 1, (n * 3) // 4 + 1)")
def fraction_sample(spark, d):
    """Rows at fixed fractions of the ranks."""
    return windows.at_fractions(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], [0.0, 0.25, 0.5, 0.75]).select("o_orderkey")


# --- cards and listings ------------------------------------------------------------------------------------------


@query(
    "overview_frames",
    """SELECT 'quality' AS frame, 'mean_completeness' AS key, round(avg(s_acctbal), 3) AS value FROM supplier UNION ALL SELECT 'quality', 'n_good', count(*) FROM supplier WHERE s_acctbal > 90 AND s_nationkey < 5
UNION ALL SELECT 'totals', 'n_annotated', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'totals', 'n_bins', count(*) FROM supplier UNION ALL SELECT 'phyla', 'N' || s_nationkey % 3, count(*) FROM supplier GROUP BY 2
UNION ALL SELECT 'sources', l_returnflag, count(*) FROM lineitem GROUP BY 2""",
)
def overview_frames(spark, d):
    """The four frames of the overview."""
    bins = table(spark, d, "supplier").select(F.col("s_acctbal").alias("completeness"), F.col("s_nationkey").alias("contamination"), text("d__x;p__N", F.col("s_nationkey") % 3).alias("taxonomy"))
    got = cards.overview({"bins": bins, "contigs": table(spark, d, "customer"), "proteins": R.proteins(spark, d), "annotations": R.annotations(spark, d)})
    flat = lambda frame, *names: got[frame].select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], list(names), "key", "value").select(F.lit(frame).alias("frame"), "key", F.round("value", 3).alias("value"))
    keyed = lambda frame, key: got[frame].select(F.lit(frame).alias("frame"), F.col(key).alias("key"), F.col("n").cast("double").alias("value"))
    return flat("quality", "mean_completeness", "n_good").unionByName(flat("totals", "n_annotated", "n_bins")).unionByName(keyed("phyla", "phylum")).unionByName(keyed("sources", "source"))


@query(
    "genome_cards",
    """WITH b AS (SELECT DISTINCT p_brand AS bin_id FROM part), c AS (SELECT 'Brand#' || c_nationkey AS bin_id, count(*) AS contigs, sum(c_custkey)::BIGINT AS length, max(c_custkey) AS longest FROM customer GROUP BY 1),
p AS (SELECT p_brand AS bin_id, count(*) AS proteins FROM part GROUP BY 1), k AS (SELECT p_brand AS bin_id, l_returnflag AS source, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT b.bin_id, contigs, length, longest, proteins, (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM k WHERE k.bin_id = b.bin_id) AS by_source FROM b LEFT JOIN c USING (bin_id) LEFT JOIN p USING (bin_id)""",
)
def genome_cards(spark, d):
    """A card for each genome."""
    p = R.proteins(spark, d)
    contigs = table(spark, d, "customer").select(text("Brand#", F.col("c_nationkey")).alias("bin_id"), F.col("c_custkey").alias("length"))
    out = cards.genome_cards(p.select("bin_id").distinct(), contigs, p, R.annotations(spark, d))
    shown = F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("by_source", shown)


@query(
    "protein_cards",
    f"""WITH {R.TAGS_SQL}, {R.ANNOTATIONS_SQL}, n AS (SELECT protein_id, name, accession FROM (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY evalue NULLS LAST, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM a) WHERE rn = 1),
s AS (SELECT protein_id, string_agg(DISTINCT accession, ',' ORDER BY accession) AS accessions FROM a GROUP BY 1)
SELECT p_partkey AS protein_id, p_size::DOUBLE AS length, coalesce(s.accessions, '') AS accessions, n.name || ' (' || n.accession || ')' AS label, s.protein_id IS NULL AS is_hypothetical, array_to_string(t.tags, ',') AS tags
FROM part LEFT JOIN s ON s.protein_id = p_partkey LEFT JOIN n ON n.protein_id = p_partkey LEFT JOIN t ON t.protein_id = p_partkey""",
)
def protein_cards(spark, d):
    """A card for each protein with derived facts."""
    out = cards.protein_cards(R.proteins(spark, d), R.annotations(spark, d), R.part_tags(spark, d))
    return out.select("protein_id", "length", F.array_join(F.coalesce("accessions", F.array().cast("array<string>")), ",").alias("accessions"), "label", "is_hypothetical", F.array_join("tags", ",").alias("tags"))


@query(
    "genome_list",
    "SELECT c_custkey AS bin_id, c_acctbal AS completeness, c_mktsegment AS rank_name FROM customer WHERE contains(lower('d__x;s__' || c_mktsegment), 'build') AND c_acctbal >= 100 AND c_nationkey <= 20 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 15 OFFSET 3",
)
def genome_list(spark, d):
    """A page of genomes with optional filters."""
    bins = table(spark, d, "customer").select(F.col("c_custkey").alias("bin_id"), F.col("c_acctbal").alias("completeness"), F.col("c_nationkey").alias("contamination"), text("d__x;s__", F.col("c_mktsegment")).alias("taxonomy"))
    return cards.list_genomes(bins, "BUILD", 100, 20, 15, 3).select("bin_id", "completeness", "rank_name")


@query("contig_list", "SELECT c_custkey AS contig_id, c_acctbal AS length FROM customer WHERE c_nationkey = 4 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def contig_list(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("contig_id"), F.col("c_nationkey").alias("bin_id"), F.col("c_acctbal").alias("length"))
    return cards.list_contigs(c, 4, 10).select("contig_id", "length")


@query(
    "protein_list",
    f"""WITH {R.ANNOTATIONS_SQL}, p AS (SELECT p_partkey, p_type, p_size FROM part WHERE p_brand = 'Brand#2' AND p_size >= 5 AND p_partkey IN (SELECT l_partkey FROM lineitem) ORDER BY p_type, p_partkey LIMIT 40)
SELECT p_partkey AS protein_id, p_type AS contig_id, p_size::DOUBLE AS length, b.label FROM p LEFT JOIN b ON b.protein_id = p_partkey""",
)
def protein_list(spark, d):
    """A page of proteins in place order with labels."""
    return cards.list_proteins(R.proteins(spark, d), R.annotations(spark, d), bin_id="Brand#2", min_length=5, has_annotation=True, limit=40).select("protein_id", "contig_id", "length", "label")


@query("annotation_records", f"WITH {R.ANNOTATIONS_SQL} SELECT protein_id, accession, evalue FROM a WHERE source = 'R' AND lower(name) LIKE '%sup2%'")
def annotation_records(spark, d):
    """(id, record) of matching annotations."""
    out = cards.search_annotations(R.annotations(spark, d), source="R", name="sup2")
    return out.select("protein_id", "record.accession", "record.evalue")


@query("annotations_of", f"WITH {R.ANNOTATIONS_SQL} SELECT protein_id, accession, evalue FROM a WHERE protein_id IN (SELECT p_partkey FROM part WHERE p_size = 9)")
def annotations_of(spark, d):
    """Annotations of a set of proteins."""
    ids = R.proteins(spark, d).filter("sequence_length = 9").select("protein_id")
    return cards.annotations_of(R.annotations(spark, d), ids).select("protein_id", "accession", "evalue")


@query("page_info", "SELECT count(*) AS total_rows, count(*) > 30 AS truncated FROM supplier")
def page_info(spark, d):
    return pages.page_info(table(spark, d, "supplier"), 20, 10)


@query(
    "merged_hits",
    """WITH h AS (SELECT l_partkey AS protein_id, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice END AS evalue, 'a' || l_orderkey || '-' || l_linenumber AS target, CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END AS identity FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT l_partkey, l_extendedprice, 'b' || l_orderkey || '-' || l_linenumber, l_discount FROM lineitem WHERE l_linenumber = 2)
SELECT protein_id, target, evalue, round(identity, 6) AS identity FROM (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY evalue NULLS LAST, target) AS r FROM h) WHERE r <= 2""",
)
def merged_hits(spark, d):
    """The two best hits of each protein over two lists."""
    li = table(spark, d, "lineitem")
    target = lambda p: text(p, F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("target")
    a = li.filter("l_linenumber = 1").select(F.col("l_partkey").alias("protein_id"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice")).alias("evalue"), target("a"), F.col("l_quantity").alias("identity"))
    b = li.filter("l_linenumber = 2").select(F.col("l_partkey").alias("protein_id"), F.col("l_extendedprice").alias("evalue"), target("b"), F.col("l_discount").alias("identity"))
    return pages.merge_hits(a, b, k=2, per="protein_id").withColumn("identity", F.round("identity", 6))


@query("sections", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' WHEN o_orderpriority LIKE '%LOW%' THEN 'later' WHEN o_orderpriority LIKE '%MED%' THEN 'middle' ELSE 'Other' END AS section FROM orders")
def sections(spark, d):
    """By category, else by ordered words of the title."""
    from ..operators import classify

    f = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"), F.col("o_orderpriority").alias("title"))
    by = spark.createDataFrame([("1-URGENT", "now")], "category string, section string")
    return classify.finding_sections(f, by, [("low", "later"), ("med", "middle")]).select("o_orderkey", "section")


@query(
    "reliability",
    """WITH a AS (SELECT l_partkey, min(CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice * 1e-8 END) AS e FROM lineitem GROUP BY 1)
SELECT p_partkey AS protein_id, concat_ws(',', CASE WHEN length(p_brand) > 7 THEN 'contaminated_genome' END, CASE WHEN p_brand LIKE '%1' THEN 'incomplete_genome' END, CASE WHEN e > 1e-5 THEN 'weak_best_hit' END, CASE WHEN l_partkey IS NULL THEN 'no_annotation' END) AS warnings FROM part LEFT JOIN a ON l_partkey = p_partkey""",
)
def reliability(spark, d):
    """Warnings of each protein."""
    p = R.proteins(spark, d)
    bins = p.select("bin_id").distinct()
    bins = bins.select("bin_id", F.when(F.col("bin_id").endswith("1"), 10.0).otherwise(90.0).alias("completeness"), F.when(F.length("bin_id") > 7, 6.0).otherwise(1.0).alias("contamination"))
    a = R.annotations(spark, d).withColumn("evalue", F.col("evalue") * 1e-8)
    return validate.reliability_warnings(p, a, bins).select("protein_id", F.array_join("warnings", ",").alias("warnings"))


@query("model_inputs", "SELECT p_partkey AS protein_id, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS sequence FROM part WHERE length(regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')) BETWEEN 1 AND 9")
def model_inputs(spark, d):
    """Cleaned sequences short enough for a model."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_name").alias("sequence"))
    return vectors.model_inputs(p, 9)


# --- provenance --------------------------------------------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    """Orders as steps: each follows the customer's one before it."""
    o = table(spark, d, "orders")
    before = F.lag("o_orderkey").over(windows.W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("summary"), F.array_compact(F.array(before)).alias("parents"))


@query(
    "provenance_summary",
    """WITH l AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders)
SELECT count(*) AS n_nodes, count(*) FILTER (WHERE parent IS NULL) AS n_roots, count(DISTINCT o_custkey) AS n_leaves, (SELECT max(k) - 1 FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey))::INTEGER AS max_depth, (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS n_hypotheses FROM l""",
)
def provenance_summary(spark, d):
    """Roots, leaves, depth and linked hypotheses of a log."""
    log = _log(spark, d)
    evidence = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("hypothesis_id"), F.col("l_orderkey").alias("entry_id"))
    return graph.summary(log.select(F.col("entry_id").alias("node")), graph.edges_of(log), evidence)


@query("evidence_steps", "SELECT l_suppkey AS hypothesis_id, l_orderkey AS entry_id, o_orderpriority AS query, o_orderstatus AS summary FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 2 = 0")
def evidence_steps(spark, d):
    """Evidence with its step's query; some steps are missing."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("hypothesis_id"), F.col("l_orderkey").alias("entry_id"))
    return graph.evidence_with_steps(e, _log(spark, d).filter("entry_id % 2 = 0"))


@query("log_append", "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'new' END AS query FROM orders")
def log_append(spark, d):
    """Entries are added, those already there stay."""
    log = _log(spark, d)
    return graph.append_log(log.filter("entry_id % 2 = 0"), log.withColumn("query", F.lit("new"))).select("entry_id", "query")


# --- sets --------------------------------------------------------------------------------------------------------


@query("predicates_of", "SELECT p_partkey AS protein_id, concat_ws(',', CASE WHEN p_type = 'PROMO' THEN 'a_promo' END, CASE WHEN p_size > 30 THEN 'b_large' END, CASE WHEN p_name LIKE '%ring' THEN 'c_ring' END) AS tags FROM part")
def predicates_of(spark, d):
    """The predicates that hold for each row, in one scan."""
    out = sets.predicates_of(R.proteins(spark, d), {"c_ring": F.col("name").endswith("ring"), "b_large": F.col("sequence_length") > 30, "a_promo": F.col("contig_id") == "PROMO"})
    return out.select("protein_id", F.array_join("tags", ",").alias("tags"))


@query("added_tags", f"WITH {R.TAGS_SQL} SELECT protein_id, array_to_string(list_sort(list_distinct(list_concat(tags, CASE WHEN protein_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 5) THEN ['giant', 'seen'] ELSE [] END))), ',') AS tags FROM t")
def added_tags(spark, d):
    """Tags added to stored ones, each once."""
    new = table(spark, d, "lineitem").filter("l_suppkey = 5").select(F.col("l_partkey").alias("protein_id"), F.array(F.lit("seen"), F.lit("giant")).alias("tags"))
    return sets.add_tags(R.part_tags(spark, d), new).select("protein_id", F.array_join("tags", ",").alias("tags"))


@query("merged_first", "SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'a' ELSE 'b' END AS place FROM customer")
def merged_first(spark, d):
    """Two lists by id, the first wins."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    return sets.merge_first(c.filter("c_nationkey = 3").select("id", F.lit("a").alias("place")), c.select("id", F.lit("b").alias("place")))


# --- scalars -----------------------------------------------------------------------------------------------------


@query("genome_ids", "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g') AS genome_id FROM customer")
def genome_ids(spark, d):
    path = text("/data/in-1/", F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "-.fna.gz").otherwise(".faa"))
    return table(spark, d, "customer").select("c_custkey", X.genome_id(path).alias("genome_id"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_LEADING = lambda known: f"coalesce(list_position(list_transform(w, lambda x: list_contains({_LIST(known)}, lower(x))), false) - 1, len(w))"
_ENDED = ", ".join(f"nullif(instr(substr(spaced, behind), ' {e} '), 0)" for e in X.TITLE_ENDS)


@query(
    "clean_titles",
    f"""WITH t AS (SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, (CASE doc_id % 6 WHEN 0 THEN 'Crystal structure of the ' WHEN 1 THEN '6abc_A Electron microscopy structure of ' WHEN 2 THEN 'Apo form of ' WHEN 3 THEN 'Model of the ' WHEN 4 THEN 'X-ray crystal structure of a ' ELSE '' END) || text FROM documents),
w0 AS (SELECT id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM t),
w1 AS (SELECT id, CASE WHEN len(w) > 0 AND regexp_matches(w[1], '{X.TITLE_CHAIN}') THEN w[2:] ELSE w END AS w FROM w0),
w2 AS (SELECT id, w[1 + coalesce(list_max(list_transform(range(1, 1 + {_LEADING(X.TITLE_HEAD)}), lambda i: CASE WHEN i > 1 AND lower(w[i]) = 'of' AND list_contains({_LIST(X.TITLE_KINDS)}, lower(w[i - 1])) THEN i ELSE 0 END)), 0):] AS w FROM w1),
p AS (SELECT id, array_to_string(w[1 + {_LEADING(X.TITLE_SKIPPED)}:], ' ') AS x FROM w2),
s AS (SELECT id, x, lower(x) || ' ' AS spaced, instr(x || ' ', ' ') AS behind FROM p),
n AS (SELECT id, left(x, coalesce(least(least({_ENDED}) + behind - 2, nullif(instr(substr(x, 2), ','), 0)), length(x))::INTEGER) AS y FROM s),
k AS (SELECT id, rtrim(regexp_replace(y, '(?i) (apo|holo)$', '')) AS z FROM n)
SELECT id, CASE WHEN regexp_matches(z, '[A-Za-z]') THEN upper(left(z, 1)) || substr(z, 2) ELSE '?' END AS title FROM k""",
)
def clean_titles(spark, d):
    """Whole texts as structure titles (H8)."""
    k = F.col("doc_id") % 6
    lead = F.when(k == 0, "Crystal structure of the ").when(k == 1, "6abc_A Electron microscopy structure of ").when(k == 2, "Apo form of ").when(k == 3, "Model of the ").when(k == 4, "X-ray crystal structure of a ").otherwise("")
    b = table(spark, d, "benchmark").select(text("b", F.col("item_id")).alias("id"), "text")
    both = b.unionByName(table(spark, d, "documents").select(text("d", F.col("doc_id")).alias("id"), F.concat(lead, "text").alias("text")))
    return both.select("id", X.clean_title(F.col("text")).alias("title"))


@query(
    "hypothetical_texts",
    "SELECT p_partkey AS protein_id, p_partkey % 8 IN (0, 1, 2, 3, 4) AS hypothetical FROM part",
)
def hypothetical_texts(spark, d):
    """Texts that say nothing about function, and some that nearly do (H9, K5f)."""
    k = F.col("p_partkey") % 8
    name = F.when(k == 0, "Conserved protein").when(k == 1, "DUF12 domain").when(k == 2, "uncharacterized").when(k == 5, "uncharacterised").when(k == 6, "putative protein")
    about = F.when(k == 3, "of unknown function").when(k == 4, "PREDICTED PROTEIN").otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), X.is_hypothetical(name, about).alias("hypothetical"))


@query("subject_parts", "SELECT p_partkey AS protein_id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_type END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size || 'a' END AS subgroup FROM part")
def subject_parts(spark, d):
    """Type and subgroup of reference ids, with and without them."""
    k = F.col("p_partkey") % 3
    subject = F.when(k == 0, text("acc1, Some organism|[", F.col("p_type"), "]_Group_", F.col("p_size"), "a")).when(k == 1, text("acc2, organism, [", F.col("p_type"), "]")).otherwise("acc3")
    kind, group = X.subject_parts(subject)
    return table(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), kind.alias("kind"), group.alias("subgroup"))


@query(
    "unit_format",
    """WITH n AS (SELECT doc_id, n_chars * n_chars AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1000000 THEN (n + 5000) // 10000 // 100 || '.' || lpad(((n + 5000) // 10000 % 100)::VARCHAR, 2, '0') || ' Mb'
WHEN n >= 1000 THEN (n + 50) // 100 // 10 || '.' || (n + 50) // 100 % 10 || ' kb' ELSE n || ' bp' END AS size FROM n""",
)
def unit_format(spark, d):
    return table(spark, d, "documents").select("doc_id", X.base_pairs(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("all_hints", "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)copyright|license') THEN 'legal' END, CASE WHEN regexp_matches(text, '(?i)the') THEN 'words' END, CASE WHEN regexp_matches(text, '(?i)[0-9]{5}') THEN 'zip' END) AS hints FROM documents")
def all_hints(spark, d):
    """All keyword hints of whole texts."""
    rules = [("[0-9]{5}", "zip"), ("copyright|license", "legal"), ("the", "words")]
    return table(spark, d, "documents").select("doc_id", F.array_join(X.all_rules(F.col("text"), rules), ",").alias("hints"))


@query("hit_confidence", "SELECT CASE WHEN e IS NULL THEN 'low' WHEN e < 1e-20 THEN 'high' WHEN e < 1e-5 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM (SELECT CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice * CASE l_linenumber % 3 WHEN 0 THEN 1e-30 WHEN 1 THEN 1e-12 ELSE 1.0 END END AS e FROM lineitem) GROUP BY 1")
def hit_confidence(spark, d):
    k = F.col("l_linenumber") % 3
    e = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice") * F.when(k == 0, 1e-30).when(k == 1, 1e-12).otherwise(1.0))
    return table(spark, d, "lineitem").groupBy(X.confidence(e).alias("confidence")).agg(F.count("*").alias("n"))


@query("attribute_maps", "SELECT o_orderkey, o_orderstatus AS status, o_custkey::VARCHAR AS customer FROM orders")
def attribute_maps(spark, d):
    """``k=v;k=v`` texts as maps."""
    m = X.attributes(text("status=", F.col("o_orderstatus"), ";customer=", F.col("o_custkey")))
    return table(spark, d, "orders").select("o_orderkey", m["status"].alias("status"), m["customer"].alias("customer"))


@query("short_hashes", "SELECT doc_id, left(sha256(source || chr(31) || coalesce(text, '')), 12) AS hash FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def short_hashes(spark, d):
    """Twelve digits of a hash of whole texts."""
    return table(spark, d, "documents").filter("source IS NOT NULL AND text IS NOT NULL").select("doc_id", X.short_hash(F.col("source"), F.col("text")).alias("hash"))


@query("user_sql", "SELECT p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def user_sql(spark, d):
    """SQL of the user's own with a parameter."""
    return registry.sql(spark, "SELECT p_type, count(*) AS n FROM {user_parts} WHERE p_size > :least GROUP BY 1", {"user_parts": table(spark, d, "part")}, least=10)


@query(
    "registry_counts",
    """WITH p AS (SELECT p_partkey AS protein_id, p_brand AS bin_id, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 120 END AS n, p_size * 3 * 60 AS end_coord, p_retailprice AS gc FROM part),
g AS (SELECT bin_id, avg(gc) AS m, stddev_samp(gc) AS s FROM p GROUP BY 1)
SELECT 'size' AS category, 'giant' AS predicate, count(*) AS n FROM p WHERE n > 2000 OR end_coord / 3 > 2000 UNION ALL SELECT 'size', 'massive', count(*) FROM p WHERE n > 5000 OR end_coord / 3 > 5000
UNION ALL SELECT 'size', 'tiny', count(*) FROM p WHERE coalesce(n, end_coord / 3) < 50 UNION ALL SELECT 'annotation', 'unannotated', count(*) FROM p WHERE protein_id NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'annotation', 'hypothetical', count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity = 7 UNION ALL SELECT 'annotation', 'confident_hit', count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_extendedprice * 1e-14 < 1e-10
UNION ALL SELECT 'annotation', 'multi_domain', 0 UNION ALL SELECT 'composition', 'gc_outlier', count(*) FROM p JOIN g USING (bin_id) WHERE s > 0 AND abs(gc - m) > 2 * s""",
)
def registry_counts(spark, d):
    """How many proteins each registered predicate holds for, by category."""
    p, a = _sized(spark, d)
    p.createOrReplaceTempView("proteins")
    a.createOrReplaceTempView("annotations")
    r = registry.Registry()
    registry.defaults(r)
    found = [r.ids(x.name, p).agg(F.count("*").alias("n")).select(F.lit(c).alias("category"), F.lit(x.name).alias("predicate"), "n") for c in r.categories() for x in r.list(c)]
    return reduce(DataFrame.unionByName, found)


_Q = [round(1.0 / (i + 1), 6) * (-1) ** i for i in range(64)]


@query("knn_vector", f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS s FROM embeddings) WHERE s >= 0.01 ORDER BY s DESC, vec_id LIMIT 12")
def knn_vector(spark, d):
    """The nearest to a raw vector above a threshold (K3)."""
    return vectors.nearest_to_vector(table(spark, d, "embeddings"), _Q, 12, 0.01).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_distance", f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, 1 / (1 + list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[])) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 12")
def knn_distance(spark, d):
    """By distance instead of angle."""
    return vectors.nearest_to_vector(table(spark, d, "embeddings"), _Q, 12, metric="l2").select("vec_id", F.round("score", 6).alias("score"))


@query("pair_threshold", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.999999")
def pair_threshold(spark, d):
    """Random projections find all pairs of (nearly) equal vectors: they fall into the same buckets (K4)."""
    return vectors.similar_pairs_lsh(table(spark, d, "embeddings"), 0.999999).select("a", "b")
