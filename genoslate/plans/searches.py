"""Searches, listings, counts and best rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import aggregates, cards, filters, pages, sets, windows
from ..sources import tables as S
from . import roles as R
from .roles import query, table


@query(
    "tag_search",
    f"""WITH {R.TAGS_SQL}, {R.ANNOTATIONS_SQL}
SELECT t.protein_id, p_size::DOUBLE AS length, array_to_string(t.tags, ',') AS tags, b.label FROM t JOIN part ON p_partkey = t.protein_id
LEFT JOIN b ON b.protein_id = t.protein_id WHERE list_has_all(t.tags, ['economy', 'giant']) AND NOT list_contains(t.tags, 'ring')
ORDER BY p_size DESC, t.protein_id LIMIT 50""",
)
def tag_search(spark, d):
    """The 50 longest (a page) with all of some tags and none of others, with best labels."""
    out = cards.search_by_tags(R.proteins(spark, d), R.part_tags(spark, d), R.annotations(spark, d), ["economy", "giant"], ["ring"], limit=50)
    return out.select("protein_id", "length", F.array_join("tags", ",").alias("tags"), "label")


@query("boolean_tag_search", f"WITH {R.TAGS_SQL} SELECT protein_id FROM t WHERE (list_contains(tags, 'promo') AND list_contains(tags, 'tiny')) OR list_contains(tags, 'gear')")
def boolean_tag_search(spark, d):
    t = F.col("tags")
    return R.part_tags(spark, d).filter(X.has_all(t, ["promo", "tiny"]) | X.has_any(t, ["gear"])).select("protein_id")


@query("tag_set_algebra", f"WITH {R.TAGS_SQL} SELECT protein_id FROM t WHERE list_contains(tags, 'small') AND list_contains(tags, 'tiny') AND NOT list_contains(tags, 'promo')")
def tag_set_algebra(spark, d):
    t = R.part_tags(spark, d)
    ids = lambda x: t.filter(F.array_contains("tags", x)).select("protein_id")
    return sets.id_algebra(t, [ids("small"), ids("tiny")], [ids("promo")])


@query(
    "list_entities",
    """SELECT s_suppkey, s_name, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_acctbal >= 1000 AND lower(r_name) LIKE '%a%' ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 20 OFFSET 5""",
)
def list_entities(spark, d):
    """One page of suppliers with optional filters (a listing, hence a limit)."""
    n = table(spark, d, "nation").join(table(spark, d, "region").filter(X.contains_text(F.col("r_name"), "A")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = filters.where_given(table(spark, d, "supplier"), F.col("s_acctbal") >= 1000, None).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return pages.page(s, [F.desc_nulls_last("s_acctbal"), F.col("s_suppkey")], 20, 5).select("s_suppkey", "s_name", "s_acctbal", "n_name")


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def keyset_page(spark, d):
    return pages.after(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 200000.0, 0, 25)


@query("length_filter", "SELECT p_partkey AS protein_id FROM part WHERE (p_size >= 20 OR (p_size * 3 - 0) / 3 >= 20) AND (p_size <= 30 OR (p_size * 3) / 3 <= 30)")
def length_filter(spark, d):
    return R.proteins(spark, d).filter(X.length_filter(20, 30)).select("protein_id")


@query("semi_anti", "SELECT p_partkey AS protein_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_extendedprice < 2000) AS annotated FROM part")
def semi_anti(spark, d):
    p = R.proteins(spark, d).select("protein_id")
    cheap = table(spark, d, "lineitem").filter("l_extendedprice < 2000").select(F.col("l_partkey").alias("protein_id"))
    return filters.annotated(p, cheap, True).withColumn("annotated", F.lit(True)).unionByName(filters.annotated(p, cheap, False).withColumn("annotated", F.lit(False)))


@query(
    "annotation_search",
    f"WITH {R.ANNOTATIONS_SQL} SELECT DISTINCT p_partkey AS protein_id, p_brand AS bin_id FROM part JOIN a ON a.protein_id = p_partkey WHERE lower(a.name) LIKE '%sup1%' AND p_size >= 10 AND lower(p_brand) LIKE '%#1%'",
)
def annotation_search(spark, d):
    bins = table(spark, d, "part").select(F.col("p_brand").alias("bin_id")).distinct().withColumn("taxonomy", F.col("bin_id"))
    out = cards.search_proteins(R.proteins(spark, d), R.annotations(spark, d), bins, pattern="sup1", taxonomy="#1", min_length=10)
    return out.select("protein_id", "bin_id")


@query(
    "overview_stats",
    """SELECT (SELECT count(*) FROM nation) AS n_bins, (SELECT count(*) FROM customer) AS n_contigs, (SELECT count(*) FROM part) AS n_proteins,
(SELECT count(*) FROM lineitem) AS n_annotations, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_annotated,
round((SELECT count(DISTINCT l_partkey) FROM lineitem) / (SELECT count(*) FROM part), 6) AS annotation_rate""",
)
def overview_stats(spark, d):
    out = aggregates.dataset_totals(table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "part"), R.annotations(spark, d))
    return out.withColumn("annotation_rate", F.round("annotation_rate", 6))


@query(
    "quality_summary",
    """SELECT round(avg(s_acctbal), 4) AS mean_completeness, round(avg(s_nationkey), 4) AS mean_contamination,
count(*) FILTER (WHERE s_acctbal > 5000 AND s_nationkey < 12) AS n_good, count(*) AS n_bins FROM supplier WHERE s_acctbal IS NOT NULL""",
)
def quality_summary(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("completeness"), F.col("s_nationkey").alias("contamination"))
    return aggregates.quality_summary(b, 5000, 12).withColumn("mean_completeness", F.round("mean_completeness", 4)).withColumn("mean_contamination", F.round("mean_contamination", 4))


@query("table_counts", "SELECT 'part' AS \"table\", count(*) AS n_rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, d):
    return aggregates.table_counts({n: table(spark, d, n) for n in ("part", "orders", "events")})


@query(
    "phylum_counts",
    """WITH l AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'd__only' WHEN n_nationkey % 5 = 3 THEN NULL ELSE 'd__' || r_name || ';p__' || n_name || ';c__' END AS taxonomy
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT CASE WHEN regexp_extract(taxonomy, 'p__([^;]+)', 1) = '' THEN 'Unknown' ELSE regexp_extract(taxonomy, 'p__([^;]+)', 1) END AS phylum, count(*) AS n
FROM l WHERE taxonomy IS NOT NULL GROUP BY 1 ORDER BY n DESC, phylum LIMIT 10""",
)
def phylum_counts(spark, d):
    """The ten most common (a top-k)."""
    c = table(spark, d, "customer").join(R.lineage(spark, d), F.col("c_nationkey") == F.col("bin_id"))
    return aggregates.phylum_counts(c, 10)


@query(
    "deepest_rank",
    """SELECT n_nationkey AS bin_id, CASE WHEN n_nationkey % 5 = 3 THEN NULL WHEN n_nationkey % 5 = 4 THEN 'only' ELSE n_name END AS rank_name FROM nation""",
)
def deepest_rank(spark, d):
    return R.lineage(spark, d).select("bin_id", X.deepest_rank(F.col("taxonomy")).alias("rank_name"))


@query("source_counts", "SELECT l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY 1")
def source_counts(spark, d):
    return aggregates.top_counts(R.annotations(spark, d), "source", name="source")


@query("best_per_key", f"WITH {R.ANNOTATIONS_SQL} SELECT protein_id, label FROM b")
def best_per_key(spark, d):
    return windows.best_label(R.annotations(spark, d))


@query(
    "best_by_score",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def best_by_score(spark, d):
    return windows.best_per_key(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderkey", "o_totalprice"], "o_orderkey", largest=True)


@query(
    "group_zscore",
    """SELECT c_custkey, round(CASE WHEN coalesce(stddev_samp(c_acctbal) OVER w, 0) = 0 THEN 0 ELSE (c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w END, 5) AS z,
CASE WHEN abs((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w) > 4 THEN 'extreme' WHEN abs((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w) > 3 THEN 'high' ELSE 'moderate' END AS severity
FROM customer WINDOW w AS (PARTITION BY c_nationkey)""",
)
def group_zscore(spark, d):
    z = windows.group_zscore(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "z")
    return z.select("c_custkey", F.round("z", 5).alias("z"), X.severity(F.col("z")).alias("severity"))


@query(
    "group_outlier",
    "SELECT c_custkey FROM (SELECT c_custkey, c_acctbal, avg(c_acctbal) OVER w AS m, stddev_samp(c_acctbal) OVER w AS s FROM customer WINDOW w AS (PARTITION BY c_nationkey)) WHERE s > 0 AND abs(c_acctbal - m) > 1.5 * s",
)
def group_outlier(spark, d):
    return windows.group_outliers(table(spark, d, "customer"), "c_nationkey", "c_acctbal", 1.5).select("c_custkey")


@query(
    "size_histogram",
    "SELECT CASE WHEN n_chars < 200 THEN '<200' WHEN n_chars < 500 THEN '200-499' WHEN n_chars < 1000 THEN '500-999' ELSE '>=1000' END AS bucket, count(*) AS n FROM documents GROUP BY 1",
)
def size_histogram(spark, d):
    return aggregates.size_histogram(table(spark, d, "documents"), F.col("n_chars"), aggregates.SIZE_CUTS["report"])


@query("length_summary", "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_length, max(n_chars) AS max_length, min(n_chars) AS min_length FROM documents GROUP BY source")
def length_summary(spark, d):
    out = aggregates.length_summary(table(spark, d, "documents"), F.col("n_chars"), "source")
    return out.withColumn("mean_length", F.round("mean_length", 4))


@query("tag_counts", f"WITH {R.TAGS_SQL} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag")
def tag_counts(spark, d):
    return aggregates.tag_counts(R.part_tags(spark, d))


@query(
    "predicate_battery",
    f"""WITH {R.TAGS_SQL} SELECT 'a_giant' AS predicate, count(*) AS n FROM t WHERE list_contains(tags, 'giant') UNION ALL
SELECT 'b_promo_tiny', count(*) FROM t WHERE list_has_all(tags, ['promo', 'tiny']) UNION ALL SELECT 'c_plain', count(*) FROM t WHERE NOT list_has_any(tags, ['promo', 'economy', 'ring'])""",
)
def predicate_battery(spark, d):
    t = F.col("tags")
    return aggregates.predicate_counts(R.part_tags(spark, d), {"a_giant": X.has_all(t, ["giant"]), "b_promo_tiny": X.has_all(t, ["promo", "tiny"]), "c_plain": X.has_none(t, ["promo", "economy", "ring"])})


@query("multi_domain", "SELECT l_partkey AS protein_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 25")
def multi_domain(spark, d):
    return aggregates.keys_with_distinct(R.annotations(spark, d), "protein_id", "accession", 25)


@query(
    "coverage_by_source",
    """SELECT d.source, count(*) AS n_rows, count(DISTINCT l.doc_id) AS n_proteins, round(count(DISTINCT l.doc_id) / (SELECT count(*) FROM documents), 3) AS coverage
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""",
)
def coverage_by_source(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("protein_id"), "source")
    a = table(spark, d, "labels").select(F.col("doc_id").alias("protein_id")).join(docs, "protein_id")
    return aggregates.coverage_by_source(a, docs)


@query("unexplored", "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def unexplored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return aggregates.top_counts(filters.annotated(docs, table(spark, d, "labels"), False, "doc_id"), "source", name="source")


@query("joined_text", "SELECT n_regionkey AS region, string_agg(n_name, '; ' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def joined_text(spark, d):
    return aggregates.joined_text(table(spark, d, "nation"), "n_regionkey", "n_name", "n_nationkey").withColumnRenamed("n_regionkey", "region")


@query(
    "derived_contigs",
    f"WITH {R.GENES_SQL} SELECT contig_id, max(end_coord) AS length, count(*) AS n_genes FROM g GROUP BY 1",
)
def derived_contigs(spark, d):
    return aggregates.derive_contigs(R.genes(spark, d).withColumn("bin_id", F.col("contig_id"))).select("contig_id", "length", "n_genes")


@query(
    "loci_summary",
    """SELECT o_orderstatus AS locus_type, o_orderpriority AS subtype, count(*) AS n_loci, count(DISTINCT o_custkey) AS n_genomes FROM orders GROUP BY 1, 2 UNION ALL
SELECT o_orderstatus, NULL, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 1""",
)
def loci_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("locus_type"), F.col("o_orderpriority").alias("subtype"), F.col("o_custkey").alias("bin_id"))
    return aggregates.loci_summary(o).drop("level")


@query(
    "evidence_confidence",
    """SELECT source AS hypothesis_id, count(*) FILTER (WHERE quality = 1) AS n_for, count(*) FILTER (WHERE quality <> 1) AS n_against, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS confidence,
CASE WHEN avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 'supported' WHEN avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) <= 0.3 THEN 'refuted' ELSE 'proposed' END AS status
FROM labels JOIN documents USING (doc_id) GROUP BY source""",
)
def evidence_confidence(spark, d):
    e = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    e = e.select(F.col("source").alias("hypothesis_id"), (F.col("quality") == 1).alias("supports"), F.lit(1.0).alias("confidence"))
    return aggregates.evidence_confidence(e, high=0.9).withColumn("confidence", F.round("confidence", 6))


@query("json_metadata", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_metadata(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "findings_dedup",
    """SELECT doc_id, length(title) AS title_length FROM (SELECT doc_id, text AS title, row_number() OVER (PARTITION BY substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 50) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def findings_dedup(spark, d):
    """Documents as findings, whole texts as titles; 50 letters and digits of a title tell it from others."""
    f = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"))
    return windows.dedup_first(f, windows.title_key(F.col("title")), "doc_id").select("doc_id", F.length("title").alias("title_length"))


@query(
    "working_sets",
    """SELECT 'a' AS set_name, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 8000 EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT 'b', count(*) FROM customer WHERE c_mktsegment = 'MACHINERY'""",
)
def working_sets(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    empty = c.select(F.lit("a").alias("set_name"), "id").limit(0)
    s = sets.set_add(empty, "A", c.filter("c_mktsegment = 'BUILDING'"))
    s = sets.set_add(s, "a", c.filter("c_acctbal > 8000"))
    s = sets.set_remove(s, "A", c.filter("c_nationkey = 3"))
    return sets.set_list(sets.set_add(s, "B", c.filter("c_mktsegment = 'MACHINERY'")))


@query(
    "integrity",
    """SELECT 'duplicate' AS kind, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""",
)
def integrity(spark, d):
    dup = filters.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    orp = filters.orphans(table(spark, d, "labels"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id", "doc_id").agg(F.count("*").alias("n"))
    return dup.select(F.lit("duplicate").alias("kind"), "n").unionByName(orp.select(F.lit("orphan").alias("kind"), "n"))


@query(
    "run_summary",
    """SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate, round(sum(value), 2) AS total_value, round(avg(value) FILTER (WHERE value <> 0), 6) AS mean_value FROM events""",
)
def run_summary(spark, d):
    out = aggregates.run_summary(table(spark, d, "events"), ["value"], F.col("event_type") != "error")
    return out.withColumns({"success_rate": F.round("success_rate", 6), "total_value": F.round("total_value", 2), "mean_value": F.round("mean_value", 6)})


@query(
    "hits_by_database",
    "SELECT l_returnflag AS source, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_proteins, count(DISTINCT l_suppkey) AS n_models FROM lineitem GROUP BY 1",
)
def hits_by_database(spark, d):
    return aggregates.hits_by_database(R.annotations(spark, d))[0]


@query("metric_pivot", "SELECT o_custkey AS file, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS \"F\", max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY 1")
def metric_pivot(spark, d):
    from ..operators.registry import feature_pivot

    tall = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderstatus").alias("metric_name"), F.col("o_totalprice").alias("metric_value"))
    return feature_pivot(tall, ["F", "O"], "file")


@query(
    "upsert",
    "SELECT c_custkey AS vec_id, CASE WHEN c_nationkey = 7 THEN -c_acctbal ELSE c_acctbal END AS v FROM customer",
)
def upsert(spark, d):
    from ..sources.sinks import upsert as merge

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("vec_id"), F.col("c_acctbal").alias("v"), "c_nationkey")
    return merge(c.drop("c_nationkey"), c.filter("c_nationkey = 7").select("vec_id", (-F.col("v")).alias("v")))


@query(
    "url_source",
    """SELECT page_id, CASE WHEN contains(lower(url), '/fr/') THEN 'french' WHEN contains(lower(url), '/de/') THEN 'german' ELSE 'other' END AS source FROM pages""",
)
def url_source(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", S.source_of_path(F.col("url"), [("/fr/", "french"), ("/de/", "german"), ("", "other")]).alias("source"))


@query("first_of_class", "SELECT doc_id FROM documents WHERE (source, lang) IN (SELECT (source, lang) FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r <= 2)")
def first_of_class(spark, d):
    return windows.first_of_class(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 2).select("doc_id")
