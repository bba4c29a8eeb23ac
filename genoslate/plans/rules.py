"""Tag rules, classification, pathways and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import classify, graph, joins, tags, validate
from . import roles as R
from .roles import query, table

#: Rules of our own over the words of part names, with a hierarchy above them.
WORD_RULES = [("ring", ["jewel"]), ("bolt", ["fastener"]), ("gear", ["machine_part"]), ("small", ["compact"]), ("blue", ["cool_colour"])]
PARENTS = [("jewel", "ornament"), ("ornament", "object"), ("fastener", "machine_part"), ("machine_part", "object"), ("cool_colour", "colour")]

_RULE_SQL = ", ".join(f"('{w}', '{t[0]}')" for w, t in WORD_RULES)
_UP_SQL = ", ".join(f"('{a}', '{b}')" for a, b in PARENTS)


@query(
    "tag_generation",
    f"""WITH RECURSIVE rules(word, tag) AS (VALUES {_RULE_SQL}), up(child, parent) AS (VALUES {_UP_SQL}),
anc(child, ancestor) AS (SELECT child, parent FROM up UNION SELECT anc.child, up.parent FROM anc JOIN up ON anc.ancestor = up.child),
base AS (SELECT p_partkey, tag FROM part JOIN rules ON contains(p_name, word)),
full_tags AS (SELECT * FROM base UNION SELECT p_partkey, ancestor FROM base JOIN anc ON child = tag),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT p_partkey AS protein_id, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM full_tags f WHERE f.p_partkey = part.p_partkey), '') AS tags FROM part""",
)
def tag_generation(spark, d):
    """Pattern rules on distinct names, then the hierarchy."""
    a = table(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.lit("name").alias("source"), F.lit(None).cast("string").alias("accession"), F.col("p_name").alias("name"), F.lit("").alias("description"))
    patterns = spark.createDataFrame([("name", w, t) for w, t in WORD_RULES], "source string, pattern string, tags array<string>")
    vocabulary = spark.createDataFrame(PARENTS, "predicate_id string, parent string")
    hit = tags.pattern_tags(tags.descriptors(a), patterns).select("name", F.col("pattern").alias("tags"))
    per = a.join(hit, "name", "left").select("protein_id", F.coalesce("tags", tags.no_tags()).alias("tags"))
    out = tags.expand_hierarchy(per, tags.hierarchy_closure(vocabulary))
    return out.select("protein_id", F.array_join("tags", ",").alias("tags"))


@query(
    "status_tags",
    """WITH s AS (SELECT p_partkey AS protein_id, count(l_partkey) AS n, count(*) FILTER (WHERE l_extendedprice < 2000) AS sure, count(DISTINCT l_returnflag) AS sources, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS domains
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT protein_id, concat_ws(',', CASE WHEN n > 0 AND domains >= 3 THEN 'multi_domain' END, CASE WHEN n > 0 AND sources >= 2 THEN 'multi_source' END, CASE WHEN n > 0 AND domains = 1 THEN 'single_domain' END,
CASE WHEN n > 0 AND sources = 1 THEN 'single_source' END, CASE WHEN n = 0 THEN 'unannotated' END, CASE WHEN sure >= 3 THEN 'well_annotated' END) AS tags FROM s""",
)
def status_tags(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("protein_id"), F.col("l_returnflag").alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("accession"), F.when(F.col("l_extendedprice") < 2000, 1e-20).otherwise(1.0).alias("evalue"))
    return tags.status_tags(R.proteins(spark, d), a, domain_source="R").select("protein_id", F.array_join("tags", ",").alias("tags"))


@query(
    "property_tags",
    """WITH s AS (SELECT *, avg(p_retailprice) OVER w AS m, coalesce(stddev_samp(p_retailprice) OVER w, 0) AS sd FROM part WINDOW w AS (PARTITION BY p_type))
SELECT p_partkey AS protein_id, concat_ws(',', CASE WHEN sd > 0 AND p_retailprice > 1500 THEN 'gc_high' END, CASE WHEN sd > 0 AND p_retailprice < 1000 THEN 'gc_low' END, CASE WHEN sd > 0 AND abs(p_retailprice - m) > 1.5 * sd THEN 'gc_outlier' END,
CASE WHEN p_size >= 20 THEN 'giant' END, CASE WHEN p_size >= 40 THEN 'massive' END, CASE WHEN p_size >= 50 THEN 'small' ELSE 'tiny' END) AS tags FROM s""",
)
def property_tags(spark, d):
    return tags.property_tags(R.proteins(spark, d), giant=20, massive=40, deviations=1.5, gc_high=1500, gc_low=1000).select("protein_id", F.array_join("tags", ",").alias("tags"))


@query(
    "rule_text",
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'the and') THEN 'boilerplate' WHEN regexp_matches(text, ' \\| ') THEN 'table' ELSE 'prose' END AS section FROM documents",
)
def rule_text(spark, d):
    """Ordered rules over whole texts."""
    return table(spark, d, "documents").select("doc_id", X.first_rule(F.col("text"), [("the and", "boilerplate"), (r" \| ", "table")], "prose").alias("section"))


@query(
    "pathway_completeness",
    """WITH have AS (SELECT DISTINCT o_custkey AS bin_id, p_brand AS accession FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
rules AS (SELECT 'P' || (b % 3) AS pathway, 'step' || lpad((b // 6)::VARCHAR, 2, '0') AS step, 'Brand#' || b AS accession FROM range(1, 26) t(b)),
steps AS (SELECT pathway, count(DISTINCT step)::INTEGER AS steps FROM rules GROUP BY 1),
done AS (SELECT bin_id, pathway, count(DISTINCT step)::INTEGER AS k FROM have JOIN rules USING (accession) GROUP BY ALL)
SELECT g.bin_id, s.pathway, coalesce(k, 0) AS steps_done, steps, round(100 * coalesce(k, 0) / steps, 1) AS percent,
CASE WHEN coalesce(k, 0) = steps THEN 'COMPLETE' WHEN 100 * coalesce(k, 0) / steps > 50 THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS status, (steps - coalesce(k, 0))::INTEGER AS n_missing
FROM (SELECT DISTINCT bin_id FROM have) g CROSS JOIN steps s LEFT JOIN done USING (bin_id, pathway)""",
)
def pathway_completeness(spark, d):
    """Customers as genomes, brands as orthologs, three pathways."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    have = li.select(F.col("o_custkey").alias("bin_id"), F.col("p_brand").alias("accession"))
    rules = spark.range(1, 26).select(F.concat(F.lit("P"), (F.col("id") % 3).cast("string")).alias("pathway"), F.concat(F.lit("step"), F.lpad(F.floor(F.col("id") / 6).cast("string"), 2, "0")).alias("step"), F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("accession"))
    return classify.pathway_completeness(have, rules).withColumn("n_missing", F.size("missing")).drop("missing")


@query(
    "annotation_consistency",
    f"""WITH {R.ANNOTATIONS_SQL}, l AS (SELECT p_partkey AS protein_id, CASE WHEN b2.name IS NULL THEN '' ELSE b2.name || ' (' || b2.accession || ')' END AS label FROM part LEFT JOIN
(SELECT protein_id, name, accession FROM (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY evalue NULLS LAST, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM a) WHERE rn = 1) b2 ON b2.protein_id = p_partkey)
SELECT protein_id, label, CASE WHEN contains(label, 'sup1') THEN 'consistent' WHEN label <> '' THEN 'inconsistent' ELSE 'uncertain' END AS status, NOT contains(label, 'sup1') AND regexp_matches(label, 'sup2') AS false_positive FROM l""",
)
def annotation_consistency(spark, d):
    return validate.annotation_consistency(R.proteins(spark, d), R.annotations(spark, d), "sup1", ["sup2"])


@query(
    "error_scan",
    f"""WITH {R.GENES_SQL}, {R.ANNOTATIONS_SQL}, f AS (SELECT DISTINCT protein_id, name FROM a WHERE name IN ('sup1', 'sup2', 'sup3')), o AS (SELECT DISTINCT protein_id, coalesce(name, description, 'unannotated') AS said FROM a)
SELECT 'problem_domain' AS kind, f.protein_id, f.name || ': ' || o.said AS detail FROM f JOIN o USING (protein_id) WHERE (f.name = 'sup1' AND (contains(o.said, 'sup9') OR contains(o.said, 'sup12'))) OR (f.name = 'sup2' AND o.said = 'O') UNION
SELECT 'overlaps_array', l.protein_id, r.protein_id || ': ' || coalesce(o.said, 'unannotated') FROM (SELECT * FROM g WHERE label = 'view') l JOIN (SELECT * FROM g WHERE label = 'error') r ON l.contig_id = r.contig_id AND l.start < r.end_coord AND l.end_coord > r.start LEFT JOIN o ON o.protein_id = l.protein_id""",
)
def error_scan(spark, d):
    """Both kinds of findings, uncapped: domains whose protein tells of an indicator, and genes over arrays."""
    g = R.genes(spark, d)
    arrays = g.filter("label = 'error'").withColumn("locus_id", F.col("protein_id").cast("string"))
    problems = spark.createDataFrame([("sup1", ["SUP9", "sup12"]), ("sup2", ["O"]), ("sup3", [])], "domain string, indicators array<string>")
    # an indicator is found anywhere in a text: "O" is the whole description of rows without a name
    a = R.annotations(spark, d).withColumn("name", F.when(F.lower("name").contains("sup"), F.col("name")))
    return validate.error_scan(a, g.filter("label = 'view'"), arrays, problems, limit=None)


@query(
    "priority_label",
    """WITH c AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN u IS NOT NULL THEN 'u' || u WHEN f IS NOT NULL THEN 'f' || f WHEN c_acctbal > 5000 THEN 'rich' ELSE '?' END AS label,
CASE WHEN u IS NOT NULL THEN 'urgent' WHEN f IS NOT NULL THEN 'finished' WHEN c_acctbal > 5000 THEN 'balance' END AS source FROM customer LEFT JOIN c ON o_custkey = c_custkey""",
)
def priority_label(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    first = lambda cond, p: o.filter(cond).groupBy("c_custkey").agg(F.concat(F.lit(p), F.min("o_orderkey").cast("string")).alias("label"))
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey", F.lit("rich").alias("label"))
    return joins.priority_label(table(spark, d, "customer"), "c_custkey", ("urgent", first("o_orderpriority = '1-URGENT'", "u")), ("finished", first("o_orderstatus = 'F'", "f")), ("balance", rich))


@query(
    "dag_depth",
    """WITH RECURSIVE n AS (SELECT conv_id * 100000 + turn AS node, conv_id, turn FROM conversations), e AS (SELECT a.node AS parent, b.node AS child FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w(node, depth) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node)
SELECT node, depth::INTEGER AS depth FROM w""",
)
def dag_depth(spark, d):
    """Turns as steps: turn n + 1 follows turn n."""
    n = table(spark, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("node"), "conv_id", "turn")
    e = n.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("node").alias("parent")).join(n, ["conv_id", "turn"]).select(F.col("node").alias("child"), "parent")
    return graph.depths(n.select("node"), e)


@query(
    "topology",
    """WITH t AS (SELECT event_id, repeat('i', (event_id % 7)::INTEGER) || repeat('M', (event_id % 5)::INTEGER) || 'o' || repeat('M', (event_id % 3)::INTEGER) AS s FROM events),
k AS (SELECT event_id, s, len(regexp_extract_all(s, 'M+')) AS n FROM t)
SELECT event_id, concat_ws(',', CASE WHEN n >= 2 THEN 'multi_pass_membrane' END, CASE WHEN n > 0 AND s[1] = 'i' THEN 'n_in_topology' END, CASE WHEN n > 0 AND s[1] = 'o' THEN 'n_out_topology' END,
CASE WHEN n >= 4 THEN 'polytopic_membrane' END, CASE WHEN n = 1 THEN 'single_pass_membrane' END, CASE WHEN n = 0 THEN 'soluble_predicted' END, CASE WHEN n >= 1 THEN 'transmembrane_predicted' END) AS tags, n::INTEGER AS n_helices FROM k""",
)
def topology(spark, d):
    e = F.col("event_id")
    s = F.concat(F.repeat(F.lit("i"), (e % 7).cast("int")), F.repeat(F.lit("M"), (e % 5).cast("int")), F.lit("o"), F.repeat(F.lit("M"), (e % 3).cast("int")))
    t = tags.topology_tags(table(spark, d, "events").select("event_id", s.alias("topology")))
    return t.select("event_id", F.array_join("tags", ",").alias("tags"), F.size("helices").alias("n_helices"))


@query(
    "interest_scores",
    """WITH z AS (SELECT p_partkey, CASE WHEN coalesce(stddev_samp(p_size) OVER b, 0) = 0 THEN 0 ELSE (p_size - avg(p_size) OVER b) / stddev_samp(p_size) OVER b END AS sz,
CASE WHEN coalesce(stddev_samp(p_retailprice) OVER t, 0) = 0 THEN 0 ELSE (p_retailprice - avg(p_retailprice) OVER t) / stddev_samp(p_retailprice) OVER t END AS gc FROM part WINDOW b AS (PARTITION BY p_brand), t AS (PARTITION BY p_type))
SELECT p_partkey AS protein_id, round(abs(sz) + abs(gc) + CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 0 ELSE 1 END, 5) AS interest FROM z""",
)
def interest_scores(spark, d):
    p = R.proteins(spark, d).withColumn("sequence_length", F.col("sequence_length").cast("double"))
    return validate.interest_scores(p, R.annotations(spark, d)).select("protein_id", F.round("interest", 5).alias("interest"))


@query(
    "ec_prefix_lookup",
    """WITH p AS (SELECT p_partkey, ['1.' || (p_size % 4) || '.' || (p_partkey % 3) || '.1', '1.' || (p_size % 4) || '.' || (p_partkey % 3), '1.' || (p_size % 4), '1'] AS x FROM part)
SELECT p_partkey AS protein_id, CASE WHEN x[2] = '1.1.2' THEN 'deep' WHEN x[3] IN ('1.1', '1.3') THEN 'middle' ELSE 'top' END AS tags FROM p""",
)
def ec_prefix_lookup(spark, d):
    p = table(spark, d, "part")
    number = F.concat(F.lit("protein [EC:1."), (F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string"), F.lit(".1]"))
    a = p.select("p_partkey", F.lit("kegg").alias("source"), F.col("p_partkey").cast("string").alias("accession"), number.alias("description"))
    rules = spark.createDataFrame([("1", ["top"]), ("1.1", ["middle"]), ("1.3", ["middle"]), ("1.1.2", ["deep"])], "prefix string, tags array<string>")
    return tags.ec_tags(a, rules).select(F.col("p_partkey").alias("protein_id"), F.array_join("ec", ",").alias("tags"))


@query("overlap_flags", f"WITH {R.GENES_SQL} SELECT DISTINCT l.protein_id, 'overlaps_error' AS tags FROM g l JOIN g r ON l.contig_id = r.contig_id AND l.start < r.end_coord AND l.end_coord > r.start WHERE r.label = 'error' AND l.label <> 'error'")
def overlap_flags(spark, d):
    g = R.genes(spark, d)
    loci = g.withColumnRenamed("protein_id", "locus_id").withColumnRenamed("label", "locus_type")
    return classify.overlap_flags(g.filter("label <> 'error'"), loci, "error", "overlaps_error").select("protein_id", F.array_join("tags", ",").alias("tags"))
