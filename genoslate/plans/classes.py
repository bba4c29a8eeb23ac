"""Rule sets by source, systems and their loci, subgroups and orthologs, each through its operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, tags, windows
from . import roles as R
from .roles import query, table
from .rules import PARENTS


def text(*parts) -> F.Column:
    """The parts as one text; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


RULE = "source string, accession string, tags array<string>"
PATTERN = "source string, pattern string, tags array<string>, field string, unless string"


def _shown(out):
    return out.select("protein_id", F.array_join("tags", ",").alias("tags"))


@query(
    "viral_tags",
    """WITH v AS (SELECT s_suppkey AS k, ['Xr', 'XhXs', 'Xu', 'other', 'XpXr'][s_suppkey % 5 + 1] AS name, ['hypothetical tail', 'Tail fiber', 'capsid'][s_suppkey % 3 + 1] AS about FROM supplier),
t AS (SELECT k, unnest(['vog:V' || k, 'vog_annotated']) AS tag FROM v UNION SELECT k, 'direct' FROM v WHERE k % 7 = 0
UNION SELECT k, 'viral_replication' FROM v WHERE k % 7 <> 0 AND name IN ('Xr', 'XpXr') UNION SELECT k, 'viral_structure' FROM v WHERE k % 7 <> 0 AND name = 'XhXs'
UNION SELECT k, 'host_beneficial' FROM v WHERE k % 7 <> 0 AND name = 'XhXs' UNION SELECT k, 'virus_beneficial' FROM v WHERE k % 7 <> 0 AND name = 'XpXr'
UNION SELECT k, 'tail_protein' FROM v WHERE k % 7 <> 0 AND about = 'Tail fiber' UNION SELECT k, 'hypothetical' FROM v WHERE about LIKE 'hypo%')
SELECT k AS protein_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY k""",
)
def viral_tags(spark, d):
    """A direct rule alone, else category codes and patterns of the description, unless it is hypothetical (K5d)."""
    k = F.col("s_suppkey")
    names = F.array(*map(F.lit, ("Xr", "XhXs", "Xu", "other", "XpXr")))
    about = F.array(*map(F.lit, ("hypothetical tail", "Tail fiber", "capsid")))
    a = table(spark, d, "supplier").select(
        k.alias("protein_id"), F.lit("VOGdb").alias("source"), text("V", k).alias("accession"), F.element_at(names, (k % 5 + 1).cast("int")).alias("name"),
        F.element_at(about, (k % 3 + 1).cast("int")).alias("description"), F.lit(None).cast("double").alias("evalue"),
    )
    exact = a.filter("protein_id % 7 = 0").select(F.lit("vogdb").alias("source"), "accession", F.array(F.lit("direct")).alias("tags"))
    patterns = spark.createDataFrame([("vogdb", r"\btail\b", ["tail_protein"], "description", "hypothetical")], PATTERN)
    codes = [("vogdb", "Xr", ["viral_replication"]), ("vogdb", "Xs", ["viral_structure"]), ("vogdb", "Xh", ["host_beneficial"]), ("vogdb", "Xp", ["virus_beneficial"])]
    categories = spark.createDataFrame(codes, "source string, code string, tags array<string>")
    return _shown(tags.annotation_tags(a, exact, patterns, direct_only=["vogdb"], categories=categories))


@query(
    "defense_tags",
    """WITH v AS (SELECT s_suppkey AS k, ['Cas9_x', 'RM_TypeI', 'Other', 'CBASS_cas'][s_suppkey % 4 + 1] || s_suppkey AS acc, CASE s_suppkey % 3 WHEN 0 THEN 'NiFe' WHEN 1 THEN 'fe_only' ELSE 'x' END AS h FROM supplier),
t AS (SELECT k, unnest(['defensefinder:' || acc, 'defensefinder_annotated', 'hyddb:' || h, 'hyddb_annotated', 'confident_hit']) AS tag FROM v UNION SELECT k, unnest(['crispr_associated', 'defense_system']) FROM v WHERE lower(acc) LIKE '%cas%'
UNION SELECT k, unnest(['restriction_modification', 'defense_system']) FROM v WHERE acc LIKE 'RM%' UNION SELECT k, unnest(['cbass', 'defense_system']) FROM v WHERE acc LIKE 'CB%'
UNION SELECT k, unnest(['nife_hydrogenase', 'hydrogenase']) FROM v WHERE h = 'NiFe' UNION SELECT k, unnest(['fe_only_hydrogenase', 'hydrogenase']) FROM v WHERE h = 'fe_only')
SELECT k AS protein_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY k""",
)
def defense_tags(spark, d):
    """Keywords of the accession, and classes by it, with tags for the source (K5e)."""
    k = F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("Cas9_x", "RM_TypeI", "Other", "CBASS_cas")))
    s = table(spark, d, "supplier")
    blank, sure = F.lit("").alias("name"), F.lit(1e-30).alias("evalue")
    a = s.select(k.alias("protein_id"), F.lit("DefenseFinder").alias("source"), text(F.element_at(kinds, (k % 4 + 1).cast("int")), k).alias("accession"), blank, F.lit("").alias("description"), sure)
    h = s.select(k.alias("protein_id"), F.lit("hyddb").alias("source"), F.when(k % 3 == 0, "NiFe").when(k % 3 == 1, "fe_only").otherwise("x").alias("accession"), blank, F.lit("").alias("description"), sure)
    exact = spark.createDataFrame([("hyddb", "nife", ["nife_hydrogenase", "hydrogenase"]), ("hyddb", "fe_only", ["fe_only_hydrogenase", "hydrogenase"])], RULE)
    # Words of accessions and their tags.
    rules = [("cas|crispr", ["crispr_associated", "defense_system"]), ("rm_|restriction|methylase", ["restriction_modification", "defense_system"]), ("cbass|cyclic", ["cbass", "defense_system"])]
    patterns = spark.createDataFrame([("defensefinder", p, t, "accession", None) for p, t in rules], PATTERN)
    out = tags.annotation_tags(a.unionByName(h), exact, patterns)
    one = out.select("protein_id", F.explode("tags").alias("tag")).groupBy("protein_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return _shown(one)


@query(
    "carbohydrate_tags",
    """WITH v AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'GH1' WHEN s_suppkey % 3 = 1 THEN 'GH' || s_suppkey + 10 ELSE 'GT2' END AS acc FROM supplier)
SELECT k AS protein_id, array_to_string(list_sort(list_concat(['cazy:' || CASE WHEN k % 2 = 0 THEN acc ELSE ' ' || lower(acc) END, 'cazy_annotated'], CASE WHEN acc = 'GH1' THEN ['beta_glucosidase'] WHEN acc LIKE 'GH%' THEN ['glycoside_hydrolase'] ELSE [] END)), ',') AS tags FROM v""",
)
def carbohydrate_tags(spark, d):
    """A family's rule whatever its case, else the class of its letters."""
    k = F.col("s_suppkey")
    family = F.when(k % 3 == 0, "GH1").when(k % 3 == 1, text("GH", k + 10)).otherwise("GT2")
    shown = F.when(k % 2 == 0, family).otherwise(text(" ", F.lower(family)))
    a = table(spark, d, "supplier").select(k.alias("protein_id"), F.lit("cazy").alias("source"), shown.alias("accession"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("evalue"))
    exact = spark.createDataFrame([("cazy", "gh1", ["beta_glucosidase"])], RULE)
    patterns = spark.createDataFrame([("cazy", r"^\s*GH", ["glycoside_hydrolase"], "accession", None)], PATTERN)
    return _shown(tags.annotation_tags(a, exact, patterns, fallback_only=["cazy"]))


@query("conflict_tags", "SELECT p_partkey AS protein_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN 'x' WHEN p_partkey % 2 = 0 THEN 'hydrogenase,nife,x' ELSE 'x' END AS tags FROM part")
def conflict_tags(spark, d):
    """A call without the domain it needs but with one that rules it out loses its tags (K5i)."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    t = p.select(k.alias("protein_id"), F.when(k % 2 == 0, F.array(*map(F.lit, ("hydrogenase", "nife", "x")))).otherwise(F.array(F.lit("x"))).alias("tags"))
    a = p.select(k.alias("protein_id"), F.explode(F.array_compact(F.array(F.when(k % 3 == 0, "PF00374"), F.when(k % 5 == 0, "PF00346")))).alias("accession"))
    return _shown(tags.drop_conflicts(t, a, "nife", ["PF00374"], ["PF00346", "PF00329"], ["nife", "hydrogenase", "hydrogen_metabolism"]))


@query("system_tags", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 2 = 0 THEN 'cas9' END, CASE WHEN o_custkey % 3 = 1 THEN 'crispr_class_1' WHEN o_custkey % 3 = 2 THEN 'crispr_class_2' END, 'crispr_subtype_' || lower(o_orderstatus) || '_b', 'crispr_type_' || lower(o_orderstatus)) AS tags FROM orders")
def system_tags(spark, d):
    """Tags of a system's class, type, subtype and nuclease (K9)."""
    c = F.col("o_custkey")
    cls = F.when(c % 3 == 1, "1").when(c % 3 == 2, "2")
    made = tags.system_tags(F.col("o_orderstatus"), text(F.col("o_orderstatus"), "-B"), cls, F.when(c % 2 == 0, "Cas9"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(made, ",").alias("tags"))


@query("vocabulary_entries", "SELECT c_mktsegment AS predicate_id, max(c_custkey) AS place, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1")
def vocabulary_entries(spark, d):
    """One entry for each id, the last."""
    v = table(spark, d, "customer").select(F.col("c_mktsegment").alias("predicate_id"), F.col("c_custkey").alias("place"), F.col("c_name").alias("name"))
    return tags.vocabulary_unique(v, "place")


_SYSTEM_MODELS = [("purchase", "I", "I-A", "effector", 1), ("view", "II", "II-B", "backbone", 2), ("error", "III", None, "backbone", 1), ("error", "IV", "IV-X", "accessory", 2)]

_SYSTEMS_SQL = f"""{R.GENES_SQL}, h AS (SELECT protein_id, contig_id, start, end_coord, label,
 CASE label WHEN 'purchase' THEN 'I' WHEN 'view' THEN 'II' WHEN 'error' THEN 'IV' ELSE 'Core' END AS system, CASE label WHEN 'purchase' THEN 'I-A' WHEN 'view' THEN 'II-B' WHEN 'error' THEN 'IV-X' END AS subtype,
 CASE label WHEN 'purchase' THEN 'effector' WHEN 'view' THEN 'backbone' WHEN 'error' THEN 'accessory' WHEN 'click' THEN 'adaptation' ELSE 'Unknown' END AS role FROM g),
m AS (SELECT *, max(end_coord) OVER (PARTITION BY contig_id ORDER BY start, protein_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
c AS (SELECT *, (sum(CASE WHEN reach IS NULL OR start - reach > 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id ORDER BY start, protein_id))::BIGINT AS locus FROM m)"""


def _mode_sql(column: str, where: str) -> str:
    return f"(SELECT {column} FROM c x WHERE x.contig_id = k.contig_id AND x.locus = k.locus AND {where} GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


def _systems(spark, d):
    g = R.genes(spark, d).withColumn("bin_id", F.col("contig_id") % 5)
    hits = g.select("protein_id", F.initcap("label").alias("hmm_name"), F.col("value").alias("score"))
    # a second, worse hit of every gene never counts
    hits = hits.unionByName(hits.select("protein_id", F.lit("purchase").alias("hmm_name"), (F.col("score") - 1).alias("score")))
    models = spark.createDataFrame(_SYSTEM_MODELS, "model string, system string, subtype string, role string, position int")
    arrays = g.filter("label = 'signup'").select(F.col("protein_id").alias("locus_id"), "contig_id", "start", "end_coord")
    return classify.classify_systems(hits, g, arrays, models, [("click", "adaptation")], array_gap=3600)


@query(
    "system_genes",
    f"""WITH {_SYSTEMS_SQL} SELECT c.protein_id, c.system, c.subtype, c.role, c.locus, coalesce(bool_or(least(abs(c.start - s.end_coord), abs(c.end_coord - s.start)) <= 3600), false) AS near_array
FROM c LEFT JOIN (SELECT * FROM g WHERE label = 'signup') s ON s.contig_id = c.contig_id AND c.start <= s.end_coord + 3600 AND c.end_coord >= s.start - 3600 GROUP BY ALL""",
)
def system_genes(spark, d):
    """Class of each gene by table (the last entry of a model), else by rules; distance to arrays; cluster."""
    placed, _ = _systems(spark, d)
    return placed.select("protein_id", "system", "subtype", "role", "locus", "near_array")


@query(
    "system_loci",
    f"""WITH {_SYSTEMS_SQL}, k AS (SELECT contig_id, locus, count(*) AS n_proteins, min(start) AS start, max(end_coord) AS end_coord FROM c GROUP BY 1, 2),
t AS (SELECT *, coalesce({_mode_sql("system", "x.role = 'effector'")}, {_mode_sql("system", "x.role = 'backbone'")}, 'Core') AS s, {_mode_sql("system", "x.system <> 'Core'")} AS other, {_mode_sql("subtype", "x.subtype IS NOT NULL")} AS subtype FROM k)
SELECT contig_id, locus, start, end_coord, n_proteins, CASE WHEN s = 'Core' THEN coalesce(other, 'Core') ELSE s END AS system, subtype, n_proteins >= 4 AS is_complete FROM t""",
)
def system_loci(spark, d):
    """A system for each cluster: by its effectors, else its backbone, else the most common other one (K8)."""
    _, loci = _systems(spark, d)
    return loci.select("contig_id", "locus", "start", "end_coord", "n_proteins", "system", "subtype", "is_complete")


@query(
    "array_report",
    f"""WITH {R.GENES_SQL}, e AS (SELECT * FROM g WHERE label = 'error'), z AS (SELECT contig_id, max(end_coord) + 500 AS len FROM g GROUP BY 1),
n AS (SELECT e.protein_id AS locus_id, list_sort(list(CASE g.label WHEN 'purchase' THEN 'cas9' WHEN 'signup' THEN 'cas1' ELSE 'cmr' END)) AS x FROM e JOIN g ON g.contig_id = e.contig_id AND abs(g.start - e.start) < 15000 WHERE g.label IN ('purchase', 'signup', 'click') GROUP BY 1)
SELECT e.protein_id AS locus_id, e.start < 1704070000 OR z.len - e.end_coord < 1704070000 - 1704069000 AS at_edge, coalesce(array_to_string(x, ','), '') AS neighbors,
CASE WHEN list_contains(x, 'cas9') THEN 'II' WHEN list_contains(x, 'cmr') THEN 'III' WHEN list_contains(x, 'cas1') THEN 'I/II/V (adaptation only)' ELSE 'Unknown' END AS system, false AS is_complete, x IS NULL AS is_orphan
FROM e JOIN z USING (contig_id) LEFT JOIN n ON n.locus_id = e.protein_id""",
)
def array_report(spark, d):
    """Arrays with their neighbours, system, edge and completeness (K10); positions count from a day's begin."""
    origin = 1_704_069_000
    g = R.genes(spark, d).withColumns({"start": F.col("start") - origin, "end_coord": F.col("end_coord") - origin})
    named = F.when(F.col("label") == "purchase", "Cas9").when(F.col("label") == "signup", "Cas1").when(F.col("label") == "click", "Cmr").otherwise(F.col("label"))
    contigs = g.groupBy("contig_id").agg((F.max("end_coord") + 500).alias("length"))
    arrays = g.filter("label = 'error'").select(F.col("protein_id").alias("locus_id"), "contig_id", "start", "end_coord")
    out = classify.array_systems(arrays, g.withColumn("label", named), contigs)
    return out.select("locus_id", "at_edge", F.array_join("neighbors", ",").alias("neighbors"), "system", "is_complete", "is_orphan")


@query(
    "subgroup_calls",
    """WITH h AS (SELECT l_partkey AS protein_id, l_extendedprice AS e, l_suppkey, 'acc|org, [' || CASE WHEN l_suppkey % 2 = 0 THEN 'NiFe' ELSE 'FeFe' END || ']_Group_' || l_suppkey % 4 || 'a' AS subject FROM lineitem),
b AS (SELECT protein_id, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'NiFe' ELSE 'FeFe' END AS kind, l_suppkey % 4 || 'a' AS subgroup FROM (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY e, subject) AS r FROM h) WHERE r = 1),
c AS (SELECT *, kind = 'NiFe' AND protein_id % 3 <> 0 AS cur FROM b WHERE subgroup IN ('0a', '1a', '2a'))
SELECT protein_id, kind, subgroup, cur AS needs_curation, array_to_string(list_sort(list_concat(['hyddb_subgroup:' || subgroup, 'group_' || left(subgroup, 1)], CASE WHEN cur THEN ['hyddb_needs_curation'] ELSE [] END)), ',') AS tags FROM c""",
)
def subgroup_calls(spark, d):
    """Subgroup of the best reference hit, its tags, and whether a domain that backs it is missing."""
    li = table(spark, d, "lineitem")
    k = F.col("l_suppkey")
    hits = li.select(F.col("l_partkey").alias("protein_id"), text("acc|org, [", F.when(k % 2 == 0, "NiFe").otherwise("FeFe"), "]_Group_", k % 4, "a").alias("subject"), F.col("l_extendedprice").alias("evalue"))
    domains = table(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.when(F.col("p_partkey") % 3 == 0, "PF00374").otherwise("PF1").alias("accession"))
    groups = spark.createDataFrame([(f"{i}a", [f"group_{i}"]) for i in range(3)], "subgroup string, tags array<string>")
    out = classify.subgroup_calls(hits, domains, groups, [("NiFe", ["PF00374"])])
    return out.select("protein_id", "kind", "subgroup", "needs_curation", F.array_join("tags", ",").alias("tags"))


@query(
    "ortholog_context",
    """SELECT l_partkey AS protein_id, string_agg(DISTINCT 'S' || l_suppkey, ',' ORDER BY 'S' || l_suppkey) AS orthologs,
concat_ws(',', CASE WHEN bool_or(l_suppkey % 11 <> 0 AND ('sup' || l_suppkey) LIKE '%9%') THEN 'nine' END, CASE WHEN bool_or(l_suppkey % 11 <> 0 AND ('sup' || l_suppkey) LIKE '%sup1%') THEN 'one' END) AS hints FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def ortholog_context(spark, d):
    """Orthologs of each protein and what their texts hint at."""
    out = classify.ortholog_context(R.annotations(spark, d), [("sup1", "one"), ("9", "nine")], source="R")
    return out.select("protein_id", F.array_join("orthologs", ",").alias("orthologs"), F.array_join("hints", ",").alias("hints"))


@query(
    "pathway_overview",
    """WITH have AS (SELECT DISTINCT o_custkey AS bin_id, p_brand AS accession FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), r AS (SELECT 'P' || b % 3 AS pathway, 's' || b AS step, 'Brand#' || b AS accession FROM range(1, 26) t(b)),
n AS (SELECT pathway, count(*) AS k FROM r GROUP BY 1), c AS (SELECT bin_id, pathway, round(100 * count(*) / any_value(k), 1) AS percent FROM have JOIN r USING (accession) JOIN n USING (pathway) GROUP BY 1, 2)
SELECT pathway, count(*) FILTER (WHERE percent > 70) AS n_genomes, max(percent) AS best FROM c GROUP BY 1""",
)
def pathway_overview(spark, d):
    """Genomes above a share of each pathway, and the best."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    have = li.select(F.col("o_custkey").alias("bin_id"), F.col("p_brand").alias("accession"))
    k = F.col("id")
    rules = spark.range(1, 26).select(text("P", k % 3).alias("pathway"), text("s", k).alias("step"), text("Brand#", k).alias("accession"))
    return classify.pathway_overview(classify.pathway_completeness(have, rules), 70)


_FULL_SQL = """p AS (SELECT *, avg(p_retailprice) OVER w AS m, coalesce(stddev_samp(p_retailprice) OVER w, 0) AS sd FROM part WINDOW w AS (PARTITION BY p_type)),
a AS (SELECT l_partkey AS k, lower(l_returnflag) AS src, l_suppkey, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice * 1e-14 END AS e FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
up(child, parent) AS (VALUES {up}), anc(child, ancestor) AS (SELECT child, parent FROM up UNION SELECT anc.child, up.parent FROM anc JOIN up ON anc.ancestor = up.child),
s AS (SELECT k, count(*) FILTER (WHERE e < 1e-10) AS sure, count(DISTINCT src) AS sources FROM a GROUP BY 1),
base AS (SELECT k, src || ':S' || l_suppkey AS tag FROM a UNION SELECT k, src || '_annotated' FROM a UNION SELECT k, 'confident_hit' FROM a WHERE e < 1e-10 UNION SELECT k, 'weak_hit' FROM a WHERE e > 1e-5
 UNION SELECT k, 'jewel' FROM a WHERE src = 'r' AND l_suppkey = 3 UNION SELECT k, 'fastener' FROM a WHERE src = 'a' AND l_suppkey = 4 UNION SELECT k, 'compact' FROM a WHERE src = 'n' AND l_suppkey % 11 <> 0 AND ('sup' || l_suppkey) LIKE 'sup1%'
 UNION SELECT p_partkey, CASE WHEN p_size < 50 THEN 'tiny' ELSE 'small' END FROM p UNION SELECT p_partkey, 'gc_high' FROM p WHERE sd > 0 AND p_retailprice > 0.6 UNION SELECT p_partkey, 'gc_outlier' FROM p WHERE sd > 0 AND abs(p_retailprice - m) > 2 * sd
 UNION SELECT p_partkey, 'unannotated' FROM p WHERE p_partkey NOT IN (SELECT k FROM a) UNION SELECT k, 'well_annotated' FROM s WHERE sure >= 3 UNION SELECT k, CASE WHEN sources = 1 THEN 'single_source' ELSE 'multi_source' END FROM s),
t AS (SELECT k, tag FROM base UNION SELECT k, ancestor FROM base JOIN anc ON child = tag)"""
_FULL_SQL = _FULL_SQL.format(up=", ".join(f"('{a}', '{b}')" for a, b in PARENTS))


def _generated(spark, d, proteins):
    a = R.annotations(spark, d).withColumn("evalue", F.col("evalue") * 1e-14)
    exact = spark.createDataFrame([("R", "S3", ["jewel"]), ("A", "S4", ["fastener"])], RULE)
    patterns = spark.createDataFrame([("N", "sup1", ["compact"])], "source string, pattern string, tags array<string>")
    vocabulary = spark.createDataFrame(PARENTS, "predicate_id string, parent string")
    return _shown(tags.generate_tags(proteins, a.join(proteins.select("protein_id"), "protein_id", "left_semi"), exact, patterns, vocabulary, source_names=None))


@query("full_tag_pipeline", f"WITH RECURSIVE {_FULL_SQL} SELECT k AS protein_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY k")
def full_tag_pipeline(spark, d):
    """Every step of tag generation over parts and their line items (K5)."""
    return _generated(spark, d, R.proteins(spark, d))


@query("tags_of_some", f"WITH RECURSIVE {_FULL_SQL.replace('FROM part WINDOW', 'FROM part WHERE p_size = 17 WINDOW').replace('SELECT p_partkey FROM part)', 'SELECT p_partkey FROM part WHERE p_size = 17)')} SELECT k AS protein_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY k")
def tags_of_some(spark, d):
    """The same for some proteins, without storing (K31); group statistics are those of the set."""
    return _generated(spark, d, R.proteins(spark, d).filter("sequence_length = 17"))


@query("split_ranks", "SELECT event_id AS protein_id, (row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1)::INTEGER AS gene_index FROM events")
def split_ranks(spark, d):
    """Ranks where every contig is larger than a task's share, and so is cut into ranges."""
    return windows.rank_in_group(R.genes(spark, d), "contig_id", ["t_us", "protein_id"], most=10).select("protein_id", "gene_index")
