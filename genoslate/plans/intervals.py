"""Neighbourhoods, overlaps, clusters and runs over events as genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, joins, validate, windows
from . import roles as R
from .roles import query, table

RANKED_SQL = f"{R.GENES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY t_us, protein_id) - 1 AS gene_index FROM g)"


def ranked(spark, d):
    return windows.rank_in_group(R.genes(spark, d), "contig_id", ["t_us", "protein_id"])


@query("gene_index", f"WITH {RANKED_SQL} SELECT protein_id, gene_index::INTEGER AS gene_index FROM r")
def gene_index(spark, d):
    return ranked(spark, d).select("protein_id", "gene_index")


@query(
    "rank_neighborhood",
    f"""WITH {RANKED_SQL} SELECT a.protein_id AS anchor, r.protein_id, (r.gene_index - a.gene_index)::INTEGER AS "offset", r.protein_id = a.protein_id AS is_anchor
FROM r JOIN r a ON r.contig_id = a.contig_id AND abs(r.gene_index - a.gene_index) <= 2 WHERE a.label = 'error'""",
)
def rank_neighborhood(spark, d):
    r = ranked(spark, d)
    return joins.rank_neighborhood(r, r.filter("label = 'error'"), "contig_id", "gene_index", "protein_id", 2).select("anchor", "protein_id", "offset", "is_anchor")


@query(
    "position_neighborhood",
    f"""WITH {R.GENES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY start, protein_id) - 1 AS pos FROM g),
h AS (SELECT a.protein_id AS anchor, r.*, r.pos - a.pos AS o FROM r JOIN r a ON r.contig_id = a.contig_id AND abs(r.pos - a.pos) <= 3 WHERE a.label = 'signup')
SELECT anchor, min(start) AS region_start, arg_max(end_coord, o) AS region_end, max(end_coord) AS max_end, count(*) AS gene_count, count(DISTINCT strand) > 1 AS strand_break, max(end_coord) - min(start) AS length_bp FROM h GROUP BY anchor""",
)
def position_neighborhood(spark, d):
    g = R.genes(spark, d)
    return joins.region_bounds(joins.position_neighborhood(g, g.filter("label = 'signup'"), 3))


@query(
    "interval_overlap",
    f"WITH {R.GENES_SQL} SELECT l.protein_id AS l_id, r.protein_id AS r_id FROM g l JOIN g r ON l.contig_id = r.contig_id AND l.start < r.end_coord AND l.end_coord > r.start AND l.protein_id < r.protein_id",
)
def interval_overlap(spark, d):
    g = R.genes(spark, d)
    return joins.overlap_join(g, g, "contig_id", "start", "end_coord", width=7200).filter("l_protein_id < r_protein_id").select(F.col("l_protein_id").alias("l_id"), F.col("r_protein_id").alias("r_id"))


@query(
    "padded_overlap",
    f"WITH {R.GENES_SQL} SELECT l.protein_id AS l_id, r.protein_id AS r_id FROM g l JOIN g r ON l.contig_id = r.contig_id AND l.start <= r.end_coord + 600 AND l.end_coord >= r.start - 600 WHERE r.label = 'error' AND l.label = 'view'",
)
def padded_overlap(spark, d):
    g = R.genes(spark, d)
    return joins.overlap_join(g.filter("label = 'view'"), g.filter("label = 'error'"), "contig_id", "start", "end_coord", width=7200, pad=600, inclusive=True).select(F.col("l_protein_id").alias("l_id"), F.col("r_protein_id").alias("r_id"))


@query(
    "bp_window",
    f"WITH {R.GENES_SQL} SELECT l.protein_id AS gene, r.protein_id AS anchor FROM g l JOIN g r ON l.contig_id = r.contig_id AND l.start >= r.start - 20000 AND l.end_coord <= r.end_coord + 20000 WHERE r.label = 'error'",
)
def bp_window(spark, d):
    g = R.genes(spark, d)
    return joins.base_pair_window(g, g.filter("label = 'error'"), 20_000).select(F.col("l_protein_id").alias("gene"), F.col("r_protein_id").alias("anchor"))


@query(
    "upstream",
    f"""WITH {R.GENES_SQL}, u AS (SELECT protein_id, contig_id, CASE WHEN strand = '+' THEN start - 10000 ELSE end_coord END AS a, CASE WHEN strand = '+' THEN start ELSE end_coord + 10000 END AS b FROM g WHERE label = 'error')
SELECT g.protein_id AS gene, u.protein_id AS anchor FROM g JOIN u ON g.contig_id = u.contig_id AND g.start < u.b AND g.end_coord > u.a""",
)
def upstream(spark, d):
    g = R.genes(spark, d)
    return joins.upstream(g, g.filter("label = 'error'"), 10_000).select(F.col("l_protein_id").alias("gene"), F.col("r_protein_id").alias("anchor"))


@query(
    "circular_window",
    f"""WITH {R.GENES_SQL}, c AS (SELECT protein_id, contig_id, label, start % 86400 AS s FROM g)
SELECT l.protein_id AS gene, r.protein_id AS anchor FROM c l JOIN c r ON l.contig_id = r.contig_id AND l.protein_id <> r.protein_id
AND least((l.s - r.s + 86400) % 86400, (r.s - l.s + 86400) % 86400) <= 60""",
)
def circular_window(spark, d):
    """Time of day on a circle of 86,400 seconds, a minute either way."""
    c = R.genes(spark, d).select("protein_id", "contig_id", F.pmod("start", F.lit(86_400)).alias("start"), F.pmod("start", F.lit(86_400)).alias("end_coord"))
    out = joins.circular_window(c, c, 60, F.lit(86_400)).filter("l_protein_id <> r_protein_id")
    return out.select(F.col("l_protein_id").alias("gene"), F.col("r_protein_id").alias("anchor"))


@query(
    "distance_join",
    f"WITH {R.GENES_SQL} SELECT l.protein_id AS purchase, r.protein_id AS error FROM g l JOIN g r ON l.contig_id = r.contig_id AND abs(l.start - r.start) < 21600 WHERE l.label = 'purchase' AND r.label = 'error'",
)
def distance_join(spark, d):
    g = R.genes(spark, d)
    return joins.distance_join(g.filter("label = 'purchase'"), g.filter("label = 'error'"), 21_600).select(F.col("l_protein_id").alias("purchase"), F.col("r_protein_id").alias("error"))


@query(
    "nearest_gap",
    f"""WITH {R.GENES_SQL} SELECT l.protein_id, coalesce(bool_or(least(abs(l.start - r.end_coord), abs(l.end_coord - r.start)) <= 3600), false) AS near
FROM g l LEFT JOIN (SELECT * FROM g WHERE label = 'error') r ON l.contig_id = r.contig_id AND l.start <= r.end_coord + 3600 AND l.end_coord >= r.start - 3600 WHERE l.label = 'view' GROUP BY 1""",
)
def nearest_gap(spark, d):
    g = R.genes(spark, d)
    return joins.near_any(g.filter("label = 'view'"), g.filter("label = 'error'"), 3600, "protein_id").select("protein_id", "near")


CLUSTERS_SQL = f"""{R.GENES_SQL}, m AS (SELECT *, max(end_coord) OVER (PARTITION BY contig_id ORDER BY start, protein_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
c AS (SELECT *, (sum(CASE WHEN reach IS NULL OR start - reach > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id ORDER BY start, protein_id))::BIGINT AS cluster FROM m)"""


@query("gap_clusters", f"WITH {CLUSTERS_SQL} SELECT protein_id, contig_id, cluster FROM c")
def gap_clusters(spark, d):
    return windows.gap_clusters(R.genes(spark, d), ["contig_id"], "start", "end_coord", 21_600, ["protein_id"]).select("protein_id", "contig_id", "cluster")


@query(
    "same_strand_chains",
    f"""WITH {R.GENES_SQL}, m AS (SELECT *, max(end_coord) OVER (PARTITION BY contig_id, strand ORDER BY start, protein_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)
SELECT protein_id, (sum(CASE WHEN reach IS NULL OR start - reach > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id, strand ORDER BY start, protein_id))::BIGINT AS chain FROM m""",
)
def same_strand_chains(spark, d):
    return joins.same_strand_chains(R.genes(spark, d), 7200).select("protein_id", "chain")


@query(
    "consecutive_runs",
    f"""WITH {RANKED_SQL}, i AS (SELECT *, gene_index - row_number() OVER (PARTITION BY contig_id, label ORDER BY gene_index) AS island FROM r)
SELECT contig_id, label, min(gene_index)::INTEGER AS first_rank, max(gene_index)::INTEGER AS last_rank, count(*) AS run_length FROM i GROUP BY contig_id, label, island HAVING count(*) >= 3""",
)
def consecutive_runs(spark, d):
    return windows.consecutive_runs(R.genes(spark, d), ["contig_id"], ["t_us", "protein_id"], F.lit(True), 3, ["label"])


@query(
    "rank_split",
    """SELECT part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (
SELECT o_orderkey, least((row_number() OVER (ORDER BY o_orderkey) - 1) // greatest(count(*) OVER () // 4, 1), 3)::INTEGER + 1 AS part FROM orders) GROUP BY part""",
)
def rank_split(spark, d):
    parts = windows.split_by_rank(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(
    "context_validation",
    f"""WITH {RANKED_SQL}, h AS (SELECT a.protein_id AS anchor, r.label, abs(r.gene_index - a.gene_index) AS dist FROM r JOIN r a ON r.contig_id = a.contig_id AND abs(r.gene_index - a.gene_index) BETWEEN 1 AND 3 WHERE a.label = 'error'),
e AS (SELECT protein_id AS anchor, unnest(['click', 'purchase', 'signup']) AS keyword FROM g WHERE label = 'error'),
m AS (SELECT e.anchor, e.keyword, min(h.dist) AS nearest FROM e LEFT JOIN h ON h.anchor = e.anchor AND h.label = e.keyword GROUP BY ALL)
SELECT m.anchor, count(*) AS n_expected, count(nearest) AS n_found, min(nearest)::INTEGER AS nearest, count(nearest) >= count(*) / 2 AS is_valid,
(SELECT count(*) FROM h WHERE h.anchor = m.anchor AND h.label = 'view') AS n_unexpected FROM m GROUP BY m.anchor""",
)
def context_validation(spark, d):
    r = ranked(spark, d)
    hood = joins.rank_neighborhood(r, r.filter("label = 'error'"), "contig_id", "gene_index", "protein_id", 3).withColumn("tags", F.array().cast("array<string>"))
    expected = r.filter("label = 'error'").select(F.col("protein_id").alias("anchor"), F.explode(F.array(*map(F.lit, ("click", "purchase", "signup")))).alias("keyword"))
    return validate.context_validation(hood, expected, "view").drop("found")


@query(
    "locus_members",
    f"""WITH {R.GENES_SQL} SELECT l.protein_id AS locus_id, x.protein_id, (row_number() OVER (PARTITION BY l.protein_id ORDER BY x.start, x.protein_id) - 1)::INTEGER AS "position"
FROM g l JOIN g x ON x.contig_id = l.contig_id AND x.start >= l.start AND x.end_coord <= l.end_coord AND x.start < l.end_coord AND x.end_coord > l.start WHERE l.label = 'purchase'""",
)
def locus_members(spark, d):
    g = R.genes(spark, d)
    loci = g.filter("label = 'purchase'").withColumnRenamed("protein_id", "locus_id")
    return classify.locus_members(g, loci)
