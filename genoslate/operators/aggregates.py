"""Counts, distributions and summaries. Each returns frames; none collects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .windows import title_key


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of several tables."""
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def dataset_totals(bins: DataFrame, contigs: DataFrame, proteins: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: rows of the four tables, annotated proteins and their share."""
    one = lambda t, n: t.agg(F.count("*").alias(n))
    a = annotations.agg(F.count("*").alias("n_annotations"), F.countDistinct("protein_id").alias("n_annotated"))
    out = one(bins, "n_bins").crossJoin(one(contigs, "n_contigs")).crossJoin(one(proteins, "n_proteins")).crossJoin(a)
    return out.withColumn("annotation_rate", F.col("n_annotated") / F.nullif(F.col("n_proteins"), F.lit(0)))


def quality_summary(bins: DataFrame, complete: float = 90, contaminated: float = 5) -> DataFrame:
    """Mean quality and number of good genomes, over those with a completeness."""
    b = bins.filter(F.col("completeness").isNotNull())
    good = (F.col("completeness") > complete) & (F.col("contamination") < contaminated)
    return b.agg(F.avg("completeness").alias("mean_completeness"), F.avg("contamination").alias("mean_contamination"), F.count_if(good).alias("n_good"), F.count("*").alias("n_bins"))


def top_counts(df: DataFrame, by: str | Column, n: int | None = None, name: str = "value") -> DataFrame:
    """Counts per value, largest first, ties by value; a limit makes it a top-k."""
    column = F.col(by) if isinstance(by, str) else by
    out = df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))
    return out if n is None else out.orderBy(F.desc("n"), name).limit(n)


def phylum_counts(bins: DataFrame, n: int = 10) -> DataFrame:
    """Genomes per phylum, null lineages left out (D3)."""
    return top_counts(bins.filter(F.col("taxonomy").isNotNull()), X.phylum(F.col("taxonomy")), n, "phylum")


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n) of all tags in one pass."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def predicate_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(predicate, n) of boolean columns in one pass."""
    sums = df.agg(*[F.count_if(c).alias(n) for n, c in predicates.items()])
    return sums.unpivot([], list(predicates), "predicate", "n")


def keys_with_distinct(df: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """Keys with at least so many distinct values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).filter(F.col("n") >= least)


def coverage_by_source(annotations: DataFrame, proteins: DataFrame) -> DataFrame:
    """Per source: rows, distinct proteins, share of all proteins to three places."""
    total = proteins.agg(F.count("*").alias("__n"))
    per = annotations.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("protein_id").alias("n_proteins"))
    return per.crossJoin(total).select("source", "n_rows", "n_proteins", F.round(F.col("n_proteins") / F.nullif(F.col("__n"), F.lit(0)), 3).alias("coverage"))


#: Three sets of cuts for sizes.
SIZE_CUTS = {"report": (200, 500, 1000), "browser": (500, 1000), "generator": (50, 150, 400, 1000, 2000)}


def size_histogram(df: DataFrame, value: Column, cuts: tuple[int, ...], labels: list[str] | None = None) -> DataFrame:
    """(bucket, n) by cuts."""
    names = labels or [f"<{cuts[0]}", *[f"{a}-{b - 1}" for a, b in zip(cuts, cuts[1:], strict=False)], f">={cuts[-1]}"]
    return df.groupBy(X.bucket_of(value, list(cuts), names).alias("bucket")).agg(F.count("*").alias("n"))


def length_summary(df: DataFrame, value: Column, group: str | None = None) -> DataFrame:
    """Mean, largest and smallest."""
    g = df.groupBy(group) if group else df.groupBy()
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean_length"), F.max(value).alias("max_length"), F.min(value).alias("min_length"))


def joined_text(df: DataFrame, key: str, value: str, order: str, sep: str = "; ") -> DataFrame:
    """(key, text): values joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(rows["v"], sep).alias("text"))


def derive_contigs(proteins: DataFrame) -> DataFrame:
    """Contigs from their genes: length is the largest end."""
    return proteins.groupBy("contig_id").agg(F.min("bin_id").alias("bin_id"), F.max("end_coord").alias("length"), F.count("*").alias("n_genes"))


def derive_bins(contigs: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Bins from contigs, those that ``bins`` lacks as ``unknown``."""
    made = contigs.filter(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.count("*").cast("int").alias("n_contigs"), F.sum(F.col("length").cast("long")).alias("total_length"))
    made = made.select("bin_id", F.lit(None).cast("double").alias("completeness"), F.lit(None).cast("double").alias("contamination"), F.lit("unknown").alias("taxonomy"), "n_contigs", "total_length")
    return made if bins is None else bins.select(made.columns).unionByName(made.join(bins.select("bin_id"), "bin_id", "left_anti"))


def run_summary(results: DataFrame, values: list[str], ok: Column, rank: str | None = None) -> DataFrame:
    """Success rate, sums and means over non-zero values; with ``rank``, counts per rank as a map."""
    aggs = [F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), (F.count_if(ok) / F.count("*")).alias("success_rate")]
    for v in values:
        aggs += [F.sum(v).alias(f"total_{v}"), F.avg(F.when(F.col(v) != 0, F.col(v))).alias(f"mean_{v}")]
    out = results.agg(*aggs)
    if rank is None:
        return out
    per = results.groupBy(rank).agg(F.count("*").alias("k")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(rank, "k")))).alias(f"by_{rank}"))
    return out.crossJoin(per)


def findings_summary(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by category, the HIGH ones, and genes mentioned."""
    genes = findings.select(F.explode("genes").alias("g")).agg(F.countDistinct("g").alias("n_genes"))
    return top_counts(findings, "category", name="category"), findings.filter(F.upper("priority") == "HIGH"), genes


def loci_summary(loci: DataFrame, kind: str = "locus_type", subtype: str = "subtype", genome: str = "bin_id") -> DataFrame:
    """Loci and distinct genomes per type, and per subtype within it (D17): totals have a null subtype and level 1."""
    return loci.rollup(kind, subtype).agg(F.count("*").alias("n_loci"), F.countDistinct(genome).alias("n_genomes"), F.grouping_id().alias("level")).filter("level < 3")


def annotations_by_source(annotations: DataFrame, key: str = "protein_id") -> DataFrame:
    """(key, by_source): a map from source to its records, by e-value."""
    record = F.struct(F.col("evalue"), F.col("accession"), F.col("name"))
    per = annotations.groupBy(key, "source").agg(F.array_sort(F.collect_list(record)).alias("records"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "records")))).alias("by_source"))


def set_summary(proteins: DataFrame, annotations: DataFrame, bins: DataFrame) -> DataFrame:
    """One row on a set of proteins: size, genomes, most common phylum and label, what stands out, warnings."""
    from .windows import best_label

    p = proteins.withColumn("len", X.length_of()).join(best_label(annotations), "protein_id", "left")
    p = p.join(bins.select("bin_id", "taxonomy", "completeness", "contamination"), "bin_id", "left")
    hypo = F.col("label").isNull() | X.is_hypothetical(F.col("label"))
    per_bin = proteins.groupBy("bin_id").agg(F.count("*").alias("k")).agg(F.max("k").alias("largest_bin"))
    s = p.agg(
        F.count("*").alias("n"), F.countDistinct("bin_id").alias("n_bins"), F.mode(X.phylum(F.col("taxonomy")), True).alias("top_phylum"), F.mode("label", True).alias("top_label"),
        F.avg("len").alias("mean_length"), F.max("len").alias("max_length"), F.count_if(hypo).alias("n_hypothetical"),
        F.count_if(F.col("contamination") > 5).alias("n_contaminated"), F.count_if(F.col("completeness") < 50).alias("n_incomplete"),
    ).crossJoin(per_bin)
    return s.withColumn("notable", X.tags_where(long_member=F.col("max_length") > 2 * F.col("mean_length"), mostly_hypothetical=F.col("n_hypothetical") > F.col("n") / 2, mostly_one_bin=F.col("largest_bin") > F.col("n") / 2)).withColumn(
        "warnings", X.tags_where(contamination=F.col("n_contaminated") > 0, completeness=F.col("n_incomplete") > 0)
    )


def family_counts(cazy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits per genome and family, and per genome."""
    return cazy.groupBy("bin_id", "family").agg(F.count("*").alias("n")), cazy.groupBy("bin_id").agg(F.count("*").alias("n"), F.countDistinct("family").alias("n_families"))


def evidence_confidence(evidence: DataFrame, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Per hypothesis: support for and against, confidence (0.5 without weight) and status."""
    w = F.coalesce(F.col("confidence"), F.lit(1.0))
    out = evidence.groupBy("hypothesis_id").agg(
        F.count_if(F.col("supports")).alias("n_for"), F.count_if(~F.col("supports")).alias("n_against"),
        F.sum(F.when(F.col("supports"), w).otherwise(0.0)).alias("__s"), F.sum(w).alias("__a"),
    )
    share = F.when(F.coalesce(F.col("__a"), F.lit(0.0)) == 0, 0.5).otherwise(F.col("__s") / F.col("__a"))
    status = F.when(share >= high, "supported").when(share <= low, "refuted").otherwise("proposed")
    return out.withColumn("confidence", share).withColumn("status", status).drop("__s", "__a")


def hits_by_database(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows, proteins and models per database; and totals with both the sum and the true distinct count."""
    per = hits.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("protein_id").alias("n_proteins"), F.countDistinct("accession").alias("n_models"))
    sums = per.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_proteins").alias("sum_of_proteins"))
    return per, sums.crossJoin(hits.agg(F.countDistinct("protein_id").alias("distinct_proteins")))


def distinct_titles(findings: DataFrame, position: str = "position") -> DataFrame:
    """Findings without repeated titles, first wins."""
    from .windows import dedup_first

    return dedup_first(findings, title_key(F.col("title")), position)
