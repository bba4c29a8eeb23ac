"""Checks of annotations against expectations, neighbours and loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import joins, windows

#: Labels that tell nothing.
EMPTY_LABELS = ("hypothetical", "uncharacterized", "unannotated", "")


def annotation_consistency(proteins: DataFrame, annotations: DataFrame, expected: str, problem_words: list[str] = ()) -> DataFrame:
    """(protein_id, label, status, false_positive) of each protein.

    consistent: the expected word is in the best label; inconsistent: the label tells something else; else uncertain. In
    the last two, a problem word in the label marks a false positive.
    """
    best = windows.best_label(annotations, strict=False)
    j = proteins.select("protein_id").join(best, "protein_id", "left").withColumn("label", F.coalesce("label", F.lit("")))
    low = F.lower("label")
    status = F.when(low.contains(expected.lower()), "consistent").when(~F.trim(low).isin(*EMPTY_LABELS), "inconsistent").otherwise("uncertain")
    wrong = (F.col("status") != "consistent") & F.coalesce(F.lower("label").rlike("|".join(problem_words)) if problem_words else F.lit(False), F.lit(False))
    return j.withColumn("status", status).withColumn("false_positive", wrong)


def consistency_summary(checked: DataFrame) -> DataFrame:
    """(status, n, percent) of K11."""
    total = checked.agg(F.count("*").alias("__n"))
    return checked.groupBy("status").agg(F.count("*").alias("n")).crossJoin(total).select("status", "n", F.round(100 * F.col("n") / F.col("__n"), 1).alias("percent"))


def context_validation(hood: DataFrame, expected: DataFrame, unexpected: str = "transposase") -> DataFrame:
    """Per anchor: expected words found near it, nearest distance, validity (at least half), unexpected neighbours.

    ``hood``: (anchor, protein_id, offset, is_anchor, label, tags); ``expected``: (anchor, keyword). A word is found in a
    label as a substring, in tags as a whole, in any case; the anchor itself doesn't count.
    """
    n = hood.filter(~F.col("is_anchor"))
    word = F.lower("keyword")
    hit = F.coalesce(F.lower("label").contains(word), F.lit(False)) | F.coalesce(F.exists("tags", lambda t: F.lower(t) == F.lower(F.col("keyword"))), F.lit(False))
    met = expected.join(n, "anchor").filter(hit).groupBy("anchor", "keyword").agg(F.min(F.abs("offset")).alias("nearest"))
    odd = n.groupBy("anchor").agg(F.count_if(F.lower("label").contains(unexpected)).alias("n_unexpected"))
    per = expected.join(met, ["anchor", "keyword"], "left").groupBy("anchor").agg(
        F.count("*").alias("n_expected"), F.count("nearest").alias("n_found"), F.min("nearest").alias("nearest"), F.array_sort(F.collect_set(F.when(F.col("nearest").isNotNull(), F.col("keyword")))).alias("found")
    )
    return per.join(odd, "anchor", "left").select("anchor", "n_expected", "n_found", "nearest", "found", (F.col("n_found") >= F.col("n_expected") / 2).alias("is_valid"), F.coalesce("n_unexpected", F.lit(0)).alias("n_unexpected"))


def error_scan(annotations: DataFrame, genes: DataFrame, arrays: DataFrame, problems: DataFrame, limit: int | None = 50) -> DataFrame:
    """(kind, protein_id, detail): likely annotation errors (K13); capped per kind on request.

    ``problems``: (domain, indicators). A protein with a domain of that name is one if any of its annotations tells of an indicator, in any
    case, by its name, else its description; domains without indicators never are. Genes over arrays are the other kind.
    """
    text = F.coalesce("name", "description", F.lit("unannotated"))
    held = annotations.join(problems, F.col("name") == F.col("domain")).select("protein_id", "domain", "indicators").distinct()
    said = held.join(annotations.select("protein_id", text.alias("said")).distinct(), "protein_id")
    told = said.filter(F.exists("indicators", lambda x: F.contains(F.lower("said"), F.lower(x))))
    one = told.select(F.lit("problem_domain").alias("kind"), "protein_id", F.concat_ws(": ", "domain", "said").alias("detail"))
    pairs = joins.overlap_join(genes.select("protein_id", "contig_id", "start", "end_coord"), arrays.select("locus_id", "contig_id", "start", "end_coord"), "contig_id", "start", "end_coord", width=5000)
    over = pairs.select(F.col("l_protein_id").alias("protein_id"), F.col("r_locus_id").cast("string").alias("locus"))
    over = over.join(annotations.select("protein_id", text.alias("said")), "protein_id", "left").withColumn("said", F.coalesce("said", F.lit("unannotated")))
    two = over.select(F.lit("overlaps_array").alias("kind"), "protein_id", F.concat_ws(": ", "locus", "said").alias("detail"))
    if limit is not None:
        # the first of each kind are chosen apart, each by the partitions' own first rows
        one, two = (x.distinct().orderBy("protein_id", "detail").limit(limit) for x in (one, two))
    return one.unionByName(two).distinct()


def reliability_warnings(proteins: DataFrame, annotations: DataFrame, bins: DataFrame) -> DataFrame:
    """(protein_id, warnings)."""
    best = annotations.groupBy("protein_id").agg(F.min("evalue").alias("__e"), F.count("*").alias("__n"))
    j = proteins.join(bins.select("bin_id", "completeness", "contamination"), "bin_id", "left").join(best, "protein_id", "left")
    w = X.tags_where(contaminated_genome=F.col("contamination") > 5, incomplete_genome=F.col("completeness") < 50, weak_best_hit=F.col("__e") > 1e-5, no_annotation=F.col("__n").isNull())
    return j.select("protein_id", w.alias("warnings"))


def interest_scores(proteins: DataFrame, annotations: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(protein_id, size_z, annotation_gap, gc_deviation, interest): ranking columns (K14); weights are the caller's."""
    w = {"size": 1.0, "gap": 1.0, "gc": 1.0} | (weights or {})
    p = windows.group_zscore(proteins.withColumn("__len", X.length_of()), "bin_id", "__len", "size_z")
    p = windows.group_zscore(p, "contig_id", "gc_content", "gc_deviation")
    gap = annotations.groupBy("protein_id").agg(F.max("score").alias("__s"))
    j = p.join(gap, "protein_id", "left").withColumn("annotation_gap", F.when(F.col("__s").isNull(), 1.0).otherwise(0.0))
    interest = w["size"] * F.abs("size_z") + w["gap"] * F.col("annotation_gap") + w["gc"] * F.abs("gc_deviation")
    return j.select("protein_id", "size_z", "annotation_gap", "gc_deviation", interest.alias("interest"))
