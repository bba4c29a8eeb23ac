"""Classification of loci, systems, subgroups and pathways from hit tables and rule tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import joins, windows


def subgroup_calls(hits: DataFrame, annotations: DataFrame, subgroups: DataFrame, trusted: list[tuple[str, list[str]]], query: str = "protein_id") -> DataFrame:
    """(protein_id, kind, subgroup, tags, needs_curation): the best reference hit of each protein, its subgroup's
    tags, and whether a domain that backs the kind is missing (K7).

    ``subgroups``: (subgroup, tags). ``trusted``: a kind and the domains of which one backs it; other kinds need none.
    """
    best = windows.best_per_key(hits, query, "evalue", ["subject"], "subject")
    kind, group = X.subject_parts(F.col("subject"))
    best = best.withColumn("kind", kind).withColumn("subgroup", group)
    domains = annotations.groupBy("protein_id").agg(F.collect_set("accession").alias("__acc"))
    j = best.join(domains.withColumnRenamed("protein_id", query), query, "left").join(subgroups.select("subgroup", F.col("tags").alias("__t")), "subgroup", "left")
    curate = F.lit(False)
    for name, needs in trusted:
        backed = F.arrays_overlap(F.coalesce("__acc", F.array().cast("array<string>")), F.array(*map(F.lit, needs)))
        curate = F.when(F.col("kind") == name, ~backed).otherwise(curate)
    j = j.withColumn("needs_curation", curate).filter(F.col("__t").isNotNull())
    own = F.array_compact(F.array(F.concat(F.lit("hyddb_subgroup:"), F.col("subgroup")), F.when(F.col("needs_curation"), F.lit("hyddb_needs_curation"))))
    return j.select(F.col(query).alias("protein_id"), "kind", "subgroup", X.tag_set(F.col("__t"), own).alias("tags"), "needs_curation")


def model_classes(hits: DataFrame, table: DataFrame, rules: list[tuple[str, str]], model: str = "hmm_name") -> DataFrame:
    """``hits`` with system, subtype and role of the model: from ``table`` (model, system, subtype, role), else by ordered rules.

    A model that stands twice in the table counts by its last ``position``.
    """
    last = table.groupBy(F.lower("model").alias("__m")).agg(F.max_by(F.struct("system", "subtype", "role"), "position").alias("__t"))
    j = hits.join(last, F.lower(model) == F.col("__m"), "left").drop("__m")
    guess = X.first_rule(F.col(model), rules, "Unknown")
    roman = F.nullif(F.regexp_extract(F.upper(model), r"TYPE[_-]?(I{1,3}|IV|VI?)(?:[_-]?([A-Z]))?(?![A-Z])", 1), F.lit(""))
    letter = F.nullif(F.regexp_extract(F.upper(model), r"TYPE[_-]?(I{1,3}|IV|VI?)(?:[_-]?([A-Z]))?(?![A-Z])", 2), F.lit(""))
    system = F.coalesce("__t.system", roman, F.lit("Core"))
    subtype = F.coalesce("__t.subtype", F.when(letter.isNotNull(), F.concat_ws("-", system, letter)))
    return j.select(*hits.columns, system.alias("system"), subtype.alias("subtype"), F.coalesce("__t.role", guess).alias("role"))


def classify_systems(hits: DataFrame, genes: DataFrame, arrays: DataFrame, table: DataFrame, rules: list[tuple[str, str]], gap: int = 10_000, array_gap: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Genes with their system call, and loci with theirs (K8).

    Order: class of each hit, distance to arrays, best hit per protein by score, clusters, then the locus's system: most common
    among effectors, else among backbone genes, else Core, and Core gives way to the most common other one. Ties
    go to the smallest name. A locus is complete with four proteins or more.
    """
    best = windows.best_per_key(model_classes(hits, table, rules), "protein_id", "score", ["hmm_name", "system", "subtype", "role"], "hmm_name", largest=True)
    placed = best.join(genes.select("protein_id", "bin_id", "contig_id", "start", "end_coord"), "protein_id")
    placed = joins.near_any(placed, arrays, array_gap, "protein_id", name="near_array")
    placed = windows.gap_clusters(placed, ["bin_id", "contig_id"], "start", "end_coord", gap, ["protein_id"], "locus")
    of = lambda c: F.mode(F.when(c, F.col("system")), True)
    loci = placed.groupBy("bin_id", "contig_id", "locus").agg(
        F.min("start").alias("start"), F.max("end_coord").alias("end_coord"), F.count("*").alias("n_proteins"), F.max("near_array").alias("near_array"),
        F.coalesce(of(F.col("role") == "effector"), of(F.col("role") == "backbone"), F.lit("Core")).alias("__s"), of(F.col("system") != "Core").alias("__other"), F.mode("subtype", True).alias("subtype"),
    )
    system = F.when(F.col("__s") == "Core", F.coalesce("__other", F.lit("Core"))).otherwise(F.col("__s"))
    loci = loci.withColumn("system", system).withColumn("is_complete", F.col("n_proteins") >= 4).drop("__s", "__other")
    return placed, loci


# Names of neighbours that count; in order, which of them decides the type of an array's system; which are effectors.
NEIGHBORS = "cas1|cas2|cas3|cas5|cas6|cas7|cas8|cas9|cas10|cas12|cas13|csm|cmr|csx"
SYSTEM_ORDER = [("cas9", "II"), ("cas12", "V"), ("cas13", "VI"), ("cas10|csm|cmr", "III"), ("cas3", "I"), ("cas1|cas2", "I/II/V (adaptation only)")]
EFFECTORS = "cas3|cas9|cas10|cas12|cas13"


def array_systems(arrays: DataFrame, genes: DataFrame, contigs: DataFrame, distance: int = 15_000, edge: int = 1000, patterns: str = NEIGHBORS, order: list[tuple[str, str]] = SYSTEM_ORDER, needed: tuple[str, ...] = ("cas1", "cas2", EFFECTORS)) -> DataFrame:
    """One row per array: edge flag, neighbours within reach, system, completeness, orphan.

    ``genes``: (contig_id, start, label), a row for each annotation of a gene. 'cas1' is also found in cas10 to cas13; distances are
    between starts. ``order``: pattern and type, the first that a neighbour meets; ``needed``: complete with a neighbour for each.
    """
    near = joins.distance_join(genes.filter(F.col("label").rlike(f"(?i){patterns}")), arrays.select("locus_id", "contig_id", "start"), distance)
    found = near.groupBy(F.col("r_locus_id").alias("locus_id")).agg(F.array_sort(F.collect_list(F.lower("l_label"))).alias("neighbors"))
    a = arrays.join(contigs.select("contig_id", F.col("length").alias("__len")), "contig_id", "left").join(found, "locus_id", "left")
    names = F.coalesce("neighbors", F.array().cast("array<string>"))
    has = lambda p: F.exists(names, lambda x: x.rlike(p))
    system = None
    for pattern, name in order:
        system = F.when(has(pattern), name) if system is None else system.when(has(pattern), name)
    complete = reduce(and_, [has(p) for p in needed])
    return a.select(
        "locus_id", "contig_id", ((F.col("start") < edge) | (F.col("__len") - F.col("end_coord") < edge)).alias("at_edge"), names.alias("neighbors"),
        system.otherwise("Unknown").alias("system"), complete.alias("is_complete"), (F.size(names) == 0).alias("is_orphan"),
    )


def pathway_completeness(orthologs: DataFrame, rules: DataFrame, whole: float = 100, partial: float = 50) -> DataFrame:
    """Per genome and pathway: steps done, all steps, percent, status, missing steps.

    ``orthologs``: (bin_id, accession); ``rules``: (pathway, step, accession), any ortholog does a step. Genomes without a
    single hit still get a row for every pathway; rows without a genome are left out.
    """
    have = orthologs.filter(F.col("bin_id").isNotNull())
    genomes = have.select("bin_id").distinct()
    done = have.distinct().join(rules, "accession").groupBy("bin_id", "pathway").agg(F.collect_set("step").alias("__done"))
    steps = rules.groupBy("pathway").agg(F.array_sort(F.collect_set("step")).alias("__steps"))
    every = genomes.crossJoin(F.broadcast(steps)).join(done, ["bin_id", "pathway"], "left")
    n, all_ = F.size(F.coalesce("__done", F.array().cast("array<string>"))), F.size("__steps")
    percent = F.round(100 * n / all_, 1)
    return every.select(
        "bin_id", "pathway", n.alias("steps_done"), all_.alias("steps"), percent.alias("percent"),
        F.when(percent >= whole, "COMPLETE").when(percent > partial, "PARTIAL").otherwise("INCOMPLETE").alias("status"),
        F.array_except("__steps", F.coalesce("__done", F.array().cast("array<string>"))).alias("missing"),
    )


def pathway_overview(completeness: DataFrame, above: float = 50) -> DataFrame:
    """Per pathway: genomes above a percentage and the best of them."""
    return completeness.groupBy("pathway").agg(F.count_if(F.col("percent") > above).alias("n_genomes"), F.max("percent").alias("best"))


def ortholog_context(annotations: DataFrame, hints: list[tuple[str, str]], source: str = "kegg") -> DataFrame:
    """(protein_id, orthologs, hints): orthologs and the pathways that their texts hint at."""
    a = annotations.filter(F.col("source") == source).withColumn("__h", X.all_rules(F.concat_ws(" ", "name", "description"), hints))
    return a.groupBy("protein_id").agg(F.array_sort(F.collect_set("accession")).alias("orthologs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__h")))).alias("hints"))


def finding_sections(findings: DataFrame, categories: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``findings`` with section: by category (category, section), else by ordered title words, else Other."""
    j = findings.join(categories.select("category", F.col("section").alias("__s")), "category", "left")
    return j.withColumn("section", F.coalesce("__s", X.first_rule(F.coalesce("title", F.lit("")), rules, "Other"))).drop("__s")


def overlap_flags(genes: DataFrame, loci: DataFrame, locus_type: str = "crispr_array", tag: str = "overlaps_crispr_array") -> DataFrame:
    """(protein_id, tags) of genes that overlap a locus of a type."""
    hit = joins.overlap_join(genes.select("protein_id", "contig_id", "start", "end_coord"), loci.filter(F.col("locus_type") == locus_type).select("locus_id", "contig_id", "start", "end_coord"), "contig_id", "start", "end_coord", width=5000)
    return hit.select(F.col("l_protein_id").alias("protein_id")).distinct().withColumn("tags", F.array(F.lit(tag)))


def locus_members(genes: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus_id, protein_id, position): genes inside each locus, 0-based in order."""
    hit = joins.overlap_join(genes.select("protein_id", "contig_id", "start", "end_coord"), loci.select("locus_id", "contig_id", "start", "end_coord"), "contig_id", "start", "end_coord", width=10_000)
    inside = hit.filter((F.col("l_start") >= F.col("r_start")) & (F.col("l_end_coord") <= F.col("r_end_coord")))
    rows = inside.select(F.col("r_locus_id").alias("locus_id"), F.col("l_protein_id").alias("protein_id"), F.col("l_start").alias("s"))
    return windows.rank_in_group(rows, "locus_id", ["s", "protein_id"], "position").drop("s")
