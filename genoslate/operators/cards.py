"""Listings, searches and cards that combine the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import aggregates, filters, pages, windows


def list_genomes(bins: DataFrame, taxonomy: str | None = None, min_completeness: float | None = None, max_contamination: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of genomes by completeness, nulls last."""
    b = filters.where_given(
        bins,
        None if taxonomy is None else X.contains_text(F.col("taxonomy"), taxonomy),
        None if min_completeness is None else F.col("completeness") >= min_completeness,
        None if max_contamination is None else F.col("contamination") <= max_contamination,
    )
    return pages.page(b.withColumn("rank_name", X.deepest_rank(F.col("taxonomy"))), [F.desc_nulls_last("completeness"), F.col("bin_id")], limit, offset)


def list_contigs(contigs: DataFrame, bin_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of contigs, longest first."""
    return pages.page(filters.where_given(contigs, None if bin_id is None else F.col("bin_id") == bin_id), [F.desc("length"), F.col("contig_id")], limit, offset)


def list_proteins(proteins: DataFrame, annotations: DataFrame, bin_id: str | None = None, contig_id: str | None = None, min_length: int | None = None, max_length: int | None = None, has_annotation: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of proteins in place order with length and best label."""
    p = filters.where_given(proteins, None if bin_id is None else F.col("bin_id") == bin_id, None if contig_id is None else F.col("contig_id") == contig_id, X.length_filter(min_length, max_length))
    if has_annotation is not None:
        p = filters.annotated(p, annotations, has_annotation)
    shown = pages.page(p.withColumn("length", X.length_of()), [F.col("contig_id"), F.col("start"), F.col("protein_id")], limit, offset)
    # only the page's own annotations are ranked
    labels = windows.best_label(annotations.join(shown.select("protein_id"), "protein_id", "left_semi"))
    return shown.join(labels, "protein_id", "left").orderBy("contig_id", "start", "protein_id")


def search_proteins(proteins: DataFrame, annotations: DataFrame, bins: DataFrame, pattern: str | None = None, accession: str | None = None, taxonomy: str | None = None, min_length: int | None = None, max_length: int | None = None) -> DataFrame:
    """Distinct proteins by annotation text, accession, lineage and length."""
    p = proteins.filter(X.length_filter(min_length, max_length))
    if pattern is not None or accession is not None:
        a = filters.where_given(annotations, None if pattern is None else X.contains_text(F.col("name"), pattern) | X.contains_text(F.col("description"), pattern), None if accession is None else F.col("accession") == accession)
        p = p.join(a.select("protein_id"), "protein_id", "left_semi")
    if taxonomy is not None:
        p = p.join(bins.filter(X.contains_text(F.col("taxonomy"), taxonomy)).select("bin_id"), "bin_id", "left_semi")
    return p


def search_by_tags(proteins: DataFrame, tags: DataFrame, annotations: DataFrame, has: list[str] = (), lacks: list[str] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of proteins by tags, longest first, with best labels."""
    found = filters.search_tags(tags, has, lacks).join(proteins, "protein_id").withColumn("length", X.length_of())
    shown = pages.page(found, [F.desc("length"), F.col("protein_id")], limit, offset)
    labels = windows.best_label(annotations.join(shown.select("protein_id"), "protein_id", "left_semi"))
    return shown.join(labels, "protein_id", "left").orderBy(F.desc("length"), "protein_id")


def search_annotations(annotations: DataFrame, source: str | None = None, accession: str | None = None, name: str | None = None) -> DataFrame:
    """(protein_id, record) of matching annotations."""
    a = filters.where_given(annotations, None if source is None else F.col("source") == source, None if accession is None else F.col("accession") == accession, None if name is None else X.contains_text(F.col("name"), name))
    return a.select("protein_id", F.struct(*[c for c in annotations.columns if c != "protein_id"]).alias("record"))


def annotations_of(annotations: DataFrame, ids: list | DataFrame) -> DataFrame:
    """Annotations of some proteins, by e-value, nulls first."""
    return filters.by_ids(annotations, ids).orderBy("protein_id", F.asc_nulls_first("evalue"), "annotation_id")


def genome_cards(bins: DataFrame, contigs: DataFrame, proteins: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per genome: quality, contigs, genes, annotation counts by source."""
    c = contigs.groupBy("bin_id").agg(F.count("*").alias("contigs"), F.sum(F.col("length").cast("long")).alias("length"), F.max("length").alias("longest"))
    p = proteins.groupBy("bin_id").agg(F.count("*").alias("proteins"))
    a = annotations.join(proteins.select("protein_id", "bin_id"), "protein_id").groupBy("bin_id", "source").agg(F.count("*").alias("n"))
    a = a.groupBy("bin_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    return bins.join(c, "bin_id", "left").join(p, "bin_id", "left").join(a, "bin_id", "left")


def protein_cards(proteins: DataFrame, annotations: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One row per protein: length, accessions, domains, best label, hypothetical flag, tags."""
    a = annotations.groupBy("protein_id").agg(
        F.array_sort(F.collect_set("accession")).alias("accessions"), F.array_sort(F.collect_set(F.when(F.col("source") == "pfam", F.col("accession")))).alias("domains"), F.max(X.is_hypothetical(F.col("name"), F.col("description")) | F.concat_ws(" ", "name", "description").rlike("(?i)unknown")).alias("h")
    )
    out = proteins.withColumn("length", X.length_of(whole=True)).join(a, "protein_id", "left").join(windows.best_label(annotations, strict=False), "protein_id", "left")
    out = out.withColumn("is_hypothetical", F.coalesce("h", F.lit(True))).drop("h")
    return out if tags is None else out.join(tags, "protein_id", "left")


def overview(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The dataset overview as frames (K17): totals, quality, phyla, sources."""
    b, c, p, a = (tables[n] for n in ("bins", "contigs", "proteins", "annotations"))
    return {"totals": aggregates.dataset_totals(b, c, p, a), "quality": aggregates.quality_summary(b), "phyla": aggregates.phylum_counts(b), "sources": aggregates.top_counts(a, "source", name="source")}


def describe_tables(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the session's tables and views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")
