"""Neighbourhoods, interval overlaps and distance joins.

Each range join has an equality key (the contig) and coordinate or rank bins beside it, so long contigs spread over tasks; a pair is kept only in
the bin where the later start lies, hence once, without a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import intervals


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def rank_neighborhood(rows: DataFrame, anchors: DataFrame, contig: str, rank: str, key: str, window: int) -> DataFrame:
    """All rows within ``window`` ranks of each anchor on its contig (C8): anchor, the row's columns, offset, is_anchor.

    Both sides get the rank's bin of ``window`` ranks, the anchor its two neighbours as well, and join by contig and bin.
    """
    step = max(1, window)
    a = anchors.select(F.col(key).alias("anchor"), F.col(contig).alias("__c"), F.col(rank).alias("__r"))
    a = a.withColumn("__bin", F.explode(F.array(*[F.floor(F.col("__r") / step) + d for d in (-1, 0, 1)])))
    r = rows.withColumn("__bin", F.floor(F.col(rank) / step))
    j = r.join(a, (r[contig] == a["__c"]) & (r["__bin"] == a["__bin"]) & (F.abs(r[rank] - a["__r"]) <= window))
    return j.select("anchor", *[r[c] for c in rows.columns], (r[rank] - F.col("__r")).alias("offset"), (r[key] == F.col("anchor")).alias("is_anchor"))


def position_neighborhood(rows: DataFrame, anchor_ids: DataFrame, window: int = 10, contig: str = "contig_id", start: str = "start", key: str = "protein_id") -> DataFrame:
    """As C8, with ranks by start on the contig (C9), plus the contig's number of genes."""
    from .windows import rank_in_group

    total = rows.groupBy(contig).agg(F.count("*").alias("contig_genes"))
    placed = rank_in_group(rows, contig, [start, key], "pos").join(total, contig)
    anchors = placed.join(anchor_ids.select(key), key, "left_semi")
    return rank_neighborhood(placed, anchors, contig, "pos", key, window)


def region_bounds(hood: DataFrame, start: str = "start", end: str = "end_coord", strand: str = "strand") -> DataFrame:
    """Per anchor: first start, end of the last gene in start order, largest end, genes, strand break, length."""
    return hood.groupBy("anchor").agg(
        F.min(start).alias("region_start"),
        F.max_by(end, "offset").alias("region_end"),
        F.max(end).alias("max_end"),
        F.count("*").alias("gene_count"),
        (F.countDistinct(strand) > 1).alias("strand_break"),
        (F.max(end) - F.min(start)).alias("length_bp"),
    )


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str, end: str, width: int | None = None, pad: int = 0, inclusive: bool = False) -> DataFrame:
    """Pairs of overlapping intervals of one key (C12; padded and inclusive: C13), columns prefixed l_ and r_.

    ``width``: width of the narrowest bins, at least about the usual interval length; without one the key alone joins. An interval of any
    length is written a bounded number of times (see ``intervals``).
    """
    a, b = _prefixed(left, "l_"), _prefixed(right, "r_")
    ls, le = F.col(f"l_{start}"), F.col(f"l_{end}")
    rs, re_ = F.col(f"r_{start}") - pad, F.col(f"r_{end}") + pad
    meets = ((ls <= re_) & (le >= rs)) if inclusive else X.overlaps(ls, le, rs, re_)
    if width is None:
        return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & meets)
    return intervals.overlapping(a, b, (f"l_{key}", f"r_{key}"), (ls, le), (rs, re_), meets, width, 0 if inclusive else 1)


def base_pair_window(rows: DataFrame, anchors: DataFrame, window: int, contig: str = "contig_id", start: str = "start", end: str = "end_coord", width: int | None = None) -> DataFrame:
    """Rows wholly within ``window`` of each anchor (C10, linear contigs), columns prefixed l_ (row) and r_ (anchor)."""
    j = overlap_join(rows, anchors, contig, start, end, width or max(window * 2, 1), pad=window, inclusive=True)
    return j.filter((F.col(f"l_{start}") >= F.col(f"r_{start}") - window) & (F.col(f"l_{end}") <= F.col(f"r_{end}") + window))


def circular_window(rows: DataFrame, anchors: DataFrame, window: int, length: Column, contig: str = "contig_id", start: str = "start", end: str = "end_coord", width: int | None = None, anchor_length: Column | None = None) -> DataFrame:
    """C10 on circles: both sides begin within the first turn (H16), rows are also tried one turn before and after. ``length``: of the contig,
    over row columns; ``anchor_length``: over anchor columns, where that differs."""
    shifted = rows.withColumn("__turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    first = X.circular(F.col(start), length) + F.col("__turn") * length
    shifted = shifted.withColumn("__start", first).withColumn("__end", first + F.col(end) - F.col(start))
    turned = anchors.withColumn("__turn", F.lit(0)).withColumn("__start", X.circular(F.col(start), anchor_length or length))
    turned = turned.withColumn("__end", F.col("__start") + F.col(end) - F.col(start))
    j = overlap_join(shifted, turned, contig, "__start", "__end", width or max(window * 2, 1), pad=window, inclusive=True)
    j = j.filter((F.col("l___start") >= F.col("r___start") - window) & (F.col("l___end") <= F.col("r___end") + window))
    return j.select(*[c for c in j.columns if "___" not in c])


def upstream(rows: DataFrame, anchors: DataFrame, length: int, contig: str = "contig_id", start: str = "start", end: str = "end_coord", strand: str = "strand") -> DataFrame:
    """Rows that overlap the ``length`` positions before each anchor in its reading direction (C11)."""
    plus = F.col(strand) == "+"
    a = anchors.withColumn("__a", F.when(plus, F.col(start) - length).otherwise(F.col(end))).withColumn("__b", F.when(plus, F.col(start)).otherwise(F.col(end) + length))
    a = a.drop(start, end).withColumnRenamed("__a", start).withColumnRenamed("__b", end)
    return overlap_join(rows, a, contig, start, end, width=max(length, 1000))


def distance_join(rows: DataFrame, anchors: DataFrame, distance: float, key: str = "contig_id", start: str = "start", strict: bool = True) -> DataFrame:
    """Pairs of one key whose starts are closer than ``distance`` (C14), columns prefixed l_ (row) and r_ (anchor)."""
    a = _prefixed(rows, "l_").withColumn("__a", F.floor(F.col(f"l_{start}") / distance))
    b = _prefixed(anchors, "r_").withColumn("__b", F.explode(F.array(*[F.floor(F.col(f"r_{start}") / distance) + d for d in (-1, 0, 1)])))
    gap = F.abs(F.col(f"l_{start}") - F.col(f"r_{start}"))
    near = gap < distance if strict else gap <= distance
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("__a") == F.col("__b")) & near).drop("__a", "__b")


def near_any(rows: DataFrame, marks: DataFrame, gap: int, key: str, contig: str = "contig_id", start: str = "start", end: str = "end_coord", name: str = "near") -> DataFrame:
    """``rows`` with whether any mark of the contig has an end within ``gap`` of a facing end."""
    hit = overlap_join(rows, marks, contig, start, end, width=max(gap * 2, 1000), pad=gap, inclusive=True)
    hit = hit.filter(X.gap_between(F.col(f"l_{start}"), F.col(f"l_{end}"), F.col(f"r_{start}"), F.col(f"r_{end}")) <= gap)
    ids = hit.select(F.col(f"l_{key}").alias(key)).distinct().withColumn(name, F.lit(True))
    return rows.join(ids, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lookup(df: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A dictionary join (C16): one row per key in ``table``; Spark broadcasts it while its size allows."""
    return df.join(table.dropDuplicates([key]), key, how)


def same_strand_chains(genes: DataFrame, gap: int, contig: str = "contig_id", start: str = "start", end: str = "end_coord", strand: str = "strand", key: str = "protein_id") -> DataFrame:
    """Chains of same-strand genes with gaps of at most ``gap`` (C19), as clusters per contig and strand."""
    from .windows import gap_clusters

    return gap_clusters(genes, [contig, strand], start, end, gap, [key], "chain")


def with_domain_in_taxon(proteins: DataFrame, annotations: DataFrame, bins: DataFrame, accession: str, taxon_prefix: str) -> DataFrame:
    """Proteins with a domain, in genomes whose lineage starts with a prefix."""
    genomes = bins.filter(F.col("taxonomy").startswith(taxon_prefix)).select("bin_id")
    hits = annotations.filter(F.col("accession") == accession).select("protein_id")
    return proteins.join(genomes, "bin_id", "left_semi").join(hits, "protein_id", "left_semi")


def priority_label(ids: DataFrame, key: str, *stacks: tuple[str, DataFrame], otherwise: str = "?") -> DataFrame:
    """(key, label, source): the label of the first stack that has one (C22); each stack: (key, label), one row per key."""
    out, choices = ids.select(key), []
    for i, (name, stack) in enumerate(stacks):
        out = out.join(stack.select(key, F.col("label").alias(f"__{i}")), key, "left")
        choices.append(F.when(F.col(f"__{i}").isNotNull(), F.struct(F.col(f"__{i}").alias("label"), F.lit(name).alias("source"))))
    best = F.coalesce(*choices, F.struct(F.lit(otherwise).alias("label"), F.lit(None).cast("string").alias("source")))
    return out.select(key, best.alias("__b")).select(key, "__b.*")


def all_annotations_of_flagged(annotations: DataFrame, pattern: str) -> DataFrame:
    """Rows whose name matches, each with every annotation of its protein."""
    flagged = annotations.filter(F.col("name").rlike(pattern)).select("protein_id", F.col("annotation_id").alias("flagged_id"), F.col("name").alias("flagged_name"))
    return flagged.join(annotations, "protein_id", "left")
