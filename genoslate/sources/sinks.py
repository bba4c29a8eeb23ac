"""Writers: FASTA text, tables, tag tables, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions


def wrap(sequence, width: int = 80):
    """Line breaks every ``width`` letters (H4)."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_lines(proteins: DataFrame, label: str | None = None, width: int = 80) -> DataFrame:
    """One text value per protein with a sequence: header (id and, if given, the ``label`` column) and wrapped letters."""
    head = F.concat(F.lit(">"), F.col("protein_id"))
    if label:
        head = F.concat_ws(" ", head, F.col(label))
    return proteins.filter(F.coalesce(F.length("sequence"), F.lit(0)) > 0).select(F.concat(head, F.lit("\n"), wrap(F.col("sequence"), width)).alias("value"))


def neighborhood_fasta_lines(window: DataFrame, label: str = "label", width: int = 80) -> DataFrame:
    """FASTA text of a neighbourhood (columns offset, is_anchor, strand): place and anchor in the header."""
    offset = F.when(F.col("offset") >= 0, F.concat(F.lit("+"), F.col("offset").cast("string"))).otherwise(F.col("offset").cast("string"))
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col("protein_id")), F.concat(F.lit("pos="), offset), F.concat(F.lit("strand="), F.col("strand")), F.when(F.col("is_anchor"), F.lit("[ANCHOR]")), F.col(label))
    return window.filter(F.coalesce(F.length("sequence"), F.lit(0)) > 0).select(F.concat(head, F.lit("\n"), wrap(F.col("sequence"), width)).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A TSV folder with headers (A25); arrays become comma lists."""
    flat = [F.array_join(c, ",").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_tags(tags: DataFrame, path: str) -> None:
    """Replace-all write of the tag table with its time (A26, H23), as a new version: whoever reads meanwhile sees the old table or the new one."""
    versions.replace(tags.withColumn("updated_at", F.current_timestamp()), path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the tag table."""
    return versions.current(spark, path)


def locus_view(spark: SparkSession, loci: DataFrame, locus_type: str, name: str) -> None:
    """A temporary view of one type of loci."""
    loci.filter(F.col("locus_type") == locus_type).createOrReplaceTempView(name)


def upsert(old: DataFrame, new: DataFrame, key: str = "vec_id", order: list[str] | None = None) -> DataFrame:
    """``new`` rows, and old ones without a new row of their key (A29). Of new rows with one key, the last by ``order`` counts, or by all other columns.

    Null keys are one key. The result has the columns of ``old``; ``order`` may name others.
    """
    rest = [c for c in new.columns if c != key]
    last = new.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("__r")).select(key, "__r.*").select(*old.columns)
    kept = old.join(new.select(F.col(key).alias("__key")).distinct(), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    return last.unionByName(kept)


def upsert_table(new: DataFrame, path: str, key: str = "vec_id", order: list[str] | None = None) -> None:
    """Upserts into a versioned table (A29): readers see the rows before or after, never between. A table that isn't there is made."""
    try:
        old = versions.current(new.sparkSession, path)
    except ValueError:
        old = new.limit(0)
    versions.replace(upsert(old, new, key, order), path)
