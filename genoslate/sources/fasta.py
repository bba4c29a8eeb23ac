"""FASTA files as tables: one record per entry, split by Spark's text reader, never read whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.shared import file_system

_ENTRY = "\n>"
#: Bytes up to which a file is one value; bytes of a larger one that a task holds at a time.
WHOLE = 32 << 20
CHUNK = 4 << 20


def read_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, header, sequence, leading, place) of every entry of the FASTA files at ``paths`` (``.gz`` as well).

    Line ends and blanks inside a sequence go; an empty file has no rows. The separator takes the ``>`` of all entries but
    a file's first, so ``leading`` is true for that one; a file without it has text before its first header. ``place`` orders a
    file's entries: the split's first byte, then the row in it.
    """
    raw = spark.read.option("lineSep", _ENTRY).text(paths if isinstance(paths, list) else [paths])
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    entry = raw.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r", "").alias("value"), place.alias("place"))
    leading = F.regexp_like("value", F.lit(r"^\s*>"))
    entry = entry.select("file", "place", leading.alias("leading"), F.regexp_replace("value", r"^\s*>", "").alias("value"))
    header = F.trim(F.substring_index("value", "\n", 1))
    sequence = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    out = entry.select("file", header.alias("header"), sequence.alias("sequence"), "leading", "place")
    return out.filter((F.col("header") != "") | (F.col("sequence") != ""))


def _header_parts() -> tuple[Column, Column, Column, Column]:
    parts = F.split("header", r"\s+#\s+")
    word = F.substring_index(F.element_at(parts, 1), " ", 1)
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    return word, number(2), number(3), number(4)


def gene_rows(entries: DataFrame, default_start: int = 1) -> DataFrame:
    """Entries as genes: ids, coordinates and strand from ``id # start # end # strand`` headers.

    An id may be ``protein|contig|genome``; else the contig is the id without its last ``_`` part. A trailing ``*`` goes.
    Without coordinates a gene spans ``default_start`` to three times its length on ``+``.
    """
    word, start, end, strand = _header_parts()
    seq = F.regexp_replace("sequence", r"\*+$", "")
    bits = F.split(word, r"\|")
    contig = F.coalesce(F.try_element_at(bits, F.lit(2)), F.regexp_replace(F.element_at(bits, 1), r"_[^_]*$", ""))
    return entries.select(
        "file",
        F.element_at(bits, 1).alias("protein_id"),
        contig.alias("contig_id"),
        F.try_element_at(bits, F.lit(3)).alias("bin_id"),
        F.coalesce(start, F.lit(default_start)).alias("start"),
        F.coalesce(end, F.length(seq) * 3).alias("end_coord"),
        F.when(strand.isNull() | (strand == 1), "+").otherwise("-").alias("strand"),
        seq.alias("sequence"),
        F.length(seq).alias("sequence_length"),
        "place",
    )


def with_gene_index(genes: DataFrame) -> DataFrame:
    """``gene_index``: 0-based rank by start within the contig (ties by id)."""
    return windows.rank_in_group(genes, "contig_id", ["start", "protein_id"])


def read_proteins(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Protein FASTA with coordinates in its headers (A1)."""
    return with_gene_index(gene_rows(read_entries(spark, paths))).drop("place")


def read_gene_calls(spark: SparkSession, root: str, pattern: str = "*.faa") -> DataFrame:
    """Gene-caller FASTA under ``root/<bin>/``: the bin is the parent folder, and ``gene_index`` the 0-based place in the file among
    the genes of its contig (A2)."""
    genes = gene_rows(read_entries(spark, f"{root.rstrip('/')}/*/{pattern}"), default_start=0)
    genes = genes.filter(~F.col("file").contains("/all_protein_symlinks/")).withColumn("bin_id", F.element_at(F.split("file", "/"), -2))
    return windows.rank_in_group(genes, ["file", "contig_id"], ["place"]).drop("place")


def read_contigs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(contig_id, sequence, length, gc_content) of nucleotide FASTA (A3)."""
    e = read_entries(spark, paths)
    gc = F.length(F.regexp_replace("sequence", "(?i)[^gc]", "")) / F.nullif(F.length("sequence"), F.lit(0))
    return e.select(F.substring_index("header", " ", 1).alias("contig_id"), "sequence", F.length("sequence").alias("length"), gc.alias("gc_content"))


def read_for_embedding(spark: SparkSession, root: str, pattern: str = "*.faa") -> DataFrame:
    """(protein_id, sequence, genome): first header word, trailing stars dropped, genome = folder (A3)."""
    e = read_entries(spark, f"{root.rstrip('/')}/*/{pattern}")
    return e.select(
        F.substring_index("header", " ", 1).alias("protein_id"),
        F.regexp_replace("sequence", r"\*+$", "").alias("sequence"),
        F.element_at(F.split("file", "/"), -2).alias("genome"),
    )


def quality_report(entries: DataFrame, letters: str = "ACGTUNRYSWKMBDHV") -> DataFrame:
    """Per file: entries, total length, duplicate ids, letters outside the code, entries without a header, text before the first one (A4)."""
    ident = F.substring_index("header", " ", 1)
    odd = F.array_distinct(F.split(F.regexp_replace(F.upper("sequence"), f"[{letters}]", ""), ""))
    return entries.groupBy("file").agg(
        F.count("*").alias("n_sequences"),
        F.sum(F.length("sequence")).alias("total_length"),
        (F.count("*") - F.countDistinct(ident)).alias("duplicate_ids"),
        F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_set(odd))), "")).alias("invalid_letters"),
        F.count_if(F.col("header") == "").alias("without_header"),
        (F.count_if("leading") == 0).alias("data_before_header"),
    )


def count_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries per file."""
    return read_entries(spark, paths).groupBy("file").agg(F.count("*").alias("n_sequences"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, md5) of files, each read in chunks."""
    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            fs, name = file_system(path)
            digest = hashlib.md5(usedforsecurity=False)
            with fs.open_input_stream(name, buffer_size=0) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], names=["path", "md5"])


def file_inventory(spark: SparkSession, root: str, pattern: str = "*.{fna,fa,fasta}", whole: int = WHOLE) -> DataFrame:
    """(file, genome_id, length, md5) of matching files (A5); ids keep letters and digits, joined by single ``_``.

    Files up to ``whole`` bytes are hashed as values. A larger one is read by one task in chunks of CHUNK bytes, which carries the digest on; it has to
    lie where Arrow can open it (local or mounted folders, HDFS, S3), and the query fails where it can't. Spark doesn't list empty files.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    small = listed.filter(F.col("length") <= whole).select("path", "length", F.md5("content").alias("md5"))
    # the content of large files is never a value: only their paths are read here
    large = listed.filter(F.col("length") > whole).select("path", "length")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = large.select("path").repartition(parts, "path").mapInArrow(_digests, "path string, md5 string")
    files = small.unionByName(large.join(sums, "path"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    ident = F.expr("trim(BOTH '_' FROM regexp_replace(n, '[^A-Za-z0-9]+', '_'))")
    return files.withColumn("n", name).select(F.col("path").alias("file"), ident.alias("genome_id"), "length", "md5")
