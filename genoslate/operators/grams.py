"""An index of letter trigrams for substring searches: only texts that hold all trigrams of a pattern are read and checked."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from .matching import GRAM, grams

#: Folders of an index, tasks that write each, and trigrams of a pattern that are intersected.
BUCKETS, WRITERS, MOST_GRAMS = 64, 4, 60


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_index(df: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """Postings (gram, key) of the distinct trigrams of each lowered text, in one folder a bucket of trigrams, sorted by trigram.

    A bucket is written by several tasks, so a trigram of most texts is no single task's work. Null and short texts have no postings; null keys are kept.
    """
    found = df.select(F.explode(grams(F.lower(F.col(text)))).alias("gram"), F.col(key).alias("key"))
    dealt = found.withColumn("bucket", _bucket(F.col("gram"), buckets)).withColumn("__w", F.pmod(F.xxhash64("key"), F.lit(WRITERS)))
    dealt.repartition("bucket", "__w").drop("__w").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    """The postings in ``path``; the type of keys is given, so an index without postings can be read too."""
    return spark.read.schema(f"gram string, key {key_type}, bucket int").parquet(path)


def needed(pattern: str) -> list[str]:
    """Trigrams that every text has in which ``contains_text`` finds ``pattern``; none if it has no run of three letters.

    With ``%`` or ``_`` it is a LIKE pattern: each run between wildcards counts, runs with escapes or other than ASCII are passed over.
    """
    runs = [pattern.lower()]
    if "%" in pattern or "_" in pattern:
        runs = [r for r in re.split("[%_]", pattern.lower()) if r.isascii() and "\\" not in r]
    return list(dict.fromkeys(r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)))[:MOST_GRAMS]


def candidates(index: DataFrame, patterns: list[str], buckets: int = BUCKETS) -> DataFrame | None:
    """Keys of the texts that hold all trigrams of any pattern; None where a pattern needs none, so that every text has to be checked.

    Postings are counted as one bit a trigram, with partial results, in one pass over the folders of the patterns' buckets.
    """
    wanted = [needed(p) for p in patterns]
    if not all(wanted):
        return None
    every = sorted({g for gs in wanted for g in gs})
    spark = index.sparkSession
    where = spark.createDataFrame([(g,) for g in every] or [("",)], "gram string").select(_bucket(F.col("gram"), buckets).alias("b")).distinct().collect()
    held = index.filter(F.col("bucket").isin([r.b for r in where]) & F.col("gram").isin(every or [""]))

    def bit(gs: list[str]) -> Column:
        return F.bit_or(reduce(lambda c, g: F.when(F.col("gram") == g[1], F.lit(1 << g[0]).cast("long")).otherwise(c), enumerate(gs), F.lit(0).cast("long")))

    if not wanted:
        return held.select("key").limit(0)
    seen = held.groupBy("key").agg(*[bit(gs).alias(f"p{i}") for i, gs in enumerate(wanted)])
    return seen.filter(reduce(or_, [F.col(f"p{i}") == (1 << len(gs)) - 1 for i, gs in enumerate(wanted)])).select("key")


def narrowed(df: DataFrame, index: DataFrame, key: str, patterns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows whose text may hold any of the patterns, for a check that follows (B3, B14, K20); all rows where the index can't tell."""
    found = candidates(index, patterns, buckets)
    if found is None:
        return df
    return df.join(found.withColumnRenamed("key", "__key"), F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def search(df: DataFrame, index: DataFrame, key: str, text: str, patterns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows whose text has any of the patterns, in any case, as ``contains_text`` has it; the same rows as a scan."""
    if not patterns:
        return df.limit(0)
    return narrowed(df, index, key, patterns, buckets).filter(reduce(or_, [X.contains_text(F.col(text), p) for p in patterns]))
