"""A corpus pipeline: quality, repeated lines, near copies, source mix, token ids.

Defined cases, in every stage: the operator's own hold; columns beyond ``COLUMNS`` are left behind, whatever they are called; an
empty table gives an empty table. quality: a null or empty text is scored as an empty one. lines: a null text becomes an empty
one, and n_chars is that of the text that is left. near: rows without an id stay unless they are copies of one with
an id. mix: a document is given as often as it is taken, so ids repeat. tokens: one row for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, line_dedup, mixing, near_dedup, pieces, quality
from .queries import PIECE_MODEL, SOURCE_WEIGHTS, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go everywhere."""
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return near_dedup.near_duplicates(docs).filter("kept").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_to_targets(docs, SOURCE_WEIGHTS)
    taken = mixed.filter("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    return taken.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding gives the text back."""
    out = pieces.encode_decode(docs, PIECE_MODEL, outputs=("n_tokens", "ids_text", "decoded"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near", near),
    ("mix", mix),
    ("tokens", tokens),
]

#: Byte-pair merges and a fitted classifier are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
