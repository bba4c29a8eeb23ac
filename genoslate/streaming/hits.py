"""Add-on hits as a file stream: the same columns as the batch load, appended as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HITS = "sequence_id string, hmm_name string, evalue double, bitscore double, env_from int, env_to int"


def stream_hits(spark: SparkSession, folder: str, proteins: DataFrame, source: str) -> DataFrame:
    """Hits of known proteins from TSV files that appear in ``folder``."""
    raw = spark.readStream.schema(HITS).options(sep="\t", header="true").csv(folder)
    known = raw.withColumnRenamed("sequence_id", "protein_id").join(proteins.select("protein_id"), "protein_id", "left_semi")
    return known.select("protein_id", F.lit(source).alias("source"), F.col("hmm_name").alias("accession"), "evalue", F.col("bitscore").alias("score"), F.col("env_from").alias("start_aa"), F.col("env_to").alias("end_aa"))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is and stops; the checkpoint makes each file count once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
