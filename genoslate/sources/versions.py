"""Tables that are replaced as a whole while others read them.

A version is a folder of its own, numbered and with a random name. Spark puts ``_SUCCESS`` into it once all of its files are there, and
that file is what makes it a version: a reader takes the highest number that has one. So a reader sees the old table or the new one, a
write that fails changes nothing, and files that are being read stay until ``drop_old``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished versions, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v") and fs.exists(hadoop(f"{path}/{n}/_SUCCESS")))


def replace(df: DataFrame, path: str) -> str:
    """Writes ``df`` as the new version of the table; the version's name. Of two writers at once, the later name counts, whole."""
    last = _versions(df.sparkSession, path)
    name = f"v{int(last[-1][1:].split('-')[0]) + 1 if last else 0:012d}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/{name}")
    return name


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version. ValueError where there is none."""
    found = _versions(spark, path)
    if not found:
        raise ValueError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{found[-1]}")


def drop_old(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all but the newest ``keep`` versions; whoever still reads those loses them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in _versions(spark, path)[: -max(1, keep)]:
        folder = hadoop(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
