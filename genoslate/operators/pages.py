"""Pages, top-k and keyset continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a total order (F1, F2, F5, F7): end the order with a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One row: total rows, and whether they go on past the page (F1); a job of its own, only on demand."""
    return df.agg(F.count("*").alias("total_rows")).withColumn("truncated", F.col("total_rows") > limit + offset)


def after(df: DataFrame, sort: str, key: str, last_sort, last_key, limit: int = 50, descending: bool = True) -> DataFrame:
    """The next page after a known last row (F3), without reading the pages before it."""
    s, k = F.col(sort), F.col(key)
    beyond = (s < last_sort) if descending else (s > last_sort)
    return df.filter(beyond | ((s == last_sort) & (k > last_key))).orderBy(s.desc() if descending else s.asc(), k).limit(limit)


def merge_hits(*tables: DataFrame, k: int = 10, per: str | None = None) -> DataFrame:
    """The best hits of several lists by e-value, nulls last; a percentage identity becomes a share."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out = out.withColumn("identity", F.when(F.col("identity") > 1, F.col("identity") / 100).otherwise(F.col("identity")))
    order = [F.col("evalue").asc_nulls_last(), F.col("target")]
    if per is None:
        return out.orderBy(*order).limit(k)
    return out.withColumn("__r", F.row_number().over(W.partitionBy(per).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")
