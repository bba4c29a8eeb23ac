"""Set algebra on ids, tags and named working sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def id_algebra(all_ids: DataFrame, has: list[DataFrame] = (), lacks: list[DataFrame] = (), key: str = "protein_id") -> DataFrame:
    """all, then in each of ``has``, and in none of ``lacks`` (G1)."""
    out = reduce(lambda d, s: d.join(s.select(key), key, "left_semi"), has, all_ids.select(key).distinct())
    return reduce(lambda d, s: d.join(s.select(key), key, "left_anti"), lacks, out)


def predicates_of(df: DataFrame, predicates: dict[str, Column], key: str = "protein_id") -> DataFrame:
    """(key, tags): the predicates that hold, of all rows in one scan."""
    return df.select(key, F.array_sort(X.tags_where(**predicates)).alias("tags"))


def add_tags(tags: DataFrame, new: DataFrame, key: str = "protein_id", column: str = "tags") -> DataFrame:
    """Stored tags with the new ones of each key; keys without a stored row are left out."""
    n = new.groupBy(key).agg(F.flatten(F.collect_list(column)).alias("__new"))
    return tags.join(n, key, "left").withColumn(column, X.tag_set(F.col(column), F.col("__new"))).drop("__new")


def set_add(sets: DataFrame, name: str, ids: DataFrame, key: str = "id") -> DataFrame:
    """Working sets (set_name, id) with the ids added; names ignore case."""
    new = ids.select(F.lit(name.lower()).alias("set_name"), F.col(key).alias("id"))
    return sets.unionByName(new).dropDuplicates(["set_name", "id"])


def set_remove(sets: DataFrame, name: str, ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The sets without the ids, or without the whole set."""
    if ids is None:
        return sets.filter(F.col("set_name") != name.lower())
    gone = ids.select(F.lit(name.lower()).alias("set_name"), F.col(key).alias("id"))
    return sets.join(gone, ["set_name", "id"], "left_anti")


def set_members(sets: DataFrame, name: str) -> DataFrame:
    return sets.filter(F.col("set_name") == name.lower()).select("id")


def set_list(sets: DataFrame) -> DataFrame:
    return sets.groupBy("set_name").agg(F.count("*").alias("n"))


def merge_tag_maps(*maps: DataFrame, key: str = "key", tags: str = "tags") -> DataFrame:
    """The union of the tags of each key over several rule maps."""
    both = reduce(DataFrame.unionByName, maps)
    return both.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tags)))).alias(tags))


def merge_first(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """``a``, and rows of ``b`` whose key ``a`` lacks."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"))
