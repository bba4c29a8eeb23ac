"""Row filters: optional conditions, lookups, tag searches, integrity checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

#: Ids up to this many are an IN list; more are a table to join with.
SMALL_LIST = 1000


def where_given(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """The rows that meet every given condition (B1)."""
    return df.filter(reduce(and_, [c for c in conditions if c is not None], F.lit(True)))


def by_ids(df: DataFrame, ids: list | DataFrame, key: str = "protein_id") -> DataFrame:
    """Point and list lookup (B2, B12); a long list or a table becomes a semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    if len(ids) <= SMALL_LIST:
        return df.filter(F.col(key).isin(list(ids)))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in ids], [key]), key, "left_semi")


def search_tags(df: DataFrame, has: list[str] = (), lacks: list[str] = (), tags: str = "tags") -> DataFrame:
    """All of ``has`` and none of ``lacks``."""
    return df.filter(X.has_all(F.col(tags), list(has)) & X.has_none(F.col(tags), list(lacks)))


def unknown_tags(requested: DataFrame, vocabulary: DataFrame, tag: str = "tag", registered: list[str] = ()) -> DataFrame:
    """Requested tags that no vocabulary entry or registered name allows; ``x:y`` tags always are allowed."""
    free = requested.filter(~F.col(tag).contains(":") & ~F.col(tag).isin(list(registered) or [""]))
    return free.join(vocabulary.select(F.col("predicate_id").alias(tag)), tag, "left_anti")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a key that the parent lacks (B9); null keys refer to nothing and are fine."""
    p = parent.select(F.col(parent_key).alias("__p"))
    return child.filter(F.col(child_key).isNotNull()).join(p, F.col(child_key) == F.col("__p"), "left_anti")


def in_window(df: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Genes of a contig that overlap [start, end)."""
    return df.filter((F.col("contig_id") == contig) & X.overlaps(F.col("start"), F.col("end_coord"), F.lit(start), F.lit(end)))


def keyword_search(df: DataFrame, words: list[str], text: str = "description") -> DataFrame:
    """Rows whose text has any of the words, in any case."""
    return df.filter(F.lower(F.col(text)).rlike("|".join(f"\\Q{w.lower()}\\E" for w in words)))


def with_status(df: DataFrame, statuses: list[str] = ("proposed", "supported"), status: str = "status") -> DataFrame:
    """Rows of the given statuses; by default the active ones."""
    return df.filter(F.col(status).isin(list(statuses)))


def keep(df: DataFrame, condition: Column | Callable) -> DataFrame:
    """A set filter by a column, or by a function of a pandas frame that gives booleans, row by row (B13, J3; see ``row_rule``)."""
    if isinstance(condition, Column):
        return df.filter(condition)

    def run(frames):
        for pdf in frames:
            yield pdf[row_rule(condition, pdf)]

    return df.mapInPandas(run, df.schema)


#: Rows at either end of a batch that a function is asked about by themselves.
ASKED_ALONE = 8


def row_rule(rule: Callable, pdf: pd.DataFrame) -> pd.Series:
    """What ``rule`` says of each row of a batch, null as false.

    A rule tells of a row by that row alone. Batches are cut as Spark pleases, so a rule that looks at others (such as those above the mean) is refused:
    it is asked about single rows and about halves of the batch too, and ValueError where it answers otherwise.
    """
    said = lambda part: pd.Series(rule(part), index=part.index).fillna(False).astype(bool) if len(part) else pd.Series([], dtype=bool)
    pdf = pdf.reset_index(drop=True)
    whole, half = said(pdf), len(pdf) // 2
    ends = sorted({*range(min(ASKED_ALONE, len(pdf))), *range(max(0, len(pdf) - ASKED_ALONE), len(pdf))})
    parts = [pdf.iloc[:half], pdf.iloc[half:], *[pdf.iloc[i : i + 1] for i in ends]]
    if not all((said(p).to_numpy() == whole[p.index].to_numpy()).all() for p in parts):
        raise ValueError("a rule has to tell of each row by itself; this one depends on the other rows of its batch")
    return whole.to_numpy()


def annotated(proteins: DataFrame, annotations: DataFrame, yes: bool = True, key: str = "protein_id") -> DataFrame:
    """Proteins with, or without, any of the annotations."""
    return proteins.join(annotations.select(key), key, "left_semi" if yes else "left_anti")


def giant(least: int = 2000) -> Column:
    """Registry rule over either measure of length (B11); generator thresholds are a parameter away."""
    return X.length_filter(least=least + 1)


def tiny(most: int = 50) -> Column:
    """Below ``most``; coordinates count only without a sequence length."""
    return X.length_of() < most


def confident(annotations: DataFrame, evalue: float = 1e-10) -> DataFrame:
    """Ids of proteins with a hit below ``evalue``."""
    return annotations.filter(F.col("evalue") < evalue).select("protein_id").distinct()


def hypothetical(annotations: DataFrame) -> DataFrame:
    """Ids of proteins with a text of unknown function."""
    return annotations.filter(X.is_hypothetical(F.col("name"), F.col("description"))).select("protein_id").distinct()
