"""Best rows, ranks, group statistics, runs and clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from .shared import written


def best_per_key(df: DataFrame, key: str | list[str], by: str, fields: list[str], ties: str | list[str], largest: bool = False) -> DataFrame:
    """The row of each key with the smallest (or largest) ``by``, nulls last, ties by ``ties``.

    A grouping with partial results, so no key is ever sorted in one task.
    """
    keys, tie = ([x] if isinstance(x, str) else x for x in (key, ties))
    value = -F.col(by) if largest else F.col(by)
    order = F.struct(F.col(by).isNull().alias("none"), value.alias("value"), *tie)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("__b")).select(*keys, "__b.*")


def best_label(annotations: DataFrame, strict: bool = True) -> DataFrame:
    """(protein_id, label): the annotation of the smallest e-value as ``name (accession)``."""
    best = best_per_key(annotations, "protein_id", "evalue", ["name", "accession"], "annotation_id")
    return best.select("protein_id", X.label_of(F.col("name"), F.col("accession"), strict).alias("label"))


#: Rows of a group that a task sorts; larger groups are cut into ranges.
SEGMENT_ROWS = 1_000_000


def _segments(df: DataFrame, groups: list[str], order: list, most: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with ``__seg``: 0 where every group fits a task; else range partitions by group and order, so that a large group
    lies in several tasks, in order."""
    if df.groupBy(*groups).count().filter(F.col("count") > (most or SEGMENT_ROWS)).isEmpty():
        return df.withColumn("__seg", F.lit(0)), False
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, since a lost and recomputed partition might be cut elsewhere
    return written(df.repartitionByRange(parts, *groups, *order).withColumn("__seg", F.spark_partition_id()), "segments"), True


def _carried(df: DataFrame, groups: list[str], value: Column, over: Callable[[str], Column], name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of each segment, taken together by ``over`` for the segments of the group before it."""
    per = df.groupBy(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(groups)], F.col("__seg").alias("__s")).agg(value.alias("__x"))
    w = W.partitionBy(*[f"__k{i}" for i in range(len(groups))]).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn(name, over("__x").over(w)).drop("__x")
    on = [F.col(g).eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(groups)] + [F.col("__seg") == F.col("__s")]
    return df.join(per, on, "left").drop("__s", *[f"__k{i}" for i in range(len(groups))])


def rank_in_group(df: DataFrame, group: str | list[str], order: list[str], name: str = "gene_index", first: int = 0, most: int | None = None) -> DataFrame:
    """Rank by ``order`` within the group (E9). A group of more than ``most`` rows (by default SEGMENT_ROWS) is ranked in ranges, which the sizes of those before offset."""
    groups = [group] if isinstance(group, str) else list(group)
    cut, large = _segments(df, groups, list(order), most)
    rank = F.row_number().over(W.partitionBy(*groups, "__seg").orderBy(*order)) - 1 + first
    out = cut.withColumn(name, rank)
    if large:
        out = _carried(out, groups, F.count("*"), F.sum, "__n").withColumn(name, (F.col(name) + F.coalesce("__n", F.lit(0))).cast("int")).drop("__n")
    return out.drop("__seg")


def _stats(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__std"))


def group_zscore(df: DataFrame, group: str, value: str, name: str = "zscore") -> DataFrame:
    """(x - mean) / std of the group; 0 where std is 0 or null."""
    j = df.join(_stats(df, group, value).withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")))
    z = F.when(F.coalesce(F.col("__std"), F.lit(0)) == 0, 0.0).otherwise((F.col(value) - F.col("__mean")) / F.col("__std"))
    return j.withColumn(name, F.coalesce(z, F.lit(0.0))).select(*df.columns, name)


def group_outliers(df: DataFrame, group: str, value: str, deviations: float = 2.0) -> DataFrame:
    """Rows further than so many standard deviations from their group's mean."""
    j = df.join(_stats(df, group, value).withColumnRenamed(group, "__g"), F.col(group) == F.col("__g"))
    return j.filter((F.col("__std") > 0) & (F.abs(F.col(value) - F.col("__mean")) > deviations * F.col("__std"))).select(*df.columns)


def gap_clusters(df: DataFrame, group: list[str], start: str, end: str, gap: float, ties: list[str], name: str = "cluster") -> DataFrame:
    """Clusters of intervals: a new one where a start is over ``gap`` past every end before it.

    Numbered from 1 within the group; rows without coordinates go. In a group beyond SEGMENT_ROWS, ranges take over the largest end and the
    number of clusters of those before.
    """
    df = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    cut, large = _segments(df, list(group), [start, *ties])
    w = W.partitionBy(*group, "__seg").orderBy(start, *ties)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    if large:
        cut = _carried(cut, list(group), F.max(end), F.max, "__reach")
        reach = F.greatest(reach, F.col("__reach"))
    new = cut.withColumn("__new", (reach.isNull() | (F.col(start) - reach > gap)).cast("int"))
    out = new.withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    if large:
        out = _carried(out, list(group), F.sum("__new"), F.sum, "__n").withColumn(name, F.col(name) + F.coalesce("__n", F.lit(0))).drop("__n", "__reach")
    return out.drop("__new", "__seg")


def consecutive_runs(df: DataFrame, group: list[str], order: list[str], member: Column, least: int, keep_by: list[str] = ()) -> DataFrame:
    """Runs of at least ``least`` neighbours (by rank in the group) that meet ``member`` (E7): first and last rank, length."""
    ranked = rank_in_group(df, list(group), list(order), "__rank")
    hit = rank_in_group(ranked.filter(member), [*group, *keep_by], ["__rank"], "__own")
    runs = hit.withColumn("__island", F.col("__rank") - F.col("__own")).groupBy(*group, *keep_by, "__island").agg(
        F.min("__rank").alias("first_rank"), F.max("__rank").alias("last_rank"), F.count("*").alias("run_length")
    )
    return runs.filter(F.col("run_length") >= least).drop("__island")


def split_by_rank(df: DataFrame, order: list[str], parts: int = 4, group: list[str] = (), name: str = "part") -> DataFrame:
    """Equal parts by rank, the rest in the last.

    Without a group, the last row of each part is selected (see ``keys_at_ranks``), and a row's part follows from comparing it with those: the table is neither
    sorted nor shuffled. Of rows that are equal by ``order``, any may be in the earlier part; only those that a cut goes through are ranked among themselves.
    """
    if group:
        w = W.partitionBy(*group)
        ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
        size = F.greatest(F.floor(F.col("__n") / parts), F.lit(1))
        return ranked.withColumn(name, F.least(F.floor((F.col("__rn") - 1) / size), F.lit(parts - 1)).cast("int") + 1).drop("__n", "__rn")
    total = df.count()
    size = max(total // parts, 1)
    ends = [e for e in range(size, size * parts, size) if e < total]
    cuts = keys_at_ranks(df, order, ends)
    if not cuts:
        return df.withColumn(name, F.lit(1))
    key = F.struct(*order)
    cut_key = [_key_literal(df, order, c.key) for c in cuts]
    part = reduce(add, [(key > k).cast("int") for k in cut_key]) + 1
    split = [(k, c) for k, c in zip(cut_key, cuts) if c.below + c.equal > c.rank]
    if not split:
        return df.withColumn(name, part)
    within = reduce(or_, [key == k for k, _ in split])
    tied = written(df.filter(within).withColumn("__id", F.monotonically_increasing_id()), "tied")
    ranked, _ = global_rank(tied, [*order, "__id"], "__rn")
    # the ranks of ties count from the first tied row: those of smaller tied keys come off
    before, ahead = F.lit(0), 0
    for k, equal, below in _distinct(split):
        before = F.when(key == k, F.lit(below - ahead)).otherwise(before)
        ahead += equal
    place = F.col("__rn") + before
    ranked = ranked.withColumn(name, F.least(F.floor((place - 1) / size), F.lit(parts - 1)).cast("int") + 1)
    return df.filter(~within).withColumn(name, part).unionByName(ranked.drop("__rn", "__id"))


def _distinct(split: list) -> list:
    """(key literal, rows equal, rows below) of each distinct cut, in order."""
    return list({c.below: (k, c.equal, c.below) for k, c in split}.values())


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> tuple[DataFrame, int]:
    """1-based rank of every row in the whole table, and the number of rows; no task sees more than a range partition.

    Rows are sorted by range, ranked within each range, and offset by the sizes of the ranges before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, since a lost and recomputed partition might be cut elsewhere
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(b) for b in before] or [F.lit(0)]), F.col("__p") + 1)
    w = W.partitionBy("__p").orderBy(*order)
    return ranged.withColumn(name, F.row_number().over(w) + offset).drop("__p"), total


@dataclass(frozen=True)
class RankedKey:
    """The key at a rank (from 1), the rows below it, and the rows that equal it."""

    rank: int
    key: Row
    below: int
    equal: int


#: Keys that cut a table in a round of selection, the rows they are drawn from, and the rows that are sorted in the end.
CUTS, DRAWN, SORTED_ROWS = 64, 2048, 100_000


def _key_literal(df: DataFrame, order: list[str], key: Row) -> Column:
    types = dict(df.dtypes)
    return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, key)])


def keys_at_ranks(df: DataFrame, order: list[str], ranks: list[int], most: int | None = None) -> list[RankedKey]:
    """The keys that stand at some ranks (ascending, nulls first), without sorting the table.

    Each round draws some keys, counts the rows at and between them in one pass with partial counts, and goes on with the intervals in which a wanted rank
    lies; what it goes on with is written. Once no more than ``most`` rows (SORTED_ROWS) are left, their distinct keys are sorted. The draw decides how many rounds it takes, never
    the result. Ranks outside the table are left out. The driver gets the drawn keys and the keys found.
    """
    most = SORTED_ROWS if most is None else most
    left, found = df.select(*order), []
    # (number of the interval, rows before it, wanted ranks in it)
    total = left.count()
    open_ = [(0, 0, sorted({r for r in ranks if 1 <= r <= total}))] if total else []
    left, rows = left.withColumn("__at", F.lit(0)), total
    key = F.struct(*order)
    while any(wanted for _, _, wanted in open_):
        if rows <= most:
            seen = W.partitionBy("__at").orderBy(*order)
            sums = left.groupBy("__at", *order).agg(F.count("*").alias("__c")).withColumn("__to", F.sum("__c").over(seen))
            hit = [(sums["__at"] == at) & (F.col("__to") - F.col("__c") + before < r) & (F.col("__to") + before >= r) for at, before, wanted in open_ for r in wanted]
            start = {at: before for at, before, _ in open_}
            for row in sums.filter(reduce(or_, hit)).collect():
                below = start[row["__at"]] + row["__to"] - row["__c"]
                value = Row(*[row[c] for c in order])
                found += [RankedKey(r, value, below, row["__c"]) for at, _, wanted in open_ if at == row["__at"] for r in wanted if below < r <= below + row["__c"]]
            break
        drawn = left.select("__at", key.alias("k")).orderBy(F.rand(len(found) + rows % 1000)).limit(DRAWN)
        keys: dict[int, list[Row]] = {}
        for row in drawn.distinct().orderBy("__at", "k").collect():
            keys.setdefault(row["__at"], []).append(row["k"])
        shown = {at: ks[:: -(-len(ks) // max(1, CUTS // len(keys)))] for at, ks in keys.items()}
        place = F.lit(0)
        for at, ks in shown.items():
            cut = [_key_literal(df, order, k) for k in ks]
            # even places lie between the drawn keys, odd ones at them
            step = reduce(add, [(key >= c).cast("int") + (key > c).cast("int") for c in cut])
            place = F.when(F.col("__at") == at, step).otherwise(place)
        placed = left.withColumn("__to", place)
        counts: dict[int, dict[int, int]] = {}
        for row in placed.groupBy("__at", "__to").count().collect():
            counts.setdefault(row["__at"], {})[row["__to"]] = row["count"]
        then, rows, kept = [], 0, []
        for at, before, wanted in open_:
            for to in sorted(counts.get(at, {})):
                n = counts[at][to]
                inside = [r for r in wanted if before < r <= before + n]
                if inside and to % 2:
                    found += [RankedKey(r, shown[at][to // 2], before, n) for r in inside]
                elif inside:
                    kept.append((F.col("__at") == at) & (F.col("__to") == to))
                    then.append((len(then), before, inside))
                    rows += n
                before += n
        if not kept:
            break
        number = reduce(lambda c, x: F.when(x[1], x[0]).otherwise(c), enumerate(kept), F.lit(None).cast("int"))
        left = written(placed.withColumn("__n", number).filter(F.col("__n").isNotNull()).select(*order, F.col("__n").alias("__at")), "selected")
        open_ = then
    return sorted(found, key=lambda x: x.rank)


def at_fractions(df: DataFrame, order: list[str], fractions: list[float]) -> DataFrame:
    """The rows at fixed fractions of the ranks (E12); of rows that are equal by ``order``, as many as there are such ranks. See ``keys_at_ranks``."""
    total = df.count()
    found = keys_at_ranks(df, order, [min(total, int(total * f) + 1) for f in fractions])
    if not found:
        return df.limit(0)
    wanted: dict[int, list[RankedKey]] = {}
    for x in found:
        wanted.setdefault(x.below, []).append(x)
    key = F.struct(*order)
    picked = [(_key_literal(df, order, xs[0].key), len(xs), xs[0].equal) for xs in wanted.values()]
    out = [df.filter(reduce(or_, [key == k for k, n, equal in picked if n == equal]))] if any(n == equal for _, n, equal in picked) else []
    return reduce(DataFrame.unionByName, out + [df.filter(key == k).limit(n) for k, n, equal in picked if n < equal])


def first_of_class(df: DataFrame, cls: str, value: str, position: str, most: int = 3) -> DataFrame:
    """Rows whose value is among the first ``most`` distinct ones of their class."""
    first = df.groupBy(cls, value).agg(F.min(position).alias("__first"))
    ranked = first.withColumn("__r", F.row_number().over(W.partitionBy(cls).orderBy("__first")))
    return df.join(ranked.filter(F.col("__r") <= most).select(cls, value), [cls, value], "left_semi")


def title_key(title: Column, length: int = 50) -> Column:
    """Letters and digits of a title in lower case, cut."""
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, length)


def dedup_first(df: DataFrame, key: Column, position: str) -> DataFrame:
    """The first row of each key by position (E11), as a grouping with partial minima."""
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("__key")).agg(F.min_by(row, position).alias("__r")).select("__r.*")
