"""Overlap joins whose rows don't depend on how long an interval is.

Bins come in levels, each ``FACTOR`` times as wide as the one below. An interval lives on the lowest level whose bins are as wide as itself, so it
touches two bins of it at most, and it asks the higher levels on which the other side has intervals, again in two bins each. A pair meets on the
higher of its two levels; short intervals never meet each other there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much wider the bins of a level are than those below it, and the widest bins.
FACTOR = 8
WIDEST = 1 << 62


def widths(width: int) -> list[int]:
    """Bin widths by level."""
    out = [int(width)]
    while out[-1] * FACTOR < WIDEST:
        out.append(out[-1] * FACTOR)
    return out


def level_of(start: Column, end: Column, sizes: list[int]) -> Column:
    """The lowest level whose bins are as wide as the interval; null without both ends."""
    length = (end - start).cast("long")
    wider = F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in sizes[:-1]]), lambda s: s < length))
    return F.when(length.isNotNull(), wider)


def _levels(df: DataFrame, level: str) -> list[int]:
    """The levels that hold intervals: one small number each."""
    return sorted(r[level] for r in df.select(level).distinct().collect() if r[level] is not None)


def _binned(df: DataFrame, start: Column, end: Column, slack: int, sizes: list[int], other: list[int], own: list[str], asking: list[str]) -> DataFrame:
    """``df`` once per bin of its own level (for each place in ``own``), and of higher levels in ``other`` (for each place in ``asking``)."""
    home = F.col("__level")
    size = lambda level: F.element_at(F.array(*[F.lit(s).cast("long") for s in sizes]), level + 1)

    def bins(level: Column, place: str) -> Column:
        low = F.floor(start / size(level)).cast("long")
        high = F.greatest(F.floor((end - slack) / size(level)).cast("long"), low)
        return F.transform(F.sequence(low, high), lambda b: F.struct(level.cast("int").alias("level"), b.alias("bin"), F.lit(place).alias("place")))

    spots = [bins(home, p) for p in own] + [F.when(home < level, bins(F.lit(level), p)) for level in other for p in asking]
    nothing = F.array().cast("array<struct<level:int,bin:bigint,place:string>>")
    return df.withColumn("__spot", F.explode(F.concat(*[F.coalesce(s, nothing) for s in spots])))


def overlapping(left: DataFrame, right: DataFrame, key: tuple[str, str], left_ends: tuple[Column, Column], right_ends: tuple[Column, Column], meets: Column, width: int, slack: int) -> DataFrame:
    """Pairs of rows of one key for which ``meets`` holds, each once.

    ``left_ends`` and ``right_ends``: columns of start and end; ``meets`` may only hold where the intervals overlap, or touch with ``slack`` 0. ``width``: of the
    narrowest bins, about the usual length. Rows without a key or an end meet nothing.
    """
    sizes = widths(width)
    a = left.withColumn("__level", level_of(*left_ends, sizes))
    b = right.withColumn("__level", level_of(*right_ends, sizes))
    on_left, on_right = _levels(a, "__level"), _levels(b, "__level")
    # place h: the left one is at home, the right one at home or asking; place g: the left one asks, the right one is at home
    a = _binned(a, *left_ends, slack, sizes, on_right, ["h"], ["g"])
    b = _binned(b, *right_ends, slack, sizes, on_left, ["h", "g"], ["h"])
    a = a.withColumnsRenamed({"__spot": "__a", "__level": "__la"})
    b = b.withColumnsRenamed({"__spot": "__b", "__level": "__lb"})
    same = [F.col(f"__a.{c}") == F.col(f"__b.{c}") for c in ("level", "bin", "place")]
    size = F.element_at(F.array(*[F.lit(s).cast("long") for s in sizes]), F.col("__a.level") + 1)
    # of the bins in which a pair meets, the one with the later start counts
    later = F.floor(F.greatest(left_ends[0], right_ends[0]) / size) == F.col("__a.bin")
    joined = a.join(b, [F.col(key[0]) == F.col(key[1]), *same])
    return joined.filter(meets & later).drop("__a", "__b", "__la", "__lb")
