"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source has a target in words. A document has a weight class (1 to MOST_CLASSES; by default the number of binary digits of
its size, so longer documents are likelier), and is to be taken ``level * weight`` times, ``most`` times at most; the level is the one
at which the source's words add up to its target. The whole copies of that number are certain. What is left of it is the document's
inclusion probability, unequal within a source, and the rest of the target is sampled without replacement: a document's
rank is its random odds u / (1 - u), for a reproducible u, divided by its inclusion odds, and the documents of the smallest
ranks are taken until the sample has its fixed size. Targets are in words, so this size is too: the document
that crosses it is taken if half of it or more fits.

No source is ever sorted in one task. Ranks are mapped to 52-bit positions and cut in two steps of ``BINS`` bins:
sums of words per bin show the bin, then the sub-bin, in which a source's rest ends; only the documents of that
sub-bin (about one in BINS * BINS of the source) are ordered. Windows see the bins or the weight classes of one source, whose number is
bounded. Sources are ranked by range partitions, and targets come from sums over sources, repeated until no further one is full.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; a source of size 0 has target 0; rows of one id and size go together; a row without an id is known by its text; an
empty table gives an empty table; columns named like an output are replaced, all others come back as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.windows import global_rank
from . import common

BINS = 4096
BUDGET = 1.5
MOST_COPIES = 2.0
MOST_CLASSES = 1000
SPAN = 1 << 52
OUTPUTS = ("__size", "__source_size", "__target", "__copies")


def by_length(size: Column) -> Column:
    """The default weight class: binary digits of the size."""
    return F.length(F.bin(size))


def source_targets(sizes: DataFrame, weights: list[float], budget: float, most: float) -> DataFrame:
    """(source, source_size, target): ``budget`` times all words by weight, ``most`` times its size at most.

    The excess of full sources is shared anew by weight until none is above: the level (words per unit of weight) only rises, and with
    it the number of full sources.
    """
    ranked, _ = global_rank(sizes, [F.col("source").asc_nulls_last()], "place")
    turn = (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    named = common.written(ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight")), "source-weights")
    level, full = 0.0, -1
    while True:
        over = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        row = named.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == full or not row["open"]:
            break
        full = row["n"]
        level = (budget * row["all"] - most * row["held"]) / row["open"]
    over = F.col("source_size") * most <= F.lit(level) * F.col("weight")
    target = F.when(over, F.col("source_size") * F.lit(most)).otherwise(F.lit(level) * F.col("weight"))
    return named.select("source", "source_size", target.cast("double").alias("target"))


def _rows(docs: DataFrame, keep: list[str], doc: str, text: str, source: str, weight: Callable[[Column], Column], seed: int) -> DataFrame:
    """(row: the kept columns, source, id, size, weight, bits), so that no column of the caller's meets one of ours."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(common.WORD)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    name = F.coalesce(F.col(doc).cast("string"), F.concat(F.lit("text:"), F.col(text)), F.lit(""))
    measured = docs.select(row.alias("row"), F.col(source).alias("source"), name.alias("id"), size.alias("size"))
    classed = measured.withColumn("weight", F.greatest(F.lit(1), F.least(F.lit(MOST_CLASSES), weight(F.col("size")))).cast("int"))
    return classed.withColumn("bits", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), 1, 13), 16, 10).cast("long"))


def _classes(rows: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(c_source, c_weight, source_size, target, whole, pi, rest): copies and inclusion probability of each weight class."""
    sums = rows.groupBy("source", "weight").agg(F.sum("size").alias("n"))
    t = targets.withColumnRenamed("source", "t_source")
    c = sums.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    down = W.partitionBy("source").orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("n").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("weight") * F.col("n")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    c = c.withColumn("level", F.when(after > 0, (F.col("target") - F.lit(most) * before) / after))
    fits = F.col("level") * F.col("weight") <= most
    # heavier classes are taken as often as may be; the first class that isn't sets the level for all lighter ones
    first = F.max(F.when(fits, F.struct("weight", "level"))).over(W.partitionBy("source"))
    c = c.withColumn("first", first)
    times = F.when(F.col("source_size") == 0, 0.0).when(F.col("weight") <= F.col("first.weight"), F.col("first.level") * F.col("weight")).otherwise(F.lit(most))
    c = c.withColumn("times", F.least(times, F.lit(most))).withColumn("whole", F.floor("times"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("n")).over(W.partitionBy("source"))
    out = c.select(F.col("source").alias("c_source"), F.col("weight").alias("c_weight"), "source_size", "target", "whole", (F.col("times") - F.col("whole")).alias("pi"), rest.alias("rest"))
    return common.written(out, "weight-classes")


def _ranked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with their class's numbers and their place: the rank q of a document as q / (1 + q), in the order of q."""
    # a row per source and class: Spark broadcasts it while it is small, and splits skewed sources beyond that
    held = rows.join(classes, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("weight") == F.col("c_weight")))
    u = (F.col("bits") + F.lit(0.5)) / float(SPAN)
    q = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    place = F.when(F.col("pi") > 0, F.floor(q / (1 + q) * float(SPAN)).cast("long")).otherwise(F.lit(SPAN))
    width = SPAN // BINS
    out = held.withColumn("place", place).withColumn("bin", F.least(F.floor(F.col("place") / width), F.lit(BINS - 1)))
    return out.withColumn("sub", F.floor((F.col("place") - F.col("bin") * width) / (width // BINS)))


def _cuts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(k_source, r_bin, r_sub, edge): per source the bin, the sub-bin and the last document of the sample."""
    ranked = _ranked(rows, classes).filter("pi > 0").select("source", "bin", "sub", "place", "id", "size", "rest")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rest = classes.groupBy(F.col("c_source").alias("t_source")).agg(F.max("rest").alias("rest"))
    reach = _crossing(ranked.groupBy("source", "bin").agg(F.sum("size").alias("n")), rest, "bin", None)
    inner = ranked.join(reach, same("source", "r_source") & (F.col("bin") == F.col("r_bin")), "left_semi")
    low = _crossing(inner.groupBy("source", "sub").agg(F.sum("size").alias("n")), rest, "sub", reach)
    last = inner.join(low, same("source", "r_source") & (F.col("sub") == F.col("r_sub")))
    last = last.groupBy("r_source", "place", "id", "size", "before", "rest").agg(F.sum("size").alias("words"))
    order = W.partitionBy("r_source").orderBy("place", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("before") + F.sum("words").over(order)
    taken = last.withColumn("upto", upto).withColumn("left", F.col("rest") - (F.col("upto") - F.col("words")))
    inside = (F.col("upto") <= F.col("rest")) | ((F.col("left") > 0) & (F.col("left") >= F.col("words") / 2))
    edge = taken.filter(inside).groupBy(F.col("r_source").alias("e_source")).agg(F.max(F.struct("place", "id", "size")).alias("edge"))
    cut = reach.join(low.select(F.col("r_source").alias("s_source"), "r_sub"), same("r_source", "s_source"), "left").join(edge, same("r_source", "e_source"), "left")
    return common.written(cut.select(F.col("r_source").alias("k_source"), "r_bin", "r_sub", "edge"), "source-cuts")


def _crossing(sums: DataFrame, rest: DataFrame, level: str, outer: DataFrame | None) -> DataFrame:
    """Per source, the last bin before which the words don't exceed the rest, and the words before it."""
    base = F.lit(0)
    if outer is not None:
        o = outer.select(F.col("r_source").alias("o_source"), F.col("before").alias("base"))
        rest = rest.join(o, F.col("t_source").eqNullSafe(F.col("o_source")), "left").drop("o_source")
        base = F.coalesce(F.col("base"), F.lit(0))
    order = W.partitionBy("source").orderBy(level).rowsBetween(W.unboundedPreceding, -1)
    run = sums.withColumn("prior", F.coalesce(F.sum("n").over(order), F.lit(0)))
    run = run.join(rest, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("before", F.col("prior") + base)
    at = run.filter(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max(F.struct(level, "before")).alias("m"))
    return common.written(at.select(F.col("source").alias("r_source"), F.col(f"m.{level}").alias(f"r_{level}"), F.col("m.before").alias("before")), f"cut-{level}")


def _taken(rows: DataFrame, classes: DataFrame, cuts: DataFrame, keep: list[str]) -> DataFrame:
    out = _ranked(rows, classes).join(cuts, F.col("source").eqNullSafe(F.col("k_source")), "left")
    inside = (F.col("bin") < F.col("r_bin")) | (
        (F.col("bin") == F.col("r_bin")) & ((F.col("sub") < F.col("r_sub")) | ((F.col("sub") == F.col("r_sub")) & (F.struct("place", "id", "size") <= F.col("edge"))))
    )
    extra = ((F.col("pi") > 0) & F.coalesce(inside, F.lit(False))).cast("int")
    made = [F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), (F.col("whole") + extra).cast("int").alias("__copies")]
    return out.select(*[F.col(f"row.`{c}`") for c in keep], *made)


def mix_plan(
    docs: DataFrame, weights: list[float], keep: list[str], doc: str = "doc_id", text: str = "text", source: str = "source",
    budget: float = BUDGET, most: float = MOST_COPIES, weight: Callable[[Column], Column] = by_length, seed: int = 17,
) -> DataFrame:
    """The ``keep`` columns with __size, __source_size, __target and __copies (how often the mix takes the document). Texts are read once."""
    if most > 2:
        raise ValueError("a document is taken twice at most")
    keep = [c for c in keep if c not in OUTPUTS]
    rows = common.written(_rows(docs, keep, doc, text, source, weight, seed), "mix-rows")
    classes, cuts = _plan(rows, weights, budget, most)
    return _taken(rows, classes, cuts, keep)


def mix_to_targets(
    docs: DataFrame, weights: list[float], doc: str = "doc_id", text: str = "text", source: str = "source",
    budget: float = BUDGET, most: float = MOST_COPIES, weight: Callable[[Column], Column] = by_length, seed: int = 17,
) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies. Texts are read twice, and never shuffled."""
    if most > 2:
        raise ValueError("a document is taken twice at most")
    rows = common.written(_rows(docs, [], doc, text, source, weight, seed).drop("row"), "mix-rows")
    classes, cuts = _plan(rows, weights, budget, most)
    keep = [c for c in docs.columns if c not in OUTPUTS]
    return _taken(_rows(docs, keep, doc, text, source, weight, seed), classes, cuts, keep)


def _plan(rows: DataFrame, weights: list[float], budget: float, most: float) -> tuple[DataFrame, DataFrame]:
    sizes = common.written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    classes = _classes(rows, source_targets(sizes, weights, budget, most), most)
    return classes, _cuts(rows, classes)
