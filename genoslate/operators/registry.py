"""Named predicates: a column, SQL text, or a function of a pandas frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import row_rule


@dataclass(frozen=True)
class Predicate:
    """One of ``column``, ``sql`` (gives ids in a column of the key's name, from tables in braces) or ``function`` (pandas frame to booleans)."""

    name: str
    category: str = "general"
    description: str = ""
    entity: str = "protein"
    column: Column | None = field(default=None, compare=False)
    sql: str | None = None
    function: Callable | None = field(default=None, compare=False)
    window_bp: int | None = None


class Registry:
    """Definitions on the driver; their evaluation is a DataFrame."""

    def __init__(self) -> None:
        self._all: dict[str, Predicate] = {}

    def register(self, predicate: Predicate) -> None:
        self._all[predicate.name] = predicate

    def get(self, name: str) -> Predicate | None:
        return self._all.get(name)

    def list(self, category: str | None = None) -> list[Predicate]:
        return [p for p in self._all.values() if category in (None, p.category)]

    def categories(self) -> list[str]:
        return sorted({p.category for p in self._all.values()})

    def reset(self) -> None:
        self._all.clear()

    def ids(self, name: str, entities: DataFrame, key: str = "protein_id", only: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """The ids for which a predicate holds (B12: within ``only``). ``tables``: what SQL rules call ``{name}``."""
        p = self._all[name]
        if p.column is not None:
            out = entities.filter(p.column).select(key)
        elif p.sql is not None:
            out = sql(entities.sparkSession, p.sql, tables).select(key)
        elif p.function is not None:

            def run(frames):
                for pdf in frames:
                    yield pdf.loc[row_rule(p.function, pdf), [key]]

            out = entities.mapInPandas(run, f"{key} {dict(entities.dtypes)[key]}")
        else:
            raise ValueError(f"{name} has no rule")
        out = out.distinct()
        return out if only is None else out.join(only.select(key), key, "left_semi")


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """SQL with named parameters over tables, which the text calls ``{name}`` (J5). Nothing is registered in the session, so two callers never meet;
    a name that ``tables`` lacks is a table of the session."""
    asked = {n for _, n, _, _ in Formatter().parse(text) if n}
    return spark.sql(text, args=args or None, **{n: (tables or {}).get(n) or spark.table(n) for n in asked})


def defaults(registry: Registry) -> None:
    """Predicates on size and annotation that need no rule table."""
    from .filters import giant, tiny

    registry.register(Predicate("giant", "size", "longer than 2000 residues", column=giant(2000)))
    registry.register(Predicate("massive", "size", "longer than 5000 residues", column=giant(5000)))
    registry.register(Predicate("tiny", "size", "shorter than 50 residues", column=tiny(50)))
    registry.register(Predicate("unannotated", "annotation", "without any annotation", sql="SELECT protein_id FROM {proteins} LEFT ANTI JOIN {annotations} USING (protein_id)"))
    registry.register(Predicate("confident_hit", "annotation", "a hit below 1e-10", sql="SELECT protein_id FROM {annotations} WHERE evalue < 1e-10"))
    unknown = " OR ".join(f"lower({c}) LIKE '%{w}%'" for w in ("hypothetical", "uncharacterized", "unknown function") for c in ("name", "description"))
    registry.register(Predicate("hypothetical", "annotation", "a name or description of unknown function", sql="SELECT DISTINCT protein_id FROM {annotations} WHERE " + unknown))
    registry.register(Predicate("gc_outlier", "composition", "further than two standard deviations from the genome's mean", sql="""
        SELECT p.protein_id FROM {proteins} p JOIN (
            SELECT bin_id, avg(gc_content) AS m, stddev_samp(gc_content) AS s FROM {proteins} WHERE gc_content IS NOT NULL AND bin_id IS NOT NULL GROUP BY bin_id
        ) g ON p.bin_id = g.bin_id WHERE g.s > 0 AND abs(p.gc_content - g.m) > 2 * g.s"""))
    registry.register(Predicate("multi_domain", "annotation", "three distinct domains", sql="SELECT protein_id FROM {annotations} WHERE source = 'pfam' GROUP BY protein_id HAVING count(DISTINCT accession) >= 3"))


def feature_pivot(features: DataFrame, metrics: list[str], key: str = "protein_id") -> DataFrame:
    """The tall feature store as one row per entity."""
    return features.groupBy(key).pivot("metric_name", metrics).agg(F.max("metric_value"))
