"""Tag generation: rules over distinct annotation descriptors, properties, status, conflicts, hierarchy.

Rules are tables, so a rule set of any size is joined, never looped over:

* exact rules: (source, accession, tags)
* pattern rules: (source, pattern, tags), tried on ``name description``; with a column ``field`` on that column alone (accession,
  name or description), and with a column ``unless`` not where that pattern is found in the description
* categories: (source, code, tags), where the name is a category, that is one that begins with X, and holds the code
* vocabulary: (predicate_id, parent)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import hierarchy, matching
from .shared import written


def no_tags() -> Column:
    return F.array().cast("array<string>")


DESCRIBED = ["source", "accession", "name", "description"]


def descriptor_key(*columns: Column) -> Column:
    """A 128-bit key of a descriptor: nulls and texts never read alike."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]))


def descriptors(annotations: DataFrame) -> DataFrame:
    """The distinct (source, accession, name, description): rules run on these alone (K5)."""
    return annotations.select(*DESCRIBED).distinct()


def exact_tags(d: DataFrame, rules: DataFrame, name: str = "exact") -> DataFrame:
    r = rules.select("source", F.upper(F.trim("accession")).alias("__a"), F.col("tags").alias(name))
    return d.join(r, (d["source"] == r["source"]) & (F.upper(F.trim(d["accession"])) == r["__a"]), "left").drop(r["source"]).drop("__a")


def _gathered(d: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """``d`` with the sorted union of the tags (``__t``) that ``hits`` holds of each descriptor (``__d``)."""
    found = hits.groupBy("__d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__t")))).alias(name))
    return d.join(found, "__d", "left")


def _keyed(d: DataFrame) -> DataFrame:
    return d if "__d" in d.columns else d.withColumn("__d", descriptor_key(*[F.col(c).cast("string") for c in DESCRIBED]))


def tried_patterns(d: DataFrame, rules: DataFrame) -> DataFrame:
    """(__d, __n): pairs of descriptors and numbered rules (``__n``, source, pattern, field) that have to be tried; each pair has the literal of the
    pattern, or a pattern without one (see ``matching``)."""
    field = {"accession": F.col("accession"), "name": F.col("name"), "description": F.col("description"), None: F.concat_ws(" ", "name", "description")}
    parts = []
    # one posting list per field that rules look at: four at most
    for name in sorted((r["__field"] for r in rules.select("__field").distinct().collect()), key=str):
        own = rules.filter(F.col("__field").eqNullSafe(F.lit(name)))
        text = d.select("source", "__d", field.get(name, field[None]).alias("__x"))
        parts.append(matching.candidates(text, own.withColumnRenamed("__s", "source"), "source", "__x", "__d", "__p", "__n"))
    out = parts[0] if parts else d.select("__d", F.lit(0).cast("long").alias("__n")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern_tags(d: DataFrame, rules: DataFrame, name: str = "pattern") -> DataFrame:
    """All tags of all patterns of the source that hit (K5a, K5b; K5e with ``field``, K5d with ``unless``).

    A pattern is tried only on descriptors that hold a literal which it needs.
    """
    kept = [c for c in d.columns if c != "__d"]
    d = _keyed(d)
    optional = lambda c: (F.col(c) if c in rules.columns else F.lit(None)).cast("string").alias(f"__{c}")
    r = rules.select(F.col("source").alias("__s"), F.col("pattern").alias("__p"), F.col("tags").alias("__t"), optional("field"), optional("unless"))
    r = written(r.withColumn("__n", F.monotonically_increasing_id()), "pattern-rules")
    pairs = tried_patterns(d, r).join(r.drop("__s"), "__n").join(d.select("__d", "accession", "name", "description"), "__d")
    field = F.col("__field")
    text = F.when(field == "accession", F.col("accession")).when(field == "name", F.col("name")).when(field == "description", F.col("description")).otherwise(F.concat_ws(" ", "name", "description"))
    found = lambda x, p: F.regexp_like(F.coalesce(x, F.lit("")), F.concat(F.lit("(?i)"), p))
    hits = pairs.filter(found(text, F.col("__p")) & (F.col("__unless").isNull() | ~found(F.col("description"), F.col("__unless"))))
    return _gathered(d, hits.select("__d", "__t"), name).select(*kept, name)


def category_tags(d: DataFrame, categories: DataFrame, name: str = "category") -> DataFrame:
    """Tags of all codes that the category holds; a name that begins with X is one (K5d)."""
    r = categories.select(F.col("source").alias("__s"), F.col("code").alias("__c"), F.col("tags").alias("__t"))
    kept = [c for c in d.columns if c != "__d"]
    d = _keyed(d)
    hits = d.join(r, (F.col("source") == F.col("__s")) & F.col("name").startswith("X") & F.contains(F.col("name"), F.col("__c")))
    return _gathered(d, hits.select("__d", "__t"), name).select(*kept, name)


def ec_tags(d: DataFrame, ec_rules: DataFrame, name: str = "ec") -> DataFrame:
    """Tags of the longest known prefix of each EC number of the description."""
    e = d.select("source", "accession", "description", F.explode(X.ec_numbers(F.col("description"))).alias("number"))
    p = e.select("source", "accession", "description", "number", F.posexplode(X.ec_prefixes(F.col("number"))).alias("__at", "__prefix"))
    hit = p.join(ec_rules.select(F.col("prefix").alias("__prefix"), F.col("tags").alias("__t")), "__prefix")
    best = hit.groupBy("source", "accession", "description", "number").agg(F.min_by("__t", "__at").alias("__t"))
    out = best.groupBy("source", "accession", "description").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__t")))).alias(name))
    return d.join(out, ["source", "accession", "description"], "left")


#: Sources whose annotations get tags of their own, and the name in these.
SOURCE_NAMES = {"pfam": "pfam", "kegg": "kegg", "cazy": "cazy", "vog": "vog", "vogdb": "vog", "hyddb": "hyddb", "defensefinder": "defensefinder"}


def annotation_tags(
    annotations: DataFrame, exact: DataFrame, patterns: DataFrame, ec_rules: DataFrame | None = None, direct_only: list[str] = (), fallback_only: list[str] = (),
    categories: DataFrame | None = None, source_names: dict[str, str] | None = SOURCE_NAMES,
) -> DataFrame:
    """(annotation columns, tags) of every annotation (K5a-K5f).

    ``direct_only`` sources stop at a direct rule (viral groups, K5d); ``fallback_only`` ones use patterns only without one (carbohydrate
    families, K5c); the others take both. Sources are compared in lower case; ``source_names``: those that get ``name:accession`` and
    ``name_annotated`` (None: all, by their own name).
    """
    low = lambda t: t.withColumn("source", F.lower("source"))
    rows = low(annotations)
    # written: every kind of rule asks it, and it is much smaller than the annotations
    d = written(descriptors(rows), "descriptors")
    d = pattern_tags(exact_tags(d, low(exact)), low(patterns))
    nothing = F.lit(None).cast("array<string>")
    d = d.withColumn("ec", nothing) if ec_rules is None else ec_tags(d, ec_rules)
    d = d.withColumn("category", nothing) if categories is None else category_tags(d, low(categories))
    alone = F.col("source").isin([s.lower() for s in {*direct_only, *fallback_only}] or [""]) & F.col("exact").isNotNull()
    quality = X.tags_where(hypothetical=X.is_hypothetical(F.col("name"), F.col("description")))
    named = F.col("source") if source_names is None else F.create_map(*[F.lit(x) for kv in source_names.items() for x in kv])[F.col("source")]
    own = F.array_compact(F.array(F.concat(named, F.lit(":"), F.col("accession")), F.concat(named, F.lit("_annotated"))))
    ruled = F.when(alone, F.col("exact")).otherwise(X.tag_set(F.col("exact"), F.col("pattern"), F.col("ec"), F.col("category")))
    d = d.select(*DESCRIBED, X.tag_set(ruled, quality, own).alias("__rule"))
    r = _keyed(d).select("__d", "__rule")
    j = annotations.withColumn("__d", descriptor_key(F.lower("source"), *[F.col(c).cast("string") for c in DESCRIBED[1:]])).join(r, "__d", "left")
    trust = X.tags_where(confident_hit=F.col("evalue") < 1e-10, weak_hit=F.col("evalue") > 1e-5)
    return j.select(*annotations.columns, X.tag_set(F.col("__rule"), trust).alias("tags"))


def property_tags(proteins: DataFrame, giant: int = 1000, massive: int = 2000, deviations: float = 2.0, gc_high: float = 0.6, gc_low: float = 0.4) -> DataFrame:
    """(protein_id, tags) from size and GC content against the contig (K5g)."""
    stats = proteins.groupBy("contig_id").agg(F.avg("gc_content").alias("__m"), F.coalesce(F.stddev_samp("gc_content"), F.lit(0.0)).alias("__s"))
    p = proteins.join(stats, "contig_id", "left").withColumn("__n", X.length_of())
    n, gc = F.col("__n"), F.col("gc_content")
    varied = F.col("__s") > 0
    size = X.bucket_of(n, [50, 150, 400, 1000, 2000], ["tiny", "small", "medium", "large", "giant", "massive"])
    tags = X.tag_set(
        F.array_compact(F.array(size)),
        X.tags_where(giant=n >= giant, massive=n >= massive, gc_outlier=varied & (F.abs(gc - F.col("__m")) > deviations * F.col("__s")), gc_high=varied & (gc > gc_high), gc_low=varied & (gc < gc_low)),
    )
    return p.select("protein_id", tags.alias("tags"))


def status_tags(proteins: DataFrame, annotations: DataFrame, domain_source: str = "pfam", well: int = 3) -> DataFrame:
    """(protein_id, tags) from how a protein is annotated (K5h); those without annotations are ``unannotated``. Sources are compared in lower case."""
    source = F.lower("source")
    domain = F.when(source == domain_source.lower(), F.col("accession"))
    a = annotations.groupBy("protein_id").agg(F.count("*").alias("n"), F.count_if(F.col("evalue") < 1e-10).alias("sure"), F.countDistinct(source).alias("sources"), F.countDistinct(domain).alias("domains"))
    j = proteins.select("protein_id").join(a, "protein_id", "left")
    tags = X.tags_where(
        unannotated=F.col("n").isNull(), well_annotated=F.col("sure") >= well, single_source=F.col("sources") == 1, multi_source=F.col("sources") >= 2, multi_domain=F.col("domains") >= 3, single_domain=F.col("domains") == 1
    )
    return j.select("protein_id", F.array_sort(tags).alias("tags"))


def topology_tags(df: DataFrame, topology: str = "topology") -> DataFrame:
    """``df`` with tags from a per-residue ``i``/``o``/``M`` string, and the helix runs, 1-based (K6)."""
    t = F.coalesce(F.col(topology), F.lit(""))
    runs = F.regexp_extract_all(t, F.lit("(M+)"), F.lit(1))
    n = F.size(runs)
    tags = X.tags_where(
        soluble_predicted=n == 0, transmembrane_predicted=n >= 1, single_pass_membrane=n == 1, multi_pass_membrane=n >= 2, polytopic_membrane=n >= 4, n_in_topology=(n > 0) & t.startswith("i"), n_out_topology=(n > 0) & t.startswith("o")
    )
    parts = F.split(t, "(?<=M)(?!M)|(?<!M)(?=M)")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)))
    spans = F.zip_with(parts, ends, lambda p, e: F.when(p.startswith("M"), F.struct((e - F.length(p) + 1).alias("start"), e.alias("end"))))
    return df.withColumn("tags", F.array_sort(tags)).withColumn("helices", F.filter(spans, lambda s: s.isNotNull()))


def hierarchy_closure(vocabulary: DataFrame) -> DataFrame:
    """(child, ancestor) of a vocabulary, without the entry itself (K29), in rounds that double the paths (see ``hierarchy``).

    A repeated id keeps its largest parent name. Any depth is followed; a CycleError names entries that are their own ancestors.
    """
    parents = vocabulary.filter(F.col("parent").isNotNull()).groupBy("predicate_id").agg(F.max("parent").alias("parent"))
    return hierarchy.ancestors(parents, "predicate_id", "parent").select("child", "ancestor")


def expand_hierarchy(tags: DataFrame, closure: DataFrame, key: str = "protein_id") -> DataFrame:
    """Tags with all their ancestors, but for ``x:y`` tags (K5i)."""
    one = tags.select(key, F.explode_outer("tags").alias("tag"))
    up = one.filter(~F.col("tag").contains(":")).join(closure.select(F.col("child").alias("tag"), "ancestor"), "tag").select(key, F.col("ancestor").alias("tag"))
    return one.unionByName(up).groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def drop_conflicts(tags: DataFrame, annotations: DataFrame, call: str, needs: list[str], excludes: list[str], remove: list[str]) -> DataFrame:
    """A call without any of the domains it needs, but with excluding ones, loses its tags (K5i)."""
    held = annotations.groupBy("protein_id").agg(F.collect_set("accession").alias("__acc"))
    any_of = lambda xs: F.arrays_overlap(F.coalesce("__acc", no_tags()), F.array(*map(F.lit, xs)))
    wrong = F.array_contains("tags", call) & ~any_of(needs) & any_of(excludes)
    j = tags.join(held, "protein_id", "left")
    return j.select("protein_id", F.when(wrong, F.array_except("tags", F.array(*map(F.lit, remove)))).otherwise(F.col("tags")).alias("tags"))


def generate_tags(
    proteins: DataFrame, annotations: DataFrame, exact: DataFrame, patterns: DataFrame, vocabulary: DataFrame,
    ec_rules: DataFrame | None = None, conflict: dict | None = None, topology: DataFrame | None = None, **options,
) -> DataFrame:
    """(protein_id, tags) of every protein (K5; K31 on a filtered input): annotation, property, status and topology tags,
    then conflicts, then ancestors, sorted. Conflicts come before ancestors, so a child that stays brings its parents back."""
    known = annotations.join(proteins.select("protein_id"), "protein_id", "left_semi").select("protein_id", "source", "accession", "name", "description", "evalue")
    per = annotation_tags(known, exact, patterns, ec_rules, **options).select("protein_id", "tags")
    parts = per.unionByName(property_tags(proteins)).unionByName(status_tags(proteins, annotations))
    if topology is not None:
        parts = parts.unionByName(topology_tags(topology).select("protein_id", "tags").join(proteins.select("protein_id"), "protein_id", "left_semi"))
    # annotations of one descriptor have equal arrays, which partial aggregates hold once before they are shuffled
    tags = parts.groupBy("protein_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    if conflict:
        tags = drop_conflicts(tags, annotations, **conflict)
    return expand_hierarchy(tags, hierarchy_closure(vocabulary))


def vocabulary_unique(vocabulary: DataFrame, position: str) -> DataFrame:
    """One entry per id, the last by position."""
    return vocabulary.groupBy("predicate_id").agg(F.max_by(F.struct(*[c for c in vocabulary.columns if c != "predicate_id"]), position).alias("__v")).select("predicate_id", "__v.*")


def system_tags(system_type: Column, subtype: Column, cls: Column, nuclease: Column) -> Column:
    """Tags of a defense system's class, type, subtype and nuclease (K9)."""
    low = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(cls == "1", "crispr_class_1").when(cls == "2", "crispr_class_2"), F.concat(F.lit("crispr_type_"), low(system_type)), F.concat(F.lit("crispr_subtype_"), low(subtype)), low(nuclease)
            )
        )
    )
