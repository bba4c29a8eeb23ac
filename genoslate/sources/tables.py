"""Hit tables, reference maps, manifests, loci and findings from their files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schemas


def _tsv(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    return spark.read.options(sep="\t", header="true", mode="PERMISSIVE", **options).csv(path)


def _first(df: DataFrame, names: list[str], kind: str) -> Column:
    """The first non-null of the columns that ``df`` has, cast; null if it has none."""
    have = [F.col(f"`{n}`").try_cast(kind) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def source_of_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The source whose part of a path comes first in ``rules``; else the file stem's first ``_`` part."""
    low = F.lower(path)
    found = None
    for part, name in rules:
        found = F.when(low.contains(part), name) if found is None else found.when(low.contains(part), name)
    stem = F.substring_index(F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"\.[^.]*$", ""), "_", 1)
    return stem if found is None else found.otherwise(stem)


#: Path parts and the source they mean, first match wins.
SOURCE_RULES = [("pfam", "pfam"), ("kofam", "kegg"), ("kegg", "kegg"), ("hyddb", "hyddb"), ("defense", "defensefinder"), ("vog", "vogdb"), ("cant", "cant_hyd")]

#: Column names that mean the same, best first.
ALIASES = {
    "evalue": ["evalue", "i_evalue", "c_evalue", "e_value"],
    "score": ["bit_score", "dom_bitscore", "bitscore"],
    "start_aa": ["ali_from", "env_from"],
    "end_aa": ["ali_to", "env_to"],
}


def _by_header(spark: SparkSession, path: str | list[str], column: str) -> list[DataFrame]:
    """The TSV files of each distinct header that names ``column``, so that columns are found by name in every file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.filter(F.array_contains(F.split(F.regexp_replace("value", r"\r$", ""), "\t"), column)).groupBy("value").agg(F.collect_set("file").alias("files"))
    return [_tsv(spark, [unquote(f) for f in sorted(r["files"])]) for r in heads.orderBy("value").collect()]


HITS = "protein_id string, source string, accession string, name string, description string, evalue double, score double, start_aa int, end_aa int"


def read_hits(spark: SparkSession, path: str | list[str], rules: list[tuple[str, str]] | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """HMM hits as annotations without ids.

    Several files may have different headers: columns are taken by name, in each file's own order; a column that a file lacks is null.
    Files whose header lacks ``sequence_id`` have no rows. The driver holds the names of the files, as it does to plan a scan.
    """
    a = ALIASES | (aliases or {})
    out = spark.createDataFrame([], HITS)
    for raw in _by_header(spark, path, "sequence_id"):
        one = raw.withColumn("__path", F.col("_metadata.file_path")).select(
            F.col("sequence_id").alias("protein_id"),
            source_of_path(F.col("__path"), SOURCE_RULES if rules is None else rules).alias("source"),
            _first(raw, ["hmm_name"], "string").alias("accession"),
            _first(raw, ["name"], "string").alias("name"),
            _first(raw, ["description"], "string").alias("description"),
            *[_first(raw, a[c], k).alias(c) for c, k in (("evalue", "double"), ("score", "double"), ("start_aa", "int"), ("end_aa", "int"))],
        )
        out = out.unionByName(one)
    return out


def describe_hits(hits: DataFrame, reference: DataFrame) -> DataFrame:
    """Names and descriptions from ``reference`` (accession, ref_name, ref_description) where hits lack them."""
    j = hits.join(reference.dropDuplicates(["accession"]), "accession", "left")
    return j.withColumn("name", F.coalesce("name", "ref_name", "accession")).withColumn("description", F.coalesce("description", "ref_description")).drop("ref_name", "ref_description").select(*hits.columns)


def with_annotation_ids(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Ids above the largest existing one, unique and increasing within each partition of the rows, without a global sort."""
    base = 0 if existing is None else (existing.agg(F.max("annotation_id")).first()[0] or 0)
    return rows.select((F.monotonically_increasing_id() + 1 + base).alias("annotation_id"), "*")


def addon_hits(hits: DataFrame, proteins: DataFrame, source: str, split_system: bool = False) -> DataFrame:
    """Hits of known proteins only; ``system__component`` accessions give description and name."""
    known = hits.join(proteins.select("protein_id"), "protein_id", "left_semi").withColumn("source", F.lit(source))
    if not split_system:
        return known
    parts = F.split("accession", "__", 2)
    return known.withColumn("description", F.element_at(parts, 1)).withColumn("name", F.coalesce(F.try_element_at(parts, F.lit(2)), F.col("accession")))


def read_cazy_json(spark: SparkSession, path: str, proteins: DataFrame | None = None) -> DataFrame:
    """Carbohydrate annotations from JSON, of known proteins."""
    rows = spark.read.schema(schemas.CAZY_JSON).json(path, multiLine=True).select(F.explode("annotations").alias("a")).select("a.*")
    out = rows.select(
        "protein_id", F.lit("cazy").alias("source"), F.col("cazyme_family").alias("accession"), F.col("cazyme_family").alias("name"),
        F.col("substrate_prediction").alias("description"), "evalue", F.lit(None).cast("double").alias("score"),
        F.col("start_position").alias("start_aa"), F.col("end_position").alias("end_aa"),
    )
    return out if proteins is None else out.join(proteins.select("protein_id"), "protein_id", "left_semi")


#: Family prefix and what it stands for.
CAZY_CLASSES = {"GH": "Glycoside Hydrolase", "GT": "Glycosyltransferase", "PL": "Polysaccharide Lyase", "CE": "Carbohydrate Esterase", "AA": "Auxiliary Activity", "CBM": "Carbohydrate-Binding Module"}


def cazy_class(family: Column) -> Column:
    """The class of a family by its letters; null if unknown."""
    return F.create_map(*[F.lit(x) for kv in CAZY_CLASSES.items() for x in kv])[F.regexp_extract(F.upper(F.trim(family)), r"^([A-Z]+)", 1)]


def read_cazy_overview(spark: SparkSession, path: str, substrates: DataFrame | None = None) -> DataFrame:
    """Overview TSV: the first call that isn't empty, split at ``+``, ``FAM(a-b)`` into family and range."""
    raw = _tsv(spark, path)
    calls = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("-")) for c in ("DIAMOND", "dbCAN_hmm", "HMMER", "Recommend Results") if c in raw.columns]
    call = F.coalesce(*[F.nullif(c, F.lit("")) for c in calls])
    one = raw.select(F.col("`Gene ID`").alias("protein_id"), F.nullif(F.trim(F.col("`EC#`")), F.lit("-")).alias("ec_number"), F.explode(F.split(call, r"\+")).alias("call"))
    family = F.regexp_extract("call", r"^\s*([A-Za-z]+\d*(?:_[A-Za-z]?\d+)?)", 1)
    at = lambda i: F.nullif(F.regexp_extract("call", r"\((\d+)-(\d+)\)", i), F.lit("")).cast("int")
    out = one.select("protein_id", family.alias("family"), at(1).alias("start_aa"), at(2).alias("end_aa"), "ec_number", F.lit(1e-16).alias("evalue"), F.lit(0.8).alias("coverage"))
    out = out.filter("family <> ''").withColumn("family_class", cazy_class(F.col("family")))
    return out if substrates is None else out.join(substrates, "family", "left")


def read_clusters_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gene clusters as loci of type ``bgc`` and their members by position (A10)."""
    c = spark.read.schema(schemas.CLUSTERS_JSON).json(path, multiLine=True).select(F.explode("clusters").alias("c")).select("c.*")
    loci = c.select(
        F.col("cluster_id").alias("locus_id"), F.lit("bgc").alias("locus_type"), F.col("contig").alias("contig_id"), "start",
        F.col("end").alias("end_coord"), F.lit(1.0).alias("confidence"), F.to_json(F.struct("bgc_type", "product")).alias("metadata"),
    )
    return loci, c.select(F.col("cluster_id").alias("locus_id"), F.posexplode("protein_list").alias("position", "protein_id")).select("locus_id", "protein_id", "position")


PROBABILITIES = ("average_p", "max_p", "alkaloid_probability", "nrp_probability", "polyketide_probability", "ripp_probability", "saccharide_probability", "terpene_probability")


def read_clusters_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Cluster TSV: members split at ``;``, eight probabilities (0 where missing), id from file and rank."""
    raw = _tsv(spark, path)
    sample = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\..*$", "")
    raw = raw.withColumn("sample", sample)
    # the rank is among one file's clusters of one contig, by place
    rank = F.row_number().over(W.partitionBy("sample").orderBy("sequence_id", F.col("start").cast("int"), F.col("end").cast("int")))
    have = lambda c: _first(raw, [c], "double")
    return raw.select(
        F.concat_ws("_", "sample", F.lit("cluster"), rank.cast("string")).alias("cluster_id"), F.col("sequence_id").alias("contig_id"),
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end_coord"), (F.col("end").cast("int") - F.col("start").cast("int")).alias("length"),
        F.col("type").alias("bgc_type"), F.filter(F.split(F.coalesce("proteins", F.lit("")), ";"), lambda p: p != "").alias("proteins"),
        *[F.coalesce(have(c), F.lit(0.0)).alias(c) for c in PROBABILITIES],
    )


def read_repeat_gff(spark: SparkSession, path: str) -> DataFrame:
    """Repeat arrays of a GFF as loci (A12): ``repeat_region`` rows of family CRISPR."""
    g = spark.read.schema(schemas.GFF).csv(path, sep="\t", comment="#")
    attr = F.str_to_map(F.coalesce("attributes", F.lit("")), F.lit(";"), F.lit("="))
    g = g.withColumn("attr", attr).filter((F.col("type") == "repeat_region") & (F.col("attr")["rpt_family"] == "CRISPR"))
    return g.select(
        F.coalesce(F.col("attr")["ID"], F.concat_ws("_", "seqid", F.col("start").cast("string"), F.col("end_coord").cast("string"))).alias("locus_id"),
        F.lit("crispr_array").alias("locus_type"), F.col("seqid").alias("contig_id"), "start", "end_coord", F.lit(1.0).alias("confidence"), F.to_json("attr").alias("metadata"),
    )


def read_repeat_json(spark: SparkSession, path: str) -> DataFrame:
    """Repeat arrays of a JSON file as loci."""
    a = spark.read.schema(schemas.ARRAYS_JSON).json(path, multiLine=True).select(F.explode("arrays").alias("a")).select("a.*")
    return a.select(
        F.col("id").alias("locus_id"), F.lit("crispr_array").alias("locus_type"), F.col("contig").alias("contig_id"), F.col("startCoordinate").alias("start"),
        F.col("endCoordinate").alias("end_coord"), F.lit(1.0).alias("confidence"), F.to_json("metadata").alias("metadata"),
    )


def read_reference(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(accession, ref_name, ref_description): ``domain`` (no header), ``ortholog`` or ``viral`` lists."""
    if kind == "domain":
        return spark.read.csv(path, sep="\t", schema="accession string, ref_name string, ref_description string")
    if kind == "ortholog":
        t = _tsv(spark, path)
        return t.select(F.col("knum").alias("accession"), F.coalesce("simplified_definition", "definition").alias("ref_name"), F.col("definition").alias("ref_description"))
    if kind == "viral":
        t = _tsv(spark, path)
        return t.select(F.col(f"`{t.columns[0]}`").alias("accession"), F.col(f"`{t.columns[3]}`").alias("ref_name"), F.col(f"`{t.columns[4]}`").alias("ref_description"))
    raise ValueError(f"unknown kind of reference: {kind}")


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, tags): a TSV of comma lists with ``#`` comments."""
    t = spark.read.csv(path, sep="\t", comment="#", schema="key string, list string")
    tags = F.filter(F.transform(F.split("list", ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.filter(F.col("list").isNotNull()).select(F.trim("key").alias("key"), tags.alias("tags"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Bins of a genome manifest (A15): taxonomy by name, then lineage, then ``unknown``."""
    g = spark.read.schema(schemas.GENOME_MANIFEST).json(path, multiLine=True).select(F.explode("genomes").alias("g")).select("g.*")
    return g.select(
        F.col("genome_id").alias("bin_id"), F.col("taxonomy.completeness").alias("completeness"), F.col("taxonomy.contamination").alias("contamination"),
        F.coalesce("taxonomy.name", "taxonomy.taxonomy", F.lit("unknown")).alias("taxonomy"), F.coalesce("n_contigs", F.lit(0)).alias("n_contigs"), F.coalesce("total_length", F.lit(0)).alias("total_length"),
    )


def read_taxonomy_checks(spark: SparkSession, path: str) -> DataFrame:
    """One row per check file: label by species, genus, unknown; complete above 90."""
    t = spark.read.schema(schemas.TAXONOMY_JSON).json(path, multiLine=True)
    return t.select(F.col("_metadata.file_path").alias("file"), F.coalesce("taxonomy.species", "taxonomy.genus", F.lit("unknown")).alias("label"), "completeness", "contamination", F.coalesce(F.col("completeness") > 90, F.lit(False)).alias("is_complete"))


def read_metrics(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Metric/value TSV as one row per file: thousands commas dropped, percent GC as a share."""
    t = spark.read.csv(path, sep="\t", schema="metric string, value string").select(F.col("_metadata.file_path").alias("file"), "metric", F.regexp_replace("value", ",", "").try_cast("double").alias("v"))
    t = t.withColumn("v", F.when(F.col("metric").isin("GC (%)", "GC%"), F.col("v") / 100).otherwise(F.col("v")))
    return t.groupBy("file").pivot("metric", metrics).agg(F.first("v", ignorenulls=True))


def read_log_metrics(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One number per named pattern (group 1) from each log file."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    number = lambda p: F.max(F.nullif(F.regexp_replace(F.regexp_extract("value", p, 1), ",", ""), F.lit("")).try_cast("double"))
    return t.groupBy("file").agg(*[number(p).alias(n) for n, p in patterns.items()])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings JSON lines: description falls back to summary; ``{name}`` is filled from evidence."""
    f = spark.read.schema(schemas.FINDINGS).json(path).withColumn("description", F.coalesce("description", "summary"))
    return fill_template(f, "description", "evidence")


def fill_template(df: DataFrame, text: str, evidence: str) -> DataFrame:
    """``text`` with each ``{name}`` replaced by that key of the JSON object ``evidence``; unknown names stay."""
    values = F.coalesce(F.from_json(evidence, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    filled = F.aggregate(F.map_entries(values), F.col(text), lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return df.withColumn(text, F.when(F.col(text).isNull(), None).otherwise(filled))


def read_structural_hits(spark: SparkSession, path: str) -> DataFrame:
    """Structural hits: rows whose numbers can't be read go; an empty e-value counts as 1."""
    t = _tsv(spark, path)
    evalue = F.trim(F.coalesce(F.col("evalue"), F.lit("")))
    identity = F.col("seq_identity").try_cast("double")
    out = t.withColumn("e", F.when(evalue == "", 1.0).otherwise(evalue.try_cast("double"))).withColumn("i", identity)
    out = out.filter(F.col("e").isNotNull())
    share = F.when(F.col("i") > 1, F.col("i") / 100).otherwise(F.col("i"))
    return out.select("protein_id", "database", "target", F.col("e").alias("evalue"), share.alias("identity"), "description")


def first_defense_hit(hits: DataFrame) -> DataFrame:
    """(protein_id, label): the best hit's name with ``__`` as a blank."""
    best = F.min_by(F.replace("accession", F.lit("__"), F.lit(" ")), F.struct(F.col("evalue").isNull(), "evalue", "accession"))
    return hits.groupBy("protein_id").agg(best.alias("label"))


def load_embeddings(spark: SparkSession, path: str, limit: int | None = None, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """Embeddings, of which a cap keeps the same rows for the same seed (A22): the first by a hash of seed and key."""
    e = spark.read.parquet(path)
    return e if limit is None else e.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(limit)
