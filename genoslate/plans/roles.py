"""The standard tables in the roles of the genome model: who is a contig, a gene, an annotation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts"):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def seconds(column: str = "ts"):
    return F.floor(micros(column) / 1_000_000).cast("long")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as genes: the user is the contig, an event spans ``value`` minutes from its second on."""
    start = seconds()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("protein_id"), F.col("user_id").alias("contig_id"), start.alias("start"), (start + F.floor(F.col("value") * 60)).cast("long").alias("end_coord"),
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("event_type").alias("label"), "value", micros().alias("t_us"),
    )


GENES_SQL = """g AS (SELECT event_id AS protein_id, user_id AS contig_id, (epoch_us(ts) // 1000000)::BIGINT AS start,
 (epoch_us(ts) // 1000000)::BIGINT + floor(value * 60)::BIGINT AS end_coord, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
 event_type AS label, value, epoch_us(ts) AS t_us FROM events)"""


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as proteins; the brand is the genome."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("protein_id"), F.col("p_brand").alias("bin_id"), F.col("p_type").alias("contig_id"), F.col("p_size").alias("sequence_length"), F.col("p_retailprice").alias("gc_content"), F.col("p_name").alias("name"), F.lit(0).alias("start"), (F.col("p_size") * 3).alias("end_coord"))


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(protein_id, tags) of parts: type, both words of the name, a size class."""
    p = table(spark, sf_dir, "part")
    tags = X.tag_set(F.array(F.lower("p_type")), F.split("p_name", " "), F.array(X.bucket_of(F.col("p_size"), [15, 35], ["tiny", "medium_size", "giant"])))
    return p.select(F.col("p_partkey").alias("protein_id"), tags.alias("tags"))


TAGS_SQL = """t AS (SELECT p_partkey AS protein_id, list_sort(list_distinct(list_concat([lower(p_type)], string_split(p_name, ' '),
 [CASE WHEN p_size < 15 THEN 'tiny' WHEN p_size < 35 THEN 'medium_size' ELSE 'giant' END]))) AS tags FROM part)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as annotations of parts: the price is the e-value, missing for every seventh supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("protein_id"), F.col("l_returnflag").alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("accession"),
        F.when(F.col("l_suppkey") % 11 != 0, F.concat(F.lit("sup"), F.col("l_suppkey").cast("string"))).alias("name"), F.col("l_linestatus").alias("description"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice")).alias("evalue"), F.col("l_quantity").alias("score"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("annotation_id"),
    )


ANNOTATIONS_SQL = """a AS (SELECT l_partkey AS protein_id, l_returnflag AS source, 'S' || l_suppkey AS accession,
 CASE WHEN l_suppkey % 11 <> 0 THEN 'sup' || l_suppkey END AS name, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice END AS evalue,
 l_linestatus AS description, l_quantity AS score, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
b AS (SELECT protein_id, CASE WHEN name IS NULL THEN NULL ELSE name || ' (' || accession || ')' END AS label, accession FROM (
 SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY evalue NULLS LAST, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM a) WHERE rn = 1)"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as genomes with a lineage, every fifth without one."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("d__"), F.col("r_name"), F.lit(";p__"), F.col("n_name"), F.lit(";c__"))
    return n.select(F.col("n_nationkey").alias("bin_id"), F.when(F.col("n_nationkey") % 5 == 4, "d__only").when(F.col("n_nationkey") % 5 == 3, None).otherwise(name).alias("taxonomy"))
