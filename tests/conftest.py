import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def genomes(spark):
    """A small seeded dataset: three genomes, four contigs, ten proteins, nine annotations."""
    from genoslate.sources import schemas

    bins = [("b1", 95.5, 2.1, "d__Archaea;p__Asgard;c__;o__", 2, 9000), ("b2", 88.2, 4.5, "d__Bacteria;p__Proteo;c__G;o__", 1, 20000), ("b3", 72.0, 8.2, "d__Bacteria;p__;c__", 1, 3000)]
    contigs = [("c1", "b1", 9000, 0.4, False, None), ("c2", "b2", 20000, 0.5, False, None), ("c3", "b3", 3000, 0.6, False, None), ("c4", "b1", 1000, 0.4, True, None)]
    sizes = [("p01", "c1", "b1", 500), ("p02", "c1", "b1", 400), ("p03", "c1", "b1", 200), ("p04", "c1", "b1", 2333), ("p05", "c1", "b1", 40), ("p06", "c2", "b2", 600), ("p07", "c2", "b2", 5333), ("p08", "c2", "b2", 500), ("p09", "c3", "b3", 400), ("p10", "c3", "b3", None)]
    proteins, at = [], {}
    for i, (p, c, b, n) in enumerate(sizes):
        start = at.get(c, 0) + 10
        length = n or 500
        at[c] = start + 3 * length
        proteins.append((p, c, b, start, at[c], "-" if p == "p02" else "+", i, "M" * length if n else None, n, 0.5))
    notes = [
        (1, "p01", "pfam", "PF00142", "NifH", "nitrogenase iron protein", 1e-50, 300.0), (2, "p02", "pfam", "PF00005", "ABC", "transporter", 1e-30, 100.0), (3, "p03", "pfam", "PF09999", "DUF1", "hypothetical protein", 1e-5, 20.0),
        (4, "p06", "kegg", "K00001", "adh", "dehydrogenase [EC:1.1.1.1]", 1e-40, 200.0), (5, "p08", "pfam", "PF00374", "NiFe", "hydrogenase", 1e-20, 90.0), (6, "p08", "kegg", "K00002", None, "x", 1e-55, 90.0),
        (7, "p09", "pfam", "PF00001", "a", "d", 1e-12, 50.0), (8, "p09", "pfam", "PF00002", "b", "d", 1e-12, 50.0), (9, "p09", "pfam", "PF00001", "a", "d", None, 50.0),
    ]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    return {
        "bins": make(bins, schemas.BINS), "contigs": make(contigs, schemas.CONTIGS), "proteins": make(proteins, schemas.PROTEINS),
        "annotations": make([(*n, None, None) for n in notes], schemas.ANNOTATIONS),
        "loci": make([("l1", "crispr_array", "c1", 100, 900, 1.0, "{}"), ("l2", "crispr_array", "c2", 15000, 15500, 1.0, "{}")], schemas.LOCI),
    }
