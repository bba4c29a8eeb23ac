"""Nearest neighbours over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, vectors
from ..sources import tables as S
from .roles import query, table

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("knn_one", f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def knn_one(spark, d):
    """The ten nearest to one row (a top-k)."""
    return vectors.nearest_to_id(table(spark, d, "embeddings"), 0, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_other_group", f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.label <> a.label AND {_COS} >= 0.2 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def knn_other_group(spark, d):
    return vectors.nearest_to_id(table(spark, d, "embeddings"), 3, 10, threshold=0.2, group="label").select("vec_id", F.round("score", 6).alias("score"))


@query(
    "knn_all",
    f"""SELECT "query", vec_id, rank FROM (SELECT a.vec_id AS "query", b.vec_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id))::INTEGER AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""",
)
def knn_all(spark, d):
    """Every row whose id is divisible by 20 as a query, against all rows."""
    e = table(spark, d, "embeddings")
    return vectors.nearest_per_query(e, e.filter("vec_id % 20 = 0"), 5).select("query", "vec_id", "rank")


@query(
    "knn_set",
    f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id < 12 AND a.vec_id <> b.vec_id)
SELECT vec_id, round(max(score), 6) AS score FROM s WHERE rn <= 20 AND vec_id >= 12 GROUP BY vec_id HAVING max(score) >= 0.3 ORDER BY max(score) DESC, vec_id LIMIT 10""",
)
def knn_set(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.nearest_to_set(e, e.filter("vec_id < 12").select("vec_id"), 10, 0.3).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_lsh")
def knn_lsh(spark, d):
    """Pairs by random projections (approximate: no SQL counterpart)."""
    return vectors.similar_pairs_lsh(table(spark, d, "embeddings"), 0.45)


@query("pca_2d")
def pca_2d(spark, d):
    """The first two principal components (fitted: no SQL counterpart)."""
    return vectors.project_2d(table(spark, d, "embeddings"))


@query(
    "neighbour_layout",
    f"""WITH n AS (SELECT a.vec_id AS q, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
e AS (SELECT q, v FROM n WHERE rank <= 5 UNION SELECT v, q FROM n WHERE rank <= 5)
SELECT count(DISTINCT q) AS n_rows, count(*) AS n_edges, 1.0 AS length_x, 1.0 AS length_y, 0.0 AS x_y, 0.0 AS x_degree, 0.0 AS y_degree, true AS settled FROM e""",
)
def neighbour_layout(spark, d):
    """The layout by the neighbour graph (K24), as sums that an eigenvector's have to be: lengths, right angles, and a residual under 0.1."""
    found, off = layout.spectral_layout(table(spark, d, "embeddings"), 5, 12)
    dot = lambda p, q, name: F.round(F.abs(F.sum(p * q)), 6).alias(name)
    x, y, root = F.col("x"), F.col("y"), F.sqrt("degree")
    return found.agg(
        F.count("*").alias("n_rows"), F.sum("degree").alias("n_edges"), dot(x, x, "length_x"), dot(y, y, "length_y"), dot(x, y, "x_y"),
        dot(x, root, "x_degree"), dot(y, root, "y_degree"), F.lit(max(off) < 0.1).alias("settled"),
    )


@query("point_labels", "SELECT vec_id, coalesce(r_name, 'unknown') AS label FROM embeddings LEFT JOIN region ON r_regionkey = label")
def point_labels(spark, d):
    by = table(spark, d, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name"))
    return vectors.point_labels(table(spark, d, "embeddings").select("vec_id", "label"), by, "label", "r_name").select("vec_id", F.col("r_name").alias("label"))


@query("embedding_cap", "SELECT vec_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 100")
def embedding_cap(spark, d):
    """A seeded cap on a load, the same rows for the same seed (the cap is the feature)."""
    return S.load_embeddings(spark, f"{d}/embeddings.parquet", 100, 7).select("vec_id")
