"""Queries over all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import neighbours as N
from tessera.sources import analogs as A


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def all_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return N.nearest_join(v, v, 10)


def cross_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest even-labelled vectors of each odd-labelled one."""
    v = vectors(spark, sf_dir)
    return N.nearest_join(v.where("label % 2 = 1"), v.where("label % 2 = 0"), 3)


def _brute(left: str, right: str, k: int) -> str:
    cosine = "list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))"
    return (
        f"WITH v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings), p AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, round({cosine}, 6) AS similarity "
        f"FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE {left} AND {right}) "
        f"SELECT key, rank, neighbour, similarity FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, neighbour) AS rank FROM p) WHERE rank <= {k}"
    )


QUERIES = {
    "v10_all_nearest": (all_nearest, _brute("true", "true", 10)),
    "j27_cross_match": (cross_match, _brute("a.label % 2 = 1", "b.label % 2 = 0", 3)),
}
