"""The test tables as a classified corpus.

Documents are text units below language / source / a third level by length; vectors
come from ``embeddings`` by id. ``labels`` isn't read here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyloom.functions import text as t
from canopyloom.operators import hierarchy
from canopyloom.storage import cut


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, l0, l1, l2, text (stripped), source."""
    l2 = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("b"), (F.col("n_chars") % 3).cast("string")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("l0"), F.col("source").alias("l1"), l2.alias("l2"), t.strip(F.col("text")).alias("text"), "source")


def units(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, id, text, path, community_id, l0, l1, l2, source."""
    return hierarchy.with_paths(documents(spark, d)).filter(F.col("text") != "")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Units with their vector, null where there is none."""
    return units(spark, d).join(embeddings(spark, d), "doc_id", "left")


def communities(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.communities(hierarchy.with_paths(documents(spark, d)))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """For each community the unit with a vector and the smallest id below it stands in for a report."""
    have = units(spark, d).join(embeddings(spark, d), "doc_id")
    first = hierarchy.members(have.select("doc_id", "l0", "l1", "l2")).groupBy("community_id").agg(F.min("doc_id").alias("doc_id"))
    rows = first.join(have.select("doc_id", "text", "vector"), "doc_id").join(communities(spark, d).select(F.col("id").alias("community_id"), "level", "parent_id", "path", "is_leaf"), "community_id")
    x = F.col("text")
    out = rows.select("community_id", F.left(x, F.lit(4)).alias("title"), "level", "parent_id", "path", "is_leaf", F.left(x, F.lit(200)).alias("summary"), x.alias("full_content"), F.col("vector").alias("embedding"))
    return cut(out, "reports")  # a row for each category, read many times


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(embeddings(spark, d).filter(F.col("doc_id") == vec_id).first()["vector"])
