"""Sources and sinks: CSV, Parquet, JSON lines, TSV graphs, resumable work and the expansion cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyloom import schema


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The classified corpus: a CSV with a header and texts that may hold line feeds; nulls become empty."""
    return spark.read.csv(path, schema=schema.CORPUS, header=True, multiLine=True, escape='"').na.fill("")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json_lines(spark: SparkSession, path: str, kind: str, strict: bool = False) -> DataFrame:
    """JSON lines; a malformed line is dropped, or fails the read if strict."""
    return spark.read.schema(kind).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_parquet(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Columns in a fixed order. Write to a new path, never to one that the plan reads."""
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """A log of finished work that later runs resume from."""
    df.write.mode("append").json(path)


def write_tsv(df: DataFrame, path: str, header: bool) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").csv(path)


def pending(candidates: DataFrame, done: DataFrame, keys: Sequence[str], success: Column | None = None) -> DataFrame:
    """Candidates without a finished key; only successes count as finished."""
    done = done.filter(success) if success is not None else done
    return candidates.join(done.select(*keys).distinct(), list(keys), "left_anti")


def complete(reports: DataFrame, communities: DataFrame, errors: Sequence[str]) -> DataFrame:
    """One row: n_reports, n_communities, n_errors, complete."""
    a = reports.agg(F.count("*").alias("n_reports"), F.count_if(F.col("summary").isin(list(errors))).alias("n_errors"))
    b = communities.agg(F.count("*").alias("n_communities"))
    return a.crossJoin(b).withColumn("complete", (F.col("n_reports") == F.col("n_communities")) & (F.col("n_errors") == 0))


def cache_key(query: Column, enhanced: bool) -> Column:
    """The key of an expanded query: depends on the query and on whether expansion is on."""
    return F.sha2(F.concat_ws(":", query, F.lit(str(enhanced))), 256)


def with_cache(queries: DataFrame, cache: DataFrame, enhanced: bool) -> DataFrame:
    """Queries with what the cache holds for them, or null."""
    return queries.withColumn("cache_key", cache_key(F.col("query"), enhanced)).join(cache, "cache_key", "left")
