"""Exact vector search and chunk choice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyloom.functions import vectors as v


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def scored(rows: DataFrame, query: Sequence[float], vector_col: str = "vector", normalize: bool = True) -> DataFrame:
    """Rows that have a vector, with ``score``: its cosine (or plain product) with the query."""
    x = F.col(vector_col)
    rows = rows.filter(~v.is_placeholder(x))
    return rows.withColumn("score", v.cosine(x, vector(query)) if normalize else v.dot(x, vector(query)))


def top_k(rows: DataFrame, query: Sequence[float], k: int, key: str = "id", threshold: float = 0.0, where: Column | None = None, mode: str = "post", over: int = 5, vector_col: str = "vector") -> DataFrame:
    """The k best rows of at least ``threshold`` (0: no threshold).

    post: the condition is applied to the best ``over`` * k of all rows, so it may
    leave fewer than k although others match; pre: to all rows.
    """
    best = scored(rows, query, vector_col)
    order = [F.desc("score"), F.asc(key)]
    if where is not None and mode == "pre":
        best = best.filter(where)
    best = best.orderBy(*order).limit(over * k)
    if threshold > 0:
        best = best.filter(F.col("score") >= threshold)
    if where is not None and mode == "post":
        best = best.filter(where)
    return best.orderBy(*order).limit(k)


def chunk_scores(chunk_vectors: Column, query: Sequence[float]) -> Column:
    """array<double>: the product of each chunk's vector with the query, by one matrix product a row (Arrow batches)."""

    @F.pandas_udf("array<double>")
    def products(rows: pd.Series) -> pd.Series:
        q = np.array(query, np.float64)
        return pd.Series([None if r is None else [float((np.asarray(x, np.float64) * q).sum()) for x in r] for r in rows], dtype=object)

    return products(chunk_vectors)


def best_chunk(chunks: Column, chunk_vectors: Column, text: Column, query: Sequence[float], tie: float = 0.0) -> Column:
    """struct<pos, chunk, score>: the chunk with the largest product with the query; the first of equals.

    Without chunks, or with another number of vectors, the whole text with score 1; so
    with one chunk. With ``tie``, a lead of less than that gives the first chunk.
    """
    each = chunk_scores(chunk_vectors, query)
    pos = F.array_position(each, F.array_max(each)).cast("int") - 1
    if tie:
        lead = F.array_max(each) - F.try_element_at(F.sort_array(each, asc=False), F.lit(2))
        pos = F.when(lead < tie, 0).otherwise(pos)
    score = F.try_element_at(each, pos + 1)
    n = F.size(chunks)
    whole = F.struct(F.lit(0).alias("pos"), text.alias("chunk"), F.lit(1.0).alias("score"))
    return F.when((n <= 0) | chunks.isNull() | (n != F.size(chunk_vectors)), whole).when(n == 1, F.struct(F.lit(0).alias("pos"), chunks[0].alias("chunk"), F.lit(1.0).alias("score"))).otherwise(F.struct(pos.cast("int").alias("pos"), F.try_element_at(chunks, pos + 1).alias("chunk"), score.alias("score")))


def per_group(rows: DataFrame, group: str, k: int | Column, key: str = "id") -> DataFrame:
    """The k best scored rows of each group, with their rank ``rn``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.asc(key)))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= k)
