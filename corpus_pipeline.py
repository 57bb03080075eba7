"""The corpus pipeline: documents to packed training sequences, in five stages.

1. ``quality``: documents that the compression classifier rejects go.
2. ``line_dedup``: boilerplate lines of a source are taken out of the texts.
3. ``near_dedup``: one document of each group of near-duplicates stays, that with
   the smallest id. Of rows with one id and text one stays; different texts under
   one id are documents of their own.
4. ``decontaminate``: documents that hold a benchmark item go.
5. ``pack``: the rest is cut and packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents, with n_chars brought up to date.
Nulls, empty texts, repeated rows and empty tables are treated as the operators'
docstrings say; rows with a null id are never near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyloom.llm import decontam, lines, neardup, packing, quality
from canopyloom.llm.tables import table, tokenizer_path
from canopyloom.storage import cut, small_side


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = cut(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        return _near_dedup_rows(docs, repeated)
    gone = cut(neardup.near_duplicates(docs, shingle=5, percent=80).filter("not kept").select("doc_id"), "gone")
    return docs.join(small_side(gone, 16), "doc_id", "left_anti").select(docs.columns)


def _near_dedup_rows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Near-dedup where the ids in ``repeated`` stand in several rows: each row is a node, with a number instead of its id."""
    ids = small_side(repeated, 16)
    once = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    rows = docs.join(ids, "doc_id", "left_anti").select(docs.columns).union(once)
    rows = cut(rows.withColumn("_cl_row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = cut(neardup.near_duplicates(rows, shingle=5, percent=80, id_col="_cl_row").filter("doc_id is not null").select(F.col("doc_id").alias("_cl_row"), "component_id", "kept"), "found")
    groups = found.filter("not kept").select("component_id").distinct()
    order = F.struct("doc_id", F.xxhash64("text").alias("h"), "_cl_row")
    members = cut(found.join(groups, "component_id", "left_semi").join(rows.select("_cl_row", order.alias("order")), "_cl_row").select("_cl_row", "component_id", "order"), "members")
    first = members.groupBy("component_id").agg(F.min("order")["_cl_row"].alias("_cl_row"))
    gone = cut(members.join(first, "_cl_row", "left_anti").select("_cl_row"), "gone")
    return rows.join(small_side(gone, 16), "_cl_row", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Compression, tokenizers and SimHash can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
