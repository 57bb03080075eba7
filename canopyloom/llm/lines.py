"""Line dedup by site-relative frequency.

A line's frequency on a host is the share of the host's pages that contain it.
Lines that at least ``least`` pages of a host hold and whose share exceeds ``ratio``
are boilerplate there and are dropped, on hosts of every size; the other lines stay in
their order. Lines are compared without ASCII white space at their ends; blank lines
are never dropped.

Two passes over the pages: one counts (host, line) with partial sums, keyed by 128
bits of hash so that lines aren't shuffled; the second filters each page's lines
against its host's boilerplate. A host has at most (distinct lines of an average
page / ratio) such lines, kept in ``SLOTS`` slots by their hash. While all of them fit
a broadcast the second pass shuffles nothing; beyond that the lines themselves are joined by (host, line) and
pages are put together again.

A null text stays null, an empty one empty; a page that loses all lines becomes
empty. A null host is a host of its own. Rows that repeat are pages of their own.
An empty table gives an empty table. Of clashing names, columns that start with
``_cl_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyloom.storage import BROADCAST_BYTES, cut


#: ASCII white space that a line may hold at its ends.
SPACE = " \t\x0b\x0c\r"
SLOTS = 64


def _key(line: Column) -> Column:
    """128 bits of a line's hash, as two numbers; null for a blank line."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float, least: int) -> DataFrame:
    """(_cl_host, _cl_key, _cl_pages, _cl_of) of the lines that exceed the ratio."""
    pages = docs.select(host.alias("_cl_host"), text.alias("_cl_text"))
    totals = pages.groupBy("_cl_host").agg(F.count("*").alias("_cl_of"))
    keys = F.array_distinct(F.transform(F.split("_cl_text", "\n"), _key))
    counts = pages.select("_cl_host", F.explode(keys).alias("_cl_key")).filter("_cl_key is not null").groupBy("_cl_host", "_cl_key").agg(F.count("*").alias("_cl_pages"))
    counts = counts.filter(F.col("_cl_pages") >= least)  # rarer lines needn't meet the totals
    return counts.join(totals.withColumnRenamed("_cl_host", "_cl_h"), F.col("_cl_host").eqNullSafe(F.col("_cl_h"))).filter(F.col("_cl_pages") > F.lit(ratio) * F.col("_cl_of")).drop("_cl_h")


def dedup_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = 0.01,
    least: int = 3,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; all columns stay."""
    host, text, names = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`"), docs.columns
    common = cut(boilerplate(docs, host, text, ratio, least), "boilerplate")
    lines = F.split(text, "\n")
    if common.count() * 64 <= broadcast_bytes:
        slot = lambda key: F.pmod(key["a"], F.lit(SLOTS)).cast("int")
        each = common.groupBy(F.col("_cl_host").alias("_cl_h"), slot(F.col("_cl_key")).alias("_cl_slot")).agg(F.collect_list("_cl_key").alias("_cl_keys"))
        held = F.map_from_entries(F.collect_list(F.struct("_cl_slot", "_cl_keys")))
        sets = each.groupBy("_cl_h").agg(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.try_element_at(held, i)).alias("_cl_common"))
        joined = docs.join(F.broadcast(sets), host.eqNullSafe(F.col("_cl_h")), "left")
        marked = F.transform(lines, lambda x: F.struct(x.alias("x"), _key(x).alias("k")))
        gone = lambda k: F.coalesce(F.array_contains(F.get(F.col("_cl_common"), slot(k)), k), F.lit(False))
        kept = F.transform(F.filter(marked, lambda m: ~gone(m["k"])), lambda m: m["x"])
        slim = F.when(F.col("_cl_common").isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
        return joined.select(*(slim.alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
    keyed = cut(docs.withColumn("_cl_id", F.struct(F.monotonically_increasing_id().alias("i"))), "lines")
    each = keyed.select("_cl_id", host.alias("_cl_host"), F.posexplode(lines).alias("_cl_at", "_cl_line")).withColumn("_cl_key", _key(F.col("_cl_line")))
    hit = each.join(common.select(F.col("_cl_host").alias("_cl_h"), F.col("_cl_key").alias("_cl_k")), (F.col("_cl_key") == F.col("_cl_k")) & F.col("_cl_host").eqNullSafe(F.col("_cl_h")))
    gone = hit.groupBy("_cl_id").agg(F.collect_set("_cl_at").alias("_cl_gone"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_cl_gone"), i))
    slim = F.when(F.col("_cl_gone").isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    return keyed.join(gone, "_cl_id", "left").select(*(slim.alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
