"""Report inputs: contexts, bin packing, routing, embedding backfill, providers of models."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyloom.functions import vectors as v
from canopyloom.params import ReportParams

EMPTY_CONTEXT = "无内容"


def bins(lengths: Column, p: ReportParams = ReportParams()) -> Column:
    """array<int>: the bin (from 0) of each length in order, by next fit.

    One bin up to ``single_bin`` in all; else as many as the target asks for, and a bin
    ends when the next length would exceed ``slack`` times the even share.
    """
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    limit = total / F.ceil(total / p.target) * p.slack
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("cur"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["cur"] > 0) & (acc["cur"] + x > limit)
        to = F.when(flush, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(to.alias("bin"), (F.when(flush, x).otherwise(acc["cur"] + x)).cast("long").alias("cur"), F.concat(acc["out"], F.array(to)).alias("out"))

    folded = F.aggregate(lengths, start, step, lambda acc: acc["out"])
    return F.when(total <= p.single_bin, F.transform(lengths, lambda x: F.lit(0))).otherwise(folded)


def packed(units: DataFrame, group: str, order: str, length: Column, p: ReportParams = ReportParams()) -> DataFrame:
    """(group, order, n, bin): units of each group with their bin.

    The same bins as ``bins`` gives, in one pass over a group's sorted rows, of which
    a task holds one batch and the open bin; only orders and lengths are moved, not texts.
    """
    rows = units.select(F.col(group).alias("g"), F.col(order).alias("k"), length.cast("int").alias("n"))
    totals = rows.groupBy(F.col("g").alias("tg")).agg(F.sum("n").alias("total"))
    limit = F.when(F.col("total") > p.single_bin, F.col("total") / F.ceil(F.col("total") / p.target) * p.slack)
    sized = rows.join(totals.select("tg", limit.alias("limit")), F.col("g").eqNullSafe(F.col("tg"))).select("g", "k", "n", "limit")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bin_, cur = None, 0, 0
        for b in batches:
            out = np.zeros(len(b), np.int32)
            names = b["g"].to_numpy(object)
            for i, (g, n, most) in enumerate(zip(names, b["n"].fillna(0).to_numpy(), b["limit"].to_numpy(float), strict=True)):
                if last is None or last[0] != g:
                    last, bin_, cur = (g,), 0, 0
                if cur > 0 and cur + n > most:  # false without a limit, which is NaN
                    bin_, cur = bin_ + 1, 0
                cur += int(n)
                out[i] = bin_
            yield b[["g", "k", "n"]].assign(bin=out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = sized.repartition("g").sortWithinPartitions("g", "k", "n")
    return dealt.mapInPandas(fold, f"g {kinds['g']}, k {kinds['k']}, n int, bin int").select(F.col("g").alias(group), F.col("k").alias(order), "n", "bin")


def dependencies(comm: DataFrame) -> DataFrame:
    """(id, n_children): how many reports each root waits for."""
    roots = comm.filter("level = 0").select("id")
    waits = comm.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return roots.join(waits, "id", "left").select("id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def leaf_context(units: DataFrame, comm: DataFrame) -> DataFrame:
    """(community_id, context, n_tokens): a leaf's own texts; above level 0."""
    own = units.join(comm.filter("is_leaf and level > 0").select(F.col("id").alias("community_id")), "community_id", "left_semi")
    return _joined(own.select("community_id", F.col("doc_id").alias("k"), "text"))


def branch_context(units: DataFrame, comm: DataFrame) -> DataFrame:
    """(community_id, context, n_tokens) of inner nodes above level 0: their children's texts under the child's title; not their own."""
    inner = comm.filter("not is_leaf and level > 0").select(F.col("id").alias("parent_id"))
    child = comm.select(F.col("id").alias("community_id"), "title", "parent_id").join(inner, "parent_id", "left_semi")
    rows = units.join(child, "community_id").select(F.col("parent_id").alias("community_id"), F.col("doc_id").alias("k"), F.concat(F.lit("【小类："), "title", F.lit("】"), "text").alias("text"))
    return _joined(rows)


def root_context(comm: DataFrame, reports: DataFrame) -> DataFrame:
    """(community_id, context, n_tokens) of roots: summaries of their children's reports; a root without any has none of its own texts."""
    roots = comm.filter("level = 0").select(F.col("id").alias("community_id"))
    child = comm.filter("level = 1").select(F.col("id").alias("child"), F.col("parent_id").alias("community_id"))
    said = child.join(reports.select(F.col("community_id").alias("child"), "title", "summary"), "child")
    rows = said.select("community_id", F.col("child").alias("k"), F.concat(F.lit("【"), "title", F.lit("】: "), "summary").alias("text"))
    return roots.join(_joined(rows), "community_id", "left").select("community_id", F.coalesce("context", F.lit(EMPTY_CONTEXT)).alias("context"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def _joined(rows: DataFrame) -> DataFrame:
    texts = F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])
    return rows.groupBy("community_id").agg(F.array_join(texts, "\n\n").alias("context"), F.sum(F.length("text")).alias("n_tokens"))


def route(n_tokens: Column, n_bins: Column, p: ReportParams = ReportParams()) -> Column:
    """Which prompt a context gets: sparse, standard, or map_reduce for several bins."""
    return F.when(n_bins > 1, "map_reduce").when(n_tokens < p.sparse, "sparse").otherwise("standard")


def backfill(units: DataFrame, stored: DataFrame, logged: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Units with a vector: the stored one if valid, else the last logged one, else a new one; placeholders become null.

    stored: (id, vector), ignored if it has another number of rows than the units;
    logged: (id, timestamp, vector). embed: from (id, text) to (id, vector).
    """
    ok = lambda x: F.when(~v.is_placeholder(x), x)
    if stored.count() != units.count():
        stored = stored.filter(F.lit(False))
    last = logged.groupBy("id").agg(F.max_by("vector", "timestamp").alias("_log"))
    rows = units.drop("vector").join(stored.select("id", F.col("vector").alias("_old")), "id", "left").join(last, "id", "left")
    rows = rows.withColumn("vector", F.coalesce(ok(F.col("_old")), ok(F.col("_log")))).drop("_old", "_log")
    new = embed(rows.filter("vector is null").select("id", "text")).select("id", F.col("vector").alias("_new"))
    return rows.join(new, "id", "left").withColumn("vector", F.coalesce("vector", ok(F.col("_new")))).drop("_new")


def vector_audit(rows: DataFrame) -> DataFrame:
    """One row: n_null, n_zero, n_valid."""
    x = F.col("vector")
    return rows.agg(F.count_if(x.isNull()).alias("n_null"), F.count_if(x.isNotNull() & v.is_placeholder(x)).alias("n_zero"), F.count_if(~v.is_placeholder(x)).alias("n_valid"))


def closed(text: str) -> str:
    """JSON text that was cut off, with its open string, lists and objects closed; what follows the first whole value goes."""
    inside, escaped, open_ = False, False, []
    for i, c in enumerate(text):
        if inside:
            inside = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            open_.append("]" if c == "[" else "}")
        elif c in "]}" and open_:
            open_.pop()
            if not open_:
                return text[: i + 1]
    return text + '"' * inside + "".join(reversed(open_))


def repair_json(text: str | None) -> dict:
    """An object out of a model's answer, else {}: fences and text around it are taken off, trailing commas and a cut-off end allowed; of a list its first element."""
    body = re.sub(r"```(?:json)?", "", text or "")
    begin = re.search(r"[\[{]", body)
    if not begin:
        return {}
    whole = closed(body[begin.start() :])
    for candidate in (whole, re.sub(r",\s*([}\]])", r"\1", whole)):
        try:
            out = json.loads(candidate, strict=False)
        except ValueError:
            continue
        if isinstance(out, list):
            out = out[0] if out else {}
        return out if isinstance(out, dict) else {}
    return {}


def stub_model(prompt: str) -> str:
    """A deterministic stand-in for a model, for tests and offline runs: a report whose summary is the prompt's md5."""
    return json.dumps({"title": "T", "summary": hashlib.md5(prompt.encode()).hexdigest(), "findings": []})


def stub_embedder(dim: int = 64, most_chars: int = 8000) -> Callable[[DataFrame], DataFrame]:
    """A deterministic provider for tests and offline runs: vectors drawn from the text's hash, zero for an empty text."""

    def vector(text: str | None) -> list[float]:
        import numpy as np

        if not text:
            return [0.0] * dim
        seed = int.from_bytes(hashlib.md5(text[:most_chars].encode()).digest()[:8], "little")
        x = np.random.Generator(np.random.PCG64(seed)).standard_normal(dim)
        return (x / np.linalg.norm(x)).astype("float32").tolist()

    def embed(rows: DataFrame) -> DataFrame:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "vector": [vector(x) for x in b["text"]]})

        return rows.select("id", "text").mapInPandas(task, "id string, vector array<float>")

    return embed
