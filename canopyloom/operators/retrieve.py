"""Retrieval: anchors, neighbours, quotas, budgeted fill, findings, evidence, supplements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyloom.functions import text as t
from canopyloom.functions import vectors as v
from canopyloom.operators import search
from canopyloom.params import MacroParams, MicroParams
from canopyloom.storage import cut

UNKNOWN = "未知"


def locate(reports: DataFrame, query: Sequence[float], look: int, keep: int, threshold: float) -> DataFrame:
    """The best ``look`` reports, of these at least ``threshold``, of these ``keep``: community_id, title, level, score, rank."""
    best = search.scored(reports, query, "embedding").orderBy(F.desc("score"), "community_id").limit(look)
    best = best.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "community_id").limit(keep)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "community_id"))  # keep rows at most
    return best.select("community_id", F.coalesce("title", F.lit(UNKNOWN)).alias("title"), "level", "score", rank.alias("rank"))


def anchors(reports: DataFrame, query: Sequence[float], p: MicroParams = MicroParams()) -> DataFrame:
    return locate(reports, query, p.search_k, p.anchors, p.threshold)


def territory(reports: DataFrame, query: Sequence[float], p: MacroParams = MacroParams()) -> DataFrame:
    return locate(reports, query, 2 * p.top_k, p.top_k, p.threshold)


def expand(start: DataFrame, edges: DataFrame, titles: DataFrame, weight: float, fanout: int, skip_roots: bool = False) -> DataFrame:
    """Communities next to the start, by edges heavier than ``weight``: the ``fanout`` heaviest of each start.

    Start communities themselves go; a target that several reach belongs to the first
    of them. Columns: community_id, title, weight, relation_type, anchor_id,
    anchor_title, anchor_score. titles: (community_id, title).
    """
    own = start.filter("level > 0") if skip_roots else start
    own = own.select(F.col("community_id").alias("source_id"), F.col("title").alias("anchor_title"), F.col("score").alias("anchor_score"), F.col("rank").alias("anchor_rank"))
    hit = F.broadcast(own).join(edges.filter(F.col("weight") > weight), "source_id")  # a few start rows
    each = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id")
    near = hit.withColumn("rn", F.row_number().over(each)).filter(F.col("rn") <= fanout)
    near = near.join(F.broadcast(start.select(F.col("community_id").alias("target_id"))), "target_id", "left_anti")
    first = Window.partitionBy("target_id").orderBy("anchor_rank", "rn")
    near = near.withColumn("n", F.row_number().over(first)).filter("n = 1")
    near = near.join(titles.select(F.col("community_id").alias("target_id"), "title"), "target_id", "left")
    return near.select(F.col("target_id").alias("community_id"), F.coalesce("title", F.lit(UNKNOWN)).alias("title"), "weight", "relation_type", F.col("source_id").alias("anchor_id"), "anchor_title", "anchor_score", "anchor_rank")


def neighbors(start: DataFrame, edges: DataFrame, titles: DataFrame, p: MicroParams = MicroParams()) -> DataFrame:
    return expand(start, edges, titles, p.weight_threshold, p.fanout)


def bridges(start: DataFrame, edges: DataFrame, titles: DataFrame, p: MacroParams = MacroParams()) -> DataFrame:
    """As ``neighbors``; roots have no bridges."""
    return expand(start, edges, titles, p.bridge_weight, p.bridge_fanout, skip_roots=True)


def quotas(cands: DataFrame, total: int | Column, order: Sequence[str] = ("rank",), score: str = "score") -> DataFrame:
    """Adds ``quota``: shares of ``total`` in proportion to scores.

    Rounded half to even, at least 1; what is left of the total goes to the last
    candidate, which gets at least 1 too. Without positive scores all get the same.
    The candidates are the few communities of one retrieval.
    """
    total = F.lit(total) if isinstance(total, int) else total
    every, seq = Window.partitionBy(), Window.orderBy(*order)
    n, sum_ = F.count("*").over(every), F.sum(score).over(every)
    share = F.greatest(F.lit(1), F.bround(total * F.col(score) / sum_, 0).cast("int"))
    rows = cands.withColumns({"_share": F.when(sum_ > 0, share).otherwise(F.greatest(F.lit(1), F.floor(total / n).cast("int"))), "_n": n, "_at": F.row_number().over(seq), "_sum": sum_})
    rest = F.greatest(F.lit(1), F.col("_share") + total - F.sum("_share").over(every))
    quota = F.when((F.col("_sum") > 0) & (F.col("_at") == F.col("_n")), rest).otherwise(F.col("_share"))
    return rows.withColumn("quota", quota.cast("int")).drop("_share", "_n", "_at", "_sum")


def penetrate(comm: DataFrame, units: DataFrame, reports: DataFrame, query: Sequence[float], is_anchor: bool, normalize: bool = False) -> DataFrame:
    """What each community offers: community_id, place, id, text, score.

    A leaf gives its best ``quota`` units (before them, on top of the quota, its
    summary if it is an anchor); another community its summary if it is an anchor,
    else nothing. comm: community_id, is_leaf, quota.
    """
    mine = units.join(F.broadcast(comm.filter("is_leaf").select("community_id", "quota")), "community_id")  # the communities of one retrieval
    best = search.per_group(search.scored(mine, query, normalize=normalize), "community_id", F.col("quota"))
    out = best.select("community_id", F.col("rn").cast("int").alias("place"), "id", "text", "score")
    if is_anchor:
        own = reports.join(F.broadcast(comm.select("community_id")), "community_id").filter("summary <> ''")
        own = search.scored(own, query, "embedding")
        out = out.unionByName(own.select("community_id", F.lit(0).alias("place"), F.concat(F.lit("summary_"), "community_id").alias("id"), F.concat(F.lit("【社区摘要】"), "summary").alias("text"), "score"))
    return out


def fill(offers: DataFrame, comm: DataFrame, budget: int) -> DataFrame:
    """Offers taken in the order of communities within a budget of characters.

    A community ends at its first offer that doesn't fit; the running total goes on and
    a later community may still fit. The fold runs over one ordered array of lengths:
    the offers of one retrieval, bounded by its quotas. comm: community_id, rank.
    """
    rows = offers.join(F.broadcast(comm.select("community_id", "rank")), "community_id")
    item = F.struct("rank", "place", "id", F.length("text").alias("n"), "community_id")
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).cast("int").alias("stopped"), F.array().cast("array<struct<rank:int,place:int,id:string,n:int,community_id:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["rank"] != acc["stopped"]) & (acc["used"] + x["n"] <= budget)
        return F.struct(
            F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["stopped"]).otherwise(x["rank"]).alias("stopped"),
            F.when(fits, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    folded = rows.groupBy().agg(F.sort_array(F.collect_list(item)).alias("all")).select(F.aggregate("all", start, step).alias("f"))
    kept = folded.select(F.posexplode("f.out").alias("seq", "o")).select("seq", "o.community_id", "o.place", "o.id", "o.n")
    return kept.join(rows.select("community_id", "place", "id", "text", "score"), ["community_id", "place", "id"])


def fallback_target(used: int, p: MicroParams = MicroParams()) -> int:
    """How many rows the global fallback may add to what is ``used`` (characters)."""
    left = p.budget - used
    return p.force_recall if left < p.force_recall * p.chars_per_unit else max(1, left // p.chars_per_unit)


def fallback(units: DataFrame, query: Sequence[float], taken: DataFrame, used: int, p: MicroParams = MicroParams()) -> DataFrame:
    """Units by similarity to the query that aren't taken yet, best first."""
    return beyond(units, query, taken, p.fallback_k, fallback_target(used, p), p.threshold)


def beyond(units: DataFrame, query: Sequence[float], taken: DataFrame, look: int, keep: int, threshold: float) -> DataFrame:
    """The best ``look`` units, of these at least ``threshold`` and not ``taken`` (id), of these ``keep``."""
    best = search.scored(units, query).orderBy(F.desc("score"), "id").limit(look).filter(F.col("score") >= threshold)
    return best.join(taken.select("id").distinct(), "id", "left_anti").orderBy(F.desc("score"), "id").limit(keep)


def supplement(units: DataFrame, query: Sequence[float], evidence: DataFrame, p: MacroParams = MacroParams()) -> DataFrame:
    return beyond(units, query, evidence, 2 * p.supplement, p.supplement, p.threshold)


def flat_findings(reports: DataFrame) -> DataFrame:
    """community_id, title, finding_index, summary, explanation, vector: as many as there are both findings and vectors."""
    f, x = t.findings(F.col("findings")), F.coalesce("finding_vectors", F.array().cast("array<array<float>>"))
    n = F.least(F.size(f), F.size(x))
    rows = reports.select("community_id", "title", F.posexplode(F.arrays_zip(F.slice(f, 1, n).alias("f"), F.slice(x, 1, n).alias("x"))).alias("finding_index", "z"))
    return rows.select("community_id", "title", "finding_index", "z.f.summary", "z.f.explanation", F.col("z.x").alias("vector"))


def top_findings(reports: DataFrame, cands: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The best k findings of the candidate communities, as rows with id and text."""
    rows = flat_findings(reports).join(F.broadcast(cands.select("community_id").distinct()), "community_id", "left_semi")
    best = search.scored(rows, query).orderBy(F.desc("score"), "community_id", "finding_index").limit(k)
    body = F.concat(F.lit("【观点】"), "summary", F.lit("\n\n【解释】"), "explanation")
    return best.withColumns({"id": F.concat_ws("_", F.lit("finding"), "community_id", "finding_index"), "text": body})


def evidence(findings: DataFrame, units: DataFrame, reports: DataFrame, query: Sequence[float], k: int, threshold: float, over: int = 5) -> DataFrame:
    """For each finding its community's summary and up to k units out of the global best ``over`` * k.

    Columns: finding_id, community_id, place (0: the summary), id, text, score.
    """
    best = search.scored(units, query).orderBy(F.desc("score"), "id").limit(over * k).filter(F.col("score") >= threshold)
    own = findings.select(F.col("id").alias("finding_id"), "community_id")
    hits = own.join(best.select("community_id", "id", "text", "score"), "community_id")
    rank = F.row_number().over(Window.partitionBy("finding_id").orderBy(F.desc("score"), "id"))
    hits = hits.withColumn("place", rank).filter(F.col("place") <= k)
    heads = own.join(search.scored(reports.filter("summary <> ''"), query, "embedding").select("community_id", "summary", "score"), "community_id")
    heads = heads.select("finding_id", "community_id", F.lit(0).alias("place"), F.concat(F.lit("summary_"), "community_id").alias("id"), F.concat(F.lit("【社区摘要】"), "summary").alias("text"), "score")
    return heads.unionByName(hits.select(heads.columns))


def micro(units: DataFrame, reports: DataFrame, edges: DataFrame | None, query: Sequence[float], p: MicroParams = MicroParams()) -> DataFrame:
    """The detail-first path: seq, id, text, score, source_type, relation_type, weight, community_id, title, anchor_title.

    reports: community_id, title, level, is_leaf, summary, embedding. Anchors fill their
    share of the budget, then neighbours theirs, then the global fallback the rest.
    """
    names = reports.select("community_id", "title")
    start = cut(anchors(reports, query, p), "anchors")
    per = lambda ratio: int(p.budget * ratio) // p.chars_per_unit
    leaf = reports.select("community_id", "is_leaf")
    q1 = quotas(start, per(p.anchor_quota_ratio)).join(leaf, "community_id")
    one = fill(penetrate(q1, units, reports, query, True), start, int(p.budget * p.anchor_quota_ratio))
    parts = [one.join(start.select("community_id", "title"), "community_id").select(F.lit(1).alias("part"), "seq", "id", "text", "score", F.lit("anchor").alias("source_type"), F.lit(None).cast("string").alias("relation_type"), F.lit(None).cast("double").alias("weight"), "community_id", "title", F.col("title").alias("anchor_title"))]
    if edges is not None and p.graph:
        near = neighbors(start, edges, names, p)
        order = F.row_number().over(Window.orderBy(F.desc("weight"), "community_id"))
        near = cut(near.withColumn("rank", order), "near")
        q2 = quotas(near, per(p.neighbor_quota_ratio), score="weight").join(leaf, "community_id")
        two = fill(penetrate(q2, units, reports, query, False), near, int(p.budget * p.neighbor_quota_ratio))
        parts.append(two.join(near.select("community_id", "title", "relation_type", "weight", "anchor_title"), "community_id").select(F.lit(2).alias("part"), "seq", "id", "text", "score", F.lit("neighbor").alias("source_type"), "relation_type", "weight", "community_id", "title", "anchor_title"))
    taken = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    taken = cut(taken, "taken")  # a budget's worth of rows
    used = taken.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    rest = fallback(units, query, taken, used, p)
    seq = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1
    rest = rest.join(names, "community_id", "left").select(F.lit(3).alias("part"), seq.alias("seq"), "id", "text", "score", F.lit("fallback").alias("source_type"), F.lit(None).cast("string").alias("relation_type"), F.lit(None).cast("double").alias("weight"), "community_id", F.coalesce("title", F.lit(UNKNOWN)).alias("title"), F.lit(None).cast("string").alias("anchor_title"))
    every = taken.unionByName(rest)
    return every.withColumn("seq", F.row_number().over(Window.orderBy("part", "seq")) - 1).drop("part")


def macro(units: DataFrame, reports: DataFrame, edges: DataFrame | None, query: Sequence[float], p: MacroParams = MacroParams()) -> DataFrame:
    """The overview-first path: seq, id, text, score, source_type, community_id, title; no rows without anchors.

    reports also has findings and finding_vectors.
    """
    names = reports.select("community_id", "title")
    start = cut(territory(reports, query, p), "territory")
    cands = start.select("community_id", "title")
    if edges is not None:
        cands = cands.unionByName(bridges(start, edges, names, p).select("community_id", "title"))
    points = cut(top_findings(reports, cands, query, p.max_findings), "points")
    proof = cut(evidence(points, units, reports, query, p.evidence_per_finding, p.threshold), "proof")
    more = supplement(units, query, proof, p)
    heads = search.scored(reports.filter("summary <> ''").join(F.broadcast(start.select("community_id", "rank")), "community_id"), query, "embedding")
    cols = ["part", "at", "id", "text", "score", "source_type", "community_id"]
    every = heads.select(F.lit(1).alias("part"), F.col("rank").cast("long").alias("at"), F.concat(F.lit("summary_"), "community_id").alias("id"), F.concat(F.lit("【社区摘要】"), "summary").alias("text"), "score", F.lit("anchor").alias("source_type"), "community_id")
    nth = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("long").alias("at")
    every = every.unionByName(points.select(F.lit(2).alias("part"), nth(F.desc("score"), "id"), "id", "text", "score", F.lit("finding").alias("source_type"), "community_id").select(cols))
    every = every.unionByName(proof.select(F.lit(3).alias("part"), nth("finding_id", "place"), "id", "text", "score", F.lit("evidence").alias("source_type"), "community_id").select(cols))
    every = every.unionByName(more.select(F.lit(4).alias("part"), nth(F.desc("score"), "id"), "id", "text", "score", F.lit("supplement").alias("source_type"), "community_id").select(cols))
    if start.isEmpty():
        every = every.filter(F.lit(False))
    every = every.join(names, "community_id", "left").withColumn("title", F.coalesce("title", F.lit(UNKNOWN)))
    return every.withColumn("seq", F.row_number().over(Window.orderBy(F.desc("score"), "part", "at")) - 1).drop("part", "at")
