"""Building reports bottom-up, and the audited graph, with model providers.

Reports: leaves first, then the nodes above them, then the roots, which read their
children's reports. A context that fits one bin is asked for at once (a sparse one
with its own prompt); a larger one is split over bins, each summarised, and the
summaries are asked for together. What a provider can't answer becomes a stand-in
record, so every community has a report; ``sources.io.complete`` tells whether any is
a stand-in. Each level is written to shared storage before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyloom.functions import text as t
from canopyloom.operators import graph, providers, reports
from canopyloom.params import GraphParams, ReportParams
from canopyloom.sources import io
from canopyloom.storage import cut

#: The summary of a report that could not be made (fixed value).
FAILED = "处理错误"
#: Our own wording; a caller may pass other prompts with {title} and {context}.
PROMPTS = {
    "sparse": "Describe the category {title} from these few sources. Answer as JSON with title, summary and findings.\n\n{context}",
    "standard": "Report on the category {title} from these sources. Answer as JSON with title, summary and findings (summary, explanation).\n\n{context}",
    "map": "Summarise this part of the category {title}.\n\n{context}",
    "reduce": "Report on the category {title} from these partial summaries. Answer as JSON with title, summary and findings (summary, explanation).\n\n{context}",
}
REPORT = "community_id string, title string, level int, summary string, findings string, full_content string"


def filled(template: str, title, context):
    """A template with {title} and {context} filled from columns."""
    before, after = template.split("{context}")
    parts = [F.lit(x) for x in before.split("{title}")]
    for i in range(len(parts) - 1, 0, -1):
        parts.insert(i, title)
    return F.concat(*parts, context, F.lit(after))


def contexts(units: DataFrame, comm: DataFrame, level: int, made: DataFrame | None) -> DataFrame:
    """(community_id, title, k, text): the ordered parts of each context of a level."""
    mine = comm.filter(F.col("level") == level)
    own = units.select("community_id", F.col("doc_id").cast("string").alias("k"), "text")
    if level:
        leaf = own.join(mine.filter("is_leaf").select(F.col("id").alias("community_id"), "title"), "community_id")
        child = comm.filter("parent_id is not null").select(F.col("id").alias("community_id"), F.col("title").alias("own"), "parent_id")
        inner = mine.filter("not is_leaf").select(F.col("id").alias("parent_id"), "title")
        below = own.join(child, "community_id").join(inner, "parent_id")
        below = below.select(F.col("parent_id").alias("community_id"), "k", F.concat(F.lit("【小类："), "own", F.lit("】"), "text").alias("text"), "title")
        return leaf.select("community_id", "title", "k", "text").unionByName(below.select("community_id", "title", "k", "text"))
    told = comm.filter("level = 1").select(F.col("id").alias("child"), F.col("parent_id").alias("community_id"))
    said = told.join(made.select(F.col("community_id").alias("child"), F.col("title").alias("own"), "summary"), "child")
    rows = said.select("community_id", F.col("child").alias("k"), F.concat(F.lit("【"), "own", F.lit("】: "), "summary").alias("text"))
    return rows.join(mine.select(F.col("id").alias("community_id"), "title"), "community_id").select("community_id", "title", "k", "text")


def binned(parts: DataFrame, p: ReportParams) -> DataFrame:
    """(community_id, title, bin, n_bins, n_tokens, context): the parts joined by bins; next fit over running sums, texts stay where they are."""
    numbered = parts.withColumn("n", F.length("text").cast("long"))
    lengths = numbered.groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("k", F.xxhash64("text").alias("h"), "n"))).alias("u"), F.sum("n").alias("n_tokens"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own, total in zip(rows["community_id"], rows["u"], rows["n_tokens"], strict=True):
            limit = total / -(-total // p.target) * p.slack if total > p.single_bin else float("inf")
            at = held = 0
            for x in own:
                if held and held + x["n"] > limit:
                    at, held = at + 1, 0
                held += x["n"]
                out.append((key, x["k"], x["h"], at))
        return pd.DataFrame(out, columns=["community_id", "k", "h", "bin"])

    where = lengths.mapInPandas(lambda batches: map(fold, batches), "community_id string, k string, h long, bin int").distinct()
    rows = numbered.withColumn("h", F.xxhash64("text")).join(where, ["community_id", "k", "h"]).join(lengths.select("community_id", "n_tokens"), "community_id")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h", "text"))), lambda x: x["text"]), "\n\n")
    bins = rows.groupBy("community_id", "title", "n_tokens", "bin").agg(texts.alias("context"))
    return bins.withColumn("n_bins", F.count("*").over(Window.partitionBy("community_id")))


def level_reports(comm: DataFrame, parts: DataFrame, level: int, provider: Callable[[str], str], p: ReportParams, limits: providers.Limits, prompts: dict[str, str]) -> DataFrame:
    """(REPORT) of one level; a community without any context is asked with an empty one."""
    bins = cut(binned(parts, p), "bins")
    title, context = F.col("title"), F.col("context")
    many = bins.filter("n_bins > 1").withColumn("id", F.concat_ws(":", "community_id", "bin"))
    mapped = cut(providers.call(many.select("id", filled(prompts["map"], title, context).alias("prompt")), provider, limits), "mapped")
    said = many.select("id", "community_id", "title", "bin").join(mapped, "id").withColumn("answer", F.coalesce("answer", F.lit(FAILED)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "answer"))), lambda x: x["answer"]), "\n\n")
    reduced = said.groupBy("community_id", "title").agg(joined.alias("context")).select("community_id", filled(prompts["reduce"], title, context).alias("prompt"))
    once = bins.filter("n_bins = 1").withColumn("route", reports.route(F.col("n_tokens"), F.lit(1), p))
    once = once.select("community_id", F.when(F.col("route") == "sparse", filled(prompts["sparse"], title, context)).otherwise(filled(prompts["standard"], title, context)).alias("prompt"))
    mine = comm.filter(F.col("level") == level).select(F.col("id").alias("community_id"), "title")
    blank = mine.join(bins.select("community_id"), "community_id", "left_anti").select("community_id", filled(prompts["sparse"], title, F.lit(reports.EMPTY_CONTEXT)).alias("prompt"))
    asked = once.unionByName(reduced).unionByName(blank).select(F.col("community_id").alias("id"), "prompt")
    answers = cut(providers.call(asked, provider, limits), "answers")
    return parsed(answers.withColumnRenamed("id", "community_id").join(mine, "community_id"), level)


def parsed(answers: DataFrame, level: int) -> DataFrame:
    """(REPORT) from (community_id, title, answer, error): repaired JSON; a stand-in where there is no usable answer."""

    def task(batches):
        import json

        for b in batches:
            out = []
            for key, title, answer in zip(b["community_id"], b["title"], b["answer"], strict=True):
                told = reports.repair_json(answer)
                summary, points = told.get("summary"), told.get("findings")
                if not isinstance(summary, str) or not summary:
                    out.append((key, title, FAILED, "[]"))
                    continue
                whole = [{"summary": str(f["summary"]), "explanation": str(f["explanation"])} for f in points or [] if isinstance(f, dict) and "summary" in f and "explanation" in f] if isinstance(points, list) else []
                out.append((key, str(told.get("title") or title), summary, json.dumps(whole, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["community_id", "title", "summary", "findings"])

    rows = answers.select("community_id", "title", "answer").mapInPandas(task, "community_id string, title string, summary string, findings string")
    full = F.when(F.col("summary") == FAILED, "").otherwise(t.report_text(F.col("title"), F.col("summary"), t.findings(F.col("findings"))))
    return rows.select("community_id", "title", F.lit(level).alias("level"), "summary", "findings", full.alias("full_content"))


def build_reports(units: DataFrame, comm: DataFrame, provider: Callable[[str], str], embed: Callable[[DataFrame], DataFrame] | None = None, p: ReportParams = ReportParams(), limits: providers.Limits = providers.Limits(), prompts: dict[str, str] = PROMPTS, levels: int = 3) -> DataFrame:
    """Reports of all communities, level by level from below, with ``embedding`` (null for a stand-in) where ``embed`` is given.

    units: doc_id, text, community_id; comm: id, title, level, parent_id, is_leaf.
    """
    made = None
    for level in range(levels - 1, -1, -1):
        own = cut(level_reports(comm, contexts(units, comm, level, made), level, provider, p, limits, prompts), f"reports-{level}")
        made = own if made is None else made.unionByName(own)
    if embed is None:
        return made
    good = made.filter(F.col("summary") != FAILED).select(F.col("community_id").alias("id"), F.col("full_content").alias("text"))
    return made.join(embed(good).select(F.col("id").alias("community_id"), F.col("vector").alias("embedding")), "community_id", "left")


def audited_edges(cand: DataFrame, done: DataFrame | None, provider: Callable[[str], str], p: GraphParams = GraphParams(), limits: providers.Limits = providers.Limits()) -> tuple[DataFrame, DataFrame]:
    """(edges, newly finished pairs): candidates that aren't ``done`` (i, j) yet are judged by the provider and turned into relationships.

    The provider answers JSON with score, direction and relation_type; other answers
    and failed calls leave the pair for the next run. cand: i, j, source, target,
    vector_score, and source_text and target_text for the prompt.
    """
    todo = io.pending(cand, done, ["i", "j"]) if done is not None else cand
    prompt = F.concat(F.lit("How are these two categories related? Answer as JSON with score (0 to 10), direction (forward, backward, bidirectional) and relation_type.\n\n# A\n"), "source_text", F.lit("\n\n# B\n"), "target_text")
    asked = todo.withColumn("id", F.concat_ws("-", "i", "j"))
    answers = providers.call(asked.select("id", prompt.alias("prompt")), provider, limits)

    def task(batches):
        for b in batches:
            out = []
            for key, answer in zip(b["id"], b["answer"], strict=True):
                told = reports.repair_json(answer)
                try:
                    out.append((key, int(told["score"]), str(told.get("direction", "")), str(told.get("relation_type", ""))))
                except (KeyError, TypeError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["id", "score", "direction", "relation_type"])

    judged = cut(answers.mapInPandas(task, "id string, score int, direction string, relation_type string"), "judged")
    rows = asked.select("id", "i", "j", "source", "target", "vector_score").join(judged, "id")
    return graph.emit_edges(rows, p), rows.select("i", "j")
