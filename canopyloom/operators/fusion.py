"""Fusion: long-text reassembly, deduplication by priority, ranking, budget, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyloom.functions import text as t

#: The order of precedence of sources, and what is written around texts.
PRIORITY = {"anchor": 1, "neighbor": 2, "fallback": 3, "finding": 4, "evidence": 5, "supplement": 6}
LOCATED = " ...[检索定位] "
MICRO_TITLE = "# 史料证据列表 (Historical Evidence)"
MACRO_TITLE = "# Macro Overview (宏观综述)"
CLAIMS_TITLE = "## I. Structural Logic & Claims (逻辑与观点)"
CLAIMS_INTRO = "基于图谱分析，发现以下核心观点及其关联："
EVIDENCE_PLACE = "  1. [证据占位]"
SUPPLEMENT_TITLE = "## II. Supplementary Historical Records (补充史料)"
SUPPLEMENT_INTRO = "原典记载："


def reassemble(text: Column, head: Column, tail: Column, best: Column, first: Column, last: Column, prefix: Column, threshold: int = 700, duplicate: float = 0.8) -> Column:
    """A long text as head, best chunk and tail; a short one whole; both after the prefix.

    The head goes if it is nearly the first chunk, the tail if it is nearly the last.
    """
    empty = F.lit("")
    head = F.when(F.coalesce(t.overlap(first, head) > duplicate, F.lit(False)), empty).otherwise(F.coalesce(head, empty))
    tail = F.when(F.coalesce(t.overlap(last, tail) > duplicate, F.lit(False)), empty).otherwise(F.coalesce(tail, empty))
    before = F.when(head != "", F.concat(head, F.lit(LOCATED))).otherwise(empty)
    after = F.when(tail != "", F.concat(F.lit(" ... "), tail)).otherwise(empty)
    return F.when(t.is_long(text, threshold), F.concat(prefix, before, best, after)).otherwise(F.concat(prefix, text))


def relation_tag(source_type: Column, relation: Column, anchor_title: Column) -> Column:
    """How a neighbour is related; empty for other sources."""
    relation, title = F.coalesce(relation, F.lit("")), F.coalesce(anchor_title, F.lit(""))
    full = F.format_string('[关联证据: 通过 "%s" 关联到 "%s"]', relation, title)
    return (
        F.when(source_type != "neighbor", "")
        .when((relation != "") & (title != ""), full)
        .when(relation != "", F.format_string('[关联证据: 通过 "%s" 关联]', relation))
        .otherwise("[关联证据]")
    )


def meta_line(path: Column, prepend: Column, tag: Column) -> Column:
    """The line above a text: its path, its source, its relation; parts that are blank are left out."""
    part = lambda x, form: F.when(F.coalesce(x, F.lit("")) != "", F.format_string(form, x))
    return F.concat_ws(" ", part(path, "[Source: %s]"), part(prepend, "[%s]"), part(tag, "%s"))


def micro_length(text: Column, path: Column, prepend: Column, tag: Column) -> Column:
    extra = F.when(F.coalesce(prepend, F.lit("")) != "", F.length(prepend) + 1).otherwise(0)
    return extra + F.length(meta_line(path, prepend, tag)) + 1 + F.length(text) + 1


def macro_length(text: Column, source_type: Column) -> Column:
    return F.length(text) + F.when(source_type.isin("finding", "evidence"), 100).otherwise(50)


def deduplicate(results: DataFrame) -> DataFrame:
    """One row an id: the source that takes precedence, then the first; at the place of the id's first row.

    ``additional_relations`` gathers what neighbour rows of a repeated id say.
    results: seq, id, text, score, source_type, relation_type, weight, anchor_title, ...
    """
    rank = F.lit(99)
    for name, k in PRIORITY.items():
        rank = F.when(F.col("source_type") == name, k).otherwise(rank)
    rows = results.withColumn("_priority", rank)
    w = Window.partitionBy("id")
    first = rows.withColumns({"_first": F.min("seq").over(w), "_n": F.count("*").over(w), "_rn": F.row_number().over(w.orderBy("_priority", "seq"))}).filter("_rn = 1")
    said = F.struct("seq", "relation_type", "weight", "anchor_title")
    near = results.filter("source_type = 'neighbor'").groupBy("id").agg(F.sort_array(F.collect_list(said)).alias("_said"))
    rows = first.join(near, "id", "left")
    more = F.when((F.col("_n") > 1) & F.col("_said").isNotNull(), F.transform("_said", lambda x: F.struct(x["relation_type"], x["weight"], x["anchor_title"])))
    return rows.withColumn("additional_relations", F.coalesce(more, F.array().cast("array<struct<relation_type:string,weight:double,anchor_title:string>>"))).withColumn("seq", F.col("_first")).drop("_priority", "_first", "_n", "_rn", "_said")


def rank(results: DataFrame) -> DataFrame:
    """Adds adjusted (a neighbour's score times its weight times 0.9) and position, best first; ties keep their order."""
    adjusted = F.when((F.col("source_type") == "neighbor") & F.col("weight").isNotNull(), F.col("score") * F.col("weight") * 0.9).otherwise(F.col("score"))
    rows = results.withColumn("adjusted", adjusted)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("adjusted"), "seq")))  # the rows of one retrieval


def stuff(results: DataFrame, length: Column, budget: int = 32_000, initial: int = 0) -> DataFrame:
    """The leading rows whose lengths fit the budget; ends at the first that doesn't. Adds used."""
    used = F.sum(length).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)) + initial
    return results.withColumn("used", used).filter(F.col("used") <= budget)


def stats(merged: DataFrame, deduplicated: DataFrame, stuffed: DataFrame, context_chars: Column, budget: int = 32_000) -> DataFrame:
    """One row of counts and of the budget's use. context_chars: the rendered context's length, of ``stuffed``'s aggregate."""
    a = merged.agg(F.count("*").alias("merged_count"))
    b = deduplicated.agg(F.count("*").alias("dedup_count"))
    c = stuffed.agg(F.count("*").alias("stuffed_count"), context_chars.alias("total_chars"))
    out = a.crossJoin(b).crossJoin(c)
    return out.withColumns({"budget_usage_percent": F.col("total_chars") / budget * 100, "exceeded_budget": F.col("total_chars") > budget})


def render_micro(rows: DataFrame) -> DataFrame:
    """One row, context: all entries under a title; empty without any. rows: position, text, path, prepend, tag."""
    prepend = F.when(F.coalesce("prepend", F.lit("")) != "", F.concat("prepend", F.lit("\n"))).otherwise("")
    entry = F.concat(prepend, meta_line(F.col("path"), F.col("prepend"), F.col("tag")), F.lit("\n"), F.col("text"))
    all_ = F.transform(F.sort_array(F.collect_list(F.struct("position", entry.alias("e")))), lambda x: x["e"])
    body = F.concat(F.lit(MICRO_TITLE + "\n\n"), F.array_join(all_, "\n\n"))
    return rows.agg(F.when(F.count("*") > 0, body).otherwise("").alias("context"))


def render_macro(rows: DataFrame) -> DataFrame:
    """One row, context: claims (findings and evidence), then the other records. rows: position, id, text, score, source_type, community_id."""
    claim = F.col("source_type").isin("finding", "evidence")
    items = F.sort_array(F.collect_list(F.struct("position", claim.alias("claim"), "id", "text", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("community_id", F.lit("")).alias("community"))))
    claims, others = F.filter("all", lambda x: x["claim"]), F.filter("all", lambda x: ~x["claim"])
    place = F.when
    one = lambda x, i: F.concat(
        F.format_string("### Claim %d: %s... (Score: %.2f)\n", (i + 1).cast("int"), F.left(x["text"], F.lit(100)), x["score"]),
        place(x["community"] != "", F.format_string("- **Context**: From Community [%s]\n", x["community"])).otherwise(""),
        F.lit(f"- **Supporting Evidence**:\n{EVIDENCE_PLACE}\n"),
    )
    rec = lambda x, i: F.format_string('%d. [%s]: "%s"', (i + 1).cast("int"), x["id"], t.preview(x["text"]))
    part1 = F.when(F.size(claims) > 0, F.concat(F.lit(f"{CLAIMS_TITLE}\n{CLAIMS_INTRO}\n\n"), F.array_join(F.transform(claims, one), "\n"), F.lit("\n"))).otherwise("")
    part2 = F.when(F.size(others) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(others, rec), "\n"))).otherwise("")
    body = F.concat(F.lit(MACRO_TITLE + "\n\n"), part1, F.lit(f"{SUPPLEMENT_TITLE}\n{SUPPLEMENT_INTRO}\n"), part2)
    return rows.agg(items.alias("all")).select(F.when(F.size("all") > 0, body).otherwise("").alias("context"))
