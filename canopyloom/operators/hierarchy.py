"""The category tree: paths, communities, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyloom.functions import text as t


def _levels():
    """(path, title, parent's path) of each level, from columns l0, l1, l2."""
    l0, l1, l2 = F.col("l0"), F.col("l1"), F.col("l2")
    p0, p1, p2 = l0, F.concat_ws("/", l0, l1), F.concat_ws("/", l0, l1, l2)
    return [(l0 != "", p0, l0, F.lit(None).cast("string")), ((l0 != "") & (l1 != ""), p1, l1, p0), ((l0 != "") & (l1 != "") & (l2 != ""), p2, l2, p1)]


def community_id(level: int, path) -> F.Column:
    return t.hash_id(F.lit(f"L{level}_"), path)


def with_paths(rows: DataFrame) -> DataFrame:
    """Adds id, path and community_id (the deepest level that isn't blank); rows without the first level go."""
    l0, l1, l2 = F.col("l0"), F.col("l1"), F.col("l2")
    path, depth = t.path(l0, l1, l2), t.depth(l0, l1, l2)
    own = F.when(depth == 1, community_id(0, path)).when(depth == 2, community_id(1, path)).otherwise(community_id(2, path))
    rows = rows.filter(l0 != "")
    return rows.withColumn("path", path).withColumn("community_id", own).withColumn("id", t.hash_id(F.col("path"), F.lit("::"), F.col("text")))


def members(rows: DataFrame) -> DataFrame:
    """Each row once for each community on its path, with community_id."""
    each = [F.when(present, community_id(i, path)) for i, (present, path, _, _) in enumerate(_levels())]
    return rows.withColumn("community_id", F.explode(F.array_compact(F.array(*each))))


def communities(rows: DataFrame) -> DataFrame:
    """id, title, level, parent_id, path, child_ids (sorted), is_leaf; rows with a blank text still make communities.

    Distinct with partial sums below one shuffle by id; children are joined back.
    """
    each = [
        F.when(present, F.struct(community_id(i, path).alias("id"), title.alias("title"), F.lit(i).alias("level"), (community_id(i - 1, up) if i else up).alias("parent_id"), path.alias("path")))
        for i, (present, path, title, up) in enumerate(_levels())
    ]
    flat = rows.select(F.explode(F.array_compact(F.array(*each))).alias("c")).select("c.*").distinct()
    children = flat.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("child_ids"))
    child_ids = F.coalesce("child_ids", F.array().cast("array<string>"))
    return flat.join(children, "id", "left").withColumn("child_ids", child_ids).withColumn("is_leaf", F.size("child_ids") == 0)


def tree_edges(comm: DataFrame) -> DataFrame:
    """(parent_id, child_id) where the parent exists."""
    child = comm.filter("parent_id is not null").select("parent_id", F.col("id").alias("child_id"))
    return child.join(comm.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def lineage(comm: DataFrame, levels: int = 3) -> DataFrame:
    """id, root_id, root_title, chain (titles from the root down, joined by ' > '); the walk is as deep as the tree.

    Communities whose chain breaks have a null root and the title Unknown.
    """
    up = comm.select("id", "title", "parent_id", F.col("id").alias("at"), F.col("parent_id").alias("next"), F.array("title").alias("chain"), F.col("title").alias("top"))
    parents = comm.select(F.col("id").alias("pid"), F.col("title").alias("ptitle"), F.col("parent_id").alias("pnext"))
    for _ in range(levels - 1):
        j = up.join(parents, up.next == parents.pid, "left")
        found = F.col("pid").isNotNull()
        up = j.select(
            "id", "title", "parent_id", F.when(found, F.col("pid")).otherwise(F.col("at")).alias("at"),
            F.when(found, F.col("pnext")).otherwise(F.col("next")).alias("next"),
            F.when(found, F.concat(F.array("ptitle"), "chain")).otherwise(F.col("chain")).alias("chain"),
            F.when(found, F.col("ptitle")).otherwise(F.col("top")).alias("top"),
        )
    whole = F.col("next").isNull()
    return up.select("id", F.when(whole, F.col("at")).alias("root_id"), F.when(whole, F.col("top")).otherwise("Unknown").alias("root_title"), F.array_join("chain", " > ").alias("chain"))


def uncoloured(comm: DataFrame) -> DataFrame:
    """Communities that no root reaches."""
    return comm.select("id").join(lineage(comm).filter("root_id is not null"), "id", "left_anti")


def cycles(comm: DataFrame, levels: int = 3) -> DataFrame:
    """Communities that are their own ancestor within ``levels`` steps; none in a tree."""
    at = comm.filter("parent_id is not null").select("id", F.col("parent_id").alias("up"))
    parents = comm.select(F.col("id").alias("up"), F.col("parent_id").alias("next"))
    out = at.filter("id = up").select("id")
    for _ in range(levels):
        at = at.join(parents, "up").filter("next is not null").select("id", F.col("next").alias("up"))
        out = out.union(at.filter("id = up").select("id"))
    return out.distinct()


def with_source_frequency(rows: DataFrame) -> DataFrame:
    """source (normalised) and prepend_source: whether the source occurs more than once in the whole corpus."""
    rows = rows.withColumn("source", t.normalize_source(F.col("source")))
    counts = rows.groupBy("source").agg(F.count("*").alias("n_source"))
    return rows.join(counts, "source").withColumn("prepend_source", F.col("n_source") > 1)


def text_units(rows: DataFrame) -> DataFrame:
    """Ingested text units from (l0, l1, l2, text, source, note): the columns of schema.TEXT_UNITS without vectors."""
    rows = with_source_frequency(rows)  # before blank rows go
    x = F.col("text")
    rows = with_paths(rows.withColumn("text", t.strip(x))).filter(x != "")
    return rows.select("id", "text", t.token_count(x).alias("n_tokens"), "community_id", t.chunks(x).alias("text_chunks"), t.head(x).alias("head"), t.tail(x).alias("tail"), t.metadata(F.col("source"), F.col("note")).alias("source_metadata"), F.col("path").alias("hierarchy_path"), "prepend_source")
