"""The similarity graph: candidates, edges, health, hubs, pruning, export."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyloom.functions import vectors as v
from canopyloom.params import GraphParams
from canopyloom.storage import cut, open_fs, small_side

EPSILON = 1e-9
#: Components of the vectors of a block of ``similar_pairs``.
BLOCK_NUMBERS = 1 << 18
#: Bytes of a task's tables of hubs and nodes in ``detours``.
HUB_BYTES = 1 << 26


def numbered(nodes: DataFrame, key: str) -> DataFrame:
    """Adds i, the position from 0 in the order of ``key``. Nodes are categories; vectors and texts stay out of the ordering."""
    order = nodes.select(key).withColumn("i", F.row_number().over(Window.orderBy(key)) - 1)
    return nodes.join(order, key)


def similar_pairs(nodes: DataFrame, above: float, block: int | None = None, id_col: str = "i", vector_col: str = "embedding") -> DataFrame:
    """(i, j, s) with i < j and cosine s > above, by matrix products of blocks.

    Each block of rows meets each other block once, in one task; a task holds two
    blocks. A block has about ``BLOCK_NUMBERS`` components, so that short vectors are
    copied to few others. Vectors that are placeholders take no part.
    """
    nodes = nodes.filter(~v.is_placeholder(F.col(vector_col))).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"))
    if block is None:
        some = nodes.select(F.size("v").alias("n")).first()
        block = min(4096, max(512, BLOCK_NUMBERS // (some["n"] if some else 1)))
    nodes = nodes.withColumn("block", F.floor(F.col("i") / block).cast("int"))
    last = nodes.agg(F.max("block").alias("n")).first()["n"] or 0
    others = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(last))))
    dealt = others.select("i", "v", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        x = np.array(group["v"].tolist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + EPSILON
        ids, home = group["i"].to_numpy(), group["block"].to_numpy()
        p, q = group["p"].iat[0], group["q"].iat[0]
        a, b = np.flatnonzero(home == p), np.flatnonzero(home == q)
        found = []
        for k in range(0, len(a), 512):
            part = a[k : k + 512]
            s = x[part] @ x[b].T
            i, j = np.nonzero((s > above) & (ids[part][:, None] < ids[b][None]))
            found.append(pd.DataFrame({"i": ids[part[i]], "j": ids[b[j]], "s": s[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"i": [], "j": [], "s": []})

    return dealt.groupBy("p", "q").applyInPandas(multiply, "i long, j long, s double")


def parent_similarity(reports: DataFrame) -> DataFrame:
    """(community_id, parent_id, s): cosine of each report with its parent's."""
    up = reports.select(F.col("community_id").alias("parent_id"), F.col("embedding").alias("up"))
    return reports.join(up, "parent_id").select("community_id", "parent_id", v.cosine(F.col("embedding"), F.col("up"), EPSILON).alias("s"))


def shadow_nodes(reports: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """Reports so close to their parent's that they never act as a source."""
    return parent_similarity(reports).filter(F.col("s") > p.shadow)


def candidates(reports: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """Candidate edges: i, j, source, target, raw, vector_score.

    reports: community_id, title, level, parent_id, path, full_content, embedding.
    Only levels above 0; pairs by position in path order; strictly within the band,
    or rescued by a title that the other's content holds; not siblings; the source's
    parent, where it is among the nodes, must not be closer to the target; shadow
    nodes aren't sources; the best ``per_source`` of each source stay.
    """
    nodes = cut(numbered(reports.filter("level > 0"), "path"), "nodes")
    light = nodes.select("i", "community_id", "parent_id")
    shadows = shadow_nodes(nodes, p).select("community_id")
    pairs = cut(similar_pairs(nodes, p.rescue).filter(F.col("s") < p.high), "pairs")
    a = light.select(F.col("i"), F.col("community_id").alias("source"), F.col("parent_id").alias("pa"))
    b = light.select(F.col("i").alias("j"), F.col("community_id").alias("target"), F.col("parent_id").alias("pb"))
    a = a.join(shadows.withColumnRenamed("community_id", "source"), "source", "left_anti")
    pairs = pairs.join(a, "i").join(b, "j")
    siblings = (F.coalesce("pa", F.lit("")) != "") & F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    pairs = pairs.filter(~siblings)
    # titles and contents meet only where the score leaves room for a rescue
    words_a = nodes.select("i", F.col("title").alias("ta"), F.col("full_content").alias("ca"))
    words_b = nodes.select(F.col("i").alias("j"), F.col("title").alias("tb"), F.col("full_content").alias("cb"))
    hit = ((F.length("ta") > 1) & F.contains("cb", "ta")) | ((F.length("tb") > 1) & F.contains("ca", "tb"))
    near = pairs.filter(F.col("s") > p.low).withColumn("score", F.col("s"))
    saved = pairs.filter(F.col("s") <= p.low).join(words_a, "i").join(words_b, "j").filter(hit).select(*pairs.columns, F.lit(p.rescued_score).alias("score"))
    scored = cut(near.unionByName(saved), "scored")
    # the source's parent competes for the target
    up = nodes.select(F.col("community_id").alias("pa"), F.col("embedding").alias("vp"))
    to = nodes.select(F.col("i").alias("j"), F.col("embedding").alias("vt"))
    rivals = scored.filter(F.col("score") < p.exempt).select("i", "j", "s", "pa").join(up, "pa").join(to, "j")
    lost = rivals.filter(F.col("s") - v.cosine(F.col("vp"), F.col("vt"), EPSILON) < p.parent_margin).select("i", "j")
    kept = scored.join(lost, ["i", "j"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "j"))
    return kept.withColumn("rn", rank).filter(F.col("rn") <= p.per_source).select("i", "j", "source", "target", F.col("s").alias("raw"), F.col("score").alias("vector_score"))


def emit_edges(audited: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """Relationships from audited candidates (source, target, score, direction, relation_type, vector_score).

    Scores from ``min_audit``; forward gives one edge, backward one the other way,
    anything else both; the weight is a tenth of the score.
    """
    one = F.struct(F.col("source").alias("source_id"), F.col("target").alias("target_id"))
    two = F.struct(F.col("target").alias("source_id"), F.col("source").alias("target_id"))
    ends = F.when(F.col("direction") == "forward", F.array(one)).when(F.col("direction") == "backward", F.array(two)).otherwise(F.array(one, two))
    rows = audited.filter(F.col("score") >= p.min_audit).withColumn("e", F.explode(ends))
    return rows.select("e.source_id", "e.target_id", (F.col("score") / 10).alias("weight"), "relation_type", "vector_score")


def stub_audit(cand: DataFrame) -> DataFrame:
    """A deterministic stand-in for the model's audit, for tests and offline runs."""
    i, j = F.col("i"), F.col("j")
    way = F.when((i + j) % 3 == 0, "forward").when((i + j) % 3 == 1, "backward").otherwise("both")
    return cand.withColumns({"score": (6 + (i * 31 + j * 17) % 5).cast("int"), "direction": way, "relation_type": F.concat(F.lit("t"), ((i + j) % 14).cast("string"))})


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over directed rows, both ends counted."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def health(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """One row: n_edges, n_nodes, n_active, n_islands, island_ratio, avg_degree, max_degree, median_degree."""
    d = degrees(edges).agg(F.count("*").alias("n_active"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"), F.max("degree").alias("max_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"))
    n = comm.agg(F.count("*").alias("n_nodes"))
    edges_n = F.col("ends") / 2
    return d.crossJoin(n).select(
        edges_n.cast("long").alias("n_edges"), "n_nodes", "n_active", (F.col("n_nodes") - F.col("n_active")).alias("n_islands"),
        ((F.col("n_nodes") - F.col("n_active")) / F.col("n_nodes")).alias("island_ratio"), (edges_n / F.col("n_nodes")).alias("avg_degree"), "max_degree", "median_degree",
    )


def top_hubs(edges: DataFrame, titles: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of highest degree with their titles. titles: (id, title)."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(k)
    return top.join(titles.select("id", "title"), "id", "left").select("id", "degree", F.coalesce("title", F.lit("未知节点")).alias("title"))


def describe(edges: DataFrame) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max of the weights, to two places."""
    w = F.col("weight")
    names = {"mean": F.avg(w), "std": F.stddev_samp(w), "min": F.min(w), "q25": F.percentile(w, F.lit(0.25)), "q50": F.percentile(w, F.lit(0.5)), "q75": F.percentile(w, F.lit(0.75)), "max": F.max(w)}
    return edges.agg(F.count(w).alias("n"), *(F.round(x, 2).alias(k) for k, x in names.items()))


def histogram(edges: DataFrame, bounds: Sequence[float] = (0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """(bin, n): right-closed bins, the lowest bound included, what lies outside dropped, empty bins kept."""
    w, spark = F.col("weight"), edges.sparkSession
    cond = [(w > lo) & (w <= hi) if k else (w >= lo) & (w <= hi) for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    pick = F.coalesce(*(F.when(c, F.lit(k)) for k, c in enumerate(cond)))
    counts = edges.select(pick.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return spark.range(len(cond)).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation_type")


def reciprocity(edges: DataFrame, strict: bool = False) -> DataFrame:
    """One row: bidirectional (pairs with two rows), unidirectional (with one), ratio.

    strict: two rows must run in opposite directions.
    """
    pair = edges.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("ways"))
    both = (F.col("n") == 2) & ((F.col("ways") == 2) if strict else F.lit(True))
    out = pair.agg(F.count_if(both).alias("bidirectional"), F.count_if(F.col("n") == 1).alias("unidirectional"))
    total = F.col("bidirectional") + F.col("unidirectional")
    return out.withColumn("ratio", F.when(total > 0, F.col("bidirectional") / total).otherwise(0.0))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: one row a pair; of several the one with the largest (source, target) gives the weight."""
    last = F.max_by("weight", F.struct("source_id", "target_id"))
    return edges.filter("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(last.alias("weight"))


def super_hubs(pairs: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(id, degree) of nodes whose degree exceeds mean + 3 population standard deviations."""
    d = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    cap = d.agg((F.avg("degree") + p.hub_sigmas * F.stddev_pop("degree")).alias("cap"))
    return d.crossJoin(F.broadcast(cap)).filter("degree > cap").select("id", "degree")


def _indexed(ids: DataFrame) -> tuple[DataFrame, int]:
    """(id, k) with k from 0 without gaps, in any order, and how many; no task sees all."""
    rows = cut(ids.distinct().withColumn("m", F.monotonically_increasing_id()), "nodes")
    part = F.shiftright("m", 33)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    first = F.try_element_at(F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair)), part) if starts else F.lit(0).cast("long")
    return rows.select("id", (first + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("k")), sum(n for _, n in sizes)


def detours(pairs: DataFrame, hubs: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(a, b, weight, firm) of hub edges below ``keep_weight`` with another path of two or three edges.

    firm: such a path has no edge that could ever be removed, that is no light hub edge.
    A task takes some hubs and reads all neighbourhoods from shared storage, one batch
    at a time: first it counts, for its hubs, the ways of two edges to each node, then
    it looks these up at the neighbours of each light edge's other end. Work and memory
    grow with hub edges and neighbours, never with the number of paths.
    """
    spark = pairs.sparkSession
    nodes, n = _indexed(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    at_hub = hubs.select("id", F.lit(True).alias("hub"))
    known = small_side(cut(nodes.join(at_hub, "id", "left").select("id", "k", F.col("hub").isNotNull().alias("hub")), "known"), 32)
    named = lambda end: known.select(F.col("id").alias(end), F.col("k").alias(f"k{end}"), F.col("hub").alias(f"hub{end}"))
    light = (F.col("huba") | F.col("hubb")) & (F.col("weight") < p.keep_weight)
    rows = cut(pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "weight", "ka", "kb", "huba", F.coalesce(light, F.lit(False)).alias("light")), "rows")
    ends = F.explode(F.array(F.struct(F.col("ka").alias("x"), F.col("kb").alias("y")), F.struct(F.col("kb").alias("x"), F.col("ka").alias("y"))))
    near = rows.select(ends.alias("e"), (~F.col("light")).cast("int").alias("firm")).groupBy("e.x").agg(F.collect_list(F.col("e.y").cast("long") * 2 + F.col("firm")).alias("near"))
    files = cut(near, "near").inputFiles()
    own = rows.filter("light").select("a", "b", "weight", F.when(F.col("huba"), F.col("ka")).otherwise(F.col("kb")).alias("h"), F.when(F.col("huba"), F.col("kb")).otherwise(F.col("ka")).alias("y"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = hubs.count()
    most = min(max(1, HUB_BYTES // max(1, 4 * n)), max(1, -(-count // (3 * tasks))))
    own = own.withColumn("turn", F.pmod(F.xxhash64("h"), F.lit(-(-count // most) or 1)))

    def neighbourhoods():
        from pyarrow import parquet

        for f in files:
            fs, path = open_fs(f)
            with parquet.ParquetFile(path, filesystem=fs) as source:
                for batch in source.iter_batches(4096, columns=["x", "near"]):
                    lists = batch.column("near")
                    values, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    yield batch.column("x").to_numpy(), at, values >> 1, (values & 1).astype(bool)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        h, y = group["h"].to_numpy(), group["y"].to_numpy()
        mine = np.unique(h)
        found = [_detours(neighbourhoods, mine[i : i + most], h, y, n) for i in range(0, len(mine), most)]
        any_, firm = np.logical_or.reduce(found, 0)
        return group[["a", "b", "weight"]].assign(firm=firm)[any_]

    kind = pairs.schema["a"].dataType.simpleString()
    return own.repartition(tasks, "turn").groupBy("turn").applyInPandas(search, f"a {kind}, b {kind}, weight double, firm boolean")


def _detours(neighbourhoods, hubs: np.ndarray, h: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Two rows of booleans for the edges (h, y) of these hubs: whether another path exists, and a firm one."""
    place = np.full(n, -1, np.int32)
    place[hubs] = np.arange(len(hubs))
    near, near_firm, two_firm = (np.zeros((len(hubs), n), bool) for _ in range(3))
    two = np.zeros((len(hubs), n), np.uint8)  # ways of two edges, up to 2
    for x, start, to, firm in neighbourhoods():
        here = np.flatnonzero(place[to] >= 0)
        here = here[np.argsort(place[to[here]], kind="stable")]
        k, row = place[to[here]], np.searchsorted(start, here, "right") - 1
        turns = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else []
        for lo, hi in zip(turns[:-1], turns[1:], strict=True):
            own, rows, sure = k[lo], row[lo:hi], firm[here[lo:hi]]
            near[own, x[rows]] = True
            near_firm[own, x[rows[sure]]] = True
            size = start[rows + 1] - start[rows]
            each = np.arange(int(size.sum())) + np.repeat(start[rows] - np.cumsum(size) + size, size)
            two[own] = np.minimum(two[own] + np.bincount(to[each], minlength=n), 2)
            two_firm[own, to[each[np.repeat(sure, size) & firm[each]]]] = True
    out = np.zeros((2, len(h)), bool)
    order = np.flatnonzero(place[h] >= 0)
    order = order[np.argsort(y[order], kind="stable")]
    at = y[order]
    for x, start, to, firm in neighbourhoods():
        firsts, lasts = np.searchsorted(at, x), np.searchsorted(at, x, "right")
        for r in np.flatnonzero(lasts > firsts):
            every = to[start[r] : start[r + 1]]
            sure = every[firm[start[r] : start[r + 1]]]
            for e in order[firsts[r] : lasts[r]]:
                k = place[h[e]]
                out[1, e] = near_firm[k, sure].any() or two_firm[k, sure].any()
                # one way of two edges to each neighbour leads over this end itself
                rest = every if out[1, e] else every[every != h[e]]
                out[0, e] = out[1, e] or near[k, rest].any() or (two[k, rest] > 1).any()
    return out


def prunable(pairs: DataFrame, hubs: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(a, b, weight) of hub edges below ``keep_weight`` with another path of two or three edges.

    Removing edges only takes paths away, so no other edge can ever be pruned.
    """
    return detours(pairs, hubs, p).select("a", "b", "weight")


def prune(pairs: DataFrame, hubs: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(a, b, weight) of the edges that are removed, exactly as a sequential pass would.

    Hubs in id order, each one's edges by weight, then by the neighbour's id; an edge
    goes if what is left still has another path of at most three edges. An edge with a
    path of edges that never go (``firm``) goes whatever the order. The replay of the
    others depends on its order, so it runs in one task; it holds the edges within two
    steps of such an edge only.
    """
    goal = cut(detours(pairs, hubs, p), "goal")
    sure, open_ = goal.filter("firm"), goal.filter("not firm")
    if open_.isEmpty():
        return sure.select("a", "b", "weight")
    ends = cut(open_.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("id", "near")
    ring = cut(ends.union(both.join(small_side(ends, 16), "id", "left_semi").select("near")).distinct(), "ring")
    inside = lambda rows: rows.join(small_side(ring.withColumnRenamed("id", "a"), 16), "a", "left_semi").join(small_side(ring.withColumnRenamed("id", "b"), 16), "b", "left_semi").select("a", "b", "weight")
    rows = inside(pairs).withColumn("kind", F.lit("edge")).union(inside(sure).withColumn("kind", F.lit("sure"))).union(open_.select("a", "b", "weight", F.lit("open"))).union(hubs.select(F.col("id"), F.col("id"), F.lit(0.0), F.lit("hub")))
    kind = pairs.schema["a"].dataType.simpleString()

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for r in group[group.kind == "edge"].itertuples():
            near.setdefault(r.a, set()).add(r.b)
            near.setdefault(r.b, set()).add(r.a)
        turns: dict = {hub: [] for hub in sorted(group[group.kind == "hub"]["a"])}
        for r in group[group.kind.isin(["sure", "open"])].itertuples():
            for hub, other in ((r.a, r.b), (r.b, r.a)):
                if hub in turns:
                    turns[hub].append((r.weight, other, r.a, r.b, r.kind == "sure"))
        removed = []
        for own in turns.values():
            for w, _, x, y, sure in sorted(own):
                if y not in near[x]:
                    continue
                near[x].discard(y)
                near[y].discard(x)
                if sure:
                    continue
                if near[x] & near[y] or any(near.get(m, set()) & near[y] for m in near[x]):
                    removed.append((x, y, w))
                else:
                    near[x].add(y)
                    near[y].add(x)
        return pd.DataFrame(removed, columns=["a", "b", "weight"])

    return sure.select("a", "b", "weight").union(rows.groupBy().applyInPandas(replay, f"a {kind}, b {kind}, weight double"))


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Directed rows without the removed pairs, in either direction."""
    keyed = edges.withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    return keyed.join(small_side(cut(removed.select("a", "b"), "removed"), 16), ["a", "b"], "left_anti").drop("a", "b")


def hub_recheck(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, degree): directed rows at each hub."""
    return hubs.select("id").join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def export_nodes(comm: DataFrame, lineage: DataFrame, edges: DataFrame, levels: Sequence[int]) -> DataFrame:
    """vos_id, id, label, description, cluster, weight of nodes at these levels that an edge between such nodes touches."""
    nodes = comm.filter(F.col("level").isin(list(levels))).select("id", "title", "level")
    inside = induced(edges, nodes)
    active = nodes.join(inside.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), "id", "left_semi").join(lineage.select("id", "root_title"), "id", "left")
    root = F.coalesce("root_title", F.lit("Unknown"))
    label = F.format_string("[Lv%d] %s > %s", F.col("level"), root, F.col("title"))
    return active.select(
        F.row_number().over(Window.orderBy("id")).alias("vos_id"), "id", F.col("title").alias("label"), label.alias("description"),
        F.dense_rank().over(Window.orderBy(root)).alias("cluster"), F.lit(1.0).alias("weight"),
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, tgt, weight with the exported nodes' numbers."""
    a = nodes.select(F.col("id").alias("source_id"), F.col("vos_id").alias("src"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("vos_id").alias("tgt"))
    return edges.join(a, "source_id").join(b, "target_id").select("src", "tgt", "weight")
