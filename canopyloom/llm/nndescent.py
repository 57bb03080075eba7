"""Approximate nearest neighbours by NN-descent and greedy graph search, by inner product.

Equal vectors form a class and are indexed once. Classes are dealt by a hash over
shards of about ``shard_rows``, so that no task ever holds more than a shard.

* Build: every class starts with its best neighbours in a few random blocks of its
  shard, an eighth of it and ``block_rows`` at most. Then, again and again, Spark joins
  bring neighbours of neighbours together: the members of each class's neighbourhood
  (its neighbours and some of those that have it as theirs) are compared with each
  other, pairs with a new member only, on vectors quantised to bytes, and each keeps
  its best ``degree``. This ends after ``rounds``, or when fewer than ``least_change``
  of all entries change.
* Each shard's classes, vectors and neighbours, with edges back, are written to one
  file in the shared folder.
* Search: the queries are a stated set. They are dealt over tasks, ``query_rows`` for
  each shard; a task reads the shard's file and walks its graph greedily, best
  candidates first, from a few random entries and from the query's own class's
  neighbours if the shard holds it, with a beam of ``beam``; scores are exact, in double
  precision, on the original vectors. Results of all shards are merged, and classes
  give their members. The index is neither shuffled nor copied for the queries.

Vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows with a null id. Of rows that share an id the one with the smallest vector
counts. Only vectors of equal dimension meet. Ties go to the smaller id; a class
keeps its ``k`` + 1 smallest ids, which is all that a result can need. A query
without candidates gives no rows. An empty table gives an empty table.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyloom.storage import cut, drop, fresh_path, open_fs, small_side

#: Shards of one dimension are numbered within this range.
STRIDE = 1 << 32


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v is array<float>, one row an id."""
    v = F.col(vector_col).cast("array<float>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("v"))
    return rows.filter("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))


def smallest(ids: Column, k: int) -> Column:
    return F.slice(F.sort_array(ids), 1, k)


def classes(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """(id, v, ids): each distinct vector with its smallest id and its ``k`` smallest ids.

    A hot vector's rows meet in two steps, salted by their ids first.
    """
    part = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(smallest(F.collect_list("id"), k).alias("ids"))
    whole = part.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids")), k).alias("ids"))
    return whole.select(F.element_at("ids", 1).alias("id"), "v", "ids")


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(x, np.float32) for x in vectors], np.float32)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row the columns of its k largest scores, or of all."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def start(index: DataFrame, degree: int, turns: int = 3) -> DataFrame:
    """(id, near): each class's best neighbours in ``turns`` random blocks of its shard. index: (shard, id, v, blocks).

    Blocks of several turns overlap, which connects them for the rounds that follow.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, x = group["id"].to_numpy(), matrix(group["v"])
        near = []
        for i in range(0, len(ids), 512):
            s = x[i : i + 512] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            for row, cols in zip(s, best(s, degree), strict=True):
                near.append([{"s": round(float(row[c]), 4), "id": int(ids[c]), "fresh": True} for c in cols if row[c] > -np.inf])
        return pd.DataFrame({"id": ids, "near": near})

    dealt = index.select("shard", "id", "v", "blocks", F.explode(F.array(*map(F.lit, range(turns)))).alias("turn")).withColumn("block", F.pmod(F.xxhash64("turn", "id"), "blocks"))
    each = dealt.groupBy("shard", "turn", "block").applyInPandas(compare, "id long, near array<struct<s:float,id:long,fresh:boolean>>")
    merged = F.array_distinct(F.flatten(F.collect_list("near")))
    return each.groupBy("id").agg(F.slice(F.sort_array(merged, asc=False), 1, degree).alias("near"))


def descend(graph: DataFrame, small: DataFrame, degree: int, reverse: int, turn: int) -> DataFrame:
    """One round: (id, near, changed) after the members of each neighbourhood have met.

    small: (id, q, scale), the vectors as bytes.
    """
    edges = graph.select(F.col("id").alias("a"), F.explode("near").alias("e")).select("a", F.col("e.id").alias("b"), F.col("e.fresh").alias("fresh"))
    # some of those that have a class as their neighbour: a bounded random choice, two steps for hubs
    back = edges.groupBy("b", F.pmod(F.xxhash64(F.lit(turn), "a"), F.lit(16)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(turn), "a", "b").alias("o"), F.col("a").alias("a"), "fresh"))), 1, reverse).alias("m"))
    back = back.groupBy("b").agg(F.slice(F.sort_array(F.flatten(F.collect_list("m"))), 1, reverse).alias("m")).select(F.col("b").alias("mid"), F.explode("m").alias("m")).select("mid", F.col("m.a").alias("id"), F.col("m.fresh").alias("fresh"))
    members = edges.select(F.col("a").alias("mid"), F.col("b").alias("id"), "fresh").union(back)
    low = graph.select("id", F.when(F.size("near") >= degree, F.array_min(F.transform("near", lambda x: x["s"]))).otherwise(F.lit(-3e38)).cast("float").alias("low"))
    known = small.join(low, "id")
    met = members.join(known, "id").groupBy("mid").agg(F.collect_list(F.struct("id", "fresh", "low", "scale", "q")).alias("m"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, c, s = [], [], []
            for rows in b["m"]:
                ids = np.array([r["id"] for r in rows])
                ids, first = np.unique(ids, return_index=True)
                rows = [rows[i] for i in first]
                fresh = np.array([r["fresh"] for r in rows])
                floor = np.array([r["low"] for r in rows], np.float32)
                sizes = {len(r["q"]) for r in rows}
                if len(ids) < 2 or len(sizes) > 1 or not fresh.any():
                    continue
                x = np.frombuffer(b"".join(r["q"] for r in rows), np.int8).reshape(len(rows), -1).astype(np.float32) * np.array([r["scale"] for r in rows], np.float32)[:, None]
                score = x @ x.T
                score[~(fresh[:, None] | fresh[None])] = -np.inf
                np.fill_diagonal(score, -np.inf)
                cols = best(score, 5)
                took = np.take_along_axis(score, cols, 1)
                i, j = np.nonzero(took > floor[:, None])
                a.append(ids[i])
                c.append(ids[cols[i, j]])
                s.append(took[i, j])
            if a:
                yield pd.DataFrame({"id": np.concatenate(a), "b": np.concatenate(c), "s": np.round(np.concatenate(s), 4)})

    found = met.select("m").mapInPandas(join, "id long, b long, s float").groupBy("id", "b").agg(F.max("s").alias("s"))
    found = found.groupBy("id").agg(F.collect_list(F.struct("s", F.col("b").alias("id"), F.lit(True).alias("fresh"))).alias("more"))
    joined = graph.select("id", "near").join(found, "id", "left")
    old = F.transform("near", lambda x: x["id"])
    kept = F.transform("near", lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"), F.lit(False).alias("fresh")))
    more = F.filter(F.coalesce("more", F.array().cast("array<struct<s:float,id:long,fresh:boolean>>")), lambda x: ~F.array_contains(old, x["id"]))
    near = F.slice(F.sort_array(F.concat(kept, more), asc=False), 1, degree)
    return joined.select("id", near.alias("near")).withColumn("changed", F.size(F.filter("near", lambda x: x["fresh"])))


def build(index: DataFrame, classes: int, degree: int, rounds: int, least_change: float, reverse: int) -> DataFrame:
    """(id, near): the neighbour graph of ``classes`` classes. index: (shard, id, v, blocks)."""
    graph = cut(start(index, degree), "graph")
    top = F.array_max(F.transform("v", lambda x: F.abs(x))) / 127

    @F.pandas_udf("binary")
    def quantise(v: pd.Series, scale: pd.Series) -> pd.Series:
        return pd.Series([np.rint(np.asarray(x, np.float32) / t).astype(np.int8).tobytes() for x, t in zip(v, scale, strict=True)])

    small = cut(index.select("id", top.cast("float").alias("scale"), quantise("v", top).alias("q")), "small")
    for turn in range(rounds):
        after = cut(descend(graph, small, degree, reverse, turn), "graph")
        changed = after.agg(F.sum("changed").alias("n")).first()["n"] or 0
        drop(graph)
        graph = after.drop("changed")
        if changed < least_change * classes * degree:
            break
    drop(small)
    return graph.select("id", F.transform("near", lambda x: x["id"]).alias("near"))


def write_shards(held: DataFrame, folder: str, degree: int) -> DataFrame:
    """(shard, path): each shard of ``held`` (shard, id, v, near) as a file below ``folder``.

    A task that runs again writes a new file; only those in the result count.
    """

    def save(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        ids, x = own["id"].to_numpy(), matrix(own["v"])
        near = [np.asarray([] if y is None else y, np.int64) for y in own["near"]]
        data, path = io.BytesIO(), f"{folder}/{uuid.uuid4().hex}.npz"
        np.savez(data, ids=ids, x=x, near=neighbourhoods(ids, near, degree))
        fs, at = open_fs(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at, compression=None) as f:
            f.write(data.getbuffer())
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "path": [path]})

    return cut(held.groupBy("shard").applyInPandas(save, "shard long, path string"), "shards")


def neighbourhoods(ids: np.ndarray, near: list[np.ndarray], degree: int) -> np.ndarray:
    """For each class the places of its neighbours and of up to ``degree`` classes that have it as theirs; filled up with len(ids)."""
    n = len(ids)
    a, b = np.repeat(np.arange(n), [len(y) for y in near]), np.concatenate([*near, np.empty(0, np.int64)])
    at = np.minimum(np.searchsorted(ids, b), max(0, n - 1))
    held = ids[at] == b if n else np.empty(0, bool)
    a, b = a[held], at[held]
    out = np.full((n, 2 * degree), n, np.int32)
    for x, y, column in ((a, b, 0), (b, a, degree)):
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        some = place < degree
        out[x[some], column + place[some]] = y[some]
    return out


@lru_cache(1)
def walker(path: str) -> "Walker":
    """The shard of a file; a worker process keeps the last one."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        held = np.load(io.BytesIO(f.read()))
    return Walker(held["ids"], held["x"], held["near"])


class Walker:
    """Greedy search of a shard: ids, vectors and neighbourhoods of its classes. ``scored`` counts the vectors compared with a query."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray):
        self.ids, self.x, self.n, self.scored = ids, x, len(ids), 0
        self.near = np.concatenate([near, np.full_like(near[:1], len(ids))])  # the place len(ids) stands for none

    def search(self, q: np.ndarray, home: np.ndarray, k: int, beam: int, width: int = 16) -> list[list[tuple[int, float]]]:
        """For each query (row of q, whose own class is ``home`` or -1) its k best (id, score) found, best first; scores in double precision."""
        nq, n, x = len(q), self.n, self.x
        row = np.arange(nq)[:, None]
        place = np.minimum(np.searchsorted(self.ids, home), n - 1)
        here = self.ids[place] == home
        begin = np.random.Generator(np.random.PCG64(1)).permutation(n)[:48]
        own = np.where(here[:, None], self.near[place], n)
        at = np.concatenate([np.where(here, place, n)[:, None], own, np.broadcast_to(begin, (nq, len(begin)))], 1)
        at.sort(axis=1)
        at[:, 1:][at[:, 1:] == at[:, :-1]] = n
        score = np.einsum("qkd,qd->qk", x[np.minimum(at, n - 1)], q)
        score[at == n] = -np.inf
        self.scored += int((at < n).sum())
        seen = np.zeros((nq, n + 1), bool)
        seen[row, at] = True
        seen[:, n] = False
        done = at == n
        while True:
            pick = np.where(done, -np.inf, score)
            cols = best(pick, width)
            live = np.take_along_axis(pick, cols, 1) > -np.inf
            if not live.any():
                break
            np.put_along_axis(done, cols, True, 1)
            new = np.where(live[:, :, None], self.near[np.take_along_axis(at, cols, 1)], n).reshape(nq, -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new[seen[row, new]] = n
            seen[row, new] = True
            seen[:, n] = False
            keep = new.min(axis=0) < n
            new = new[:, keep]
            self.scored += int((new < n).sum())
            if new.shape[1]:
                s = np.einsum("qkd,qd->qk", x[np.minimum(new, n - 1)], q)
                s[new == n] = -np.inf
                at, score, done = np.concatenate([at, new], 1), np.concatenate([score, s], 1), np.concatenate([done, new == n], 1)
            if at.shape[1] > beam:
                cols = best(score, beam)
                at, score, done = (np.take_along_axis(y, cols, 1) for y in (at, score, done))
        out = []
        for i in range(nq):
            found = at[i][score[i] > -np.inf]
            exact = (x[found].astype(np.float64) * q[i].astype(np.float64)).sum(1)
            order = np.lexsort((self.ids[found], -exact))[:k]
            out.append([(int(self.ids[found[j]]), float(exact[j])) for j in order])
        return out


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    shard_rows: int = 65_536,
    block_rows: int = 1024,
    degree: int = 24,
    reverse: int = 16,
    rounds: int = 5,
    least_change: float = 0.05,
    beam: int = 400,
    query_rows: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score. A query isn't its own neighbour."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    index = cut(classes(rows, k + 1), "classes")
    total = index.count()
    shard = F.size("v") * F.lit(STRIDE) + F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // shard_rows))))
    index = cut(index.withColumn("shard", shard), "index")
    sizes = cut(index.groupBy("shard").agg(F.greatest(F.lit(8), F.ceil(F.count("*") / block_rows)).alias("blocks")), "sizes")
    dealt = index.select("shard", "id", "v").join(small_side(sizes, 16), "shard")
    graph = build(dealt, total, degree, rounds, least_change, reverse)
    files = write_shards(dealt.drop("blocks").join(graph, "id", "left"), fresh_path(spark, "shard-files"), degree)

    own = index.select("v", F.col("id").alias("home"))
    asked = cut(valid(queries, id_col, vector_col).join(own, "v", "left"), "queries")
    parts = max(1, -(-asked.count() // query_rows))
    here = F.shiftright(F.col("shard"), 32) == F.size("v")
    each = asked.join(small_side(files, 160), here).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(parts)).cast("int"))

    def walk(ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = walker(ask["path"].iat[0])
        for i in range(0, len(ask), 128):
            some = ask.iloc[i : i + 128]
            found = held.search(matrix(some["v"]), some["home"].fillna(-1).to_numpy(np.int64), k + 1, beam)
            out += [(int(q), c, s) for q, hits in zip(some["id"], found, strict=True) for c, s in hits]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    hits = each.repartition(parts, "path", "part").groupBy("path", "part").applyInPandas(walk, "query_id long, id long, score double")
    hits = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k + 1).alias("top"))
    hits = hits.select("query_id", F.explode("top").alias("t")).select("query_id", (-F.col("t.s")).alias("score"), F.col("t.id").alias("id"))
    each = hits.join(index.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    ranked = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
