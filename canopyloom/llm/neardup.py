"""Near-duplicates by one-permutation MinHash with optimal densification, exact links and connected components.

1. Documents with equal shingle sets form a class; its smallest id stands for it.
2. Each class gets one hash per bin from a single permutation (the smallest hash in
   each of ``BINS`` ranges); empty bins borrow from a full bin that a fixed random
   sequence names (optimal densification). ``ROWS`` bins make a band.
3. Within the bucket of a band every member is linked to one centre (a star), so the
   number of candidate edges is at most bands x classes. The centre is the member
   whose buckets are largest, which is an original rather than an edited copy.
4. Candidates are confirmed on full shingle sets. Connected components follow by
   label propagation with pointer jumping; each round's tables are written to shared
   storage.
5. A star can miss a link between two members that aren't similar to the centre. So
   in buckets that still hold several components, members outside the largest one are
   compared with all members of other components, in bounded blocks: each pair in the
   first bucket that it shares, small sets whole and others by signature, which loses
   few pairs (see ``alike``). What may reach the threshold is confirmed on full sets
   too: first a forest of each task's pairs, then those that it hasn't joined.

Rules: words are runs of characters other than space and U+0009 to U+000D, A-Z in
lower case. With fewer words than a shingle has, the whole sequence is the one
shingle. Null, empty and blank texts have an empty set and are linked with nothing.
Rows that share an id but not the text are documents of their own, of which any may
be linked; component_id is the smallest id in a row's own group. Rows equal in id and
text are equal in the result. A row with a null id is its own component (component_id
null, kept true). An empty table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyloom.storage import cut, drop, small_side

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
TRIES = 256
#: Sets of up to so many shingles have no signature, which is too coarse for them: they are compared whole.
FEW = 300
#: Standard deviations below the threshold at which a signature still passes.
SIGMAS = 6


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (multiply and shift)."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word; bytes.lower and bytes.split know ASCII only, as the rules ask."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out + words[i : n - size + 1 + i])
    return np.unique(out)


#: For each bin the bins that it borrows from, in turn: a fixed random sequence.
BORROW = np.random.Generator(np.random.PCG64(20240229)).integers(0, BINS, (TRIES, BINS))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One hash per bin of a set's sorted hashes, densified."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    for row in BORROW:
        if not len(empty):
            break
        source = row[empty]
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    out[empty] = hashes[first[0]]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """32 bits for each band: among 10 million sets chance adds 1 in 400 to a bucket, which the sizes and the confirmation take out."""
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out + rows[:, i])
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame, shingle: int, few: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), bands, and for comparisons few (32 bits a shingle, up to ``few`` shingles) and sig (16 bits a bin, above ``FEW``); sets between the two sizes meet both kinds and have both."""
    schema = "doc_id long, n_shingles long, set_key binary, bands array<int>, sig binary, few binary"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingle_set(t, shingle)
                if len(s):
                    sig = signature(s)
                    coarse = mix(sig).astype(np.uint16).tobytes() if len(s) > FEW else None
                    whole = (s >> np.uint64(32)).astype(np.uint32).tobytes() if len(s) <= few else None
                    rows.append((len(s), xxh3_128_digest(s.tobytes()), bands(sig), coarse, whole))
                else:
                    rows.append((0, None, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "bands", "sig", "few"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.mapInPandas(task, schema)


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int, most: int = 1 << 19) -> DataFrame:
    """(id, set) of the documents in ``ids`` (id), one row an id; handed on whenever ``most`` shingles have gathered, not a batch at a time."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets, n, at = [], 0, 0
            for i, t in enumerate(b["text"], 1):
                sets.append(shingle_set(t, shingle).view(np.int64))
                n += len(sets[-1])
                if i == len(b) or n >= most:
                    yield pd.DataFrame({"id": b["doc_id"].iloc[at:i].to_numpy(), "set": sets})
                    sets, n, at = [], 0, i

    wanted = docs.join(small_side(ids, 16), docs.doc_id == ids.id, "left_semi")
    return wanted.mapInPandas(task, "id long, set array<long>")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``edges`` whose sets have 100 * intersection >= percent * union.

    Columns only: batches of pairs of sets for Python took hundreds of MB of an executor.
    """
    with_b = edges.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    na, nb, inner = (F.size(x).cast("long") for x in ("sa", "sb", F.array_intersect("sa", "sb")))
    # sizes first: a ratio of sizes below the threshold can't reach it
    fits = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return both.filter(fits).filter((100 + percent) * inner >= percent * (na + nb)).select("a", "b")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, label): each node of ``edges`` (a, b) with the smallest id it is connected to.

    Labels spread over edges by a minimum with partial sums, then jump to their own
    labels; ends when nothing changes. Tables of each round lie in shared storage.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "both")
    now = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), name)
    while True:
        seen = both.join(now.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("old"))
        low = now.select("id", "label", F.col("label").alias("old")).union(seen).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = now.select(F.col("id").alias("l"), F.col("label").alias("up"))
        after = cut(low.join(up, F.col("label") == F.col("l")).select("id", F.least("label", "up").alias("label"), "old"), name)
        changed = not after.filter("label <> old").isEmpty()
        drop(now)
        now = after.select("id", "label")
        if not changed:
            drop(both)
            return now


def buckets_of(rows: DataFrame) -> DataFrame:
    """(band, hash, id, n, mass) of the buckets with several members; mass: the sizes of all of an id's buckets together."""
    shared = cut(rows.groupBy("band", "hash").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    kept = cut(rows.join(shared, ["band", "hash"]), "kept")
    mass = cut(kept.groupBy("id").agg(F.sum("m").alias("mass")), "mass")
    out = cut(kept.select("band", "hash", "id", "n").join(mass, "id"), "bands")
    drop(shared, kept, mass)
    return out


def stars(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate edges (a < b): each bucket's members with its centre, the member with the largest mass, then the smallest id, where sizes allow a link.

    An original lies in the largest bucket of every band, so it outweighs its edited
    copies, which may be alike to it but not to each other.
    """
    centres = rows.groupBy("band", "hash").agg(F.max(F.struct("mass", (-F.col("id")).alias("neg"), "n")).alias("c"))
    pairs = rows.join(centres, ["band", "hash"]).filter(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")).select("id", (-F.col("c.neg")).alias("c")).filter("id <> c")
    return pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def overlaps(own: list[bytes], every: list[bytes], most: int = 1 << 23) -> np.ndarray:
    """How many 32-bit values each set of ``own`` shares with each of ``every``.

    Values that many sets hold are counted by matrix products, the others by their
    sorted places, ``most`` at a time.
    """
    x, y = (np.frombuffer(b"".join(z), np.uint32) for z in (own, every))
    row_x, row_y = (np.repeat(np.arange(len(z)), [len(v) // 4 for v in z]) for z in (own, every))
    order = np.argsort(y, kind="stable")
    y, row_y = y[order], row_y[order]
    lo, hi = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    often = hi - lo
    out = np.zeros((len(own), len(every)), np.float32)
    heavy = often > max(16, len(every) // 8)
    names = np.unique(x[heavy])
    for i in range(0, len(names), 2048):
        part = names[i : i + 2048]
        one, all_ = np.zeros((len(own), len(part)), np.float32), np.zeros((len(every), len(part)), np.float32)
        mine = heavy & (x >= part[0]) & (x <= part[-1])
        one[row_x[mine], np.searchsorted(part, x[mine])] = 1
        to = np.searchsorted(part, y)
        theirs = np.flatnonzero(part[np.minimum(to, len(part) - 1)] == y)
        all_[row_y[theirs], to[theirs]] = 1
        out += one @ all_.T
    light = np.flatnonzero(~heavy & (often > 0))
    ends = np.cumsum(often[light])
    at = 0
    while at < len(light):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        some = light[at:stop]
        n = often[some]
        place = np.arange(int(n.sum())) + np.repeat(lo[some] - np.cumsum(n) + n, n)
        out += np.bincount(np.repeat(row_x[some], n) * len(every) + row_y[place], minlength=out.size).reshape(out.shape)
        at = stop
    return out


def alike(own: np.ndarray, every: np.ndarray, open_: np.ndarray, n: np.ndarray, sig: np.ndarray, few: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of ``open_`` (booleans, own x every) may reach the threshold. own, every: positions in n, sig and few.

    Sizes must allow it. Two small sets are compared whole. Of others, also of a small
    and a large one, the signatures must agree in all but ``SIGMAS`` standard deviations of the threshold's bins; of pairs
    right at 80 % about 1 in 10 million (binomial tail) falls below that, as many as
    share no bucket at all.
    """
    x, y = n[own], n[every]
    open_ = open_ & (100 * np.minimum(x[:, None], y[None]) >= percent * np.maximum(x[:, None], y[None]))
    out = np.zeros_like(open_)
    small, small_too = (np.array([f is not None for f in few[k]], bool) for k in (own, every))
    i = np.flatnonzero(small & (open_ & small_too).any(1))
    j = np.flatnonzero(small_too & (open_ & small[:, None]).any(0))
    if len(i) and len(j):
        both = overlaps(few[own[i]].tolist(), few[every[j]].tolist())
        total = x[i][:, None] + y[j][None] - both
        out[np.ix_(i, j)] = 100 * (both + 1) >= percent * (total - 1)  # one shingle of tolerance for shortened hashes
    coarse = open_ & ~(small[:, None] & small_too)
    large, large_too = np.flatnonzero(coarse.any(1)), np.flatnonzero(coarse.any(0))
    if len(large):
        a, b = (np.frombuffer(b"".join(sig[k]), np.uint16).reshape(len(k), BINS) for k in (own[large], every[large_too]))
        share = percent / 100
        for k, row in zip(large, a, strict=True):
            to = np.flatnonzero(coarse[k, large_too])
            least = share - SIGMAS * np.sqrt(share * (1 - share) / np.minimum(BINS, np.minimum(y[large_too[to]], x[k])))
            out[k, large_too[to]] = (b[to] == row).mean(1) >= least
    return out & open_


def forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which edges (x, y), taken in turn, join two parts that weren't joined before."""
    names, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    root, out = list(range(len(names))), np.zeros(len(x), bool)

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for i, (a, b) in enumerate(both.reshape(2, -1).T.tolist()):
        a, b = top(a), top(b)
        root[a], out[i] = b, a != b
    return out


def across(rows: DataFrame, labels: DataFrame, sigs: DataFrame, percent: int, block: int = 300, tasks: int = 64, *, marked: bool = False) -> DataFrame:
    """Candidate edges (a < b) between different components of a bucket, in blocks.

    The members of a bucket are dealt once over blocks of about ``block``. Those
    outside the bucket's largest component meet every block, so rows are copied in
    proportion to them alone, and a task holds two blocks. A pair is compared in the
    first band whose bucket it shares. sigs: (id, n, bands, sig, few). marked: with
    tree, true for a forest of each task's edges that joins the same components as all of them.
    """
    members = rows.select("band", "hash", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = cut(members, "members")
    sizes = members.groupBy("band", "hash", "label").agg(F.count("*").alias("own"))
    top = F.max(F.struct("own", "label"))["label"]
    mixed = sizes.groupBy("band", "hash").agg(F.sum("own").alias("m"), (F.sum("own") - F.max("own")).alias("rest"), top.alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    parts = [F.ceil(F.col(c) / block).cast("int").alias(name) for c, name in (("m", "parts"), ("rest", "sides"))]
    mixed = cut(mixed.select("band", "hash", "top", "m", "rest", *parts), "mixed")
    dealt = members.join(mixed, ["band", "hash"]).withColumn("mark", F.xxhash64("id", "band")).withColumn("outside", F.col("label") != F.col("top"))
    every = dealt.withColumn("i", F.pmod("mark", "parts").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).withColumn("own", F.lit(False))
    own = dealt.filter("outside").withColumn("j", F.pmod("mark", "sides").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.lit(True))
    ids = cut(dealt.select("id").distinct(), "ids")
    sigs = sigs.join(small_side(ids, 16), "id", "left_semi")
    # small buckets share a group, whose size stays near that of two blocks
    total = mixed.agg(F.sum(F.col("m") * F.col("sides") + F.col("rest") * F.col("parts")).alias("n")).first()["n"] or 0
    pack = F.pmod(F.xxhash64("band", "hash"), F.lit(max(tasks, int(total) // (4 * block)))).alias("pack")
    columns = ["band", "hash", "i", "j", "id", "label", "outside", "own"]
    both = every.select(pack, *columns).union(own.select(pack, *columns)).join(sigs, "id").repartition(tasks, "pack", "i", "j")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["band", "hash"])
        band, ids, label, n = (group[c].to_numpy() for c in ("band", "id", "label", "n"))
        is_own, outside, keys = group["own"].to_numpy(), group["outside"].to_numpy(), np.array(group["bands"].tolist(), np.int64)
        sig, few = group["sig"].to_numpy(object), group["few"].to_numpy(object)
        marks = group["hash"].to_numpy()
        turns = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (band[1:] != band[:-1]), [True]]))
        found = [np.empty((4, 0), np.int64)]
        for lo, hi in zip(turns[:-1], turns[1:], strict=True):
            own, every = lo + np.flatnonzero(is_own[lo:hi]), lo + np.flatnonzero(~is_own[lo:hi])
            # two that are both outside meet twice: the smaller id's turn counts
            open_ = (label[own][:, None] != label[every][None]) & (~outside[every][None] | (ids[own][:, None] < ids[every][None]))
            if band[lo]:
                for k in range(len(own)):
                    to = np.flatnonzero(open_[k])
                    open_[k, to] = (keys[every[to], : band[lo]] != keys[own[k], : band[lo]]).all(1)
            if open_.any():
                i, j = np.nonzero(alike(own, every, open_, n, sig, few, percent))
                found.append(np.stack([ids[own[i]], ids[every[j]], label[own[i]], label[every[j]]]))
        a, b, *ends = np.concatenate(found, 1)
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "tree": forest(*ends)})
        return out.groupby(["a", "b"], as_index=False)["tree"].max()

    out = cut(both.groupBy("pack", "i", "j").applyInPandas(compare, "a long, b long, tree boolean").groupBy("a", "b").agg(F.max("tree").alias("tree")), "across")
    drop(members, mixed, ids)
    return out if marked else out.select("a", "b")


def apart(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The (a, b) of ``edges`` whose ends have different labels; an id without one is its own."""
    a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    ends = edges.join(a, "a", "left").join(b, "b", "left")
    return ends.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def linked(docs: DataFrame, candidates: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The confirmed edges of a table of candidates."""
    ids = cut(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = cut(sets_of(docs, ids, shingle), "sets")
    out = cut(confirm(candidates, sets, percent), "confirmed")
    drop(sets, ids)
    return out


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _groups(docs, shingle, percent)
    # rows are numbered in the stead of ids; a group's smallest id follows from its rows
    rows = cut(docs.withColumn("id", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = cut(_groups(rows.select(F.col("id").alias("doc_id"), "text"), shingle, percent).filter("doc_id is not null").select(F.col("doc_id").alias("id"), "n_shingles", F.col("component_id").alias("part")), "found")
    ids = found.join(rows.select("id", "doc_id"), "id")
    first = ids.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    known = ids.join(first, "part").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return known.union(_groups(rows.filter("id is null").select(F.col("id").alias("doc_id"), "text"), shingle, percent))


def _groups(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` of (doc_id, text), where no id but null stands in several rows."""
    few = -(-FEW * 100 // percent)  # so that a set without ``few`` can't reach one without ``sig``
    sketched = cut(sketch(docs, shingle, few), "sketch")
    # a class's bands come along: a join for them would shuffle all bands, for each use once more
    least = F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands")).alias("c")
    reps = cut(sketched.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(least).select("set_key", "c.*"), "reps")
    classes = reps.select("set_key", "id")
    rows = buckets_of(reps.select("id", "n", F.posexplode("bands").alias("band", "hash")))
    candidates = cut(stars(rows, percent), "candidates")
    first = linked(docs, candidates, shingle, percent)
    labels = components(first)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = across(rows, labels, sketched.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sig", "few"), percent, tasks=tasks, marked=True)
    drop(candidates, rows)
    # the pairs of a group of k are about k * k / 2, but k - 1 confirmed links join it: others count only where those failed
    for tree in (True, False):
        some = cut(apart(rest.filter(F.col("tree") == tree), labels), "apart")
        if not some.isEmpty():
            more = linked(docs, some, shingle, percent)
            if not more.isEmpty():
                links = cut(first.union(more), "links")
                drop(labels, first)
                first, labels = links, components(links)
            drop(more)
        drop(some)
    drop(rest, first)
    out = sketched.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("rep"))
    out = out.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
