"""Small cases worked out by hand."""

import random
import time
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from canopyloom.functions import filters
from canopyloom.functions import text as t
from canopyloom.functions import vectors as v
from canopyloom.operators import fusion, graph, reports, retrieve
from canopyloom.params import GraphParams
from canopyloom.plans import answer


def value(spark, column, **cols):
    df = spark.range(1).select(*(F.lit(x).alias(k) for k, x in cols.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,spans", [(500, []), (501, [(0, 300), (200, 500), (201, 501)]), (700, [(0, 300), (200, 500), (400, 700)]), (900, [(0, 300), (200, 500), (400, 700), (600, 900)])])
def test_chunks(spark, n, spans):
    x = "".join(chr(0x4E00 + i) for i in range(n))
    assert value(spark, t.chunks(F.col("x")), x=x) == [x[a:b] for a, b in spans]


def test_strip_and_source(spark):
    assert value(spark, t.strip(F.col("x")), x="　 a b \n　") == "a b"
    assert value(spark, t.normalize_source(F.col("x")), x=" 史记 ·天官") == "史记"


@pytest.mark.parametrize("scores,total,want", [([0.9, 0.8, 0.7], 19, [7, 6, 6]), ([0.5, 0.5], 5, [2, 3]), ([0.9, 0.02, 0.02], 19, [18, 1, 1]), ([1.0, 1.0, 1.0], 2, [1, 1, 1]), ([0.0, 0.0], 5, [2, 2])])
def test_quotas(spark, scores, total, want):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "rank int, score double")
    assert [r["quota"] for r in retrieve.quotas(df, total).orderBy("rank").collect()] == want


def test_fill_goes_on_to_later_communities(spark):
    lengths = [[400, 700, 100], [300, 900], [250]]
    offers = spark.createDataFrame([(f"c{i}", k, f"u{i}{k}", "x" * n, 1.0) for i, own in enumerate(lengths) for k, n in enumerate(own)], "community_id string, place int, id string, text string, score double")
    comm = spark.createDataFrame([(f"c{i}", i) for i in range(3)], "community_id string, rank int")
    assert [r["id"] for r in retrieve.fill(offers, comm, 1000).orderBy("seq").collect()] == ["u00", "u10", "u20"]


def test_packed_groups_equal_next_fit_in_linear_time(spark):
    r = random.Random(5)
    own = [(g, k, r.choice([0, 5, 900, 4000, 13_000])) for g, n in (("a", 60_000), ("b", 3), (None, 40), ("", 300)) for k in range(n)]
    want = []
    for name in ("a", "b", None, ""):
        rows = [x for x in own if x[0] == name]
        total = sum(n for *_, n in rows)
        limit = total / -(-total // 12_000) * 1.1 if total > 15_000 else float("inf")
        at = cur = 0
        for g, k, n in rows:
            at, cur = (at + 1, n) if cur > 0 and cur + n > limit else (at, cur + n)
            want.append((g, k, n, at))
    r.shuffle(own)
    start = time.monotonic()
    got = reports.packed(spark.createDataFrame(own, "g string, k long, n int"), "g", "k", F.col("n")).collect()
    assert Counter(map(tuple, got)) == Counter(want) and time.monotonic() - start < 40


@pytest.mark.parametrize("lengths,want", [([7000, 8000], [0, 0]), ([20000], [0]), ([9000] * 3, [0, 1, 2]), ([6000] * 5, [0, 1, 2, 3, 4])])
def test_bins(spark, lengths, want):
    df = spark.createDataFrame([(lengths,)], "n array<int>")
    assert df.select(reports.bins(F.col("n")).alias("b")).first()["b"] == want


def test_histogram_and_describe(spark):
    e = spark.createDataFrame([(w,) for w in (0.59, 0.6, 0.7, 0.7, 0.8, 0.85, 0.9, 1.0, 1.01)], "weight double")
    assert [r["n"] for r in graph.histogram(e).orderBy("bin").collect()] == [3, 1, 2, 1]
    d = graph.describe(spark.createDataFrame([(w,) for w in (0.7, 0.8, 0.9, 1.0)], "weight double")).first()
    assert (d["mean"], d["std"], d["q25"], d["q50"]) == (0.85, 0.13, 0.78, 0.85)
    assert d["q75"] == pytest.approx(0.925, abs=0.0051)


def test_reciprocity(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("E", "F"), ("E", "F")], "source_id string, target_id string")
    assert graph.reciprocity(e.limit(3)).first().asDict() == {"bidirectional": 1, "unidirectional": 1, "ratio": 0.5}
    assert graph.reciprocity(e).first()["bidirectional"] == 2 and graph.reciprocity(e, strict=True).first()["bidirectional"] == 1


def test_edge_emission(spark):
    rows = [("A", "B", s, d, "t", 0.5) for s, d in ((6, "forward"), (7, "forward"), (8, "backward"), (9, "odd"))]
    e = graph.emit_edges(spark.createDataFrame(rows, "source string, target string, score int, direction string, relation_type string, vector_score double"))
    assert sorted((r["source_id"], r["target_id"], r["weight"]) for r in e.collect()) == [("A", "B", 0.7), ("A", "B", 0.9), ("B", "A", 0.8), ("B", "A", 0.9)]


def test_findings(spark):
    cases = {"": 0, "oops": 0, '{"summary":"a"}': 0, "[1]": 0, '[{"summary":"a"}]': 0, '[{"summary":"a","explanation":"b"}]': 1}
    for x, n in cases.items():
        assert len(value(spark, t.findings(F.col("x")), x=x)) == n, x


def test_filters(spark):
    x = F.col("x")
    assert value(spark, filters.keyword_filter(x, must=["sun", "MOON"], any_of=["star", "moon"]), x="Sun and Moon")
    assert not value(spark, filters.keyword_filter(x, must_not=["AND"]), x="Sun and Moon")
    assert [value(spark, filters.scope_filter(x, ["天部"]), x=p) for p in ("天部/日", "天部外/x", "", "地部")] == [True, True, True, False]
    assert value(spark, filters.composite(x, x, x), x="a")


def test_overlap_and_reassembly(spark):
    assert value(spark, t.overlap(F.col("a"), F.col("b")), a="x" * 300, b="x" * 200) == pytest.approx(2 / 3)
    long_ = "".join(chr(0x4E00 + i) for i in range(800))
    args = [F.lit(x) for x in (long_, long_[:200], long_[-100:], "BEST", long_[:240], "zz", "[p] ")]
    assert value(spark, fusion.reassemble(*args), x=1) == "[p] BEST ... " + long_[-100:]
    assert value(spark, fusion.reassemble(F.lit("short"), *args[1:]), x=1) == "[p] short"


def test_fusion_keeps_the_anchor_and_its_relations(spark):
    kind = "seq long, id string, text string, score double, source_type string, relation_type string, weight double, anchor_title string"
    rows = spark.createDataFrame([(0, "a", "x", 0.8, "neighbor", "r", 0.9, "t"), (1, "a", "x", 0.8, "anchor", None, None, None), (2, "b", "y", 0.8, "neighbor", "r", 0.9, "t")], kind)
    got = {r["id"]: r for r in fusion.rank(fusion.deduplicate(rows)).collect()}
    assert got["a"]["source_type"] == "anchor" and got["a"]["seq"] == 0 and len(got["a"]["additional_relations"]) == 1
    assert got["b"]["adjusted"] == pytest.approx(0.648)


def test_render_empty(spark):
    empty = spark.createDataFrame([], "position int, id string, text string, path string, prepend string, tag string, score double, source_type string, community_id string")
    assert fusion.render_micro(empty).first()["context"] == "" and fusion.render_macro(empty).first()["context"] == ""


def test_placeholder(spark):
    rows = [(None,), ([],), ([0.0, 1e-9],), ([0.0, 0.1],)]
    df = spark.createDataFrame(rows, "x array<double>")
    assert [r["p"] for r in df.select(v.is_placeholder(F.col("x")).alias("p")).collect()] == [True, True, True, False]


def _replay(edges: dict, hubs: list, hops: int = 3) -> set:
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    gone = set()
    for hub in sorted(hubs):
        own = sorted((edges[min(hub, y), max(hub, y)], y) for y in list(near.get(hub, ())))
        for w, y in own:
            if w >= 0.8:
                continue
            near[hub].discard(y)
            near[y].discard(hub)
            seen, queue, found = {hub}, deque([(hub, 0)]), False
            while queue and not found:
                x, k = queue.popleft()
                for z in near[x]:
                    if z == y:
                        found = True
                    elif z not in seen and k + 1 < hops:
                        seen.add(z)
                        queue.append((z, k + 1))
            if found:
                gone.add((min(hub, y), max(hub, y)))
            else:
                near[hub].add(y)
                near[y].add(hub)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_prune_equals_sequential_search(spark, seed):
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(30), 2))): r.choice([0.7, 0.75, 0.8, 0.9]) for _ in range(70)}
    hubs = r.sample(range(30), 4)
    pairs = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, weight double")
    got = graph.prune(pairs, spark.createDataFrame([(h, 1) for h in hubs], "id long, degree long"), GraphParams())
    assert {(r["a"], r["b"]) for r in got.collect()} == _replay(edges, hubs)


def test_detours_of_a_hub_with_many_paths(spark):
    leaves = range(1, 151)  # 0 is linked with all, all with all: millions of paths
    pairs = [(a, b, 0.7 if a == 0 else 0.9) for a in (0, *leaves) for b in leaves if a < b] + [(0, 200, 0.7), (0, 201, 0.9), (201, 202, 0.9), (0, 202, 0.7)]
    df = spark.createDataFrame(pairs, "a long, b long, weight double")
    hubs = spark.createDataFrame([(0, 154)], "id long, degree long")
    got = {(r["a"], r["b"]): r["firm"] for r in graph.detours(df, hubs).collect()}
    assert got == {(0, b): False for b in leaves} | {(0, 202): True}  # 200 has no other path
    gone = {r["b"] for r in graph.prune(df, hubs).collect()}
    assert gone == {*range(1, 150), 202}  # the last leaf keeps its edge


def test_json_repair():
    assert reports.repair_json('```json\n{"a": 1,}\n```') == {"a": 1}
    assert reports.repair_json("[{\"a\": 2}, 3]") == {"a": 2} and reports.repair_json("[]") == {} and reports.repair_json("none") == {}
    assert reports.repair_json('Sure: {"a": "x, }", "b": [1, {"c": "d') == {"a": "x, }", "b": [1, {"c": "d"}]}
    assert reports.repair_json('{"a": "line\nfeed \\" quote"} and {"b": 2}') == {"a": 'line\nfeed " quote'} and reports.repair_json("{broken") == {} and reports.repair_json(None) == {}


def test_answer_parts():
    cache: dict = {}
    assert answer.expand_query("q", lambda q: "a b", cache).expanded == "q a b" and len(cache) == 1
    assert answer.expand_query("z", lambda q: 1 / 0, cache).expanded == "z" and len(cache) == 1
    with pytest.raises(ValueError):
        answer.retriever("other")
    with pytest.raises(ValueError):
        answer.prompt("c", "q", "other")
    result = {"query": "q", "mode": "micro", "translated_query": "q", "response": "r", "statistics": {"retrieval_count": 1, "context_chars": 2, "budget_usage": 3.0}}
    assert all("q" in answer.render(result, k) for k in ("text", "json", "markdown"))


def test_sources(spark, tmp_path):
    from canopyloom.sources import io

    (tmp_path / "a.csv").write_text('l0,l1,l2,text,source,note\n天部,日,,"a\nb",史记,\n', encoding="utf-8")
    row = io.read_corpus(spark, str(tmp_path / "a.csv")).first()
    assert row["text"] == "a\nb" and row["l2"] == "" and row["note"] == ""
    (tmp_path / "b.jsonl").write_text('{"i": 1}\nbroken\n{"i": 2}\n')
    assert io.read_json_lines(spark, str(tmp_path / "b.jsonl"), "i int").filter("i is not null").count() == 2
    with pytest.raises(Exception):
        io.read_json_lines(spark, str(tmp_path / "b.jsonl"), "i int", strict=True).collect()
    df = spark.createDataFrame([(1, "x")], "i int, s string")
    io.append_json_lines(df, str(tmp_path / "log"))
    io.append_json_lines(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    io.write_tsv(df, str(tmp_path / "t"), header=False)
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "1\tx"
