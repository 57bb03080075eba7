"""Providers, report building, audited edges, loading, the command line and long-text processing."""

import hashlib
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from canopyloom import __main__ as cli
from canopyloom import schema
from canopyloom.functions import vectors as v
from canopyloom.operators import graph, hierarchy, providers, reports
from canopyloom.params import GraphParams, MicroParams, ReportParams, from_environment
from canopyloom.plans import answer, build
from canopyloom.sources import io, tables, views

FAST = providers.Limits(retries=3, first_wait=0.0, most_wait=0.0, busy_wait=0.0)


def stub(prompt: str) -> str:
    """Says how long what it read is, so that every context can be checked."""
    if "broken" in prompt:
        raise ValueError("no")
    told = hashlib.md5(prompt.encode()).hexdigest()
    return told if prompt.startswith("Summarise") else "```json\n" + json.dumps({"title": "T", "summary": told, "findings": [{"summary": "a", "explanation": "b"}]})[:-1] + ",}\n```"


def vector_of(text: str) -> list[float]:
    return [float(len(text)), 1.0, 2.0]


def say(prompt: str) -> str:
    return "answered: " + prompt[-20:]


def test_errors_become_rows_and_busy_waits(spark):
    def model(prompt: str) -> str:
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    rows = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", None)], "id string, prompt string")
    got = {r["id"]: (r["answer"], r["error"]) for r in providers.call(rows, model, FAST).collect()}
    assert got == {"1": ("OK", None), "2": (None, "ValueError: no"), "3": ("", None)}
    assert providers.call(rows.limit(0), model, FAST).count() == 0
    waits, turns = [], iter([providers.Busy(7.0), RuntimeError("x"), None])

    def odd(prompt: str) -> str:
        e = next(turns)
        if e:
            raise e
        return "done"

    limits = providers.Limits(retries=3, first_wait=2.0, most_wait=3.0)
    assert providers.ask(odd, "p", limits, providers.Pause(), waits.append) == ("done", None)
    assert waits[0] == pytest.approx(7.0, abs=0.5) and 1.5 <= waits[1] <= 3.0


def test_what_is_in_flight_is_bounded():
    gate, now, most, lock = providers.InFlight(3, 10), [0, 0], [0, 0], threading.Lock()

    def work(tokens: int) -> None:
        with gate.hold(tokens):
            with lock:
                now[0], now[1] = now[0] + 1, now[1] + min(tokens, 10)
                most[0], most[1] = max(most[0], now[0]), max(most[1], now[1])
            time.sleep(0.005)
            with lock:
                now[0], now[1] = now[0] - 1, now[1] - min(tokens, 10)

    threads = [threading.Thread(target=work, args=(n,)) for n in [1, 4, 6, 50, 3, 3, 9, 2, 2, 2, 1, 0] * 3]
    for x in threads:
        x.start()
    for x in threads:
        x.join(20)
    assert 1 < most[0] <= 3 and most[1] <= 10 and now == [0, 0]


def brute_reports(units, comm, p):
    """The same, community by community, in plain Python."""
    made = {}
    for level in (2, 1, 0):
        for c in [c for c in comm.values() if c["level"] == level]:
            if level:
                own = sorted((str(u["doc_id"]), u["text"]) for u in units if u["community_id"] == c["id"]) if c["is_leaf"] else sorted((str(u["doc_id"]), f"【小类：{comm[u['community_id']]['title']}】{u['text']}") for u in units if comm[u["community_id"]]["parent_id"] == c["id"])
                texts = [x for _, x in own]
            else:
                texts = [f"【{made[k]['title']}】: {made[k]['summary']}" for k in sorted(made) if comm[k]["parent_id"] == c["id"] and comm[k]["level"] == 1]
            total = sum(map(len, texts))
            bins = [[]]
            limit = total / -(-total // p.target) * p.slack if total > p.single_bin else float("inf")
            for x in texts:
                if bins[-1] and sum(map(len, bins[-1])) + len(x) > limit:
                    bins.append([])
                bins[-1].append(x)
            if len(bins) > 1:
                asked = [build.PROMPTS["map"].format(title=c["title"], context="\n\n".join(x)) for x in bins]
                prompt = build.PROMPTS["reduce"].format(title=c["title"], context="\n\n".join(build.FAILED if "broken" in x else stub(x) for x in asked))
            else:
                prompt = build.PROMPTS["sparse" if total < p.sparse else "standard"].format(title=c["title"], context="\n\n".join(texts) if texts else reports.EMPTY_CONTEXT)
            failed = "broken" in prompt
            made[c["id"]] = {"title": c["title"] if failed else "T", "summary": build.FAILED if failed else hashlib.md5(prompt.encode()).hexdigest()}
    return {k: x["summary"] for k, x in made.items()}


def test_reports_bottom_up_against_plain_python(spark, small):
    p = ReportParams(single_bin=6000, target=4000)
    units = views.units(spark, small).select("doc_id", "text", "community_id", "path")
    units = units.withColumn("text", F.when(F.col("doc_id").isin(4, 8), "broken").otherwise(F.col("text")))
    comm = views.communities(spark, small)
    got = build.build_reports(units, comm, stub, reports.stub_embedder(8), p, FAST).collect()
    want = brute_reports([r.asDict() for r in units.collect()], {r["id"]: r.asDict() for r in comm.collect()}, p)
    assert {r["community_id"]: r["summary"] for r in got} == want and len(got) == len(want)
    failed = [r for r in got if r["summary"] == build.FAILED]
    assert len(failed) >= 1 and all(r["embedding"] is None and r["findings"] == "[]" and not r["full_content"] for r in failed)
    assert all(len(r["embedding"]) == 8 and r["full_content"].startswith("# T\n\n## Summary\n") for r in got if r["summary"] != build.FAILED)
    done = io.complete(spark.createDataFrame([(r["summary"],) for r in got], "summary string"), comm, [build.FAILED]).first()
    assert not done["complete"] and done["n_errors"] == len(failed)


def test_audited_edges_resume(spark):
    cand = spark.createDataFrame([(0, 1, "a", "b", 0.5, "x", "y"), (0, 2, "a", "c", 0.6, "x", "broken"), (1, 2, "b", "c", 0.7, "y", "z"), (2, 3, "c", "d", 0.8, "x", "none")], "i int, j int, source string, target string, vector_score double, source_text string, target_text string")

    def judge(prompt: str) -> str:
        if "broken" in prompt:
            raise ValueError("no")
        return "I can't say" if "none" in prompt else '{"score": 8, "direction": "forward", "relation_type": "near",}'

    done = spark.createDataFrame([(0, 1)], "i int, j int")
    edges, finished = build.audited_edges(cand, done, judge, GraphParams(), FAST)
    assert [tuple(r)[:4] for r in edges.collect()] == [("b", "c", 0.8, "near")] and [tuple(r) for r in finished.collect()] == [(1, 2)]
    assert len(build.audited_edges(cand, None, judge, GraphParams(), FAST)[0].collect()) == 2


def test_long_texts_are_reassembled_before_fusion(spark):
    long_ = "".join(chr(0x4E00 + i) for i in range(900))
    chunks = [long_[i : i + 300] for i in (0, 200, 400, 600)]
    vectors = [[0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]
    units = spark.createDataFrame([("u", "天/日", chunks, vectors, ""), ("s", "天/日", [], None, "史记"), ("n", "天", chunks, vectors[:2], "")], "id string, path string, text_chunks array<string>, chunk_vectors array<array<float>>, prepend string")
    rows = spark.createDataFrame([(0, "u", long_), (1, "s", "short"), (2, "summary_x", long_), (3, "n", long_)], "seq int, id string, text string")
    got = {r["id"]: (r["text"], r["original_length"]) for r in answer.process(rows, units, [1.0, 0.0]).collect()}
    assert got["u"] == (f"[天·日] {long_[:200]} ...[检索定位] {chunks[1]} ... {long_[-100:]}", 900)
    assert got["s"] == ("史记short", 5) and got["summary_x"] == (long_, 900)
    assert got["n"][0] == f"[天] {long_[:200]} ...[检索定位] {long_} ... {long_[-100:]}"


def corpus(spark, folder: str, small: str) -> None:
    units, comm = views.vectors(spark, small), views.communities(spark, small)
    three = F.array(*(F.col("vector")[i] for i in range(3))).cast("array<float>")
    units.select("id", "text", three.alias("vector"), "community_id", F.col("path").alias("hierarchy_path"), F.lit('["a"]').alias("text_chunks")).write.parquet(f"{folder}/text_units.parquet")
    comm.drop("is_leaf").withColumn("child_ids", F.to_json("child_ids")).write.parquet(f"{folder}/communities.parquet")
    r = views.reports(spark, small).withColumn("embedding", F.slice("embedding", 1, 3)).select("community_id", "title", "level", "summary", "full_content", "embedding")
    r.withColumn("summary", F.lit("old")).coalesce(1).write.parquet(f"{folder}/reports.parquet")
    time.sleep(0.01)
    r.coalesce(1).write.mode("append").parquet(f"{folder}/reports.parquet")


def test_loading_and_the_command_line(spark, small, tmp_path, capsys, monkeypatch):
    folder = str(tmp_path / "corpus")
    corpus(spark, folder, small)
    c = tables.load_all(spark, folder)
    assert c.relationships is None and c.communities.columns == [x.split()[0] for x in schema.COMMUNITIES.split(", ")]
    first = c.text_units.first()
    assert first["text_chunks"] == ["a"] and first["chunk_vectors"] is None and first["prepend_source"] is False
    assert c.reports.count() == c.reports.select("community_id").distinct().count() == views.reports(spark, small).count()
    assert c.communities.filter("is_leaf <> (size(child_ids) = 0)").isEmpty()
    own = ["--embed", "tests.test_build:vector_of", "--generate", "tests.test_build:say", "--format", "json", "--micro-threshold", "-1", "--cache", str(tmp_path / "cache")]
    monkeypatch.setenv("CANOPYLOOM_MICRO_BUDGET", "2500")
    assert cli.main([folder, "What is there?", *own], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["response"].startswith("answered: ") and told["statistics"]["context_chars"] <= 2600 and told["statistics"]["retrieval_count"] > 0
    assert cli.main([folder, "q", *own, "--output", str(tmp_path / "out.txt")], spark) == 0 and (tmp_path / "out.txt").exists()
    assert cli.main([folder + "-none", "q", *own], spark) == 1 and cli.main([folder], spark) == 2


def test_environment():
    p = from_environment(MicroParams, "micro", {"CANOPYLOOM_MICRO_GRAPH": "no", "CANOPYLOOM_MICRO_THRESHOLD": "0.5", "CANOPYLOOM_MACRO_BUDGET": "1"})
    assert (p.graph, p.threshold, p.budget) == (False, 0.5, 32_000)
    for bad in ({"CANOPYLOOM_MICRO_GRAPH": "perhaps"}, {"CANOPYLOOM_MICRO_BUDGET": "x"}):
        with pytest.raises(ValueError):
            from_environment(MicroParams, "micro", bad)


def test_persistent_cache(tmp_path):
    cache = tables.QueryCache(str(tmp_path / "c"))
    one = answer.expand_query("q", answer.translator(lambda p: "a b"), cache)
    again = answer.expand_query("q", answer.translator(lambda p: 1 / 0), tables.QueryCache(str(tmp_path / "c")))
    assert one == again and again.expanded == "q a b" and len(cache) == 1
    key = next(iter(cache))
    (tmp_path / "c" / f"{key}.json").write_text("{broken")
    assert key not in cache
    del cache[key]
    assert len(cache) == 0


def test_batch_generation_and_embedder(spark):
    rows = spark.createDataFrame([("1", "context", "q1"), ("2", "x" * 50, "q2"), ("3", None, "q")], "id string, context string, query string")
    got = {r["id"]: r for r in answer.generate_all(rows, "micro", lambda p: p[-30:], FAST, budget=20).collect()}
    assert got["1"]["error"] is None and got["1"]["answer"] and got["2"]["answer"] is None and "20" in got["2"]["error"] and got["3"]["error"]
    texts = spark.createDataFrame([("1", "abc"), ("2", ""), ("3", None)], "id string, text string")
    assert {r["id"]: r["vector"] for r in providers.embedder(lambda t: [float(len(t))], FAST)(texts).collect()} == {"1": [3.0], "2": None, "3": None}


def test_graph_files(spark, tmp_path):
    comm = spark.createDataFrame([("r", "R", 0, None), ("a", "A", 1, "r"), ("b", "B", 1, "r"), ("c", "C", 2, "a")], "id string, title string, level int, parent_id string")
    edges = spark.createDataFrame([("a", "b", 0.7), ("a", "c", 0.9), ("r", "a", 0.9)], "source_id string, target_id string, weight double")
    at = tables.write_graph(comm, hierarchy.lineage(comm), edges, str(tmp_path))
    read = lambda p: [r[0] for r in spark.read.text(p).collect()]
    assert read(at["macro"][0])[0] == "id\tlabel\tdescription\tcluster\tweight" and len(read(at["macro"][0])) == 3 and read(at["macro"][1]) == ["1\t2\t0.7"]
    assert len(read(at["full"][0])) == 4 and sorted(read(at["full"][1])) == ["1\t2\t0.7", "1\t3\t0.9"]


def test_vector_summary_counts_chunks(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0], [2.0]]), ([0.0], None)], "v array<double>, c array<array<double>>")
    got = [r["s"].asDict() for r in df.select(v.summary(F.col("v"), F.col("c")).alias("s")).collect()]
    assert [(x["norm"], x["is_zero"], x["chunk_count"]) for x in got] == [(5.0, False, 2), (0.0, True, 0)]


def test_cycles(spark):
    comm = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None), ("d", "d")], "id string, parent_id string")
    assert sorted(r["id"] for r in hierarchy.cycles(comm).collect()) == ["a", "b", "d"]
    assert graph.reciprocity is not None
