"""WARC, quality, decontamination, main text, near-duplicates, nearest neighbours, pipeline."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyloom.llm import decontam, labelled_pages, maintext, neardup, nndescent, quality, queries, warc
from tests.llm import hand_pages
from tests.llm.test_text_ops import DOCS, odd_docs
from tests.oracle import normal, rows_of


def test_warc_matches_sql(spark, small):
    got, want = queries.op2_warc(spark, small).toPandas(), rows_of(queries.ORACLE_SQL["op2_warc"], small)
    assert normal(got) == normal(want)


def test_warc_copies_and_edges(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (2, None, big), (5, "u\r\nX: y", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (5, "u5", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, archive string, frame int").repartition(3)
    index = warc.write(pages, str_path(spark), frame_bytes=2000, archive_bytes=5000)
    got = warc.read(index).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, "revisit", 5), (2, "revisit", 5), (None, "revisit", 5), (5, "response", None), (5, "response", None), (3, "response", None), (4, "response", None), (6, "response", None), (7, "response", None)]
    )
    assert all(r["payload_bytes"] == 1200 and r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() for r in got if r["page_id"] in (1, 2, 5, None))
    for r in index.collect():
        head, http, payload = warc.read_record(r["archive"], r["frame"], r["offset"])
        assert warc.number(head["warc-record-id"]) == r["page_id"]
        assert head["warc-type"] == "revisit" or hashlib.sha1(payload).hexdigest() == r["payload_digest"]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def str_path(spark):
    from canopyloom.storage import fresh_path

    return fresh_path(spark, "warc-test")


def test_warc_frames_are_plain_zstandard(spark):
    import zstandard

    pages = spark.createDataFrame([(i, "u", "x" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    from canopyloom.storage import open_fs

    archive = warc.write(pages, str_path(spark), frame_bytes=900).first()["archive"]
    fs, path = open_fs(archive)
    with fs.open_input_file(path) as f:
        data = f.read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") == 20


def test_quality_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op3_quality(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_scores_against_a_direct_computation(spark):
    """Every score of the query from the fitted model's parts, by plain calls of the library; long texts whole."""
    import zstandard

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in queries.op3_quality(spark, d).collect()}
    assert got.keys() == rows.keys()
    codec = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (model.bad, model.good)]
    for i, text in rows.items():
        data = text.encode()
        parts = [data[k : k + model.chunk] for k in range(0, len(data), model.chunk)]
        bad, good = (max(1, sum(len(c.compress(x)) - 6 for x in parts)) for c in codec)
        n = len(data) + 1
        x = np.clip([(bad - good) / (bad + good), (bad - good) / n, np.log((bad + good) / 2 / n), np.log(n)], model.low, model.high)
        x = np.array([*x, *(x[a] * x[b] for a in range(4) for b in range(a, 4))])
        score = 1 / (1 + np.exp(-np.clip((x - model.mean) / model.scale @ model.weights[1:] + model.weights[0], -30, 30)))
        import zlib

        assert got[i] == (pytest.approx(score, abs=1e-9), int(score >= 0.3), zlib.crc32(str(i).encode()) % 5 == 0)


def test_long_texts(spark):
    """One text of some megabytes through the operators that read texts or pages."""
    text = " ".join(f"word{i % 5000}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (3, "short", "en", "s", 1)], DOCS)
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40)))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.find(docs, items).orderBy("doc_id").collect()] == [(1, 1, 1.0), (2, 1, 1.0)]
    assert [r["component_id"] for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3]
    page = spark.createDataFrame([(1, "u", f"<article><p>{text}</p></article>")], "page_id long, url string, html string")
    assert maintext.extract(page).first()["text"] == text
    assert warc.round_trip(spark, page).first()["payload_bytes"] == len(text) + 26


def test_quality_edges(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(17)] + [(None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == docs.count() and quality.score(docs.limit(0), model).count() == 0
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.fit(docs, labels.limit(0)).constant == 0.5
    assert quality.keep_good(docs, one).columns == docs.columns and quality.keep_good(docs, one).count() == docs.count()


def words(text):
    return [w for w in (re.sub(r"[!-/:-@\[-`{-~]", "", x) for x in re.split(r"[ \t\n\r\x0b\x0c]+", text.lower())) if w]


def brute_leaks(docs, items, threshold=0.8):
    found = set()
    for d, text in docs:
        w = words(text or "")
        for i, item in items:
            v = words(item or "")
            k = min(5, len(v))
            if not v or len(w) < len(v):
                continue
            own = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            n = sum(own.values())
            for s in range(len(w) - len(v) + 1):
                both = sum((own & Counter(tuple(w[j : j + k]) for j in range(s, s + n))).values())
                if both / (2 * n - both) >= threshold:
                    found.add((d, i))
                    break
    return found


def test_decontamination_against_brute_force(spark):
    r = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocab, n))
    items = [(i, say(r.integers(12, 50))) for i in range(12)] + [(50, "only three words"), (51, None), (52, "")]
    docs = [(None, None), (0, ""), (1, say(60))]
    for i, (_, text) in enumerate(items[:12]):
        w = text.split()
        docs.append((10 + i, f"{say(20)} {text.upper()}, {say(9)}"))
        w[len(w) // 2] = "changed"
        docs.append((30 + i, f"{say(20)}\n{' '.join(w)}. {say(30)}"))
        docs.append((60 + i, f"{say(5)} {' '.join(w[: len(w) // 2])} {say(5)}"))
    docs += [(90, "x only three words y"), (91, items[0][1]), (91, items[0][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("z")), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find(a, b).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 12
    assert {(x["doc_id"], x["item_id"]) for x in decontam.find(a, b, block_bytes=500).collect()} == want
    left = {x["doc_id"] for x in decontam.drop_contaminated(a, b).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.find(a.limit(0), b).count() == 0 and decontam.find(a, b.limit(0)).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    w = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(w[:59])), (2, " ".join(w[:30] + w[31:])), (3, " ".join(w[:49])), (4, " ".join(w[:48])), (5, " ".join(w[:3])), (6, " ".join(w[2:] + w[2:4]))]
    items = [(7, " ".join(w)), (8, None)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontam.find(a, b).collect()}
    assert {d: (x["start_word"], x["n_words"]) for d, x in got.items()} == {1: (0, 59), 2: (0, 59), 3: (0, 49), 6: (0, 60)}
    assert [got[d]["similarity"] for d in (1, 2, 3)] == [55 / 56, 51 / 60, 45 / 56]
    assert {x["doc_id"] for x in decontam.drop_contaminated(a, b).collect()} == {4, 5}


def test_decontamination_beyond_the_radius():
    for seed, far in ((2743, 22), (6913, 21), (11252, 22)):
        w = [f"s{seed}w{i}" for i in range(50)]
        items = decontam.Items([(1, " ".join(w))], 5, 20)
        w[25] = "changed"
        assert items.search(" ".join(["a", "b", *w, "c"]), 0.8) == [(1, 2, 50, far, 41 / 51)]
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(list("abcdef"), r.integers(3, 14)))) for i in range(40)]
    docs = [(i, " ".join(r.choice(list("abcdef"), r.integers(14, 300)))) for i in range(25)]
    got = {(d, x[0]) for d, t in docs for x in decontam.Items(rows, 5, 0).search(t, 0.3)}
    assert got == brute_leaks(docs, rows, 0.3) and len(got) > 20


def test_hamming_blocks_select():
    """Each step leaves fewer pairs; a long run is fingerprinted in steps and finds the same."""
    r = np.random.default_rng(21)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choice(vocab, 30))) for i in range(150)]
    text = " ".join([" ".join(r.choice(vocab, 40)) + " " + x for _, x in rows] * 2)
    items = decontam.Items(rows, 5, 7)
    got = sorted(items.search(text, 0.8))
    assert [x[0] for x in got] == list(range(150)) and all(x[3:] == (0, 1.0) for x in got)
    left = items.left
    assert left["blocks"] < left["windows"] / 20 and left["radius"] < left["blocks"] / 10 and left["radius"] >= left["similar"] >= 300
    try:
        decontam.STEP = 7
        assert sorted(decontam.Items(rows, 5, 7).search(text, 0.8)) == got
    finally:
        decontam.STEP = 4096


def test_hamming_blocks_find_all_within_the_radius():
    r = np.random.default_rng(9)
    items = decontam.Items([(i, " ".join(r.choice([f"w{j}" for j in range(50)], 20))) for i in range(30)], 5, 20)
    key = next(iter(items.index))
    own, known, _ = items.index[key]
    probes = np.array([int(known[r.integers(len(known))]) ^ int(sum(1 << int(b) for b in r.choice(64, r.integers(0, 26), replace=False))) for _ in range(200)], np.uint64)
    got = {(w, i) for w, i, _ in items.near(key, probes)}
    assert got == {(w, int(own[j])) for w in range(200) for j in range(len(known)) if int(probes[w] ^ known[j]).bit_count() <= 20}


def test_main_text_on_held_out_pages():
    model = maintext.default_model()
    right = total = 0
    for html in labelled_pages.pages(60, seed=1234):
        nodes = maintext.read(html)
        want = maintext.label(nodes)
        for node, y, p in zip(nodes, want, model.marginals(nodes), strict=True):
            if not node.tag:
                right += (p >= 0.5) == y
                total += 1
    assert right / total > 0.95


def test_main_text_of_hand_written_pages():
    """At least 28 in 31 blocks right over pages that share no layout code with the training pages."""
    right = extra = missing = 0
    for _, html, want in hand_pages.PAGES:
        text = maintext.main_text(html, maintext.default_model())
        got, want = Counter(text.split("\n") if text else []), Counter(want)
        right, extra, missing = right + (got & want).total(), extra + (got - want).total(), missing + (want - got).total()
    assert len(hand_pages.PAGES) > 30 and right / (right + extra + missing) > 0.9


def test_the_models_file_is_what_training_gives():
    trained, held = maintext.train(labelled_pages.pages()), maintext.default_model()
    assert held.unary == pytest.approx(trained.unary, abs=1e-4)
    assert np.array(held.pair) == pytest.approx(np.array(trained.pair), abs=1e-4)


@pytest.mark.parametrize("html", ["<a " * 330_000, "<![CDATA[" * 110_000, "<div>" * 160_000, '<a "><a" ' * 110_000, "<p><div>" * 110_000, "<b>" * 300_000, "&" * 1_000_000, "<li>" * 200_000])
def test_reading_long_odd_pages_takes_linear_time(html):
    began = time.process_time()
    maintext.read(html)
    assert time.process_time() - began < 6


def test_references_do_not_arise_across_tags():
    assert [n.text for n in maintext.read("<p>&<i>lt;</i>script &am<b>p;</b> &lt;</p>") if not n.tag] == ["&lt;script &amp; <"]


def test_marginals_against_enumeration():
    from itertools import product
    from math import exp

    model = maintext.default_model()
    nodes = maintext.read("<body><nav><a href='/'>a</a></nav><article><p>Some words here. And more.</p></article></body>")
    own = model.evidence(nodes)
    total, ones = 0.0, [0.0] * len(nodes)
    for states in product((0, 1), repeat=len(nodes)):
        e = sum(x for x, y in zip(own, states, strict=True) if y) + sum(model.pair[not n.tag][states[n.parent]][states[i]] for i, n in enumerate(nodes) if i)
        total += exp(e)
        for i, y in enumerate(states):
            ones[i] += exp(e) * y
    assert model.marginals(nodes) == pytest.approx([x / total for x in ones], abs=1e-9)


def test_main_text_rules(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>menu</a></ul></nav><article><h1>A &amp; B</h1><p>One \n two&nbsp;three.<script>x<p></script><p><b>Four.<br>five</b></article><div class='comments'><p>I say so.</p></div><footer>&copy; me</footer>"
    assert maintext.main_text(page, maintext.default_model()) == "A & B\nOne two three.\nFour. five"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<<<>>> & <p", "x"), (3, "u", "<div>" * 3000, "x")], "page_id long, url string, html string, text string")
    got = maintext.extract(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got) and maintext.extract(pages.limit(0)).count() == 0


def test_main_text_keeps_formulas_and_embedded_text():
    say = "This is a long enough sentence of the article. It goes on for a while."
    page = f"<body><article><h1>Title</h1><p>{say} Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold here.</p><p>{say}</p><noscript><p>{say} Noscript.</p></noscript><p>{say} <object data='a'>{say} Object.</object> {say} After.</p></article></body>"
    leaves = [n.text for n in maintext.read(page) if not n.tag]
    assert leaves == ["Title", f"{say} Let x=2 hold here.", say, f"{say} Noscript.", say, f"{say} Object.", f"{say} After."]
    assert maintext.main_text(page, maintext.default_model()) == "\n".join(leaves)
    for tag in ("audio", "video", "canvas", "svg"):
        assert [n.text for n in maintext.read(f"<p>a <{tag}>b</{tag}> c") if not n.tag] == ["a", "b", "c"]
    assert [n.text for n in maintext.read("<p>a <template>b</template>c<script>d</script>") if not n.tag] == ["a c"]


def brute_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids, where = sorted(sets), defaultdict(list)
    for d in ids:
        hits = Counter(x for g in sets[d] for x in where[g])
        for o, n in hits.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                up[b] = a
        for g in sets[d]:
            where[g].append(d)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_the_calibration_converges():
    r = np.random.default_rng(26)  # whole Newton steps diverge here
    y = (np.arange(300) % 2).astype(float)
    a = r.standard_t(1, (300, 4)) * 0.3 + np.where(y, 1, -1)[:, None] * [1, 0.9, 0.8, 0]
    x = np.stack([*a.T, *(a[:, i] * a[:, j] for i in range(4) for j in range(i, 4))], 1)
    x = (x - x.mean(0)) / x.std(0)
    weight = np.where(y, 9.5, 0.5)
    w = quality.logistic(x, y, weight, ridge=0.1)
    x = np.concatenate([np.ones((300, 1)), x], 1)
    gradient = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y)) + 0.1 * w
    assert np.abs(w).max() < 20 and np.abs(gradient).max() < 1e-3


def test_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(500)]
    docs, n = [], 0
    for size in (3, 4, 5, 8, 20, 60, 150):
        base = list(r.choice(vocab, size))
        for _ in range(14):
            w = list(base)
            for _ in range(r.integers(0, max(2, size // 25))):
                w[r.integers(len(w))] = str(r.choice(vocab))
            docs.append((n := n + 1, " ".join(w)))
    chain = list(r.choice(vocab, 120))
    for i in range(25):  # neighbours are alike, ends aren't
        chain[4 * i] = f"new{i}"
        docs.append((n := n + 1, " ".join(chain)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "Same Text"), (904, "same\ttext"), (905, "same text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit("x")).repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df, shingle=4).collect()}
    assert got == brute_components(docs, 4, 80)
    again = neardup.near_duplicates(df.union(df).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), shingle=4).collect()
    assert len(again) == 2 * len(docs) + 1 and all(x["kept"] for x in again if x["doc_id"] is None)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_a_pair_is_compared_in_its_first_shared_bucket(spark):
    # the 16-bit signatures agree, the 64-bit bands only in band 3
    sig = np.arange(neardup.BINS, dtype=np.uint16).tobytes()
    rows = spark.createDataFrame([(0, 11, 1), (0, 12, 2), (3, 13, 1), (3, 13, 2), (5, 14, 1), (5, 14, 2)], "band int, hash long, id long")
    sigs = spark.createDataFrame([(i, 1000, [10 + i, 0, 5 + i, 13, 7, 14] + [i] * 26, sig, None) for i in (1, 2)], "id long, n long, bands array<long>, sig binary, few binary")
    labels = spark.createDataFrame([], "id long, label long")
    assert [tuple(r) for r in neardup.across(rows, labels, sigs, 80).collect()] == []  # band 1 is shared, too, so it is compared there
    sigs = sigs.withColumn("bands", F.transform("bands", lambda x, k: F.when(k == 1, F.col("id")).otherwise(x)))
    assert [tuple(r) for r in neardup.across(rows, labels, sigs, 80).collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_against_sets(seed):
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, (40, 300, 5000, 100_000)[seed], r.integers(0, 90))).astype(np.uint32) for _ in range(70)]
    got = neardup.overlaps([x.tobytes() for x in sets[:30]], [x.tobytes() for x in sets], most=500)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets[:30]]


def test_buckets_in_small_blocks_give_the_same_links(spark):
    r = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(120):
        w = list(base)
        for k in r.choice(60, r.integers(0, 7), replace=False):
            w[k] = f"x{r.integers(4)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: root for d, (_, root) in brute_components(docs, 3, 80).items()}
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, shingle=3).collect()} == want and len(set(want.values())) > 5
    old = neardup.across.__defaults__
    try:
        neardup.across.__defaults__ = (7, 5)
        assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, shingle=3).collect()} == want
    finally:
        neardup.across.__defaults__ = old


def test_confirming_takes_little_memory_outside_the_heap(spark):
    words = [f"w{i}" for i in range(9000)]
    # 1, 2: 1800 of 2200 shingles in common, 81 %; 1, 3: 1700 of 2300, 73 %; 5: another text
    docs = [(i, " ".join(words[k : k + 2000])) for i, k in ((1, 0), (2, 200), (3, 300), (4, 0), (5, 6000))]
    docs = spark.createDataFrame([*docs, (6, "a b"), (7, "a b"), (8, "b a"), (9, "")], "doc_id long, text string")
    sets = neardup.cut(neardup.sets_of(docs, docs.select(F.col("doc_id").alias("id")), 1, most=2500))
    assert {r["id"]: len(r["set"]) for r in sets.collect()} == {1: 2000, 2: 2000, 3: 2000, 4: 2000, 5: 2000, 6: 2, 7: 2, 8: 2, 9: 0}
    pairs = [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (5, 6), (6, 7), (7, 8)]
    edges = neardup.cut(spark.createDataFrame(pairs * 800, "a long, b long").coalesce(1))
    arrow = spark._jvm.org.apache.spark.sql.util.ArrowUtils.rootAllocator()
    before = arrow.getPeakMemoryAllocation()
    got = neardup.confirm(edges, sets, 80).groupBy("a", "b").count().collect()
    assert {tuple(r) for r in got} == {(*p, 800) for p in pairs if p not in ((1, 3), (1, 5), (5, 6))}
    assert arrow.getPeakMemoryAllocation() < before + (16 << 20)


def test_a_group_is_joined_by_few_confirmed_pairs(spark, monkeypatch):
    # m and each of 30 edited copies of it share 90 %, two of the copies with each other 81 %
    base = [f"w{i}" for i in range(200)]
    docs = [(0, base)] + [(k, base[:10 * (k - 1) // 2] + [f"x{k}.{j}" for j in range(10)] + base[10 * (k - 1) // 2 + 10 :]) for k in range(1, 31)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string").repartition(3)
    asked, plain = [], neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda docs, edges, *a: asked.append(edges.count()) or plain(docs, edges, *a))
    # no star finds anything, so each document is a component when members of buckets are compared
    monkeypatch.setattr(neardup, "stars", lambda rows, percent: rows.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b")))
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, shingle=1).collect()}
    assert got == dict.fromkeys(range(31), 0)
    assert sum(asked) < 100, asked  # of 465 pairs


def test_a_forest_joins_what_all_edges_join():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 60, (2, 400)) * 10**9 + np.array([[0], [7]])
    x, y = np.minimum(x, y), np.maximum(x, y)
    tree = neardup.forest(x, y)

    def parts(x, y):
        label = {k: k for k in (*x.tolist(), *y.tolist())}
        for _ in label:
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                label[a] = label[b] = min(label[a], label[b])
        return label

    whole, kept = parts(x, y), parts(x[tree], y[tree])
    assert kept == {k: whole[k] for k in kept} and kept.keys() == whole.keys()
    assert tree.sum() == len(whole) - len(set(whole.values()))
    assert not len(neardup.forest(x[:0], y[:0]))


def test_a_small_and_a_large_set_are_compared(spark):
    docs = []
    for c in range(5):
        w = lambda name, n: [f"{name}{c}x{k}" for k in range(n)]
        for i in range(20):  # sets of 343 and of 403 shingles, alike within a size; across sizes one pair only, of which neither is a centre
            own = w("own", 8) if i == 7 else []
            docs.append((len(docs), " ".join(w("all", 330) + own + w(f"s{i}y", 16 - len(own)))))
            docs.append((len(docs), " ".join(w("all", 330) + own + w(f"l{i}y", 16 - len(own)) + w("more", 60))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df, shingle=4).collect()}
    assert got == brute_components(docs, 4, 80) and {n for n, _ in got.values()} == {343, 403}


def test_rows_that_share_an_id_but_not_the_text(spark):
    a, b, c = (" ".join(f"{n}{i}" for i in range(30)) for n in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, a), (4, ""), (5, c), (5, c), (6, c + " x"), (2, c), (None, a), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(df, shingle=4).collect())
    assert got == Counter([(1, 27, 1, True), (2, 27, 1, False), (2, 27, 2, True), (3, 27, 2, False), (4, 27, 1, False), (4, 0, 4, True), (5, 27, 2, False), (5, 27, 2, False), (6, 28, 2, False), (2, 27, 2, True), (None, 27, None, True), (None, 0, None, True)])


def test_near_duplicates_of_a_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.op9_minhash(spark, d).collect()}
    assert got == brute_components(rows, 4, 80)


def test_nearest_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((700, 16)).astype(np.float32)
    x[600:660] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), (5, [float(c) for c in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = defaultdict(list)
    for h in nndescent.search(df, df.filter("vec_id % 20 = 0"), k=20, shard_rows=250, block_rows=24, query_rows=9).orderBy("query_id", "rank").collect():
        got[h["query_id"]].append((h["vec_id"], h["score"]))
    full, hits = x.astype(np.float64), []
    for q in range(0, 700, 20):
        s = full @ full[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        assert len(got[q]) == 20 and [v for _, v in got[q]] == pytest.approx([float(full[i] @ full[q]) for i, _ in got[q]])
        hits.append(len({i for i, _ in got[q]} & set(want.tolist())) / 20)
    assert np.mean(hits) >= 0.9 and [i for i, _ in got[0][:20]] == list(range(600, 620))
    few = nndescent.search(df.filter("vec_id < 4"), df.filter("vec_id = 0"), k=20).collect()
    assert [h["rank"] for h in few] == [1, 2, 3] and nndescent.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_nearest_neighbours_of_a_whole_table(spark, sf):
    """The query as it is registered, against brute force in double precision."""
    t = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, place = np.array(t["embedding"].tolist(), np.float64), {v: i for i, v in enumerate(t["vec_id"])}
    got = defaultdict(list)
    for h in queries.op10_nn_descent(spark, f"/root/testdata/sf{sf}").orderBy("query_id", "rank").collect():
        got[h["query_id"]].append((h["vec_id"], h["score"]))
    hits = []
    for q in t["vec_id"][t["vec_id"] % 20 == 0]:
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        want = {int(t["vec_id"][i]) for i in np.argsort(-s, kind="stable")[:20]}
        assert len(got[q]) == 20 and [v for _, v in got[q]] == pytest.approx([s[place[i]] for i, _ in got[q]])
        hits.append(len(want & {i for i, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_the_walk_visits_a_small_share_of_a_shard():
    r = np.random.default_rng(12)
    centres = r.standard_normal((300, 24))
    x = (centres[r.integers(0, 300, 6000)] + 0.5 * r.standard_normal((6000, 24))).astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    ids = np.arange(6000) * 3
    near = [ids[np.argsort(-row)[:24]] for row in s]
    w = nndescent.Walker(ids, x, nndescent.neighbourhoods(ids, near, 24))
    for home in (ids[:200], np.full(200, -1)):
        w.scored = 0
        found = w.search(x[:200], home, 21, 100)
        want = [{*ids[np.argsort(-row)[:20]].tolist(), int(i)} for row, i in zip(s[:200], ids, strict=False)]
        assert np.mean([len(a & {i for i, _ in b}) / len(a) for a, b in zip(want, found, strict=True)]) > 0.9
        assert w.scored / 200 / 6000 < 0.25


def test_pipeline_stages(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(c.STAGES):
        before = docs
        from canopyloom.storage import cut

        docs = cut(stage(spark, before, small))
        if i < len(c.STAGES) - 1:
            assert docs.columns == columns and docs.count() > 0
        if name == "near_dedup":
            parts = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {d for d, (_, root) in parts.items() if root == d}
        if name == "decontaminate":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            five = {tuple(words(x)[j : j + 5]) for _, x in bench for j in range(len(words(x)) - 4)}
            near = [(d, x) for d, x in rows if any(tuple(words(x)[j : j + 5]) in five for j in range(len(words(x)) - 4))]
            bad = {d for d, _ in brute_leaks(near, bench)}
            assert {r["doc_id"] for r in docs.collect()} == {d for d, _ in rows} - bad
        if name == "pack":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}


def test_near_dedup_of_repeated_ids(spark):
    import corpus_pipeline as c

    a, b, x = (" ".join(f"{n}{i}" for i in range(30)) for n in "abx")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (4, x), (4, x), (5, ""), (5, ""), (6, "y"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = c.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, a), (2, b), (4, x), (5, ""), (6, "y"), (None, a), (None, a)])


def test_pipeline_on_odd_and_empty_tables(spark, small):
    import corpus_pipeline as c

    for docs in (odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"), spark.createDataFrame([], DOCS)):
        for _, stage in c.STAGES:
            docs = stage(spark, docs, small)
        docs.collect()
