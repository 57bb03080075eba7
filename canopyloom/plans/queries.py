"""Queries over the test tables, one or more for each operator, and their SQL.

Thresholds are lower than the defaults where the tables' vectors are nearly random,
so that every branch has rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyloom.functions import filters
from canopyloom.functions import text as t
from canopyloom.functions import vectors as v
from canopyloom.operators import fusion, graph, hierarchy, reports, retrieve, search
from canopyloom.params import GraphParams, MacroParams, MicroParams, ReportParams
from canopyloom.plans import answer, build
from canopyloom.sources import io, views
from canopyloom.storage import cut

GRAPH = GraphParams(low=0.20, high=0.96, rescue=0.10)
MICRO = MicroParams(threshold=0.10, weight_threshold=0.7)
MACRO = MacroParams(threshold=0.10)
SIM = 0.32
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH RECURSIVE " + CTES + sql if sql.lstrip().startswith(",") else sql
        return f

    return add


def r6(x):
    return F.round(x, 6)


CTES = r"""
docs AS (
  SELECT doc_id, lang AS l0, source AS l1, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'b' || CAST(n_chars % 3 AS VARCHAR) END AS l2,
    trim(text, E' \t\n\r') AS text, source FROM documents
), units AS (
  SELECT *, md5(path || '::' || text) AS id, md5((CASE WHEN l2 = '' THEN 'L1_' ELSE 'L2_' END) || path) AS community_id
  FROM (SELECT *, l0 || '/' || l1 || CASE WHEN l2 = '' THEN '' ELSE '/' || l2 END AS path FROM docs) WHERE text <> ''
), flat AS (
  SELECT DISTINCT id, title, level, parent_id, path FROM (
    SELECT md5('L0_' || l0) AS id, l0 AS title, 0 AS level, CAST(NULL AS VARCHAR) AS parent_id, l0 AS path FROM docs
    UNION ALL SELECT md5('L1_' || l0 || '/' || l1), l1, 1, md5('L0_' || l0), l0 || '/' || l1 FROM docs
    UNION ALL SELECT md5('L2_' || l0 || '/' || l1 || '/' || l2), l2, 2, md5('L1_' || l0 || '/' || l1), l0 || '/' || l1 || '/' || l2 FROM docs WHERE l2 <> '')
), kids AS (
  SELECT parent_id AS id, string_agg(id, ',' ORDER BY id) AS child_ids FROM flat WHERE parent_id IS NOT NULL GROUP BY 1
), comm AS (
  SELECT f.*, coalesce(k.child_ids, '') AS child_ids, k.id IS NULL AS is_leaf FROM flat f LEFT JOIN kids k USING (id)
), vecs AS (
  SELECT u.*, CAST(e.embedding AS DOUBLE[]) AS vector FROM units u JOIN embeddings e ON u.doc_id = e.vec_id
), firsts AS (
  SELECT cid, min(doc_id) AS doc_id FROM (
    SELECT doc_id, md5('L0_' || l0) AS cid FROM vecs UNION ALL SELECT doc_id, md5('L1_' || l0 || '/' || l1) FROM vecs
    UNION ALL SELECT doc_id, community_id FROM vecs WHERE l2 <> '') GROUP BY 1
), reports AS (
  SELECT f.cid AS community_id, left(x.text, 4) AS title, c.level, c.parent_id, c.path, c.is_leaf, left(x.text, 200) AS summary, x.text AS full_content, x.vector AS embedding
  FROM firsts f JOIN vecs x USING (doc_id) JOIN comm c ON c.id = f.cid
), q AS (
  SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0
), nodes AS (
  SELECT *, row_number() OVER (ORDER BY path) - 1 AS i, sqrt(list_dot_product(embedding, embedding)) + 1e-9 AS nrm FROM reports WHERE level > 0
), shadow AS (
  SELECT a.community_id, a.parent_id, list_dot_product(a.embedding, b.embedding) / (a.nrm * b.nrm) AS s FROM nodes a JOIN nodes b ON a.parent_id = b.community_id
), pairs AS (
  SELECT a.i, b.i AS j, a.community_id AS source, b.community_id AS target, a.parent_id AS pa, list_dot_product(a.embedding, b.embedding) / (a.nrm * b.nrm) AS s,
    (length(a.title) > 1 AND contains(b.full_content, a.title)) OR (length(b.title) > 1 AND contains(a.full_content, b.title)) AS hit, b.embedding AS eb, b.nrm AS nb
  FROM nodes a JOIN nodes b ON a.i < b.i
  WHERE a.community_id NOT IN (SELECT community_id FROM shadow WHERE s > 0.92) AND NOT (coalesce(a.parent_id, '') <> '' AND a.parent_id = b.parent_id)
), scored AS (
  SELECT p.*, CASE WHEN s > 0.20 AND s < 0.96 THEN s WHEN s > 0.10 AND s <= 0.20 AND hit THEN 0.99 END AS score FROM pairs p
), cand AS (
  SELECT * FROM (
    SELECT s.i, s.j, s.source, s.target, s.s AS raw, s.score AS vector_score, row_number() OVER (PARTITION BY s.i ORDER BY s.score DESC, s.j) AS rn
    FROM scored s LEFT JOIN nodes p ON p.community_id = s.pa
    WHERE s.score IS NOT NULL AND NOT (s.score < 0.98 AND p.i IS NOT NULL AND s.s - list_dot_product(p.embedding, s.eb) / (p.nrm * s.nb) < 0)) WHERE rn <= 50
), audited AS (
  SELECT *, 6 + (i * 31 + j * 17) % 5 AS score, (i + j) % 3 AS way, 't' || CAST((i + j) % 14 AS VARCHAR) AS relation_type FROM cand
), edges AS (
  SELECT source AS source_id, target AS target_id, score / 10.0 AS weight, relation_type, vector_score FROM audited WHERE score >= 7 AND way <> 1
  UNION ALL SELECT target, source, score / 10.0, relation_type, vector_score FROM audited WHERE score >= 7 AND way <> 0
), deg AS (
  SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1
), lin AS (
  SELECT id, id AS root_id, title AS root_title, title AS chain FROM flat WHERE parent_id IS NULL
  UNION ALL SELECT f.id, l.root_id, l.root_title, l.chain || ' > ' || f.title FROM flat f JOIN lin l ON f.parent_id = l.id
), sim AS (
  SELECT a.vec_id AS a, b.vec_id AS b, CAST((7 + (a.vec_id * 31 + b.vec_id * 17) % 4) AS DOUBLE) / 10 AS weight
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.32
), sdeg AS (
  SELECT id, count(*) AS degree FROM (SELECT a AS id FROM sim UNION ALL SELECT b FROM sim) GROUP BY 1
), hubs AS (
  SELECT id, degree FROM sdeg WHERE degree > (SELECT avg(degree) + 3 * stddev_pop(degree) FROM sdeg)
), rsim AS (
  SELECT r.community_id, r.title, r.level, r.is_leaf, r.summary, list_cosine_similarity(r.embedding, q.qv) AS score FROM reports r, q
), best10 AS (SELECT * FROM rsim ORDER BY score DESC, community_id LIMIT 10),
anch AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, community_id) AS rnk FROM (SELECT * FROM best10 WHERE score >= 0.10 ORDER BY score DESC, community_id LIMIT 5)
), best6 AS (SELECT * FROM rsim ORDER BY score DESC, community_id LIMIT 6),
terr AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, community_id) AS rnk FROM (SELECT * FROM best6 WHERE score >= 0.10 ORDER BY score DESC, community_id LIMIT 3)
), usim AS (SELECT v.*, list_cosine_similarity(v.vector, q.qv) AS score FROM vecs v, q)
"""


# --- derived inputs -------------------------------------------------------------------


def candidates_of(s: SparkSession, d: str) -> DataFrame:
    return graph.candidates(views.reports(s, d), GRAPH)


def edges_of(s: SparkSession, d: str) -> DataFrame:
    return cut(graph.emit_edges(graph.stub_audit(candidates_of(s, d)), GRAPH), "edges")


def similarity_graph(s: SparkSession, d: str) -> DataFrame:
    rows = views.embeddings(s, d).select(F.col("doc_id").alias("i"), F.col("vector").alias("embedding"))
    i, j = F.col("i"), F.col("j")
    return graph.similar_pairs(rows, SIM).select(i.alias("a"), j.alias("b"), ((7 + (i * 31 + j * 17) % 4) / 10).alias("weight"))


def _with_hubs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The similarity graph and its hubs, both written once, as pruning reads them several times."""
    g = cut(similarity_graph(s, d), "similar")
    return g, cut(graph.super_hubs(g, GRAPH), "hubs")


def with_findings(s: SparkSession, d: str) -> DataFrame:
    """Reports with two findings each: their text's ends, with the embedding and its reverse as vectors."""
    r, x = views.reports(s, d), F.col("full_content")
    f = lambda a, b: F.struct(a.alias("summary"), b.alias("explanation"))
    return r.withColumn("findings", F.to_json(F.array(f(F.left(x, F.lit(30)), F.substring(x, 31, 60)), f(F.right(x, F.lit(30)), F.lit("tail"))))).withColumn("finding_vectors", F.array("embedding", F.reverse("embedding")))


def chunked(s: SparkSession, d: str) -> DataFrame:
    """Units with chunks; chunk k of document n has the vector (n + k) modulo the number of vectors."""
    u = views.units(s, d).select("doc_id", "id", "text", "path").withColumn("text_chunks", t.chunks(F.col("text")))
    e = views.embeddings(s, d)
    n = e.count()
    each = u.select("doc_id", F.posexplode("text_chunks").alias("k", "c")).select("doc_id", "k", ((F.col("doc_id") + F.col("k")) % n).alias("vec"))
    got = each.join(e.withColumnRenamed("doc_id", "vec"), "vec").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "vector"))).alias("z"))
    return u.join(got.select("doc_id", F.transform("z", lambda x: x["vector"]).alias("chunk_vectors")), "doc_id", "left")


# --- ingest and hierarchy ---------------------------------------------------------------


@query(", x AS (SELECT 1) SELECT id, title, level, parent_id, child_ids, is_leaf FROM comm")
def ingest_communities(s, d):
    return views.communities(s, d).select("id", "title", "level", "parent_id", F.array_join("child_ids", ",").alias("child_ids"), "is_leaf")


@query(r""", x AS (SELECT source, count(*) AS n FROM docs GROUP BY 1)
SELECT id, length(text) AS n_tokens, community_id, left(text, 200) AS head, right(text, 100) AS tail, path AS hierarchy_path, x.n > 1 AS prepend_source,
  '{"source":"' || u.source || '","note":""}' AS source_metadata FROM units u JOIN x USING (source)""")
def ingest_text_units(s, d):
    rows = hierarchy.text_units(views.documents(s, d).withColumn("note", F.lit("")))
    return rows.select("id", "n_tokens", "community_id", "head", "tail", "hierarchy_path", "prepend_source", "source_metadata")


@query(r""", c AS (SELECT doc_id, text, CAST(ceil((length(text) - 300) / 200.0) AS INT) AS n FROM units WHERE length(text) > 500),
e AS (SELECT doc_id, text, n, unnest(range(0, n + 1)) AS k FROM c)
SELECT doc_id, CAST(k AS INT) AS pos, md5(CASE WHEN k = n THEN right(text, 300) ELSE substring(text, CAST(200 * k + 1 AS INT), 300) END) AS chunk FROM e""")
def chunk_explode(s, d):
    return views.units(s, d).select("doc_id", F.posexplode(t.chunks(F.col("text"))).alias("pos", "c")).select("doc_id", "pos", F.md5("c").alias("chunk"))


@query(", x AS (SELECT 1) SELECT id, root_id, root_title, chain FROM lin")
def root_lineage(s, d):
    return hierarchy.lineage(views.communities(s, d))


@query(", x AS (SELECT 1) SELECT id FROM flat WHERE id NOT IN (SELECT id FROM lin)")
def uncoloured_nodes(s, d):
    return hierarchy.uncoloured(views.communities(s, d))


@query(", x AS (SELECT 1) SELECT c.parent_id, c.id AS child_id FROM flat c JOIN flat p ON c.parent_id = p.id")
def tree_edges(s, d):
    return hierarchy.tree_edges(views.communities(s, d))


@query(", x AS (SELECT 1) SELECT source, count(*) AS n_source, count(*) > 1 AS prepend_source FROM docs GROUP BY source")
def source_frequency(s, d):
    return hierarchy.with_source_frequency(views.documents(s, d)).select("source", "n_source", "prepend_source").distinct()


# --- filters and search --------------------------------------------------------------------


@query(""", x AS (SELECT 1) SELECT doc_id, id FROM units WHERE contains(lower(text), 'the') AND NOT contains(lower(text), '***') AND (contains(lower(text), 'tion') OR contains(lower(text), 'zzz'))""")
def filter_keywords(s, d):
    return views.units(s, d).filter(filters.keyword_filter(F.col("text"), ["The"], ["TION", "zzz"], ["***"])).select("doc_id", "id")


@query(""", x AS (SELECT 1) SELECT doc_id, path FROM units WHERE (path = '' OR starts_with(path, 'en/src1') OR starts_with(path, 'fr/'))
AND community_id IN (SELECT community_id FROM units WHERE length(text) > 2000)""")
def filter_scope(s, d):
    u = views.units(s, d)
    some = u.filter(F.length("text") > 2000).select("community_id").distinct()
    return u.filter(filters.scope_filter(F.col("path"), ["en/src1", "fr/"])).join(some, "community_id", "left_semi").select("doc_id", "path")


@query(", x AS (SELECT 1) SELECT doc_id, round(score, 6) AS score FROM usim WHERE score >= 0.15 ORDER BY score DESC, id LIMIT 10")
def topk_search(s, d):
    return search.top_k(views.vectors(s, d), views.query_vector(s, d), 10, threshold=0.15).select("doc_id", r6("score").alias("score"))


@query(", b AS (SELECT * FROM usim ORDER BY score DESC, id LIMIT 50) SELECT doc_id, round(score, 6) AS score FROM b WHERE score >= 0.15 AND l0 = 'en' AND doc_id % 2 = 1 ORDER BY score DESC, id LIMIT 10")
def topk_postfilter(s, d):
    where = (F.col("l0") == "en") & (F.col("doc_id") % 2 == 1)
    return search.top_k(views.vectors(s, d), views.query_vector(s, d), 10, threshold=0.15, where=where).select("doc_id", r6("score").alias("score"))


@query(", x AS (SELECT 1) SELECT doc_id, round(score, 6) AS score FROM usim WHERE score >= 0.05 AND l0 = 'en' AND doc_id % 2 = 1 ORDER BY score DESC, id LIMIT 10")
def topk_prefilter(s, d):
    where = (F.col("l0") == "en") & (F.col("doc_id") % 2 == 1)
    return search.top_k(views.vectors(s, d), views.query_vector(s, d), 10, threshold=0.05, where=where, mode="pre").select("doc_id", r6("score").alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE), 6) AS first, false AS is_zero FROM embeddings")
def vector_health(s, d):
    x = v.summary(F.col("vector"))
    return views.embeddings(s, d).select(F.col("doc_id").alias("vec_id"), x.alias("x")).select("vec_id", r6("x.norm").alias("norm"), r6(F.col("x.sample")[0].cast("double")).alias("first"), "x.is_zero")


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))))), 6) AS l1 FROM embeddings")
def vector_normalize(s, d):
    l1 = F.aggregate(v.normalize(F.col("vector")), F.lit(0.0), lambda a, x: a + F.abs(x))
    return views.embeddings(s, d).select(F.col("doc_id").alias("vec_id"), r6(l1).alias("l1"))


_CHUNK = r""", c AS (SELECT doc_id, text, CAST(ceil((length(text) - 300) / 200.0) AS INT) AS n FROM units WHERE length(text) > 500),
e AS (SELECT doc_id, text, n, unnest(range(0, n + 1)) AS k FROM c),
z AS (SELECT e.doc_id, e.k, list_dot_product(CAST(m.embedding AS DOUBLE[]), q.qv) AS score FROM e JOIN embeddings m ON m.vec_id = (e.doc_id + e.k) % (SELECT count(*) FROM embeddings), q),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS rn, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS nxt FROM z)
"""


@query(_CHUNK + "SELECT doc_id, CAST(k AS INT) AS pos, round(score, 6) AS score FROM o WHERE rn = 1")
def best_chunk(s, d):
    b = search.best_chunk(F.col("text_chunks"), F.col("chunk_vectors"), F.col("text"), views.query_vector(s, d))
    return chunked(s, d).filter(F.size("text_chunks") > 0).select("doc_id", b.alias("b")).select("doc_id", "b.pos", r6("b.score").alias("score"))


@query(_CHUNK + "SELECT o.doc_id, CAST(CASE WHEN o.score - o.nxt < 0.01 THEN 0 ELSE o.k END AS INT) AS pos FROM o WHERE rn = 1")
def best_chunk_tie(s, d):
    b = search.best_chunk(F.col("text_chunks"), F.col("chunk_vectors"), F.col("text"), views.query_vector(s, d), tie=0.01)
    return chunked(s, d).filter(F.size("text_chunks") > 0).select("doc_id", b["pos"].alias("pos"))


# --- graph ---------------------------------------------------------------------------------


@query(", x AS (SELECT 1) SELECT community_id, parent_id, round(s, 6) AS s FROM shadow WHERE s > 0.92")
def shadow_nodes(s, d):
    return graph.shadow_nodes(views.reports(s, d).filter("level > 0"), GRAPH).select("community_id", "parent_id", r6("s").alias("s"))


@query(", x AS (SELECT 1) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(weight, 6) AS weight FROM sim")
def all_pairs(s, d):
    return similarity_graph(s, d).withColumn("weight", r6("weight"))


@query(", x AS (SELECT 1) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, source, target, round(raw, 6) AS raw, round(vector_score, 6) AS vector_score FROM cand")
def candidates(s, d):
    return candidates_of(s, d).select("i", "j", "source", "target", r6("raw").alias("raw"), r6("vector_score").alias("vector_score"))


@query(", x AS (SELECT 1) SELECT source_id, target_id, round(CAST(weight AS DOUBLE), 6) AS weight, relation_type, round(vector_score, 6) AS vector_score FROM edges")
def edge_emission(s, d):
    return edges_of(s, d).withColumns({"weight": r6("weight"), "vector_score": r6("vector_score")})


@query(""", n AS (SELECT count(*) AS n_nodes FROM flat), e AS (SELECT count(*) AS n_edges FROM edges),
g AS (SELECT count(*) AS n_active, max(degree) AS max_degree, quantile_cont(degree, 0.5) AS median_degree FROM deg)
SELECT n_edges, n_nodes, n_active, n_nodes - n_active AS n_islands, round((n_nodes - n_active) / CAST(n_nodes AS DOUBLE), 6) AS island_ratio, round(n_edges / CAST(n_nodes AS DOUBLE), 6) AS avg_degree,
max_degree, round(CAST(median_degree AS DOUBLE), 6) AS median_degree FROM n, e, g""")
def graph_stats(s, d):
    h = graph.health(edges_of(s, d), views.communities(s, d))
    return h.withColumns({c: r6(c) for c in ("island_ratio", "avg_degree", "median_degree")})


@query(", x AS (SELECT 1) SELECT d.id, degree, coalesce(f.title, '未知节点') AS title FROM deg d LEFT JOIN flat f USING (id) ORDER BY degree DESC, d.id LIMIT 10")
def degree_topk(s, d):
    return graph.top_hubs(edges_of(s, d), views.communities(s, d))


@query(""", x AS (SELECT CAST(weight AS DOUBLE) AS w FROM edges) SELECT count(*) AS n, round(avg(w), 2) AS mean, round(stddev_samp(w), 2) AS std, round(min(w), 2) AS min, round(quantile_cont(w, 0.25), 2) AS q25,
round(quantile_cont(w, 0.5), 2) AS q50, round(quantile_cont(w, 0.75), 2) AS q75, round(max(w), 2) AS max FROM x""")
def weight_describe(s, d):
    return graph.describe(edges_of(s, d))


@query(""", w AS (SELECT CASE WHEN weight >= 0.6 AND weight <= 0.7 THEN 0 WHEN weight > 0.7 AND weight <= 0.8 THEN 1 WHEN weight > 0.8 AND weight <= 0.9 THEN 2 WHEN weight > 0.9 AND weight <= 1.0 THEN 3 END AS bin FROM edges)
SELECT CAST(b.bin AS INT) AS bin, count(w.bin) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS bin) b LEFT JOIN w ON w.bin = b.bin GROUP BY b.bin""")
def weight_hist(s, d):
    return graph.histogram(edges_of(s, d))


@query(", x AS (SELECT 1) SELECT relation_type, count(*) AS n FROM edges GROUP BY 1")
def relation_types(s, d):
    return graph.relation_types(edges_of(s, d))


@query(""", p AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS n FROM edges GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (n = 2) AS bidirectional, count(*) FILTER (n = 1) AS unidirectional FROM p)
SELECT bidirectional, unidirectional, round(bidirectional / CAST(bidirectional + unidirectional AS DOUBLE), 6) AS ratio FROM c""")
def reciprocity(s, d):
    return graph.reciprocity(edges_of(s, d)).withColumn("ratio", r6("ratio"))


@query(", x AS (SELECT 1) SELECT CAST(id AS BIGINT) AS id, degree FROM hubs")
def super_hubs(s, d):
    return graph.super_hubs(similarity_graph(s, d), GRAPH)


@query(""", bth AS (SELECT a AS x, b AS y FROM sim UNION ALL SELECT b, a FROM sim),
light AS (SELECT * FROM sim WHERE weight < 0.8 AND (a IN (SELECT id FROM hubs) OR b IN (SELECT id FROM hubs))),
one AS (SELECT l.a, l.b, l.weight, n.y AS m FROM light l JOIN bth n ON n.x = l.a WHERE n.y <> l.b),
two AS (SELECT one.a, one.b, weight FROM one JOIN bth n ON n.x = m AND n.y = one.b),
three AS (SELECT one.a, one.b, weight FROM one JOIN bth n ON n.x = m JOIN bth e ON e.x = n.y AND e.y = one.b WHERE n.y <> one.a AND n.y <> one.b)
SELECT DISTINCT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(weight, 6) AS weight FROM (SELECT * FROM two UNION ALL SELECT * FROM three)""")
def prune_superset(s, d):
    g, hubs = _with_hubs(s, d)
    return graph.prunable(g, hubs, GRAPH).withColumn("weight", r6("weight"))


#: The sequential pass: every hub's light edges in turn, each with its other paths of two or three edges as lists of edges.
_PRUNE = """, bth AS (SELECT a AS x, b AS y, a || '-' || b AS e FROM sim UNION ALL SELECT b, a, a || '-' || b FROM sim),
light AS (SELECT a, b, weight, a || '-' || b AS e FROM sim WHERE weight < 0.8 AND (a IN (SELECT id FROM hubs) OR b IN (SELECT id FROM hubs))),
one AS (SELECT l.*, n.y AS m, n.e AS e1 FROM light l JOIN bth n ON n.x = l.a WHERE n.y <> l.b),
ways AS (
  SELECT one.e, [e1, n.e] AS way FROM one JOIN bth n ON n.x = m AND n.y = one.b
  UNION ALL SELECT one.e, [e1, n.e, z.e] FROM one JOIN bth n ON n.x = m JOIN bth z ON z.x = n.y AND z.y = one.b WHERE n.y <> one.a AND n.y <> one.b),
goal AS (SELECT e, list(way) AS ways FROM ways GROUP BY e),
turns AS (SELECT row_number() OVER (ORDER BY h.id, l.weight, CASE WHEN l.a = h.id THEN l.b ELSE l.a END) AS k, l.e, g.ways FROM hubs h JOIN light l ON l.a = h.id OR l.b = h.id JOIN goal g ON g.e = l.e),
run AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone
  UNION ALL SELECT t.k, CASE WHEN NOT list_contains(run.gone, t.e) AND len(list_filter(t.ways, lambda w: NOT list_has_any(w, run.gone))) > 0 THEN list_append(run.gone, t.e) ELSE run.gone END FROM run JOIN turns t ON t.k = run.k + 1),
cut AS (SELECT unnest(gone) AS e FROM run WHERE k = (SELECT max(k) FROM run))
"""


@query(_PRUNE + "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, weight FROM light WHERE e IN (SELECT e FROM cut)")
def prune_exact(s, d):
    g, hubs = _with_hubs(s, d)
    return graph.prune(g, hubs, GRAPH)


@query(_PRUNE + """, ends AS (SELECT unnest([a, b]) AS id FROM sim WHERE a || '-' || b NOT IN (SELECT e FROM cut))
SELECT CAST(h.id AS BIGINT) AS id, count(ends.id) AS degree FROM hubs h LEFT JOIN ends ON ends.id = h.id GROUP BY 1""")
def prune_apply(s, d):
    g, hubs = _with_hubs(s, d)
    directed = g.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "weight")
    return graph.hub_recheck(graph.without(directed, graph.prune(g, hubs, GRAPH)), hubs)


_EXPORT = """, nd AS (SELECT id, title, level FROM flat WHERE level IN (1, 2)),
ind AS (SELECT * FROM edges WHERE source_id IN (SELECT id FROM nd) AND target_id IN (SELECT id FROM nd)),
act AS (SELECT nd.*, coalesce(lin.root_title, 'Unknown') AS root FROM nd LEFT JOIN lin USING (id) WHERE nd.id IN (SELECT source_id FROM ind UNION SELECT target_id FROM ind)),
ex AS (SELECT CAST(row_number() OVER (ORDER BY id) AS INT) AS vos_id, id, title AS label, '[Lv' || level || '] ' || root || ' > ' || title AS description, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS cluster, CAST(1.0 AS DOUBLE) AS weight FROM act)
"""


@query(_EXPORT + "SELECT * FROM ex")
def export_nodes(s, d):
    c = views.communities(s, d)
    return graph.export_nodes(c, hierarchy.lineage(c), edges_of(s, d), [1, 2])


@query(_EXPORT + "SELECT a.vos_id AS src, b.vos_id AS tgt, round(CAST(e.weight AS DOUBLE), 6) AS weight FROM edges e JOIN ex a ON e.source_id = a.id JOIN ex b ON e.target_id = b.id")
def export_edges(s, d):
    c, e = views.communities(s, d), edges_of(s, d)
    return graph.export_edges(e, graph.export_nodes(c, hierarchy.lineage(c), e, [1, 2])).withColumn("weight", r6("weight"))


# --- retrieval -------------------------------------------------------------------------------


@query(", x AS (SELECT 1) SELECT community_id, title, level, round(score, 6) AS score, CAST(rnk AS INT) AS rank FROM anch")
def anchors(s, d):
    return retrieve.anchors(views.reports(s, d), views.query_vector(s, d), MICRO).withColumn("score", r6("score"))


@query(", x AS (SELECT 1) SELECT community_id, title, level, round(score, 6) AS score, CAST(rnk AS INT) AS rank FROM terr")
def territory(s, d):
    return retrieve.territory(views.reports(s, d), views.query_vector(s, d), MACRO).withColumn("score", r6("score"))


_NEAR = """, h AS (SELECT e.source_id, e.target_id, CAST(e.weight AS DOUBLE) AS weight, e.relation_type, a.rnk, a.title AS anchor_title, row_number() OVER (PARTITION BY e.source_id ORDER BY e.weight DESC, e.target_id) AS rn
  FROM edges e JOIN {start} a ON e.source_id = a.community_id {roots} WHERE e.weight > {weight}),
f AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rnk, rn) AS n FROM h WHERE rn <= 5 AND target_id NOT IN (SELECT community_id FROM {start}))
SELECT target_id AS community_id, r.title, round(weight, 6) AS weight, relation_type, source_id AS anchor_id, anchor_title FROM f LEFT JOIN reports r ON r.community_id = f.target_id WHERE n = 1"""


@query(_NEAR.format(start="anch", roots="", weight=0.7))
def neighbors(s, d):
    r = views.reports(s, d)
    near = retrieve.neighbors(retrieve.anchors(r, views.query_vector(s, d), MICRO), edges_of(s, d), r, MICRO)
    return near.select("community_id", "title", r6("weight").alias("weight"), "relation_type", "anchor_id", "anchor_title")


@query(_NEAR.format(start="terr", roots="AND a.level > 0", weight=0.8))
def bridges(s, d):
    r = views.reports(s, d)
    near = retrieve.bridges(retrieve.territory(r, views.query_vector(s, d), MACRO), edges_of(s, d), r, MACRO)
    return near.select("community_id", "title", r6("weight").alias("weight"), "relation_type", "anchor_id", "anchor_title")


_QUOTA = """, sh AS (SELECT *, greatest(1, CAST(round_even(19 * score / sum(score) OVER (), 0) AS INT)) AS share, count(*) OVER () AS n FROM anch),
qt AS (SELECT community_id, title, is_leaf, summary, score, rnk, CAST(CASE WHEN rnk = n THEN greatest(1, share + 19 - sum(share) OVER ()) ELSE share END AS INT) AS quota FROM sh)
"""


@query(_QUOTA + "SELECT community_id, round(score, 6) AS score, quota FROM qt")
def quota(s, d):
    return retrieve.quotas(retrieve.anchors(views.reports(s, d), views.query_vector(s, d), MICRO), 19).select("community_id", r6("score").alias("score"), "quota")


@query(_QUOTA + """, off AS (
  SELECT rnk, 0 AS place, 'summary_' || community_id AS id, community_id, length('【社区摘要】' || summary) AS n FROM qt WHERE summary <> ''
  UNION ALL SELECT qt.rnk, x.rn, x.id, x.community_id, x.n FROM (
    SELECT v.community_id, v.id, length(v.text) AS n, row_number() OVER (PARTITION BY v.community_id ORDER BY list_dot_product(v.vector, q.qv) DESC, v.id) AS rn FROM vecs v, q) x
  JOIN qt ON qt.community_id = x.community_id AND qt.is_leaf AND x.rn <= qt.quota),
o AS (SELECT *, row_number() OVER (ORDER BY rnk, place, id) AS k FROM off),
st AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS stopped, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS community_id, false AS took
  UNION ALL SELECT o.k, CASE WHEN o.rnk <> st.stopped AND st.used + o.n <= 9600 THEN st.used + o.n ELSE st.used END, CASE WHEN o.rnk <> st.stopped AND st.used + o.n <= 9600 THEN st.stopped ELSE o.rnk END,
    o.id, o.community_id, o.rnk <> st.stopped AND st.used + o.n <= 9600 FROM st JOIN o ON o.k = st.k + 1)
SELECT community_id, id, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS seq FROM st WHERE took""")
def waterfall_fill(s, d):
    r, qv = views.reports(s, d), views.query_vector(s, d)
    start = retrieve.anchors(r, qv, MICRO)
    q1 = retrieve.quotas(start, 19).join(r.select("community_id", "is_leaf"), "community_id")
    units = views.vectors(s, d)
    return retrieve.fill(retrieve.penetrate(q1, units, r, qv, True), start, 9600).select("community_id", "id", F.col("seq").cast("int").alias("seq"))


@query(", b AS (SELECT * FROM usim ORDER BY score DESC, id LIMIT 100) SELECT doc_id, round(score, 6) AS score FROM b WHERE score >= 0.10 AND id NOT IN (SELECT id FROM units WHERE length(text) < 700) ORDER BY score DESC, id LIMIT 20")
def fallback(s, d):
    u = views.vectors(s, d)
    return retrieve.fallback(u, views.query_vector(s, d), u.filter("length(text) < 700"), 30_000, MICRO).select("doc_id", r6("score").alias("score"))


@query(", b AS (SELECT * FROM usim ORDER BY score DESC, id LIMIT 20) SELECT doc_id, round(score, 6) AS score FROM b WHERE score >= 0.10 AND id NOT IN (SELECT id FROM units WHERE length(text) < 500) ORDER BY score DESC, id LIMIT 10")
def supplement(s, d):
    u = views.vectors(s, d)
    return retrieve.supplement(u, views.query_vector(s, d), u.filter("length(text) < 500"), MACRO).select("doc_id", r6("score").alias("score"))


_FIND = """, fl AS (
  SELECT community_id, 0 AS finding_index, left(full_content, 30) AS summary, substring(full_content, 31, 60) AS explanation, embedding AS x FROM reports
  UNION ALL SELECT community_id, 1, right(full_content, 30), 'tail', list_reverse(embedding) FROM reports),
tf AS (SELECT fl.community_id, fl.finding_index, 'finding_' || community_id || '_' || finding_index AS id, '【观点】' || summary || chr(10) || chr(10) || '【解释】' || explanation AS text, list_cosine_similarity(x, q.qv) AS score
  FROM fl, q WHERE community_id IN (SELECT community_id FROM terr) ORDER BY score DESC, community_id, finding_index LIMIT 5)
"""


@query(_FIND + "SELECT id, md5(text) AS text, round(score, 6) AS score FROM tf")
def findings_topk(s, d):
    r, qv = with_findings(s, d), views.query_vector(s, d)
    return retrieve.top_findings(r, retrieve.territory(r, qv, MACRO), qv, 5).select("id", F.md5("text").alias("text"), r6("score").alias("score"))


@query(_FIND + """, b AS (SELECT community_id, id, score FROM usim ORDER BY score DESC, id LIMIT 10),
hit AS (SELECT tf.id AS finding_id, b.id, b.score, row_number() OVER (PARTITION BY tf.id ORDER BY b.score DESC, b.id) AS place FROM tf JOIN b USING (community_id) WHERE b.score >= 0.10)
SELECT finding_id, CAST(place AS INT) AS place, id, round(score, 6) AS score FROM hit WHERE place <= 2
UNION ALL SELECT tf.id, 0, 'summary_' || tf.community_id, round(r.score, 6) FROM tf JOIN rsim r USING (community_id) WHERE r.summary <> ''""")
def evidence(s, d):
    r, qv = with_findings(s, d), views.query_vector(s, d)
    points = retrieve.top_findings(r, retrieve.territory(r, qv, MACRO), qv, 5)
    return retrieve.evidence(points, views.vectors(s, d), r, qv, 2, 0.10).select("finding_id", F.col("place").cast("int").alias("place"), "id", r6("score").alias("score"))


_MICRO = _QUOTA + _NEAR[: _NEAR.index("SELECT target_id AS community_id, r.title")].format(start="anch", roots="", weight=0.7) + """, nq AS (
  SELECT target_id, weight, relation_type, anchor_title, row_number() OVER (ORDER BY weight DESC, target_id) AS rnk, count(*) OVER () AS n, greatest(1, CAST(round_even(19 * weight / sum(weight) OVER (), 0) AS INT)) AS share FROM f WHERE n = 1),
nt AS (SELECT nq.*, r.title, r.is_leaf, CASE WHEN rnk = nq.n THEN greatest(1, share + 19 - sum(share) OVER ()) ELSE share END AS quota FROM nq LEFT JOIN reports r ON r.community_id = nq.target_id),
inner_rank AS (SELECT v.community_id, v.id, v.text, list_dot_product(v.vector, q.qv) AS score, row_number() OVER (PARTITION BY v.community_id ORDER BY list_dot_product(v.vector, q.qv) DESC, v.id) AS rn FROM vecs v, q),
off1 AS (
  SELECT qt.rnk, 0 AS place, 'summary_' || qt.community_id AS id, qt.community_id, '【社区摘要】' || qt.summary AS text, qt.score FROM qt WHERE qt.summary <> ''
  UNION ALL SELECT qt.rnk, x.rn, x.id, x.community_id, x.text, x.score FROM inner_rank x JOIN qt ON qt.community_id = x.community_id AND qt.is_leaf AND x.rn <= qt.quota),
off2 AS (SELECT nt.rnk, x.rn AS place, x.id, x.community_id, x.text, x.score FROM inner_rank x JOIN nt ON nt.target_id = x.community_id AND nt.is_leaf AND x.rn <= nt.quota),
o1 AS (SELECT *, length(text) AS n, row_number() OVER (ORDER BY rnk, place, id) AS k FROM off1),
o2 AS (SELECT *, length(text) AS n, row_number() OVER (ORDER BY rnk, place, id) AS k FROM off2),
st1 AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS stopped, false AS took
  UNION ALL SELECT o.k, CASE WHEN o.rnk <> st1.stopped AND st1.used + o.n <= 9600 THEN st1.used + o.n ELSE st1.used END, CASE WHEN o.rnk <> st1.stopped AND st1.used + o.n <= 9600 THEN st1.stopped ELSE o.rnk END,
    o.rnk <> st1.stopped AND st1.used + o.n <= 9600 FROM st1 JOIN o1 o ON o.k = st1.k + 1),
st2 AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS stopped, false AS took
  UNION ALL SELECT o.k, CASE WHEN o.rnk <> st2.stopped AND st2.used + o.n <= 9600 THEN st2.used + o.n ELSE st2.used END, CASE WHEN o.rnk <> st2.stopped AND st2.used + o.n <= 9600 THEN st2.stopped ELSE o.rnk END,
    o.rnk <> st2.stopped AND st2.used + o.n <= 9600 FROM st2 JOIN o2 o ON o.k = st2.k + 1),
taken AS (
  SELECT 1 AS part, o1.k, o1.id, o1.text, o1.score, 'anchor' AS source_type, CAST(NULL AS VARCHAR) AS relation_type, CAST(NULL AS DOUBLE) AS weight, o1.community_id, a.title, a.title AS anchor_title
    FROM st1 JOIN o1 USING (k) JOIN anch a ON a.community_id = o1.community_id WHERE took
  UNION ALL SELECT 2, o2.k, o2.id, o2.text, o2.score, 'neighbor', nt.relation_type, nt.weight, o2.community_id, coalesce(nt.title, '未知'), nt.anchor_title
    FROM st2 JOIN o2 USING (k) JOIN nt ON nt.target_id = o2.community_id WHERE took),
goal AS (SELECT CASE WHEN 32000 - u < 10000 THEN 20 ELSE greatest(1, (32000 - u) // 500) END AS target FROM (SELECT coalesce(sum(length(text)), 0) AS u FROM taken)),
b100 AS (SELECT * FROM usim ORDER BY score DESC, id LIMIT 100),
rest AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM b100 WHERE score >= 0.10 AND id NOT IN (SELECT id FROM taken)),
got AS (SELECT * FROM taken UNION ALL SELECT 3, rest.k, rest.id, rest.text, rest.score, 'fallback', NULL, NULL, rest.community_id, coalesce(r.title, '未知'), NULL FROM rest LEFT JOIN reports r USING (community_id), goal WHERE rest.k <= target),
micro AS (SELECT row_number() OVER (ORDER BY part, k) - 1 AS seq, id, text, score, source_type, relation_type, weight, community_id, title, anchor_title FROM got)
"""


@query(_MICRO + "SELECT CAST(seq AS INT) AS seq, id, text, round(score, 6) AS score, source_type, relation_type, weight, community_id, title, anchor_title FROM micro")
def micro_retrieve(s, d):
    r = views.reports(s, d)
    return retrieve.micro(views.vectors(s, d), r, edges_of(s, d), views.query_vector(s, d), MICRO).withColumn("score", r6("score"))


_MACRO = _NEAR[: _NEAR.index("SELECT target_id AS community_id, r.title")].format(start="terr", roots="AND a.level > 0", weight=0.8) + """, cs AS (SELECT community_id FROM terr UNION SELECT target_id FROM f WHERE n = 1),
fl AS (
  SELECT community_id, 0 AS finding_index, left(full_content, 30) AS summary, substring(full_content, 31, 60) AS explanation, embedding AS x FROM reports
  UNION ALL SELECT community_id, 1, right(full_content, 30), 'tail', list_reverse(embedding) FROM reports),
tf AS (SELECT fl.community_id, fl.finding_index, 'finding_' || community_id || '_' || finding_index AS id, '【观点】' || summary || chr(10) || chr(10) || '【解释】' || explanation AS text, list_cosine_similarity(x, q.qv) AS score
  FROM fl, q WHERE community_id IN (SELECT community_id FROM cs) ORDER BY score DESC, community_id, finding_index LIMIT 5),
b10 AS (SELECT community_id, id, text, score FROM usim ORDER BY score DESC, id LIMIT 10),
hit AS (SELECT tf.id AS finding_id, b10.community_id, b10.id, b10.text, b10.score, row_number() OVER (PARTITION BY tf.id ORDER BY b10.score DESC, b10.id) AS place FROM tf JOIN b10 USING (community_id) WHERE b10.score >= 0.10),
ev AS (SELECT * FROM hit WHERE place <= 2 UNION ALL SELECT tf.id, tf.community_id, 'summary_' || tf.community_id, '【社区摘要】' || r.summary, r.score, 0 FROM tf JOIN rsim r USING (community_id) WHERE r.summary <> ''),
b20 AS (SELECT * FROM usim ORDER BY score DESC, id LIMIT 20),
sup AS (SELECT * FROM b20 WHERE score >= 0.10 AND id NOT IN (SELECT id FROM ev) ORDER BY score DESC, id LIMIT 10),
got AS (
  SELECT 1 AS part, rnk AS pl, 'summary_' || community_id AS id, '【社区摘要】' || summary AS text, score, 'anchor' AS source_type, community_id FROM terr WHERE summary <> ''
  UNION ALL SELECT 2, row_number() OVER (ORDER BY score DESC, id), id, text, score, 'finding', community_id FROM tf
  UNION ALL SELECT 3, row_number() OVER (ORDER BY finding_id, place), id, text, score, 'evidence', community_id FROM ev
  UNION ALL SELECT 4, row_number() OVER (ORDER BY score DESC, id), id, text, score, 'supplement', community_id FROM sup),
macro AS (SELECT row_number() OVER (ORDER BY score DESC, part, pl) - 1 AS seq, got.id, got.text, got.score, got.source_type, got.community_id, coalesce(r.title, '未知') AS title FROM got LEFT JOIN reports r USING (community_id))
"""


@query(_MACRO + "SELECT CAST(seq AS INT) AS seq, id, text, round(score, 6) AS score, source_type, community_id, title FROM macro")
def macro_retrieve(s, d):
    return retrieve.macro(views.vectors(s, d), with_findings(s, d), edges_of(s, d), views.query_vector(s, d), MACRO).withColumn("score", r6("score"))


# --- fusion ------------------------------------------------------------------------------------


def _results(s: SparkSession, d: str) -> DataFrame:
    """A retrieval's rows made up from vectors: three sources that overlap by score; every unit with a vector is in one at least."""
    u = search.scored(views.vectors(s, d), views.query_vector(s, d))
    kinds = {"neighbor": (0, -0.05), "anchor": (1, 0.05), "fallback": (2, -2.0)}
    parts = [u.filter(F.col("score") >= low).select("doc_id", "id", "text", "path", "score", F.lit(n).alias("source_type"), F.lit(k).alias("k")) for n, (k, low) in kinds.items()]
    rows = parts[0].union(parts[1]).union(parts[2])
    near = F.col("source_type") == "neighbor"
    return rows.select(
        (F.col("k") * 1_000_000 + F.col("doc_id")).alias("seq"), "id", "text", "path", "score", "source_type", F.when(near, F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))).alias("relation_type"),
        F.when(near, 0.7 + 0.1 * (F.col("doc_id") % 3)).alias("weight"), F.when(near, F.concat(F.lit("a"), (F.col("doc_id") % 2).cast("string"))).alias("anchor_title"),
    )


_FUSE = """, raw AS (
  SELECT k * 1000000 + doc_id AS seq, id, text, path, score, kind AS source_type, CASE WHEN k = 0 THEN 't' || (doc_id % 5) END AS relation_type, CASE WHEN k = 0 THEN CAST(0.7 + 0.1 * (doc_id % 3) AS DOUBLE) END AS weight,
    CASE WHEN k = 0 THEN 'a' || (doc_id % 2) END AS anchor_title
  FROM usim, (SELECT unnest([0, 1, 2]) AS k, unnest(['neighbor', 'anchor', 'fallback']) AS kind, unnest([-0.05, 0.05, -2.0]) AS low) WHERE score >= low),
dd AS (SELECT *, min(seq) OVER (PARTITION BY id) AS fst, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY CASE source_type WHEN 'anchor' THEN 1 WHEN 'neighbor' THEN 2 ELSE 3 END, seq) AS rn,
  string_agg(relation_type || ':' || anchor_title, ',' ORDER BY seq) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS said FROM raw),
ded AS (SELECT fst AS seq, id, text, path, score, source_type, relation_type, weight, anchor_title, CASE WHEN n > 1 THEN coalesce(said, '') ELSE '' END AS relations FROM dd WHERE rn = 1),
rk AS (SELECT *, CASE WHEN source_type = 'neighbor' THEN score * weight * 0.9 ELSE score END AS adjusted FROM ded),
ps AS (SELECT *, row_number() OVER (ORDER BY adjusted DESC, seq) AS position, '[Source: ' || path || ']' || CASE WHEN source_type = 'neighbor' THEN ' [关联证据: 通过 "' || relation_type || '" 关联到 "' || anchor_title || '"]' ELSE '' END AS meta FROM rk),
sf AS (SELECT *, sum(length(meta) + 1 + length(text) + 1) OVER (ORDER BY position) AS used FROM ps)
"""


@query(_FUSE + "SELECT seq, id, source_type, relations FROM ded")
def fusion_dedupe(s, d):
    rel = F.array_join(F.transform("additional_relations", lambda x: F.concat(x["relation_type"], F.lit(":"), x["anchor_title"])), ",")
    return fusion.deduplicate(_results(s, d)).select("seq", "id", "source_type", rel.alias("relations"))


@query(_FUSE + "SELECT id, CAST(position AS INT) AS position, round(adjusted, 6) AS adjusted FROM ps")
def fusion_rank(s, d):
    return fusion.rank(fusion.deduplicate(_results(s, d))).select("id", "position", r6("adjusted").alias("adjusted"))


def _stuffed(s: SparkSession, d: str) -> DataFrame:
    rows = fusion.rank(fusion.deduplicate(_results(s, d))).withColumn("prepend", F.lit("")).withColumn("tag", fusion.relation_tag(F.col("source_type"), F.col("relation_type"), F.col("anchor_title")))
    return fusion.stuff(rows, fusion.micro_length(F.col("text"), F.col("path"), F.col("prepend"), F.col("tag")))


@query(_FUSE + "SELECT id, CAST(position AS INT) AS position, CAST(used AS BIGINT) AS used FROM sf WHERE used <= 32000")
def fusion_stuff(s, d):
    return _stuffed(s, d).select("id", "position", F.col("used").cast("long").alias("used"))


@query(_FUSE + "SELECT md5('# 史料证据列表 (Historical Evidence)' || chr(10) || chr(10) || string_agg(meta || chr(10) || text, chr(10) || chr(10) ORDER BY position)) AS context FROM sf WHERE used <= 32000")
def render_micro(s, d):
    return fusion.render_micro(_stuffed(s, d)).select(F.md5("context").alias("context"))


@query(_FUSE + """, c AS (SELECT count(*) AS stuffed_count, length('# 史料证据列表 (Historical Evidence)' || chr(10) || chr(10) || string_agg(meta || chr(10) || text, chr(10) || chr(10) ORDER BY position)) AS total_chars FROM sf WHERE used <= 32000)
SELECT (SELECT count(*) FROM raw) AS merged_count, (SELECT count(*) FROM ded) AS dedup_count, stuffed_count, CAST(total_chars AS INT) AS total_chars, round(total_chars / 32000.0 * 100, 6) AS budget_usage_percent, total_chars > 32000 AS exceeded_budget FROM c""")
def fusion_stats(s, d):
    raw, kept = _results(s, d), _stuffed(s, d)
    length = F.length(F.lit(fusion.MICRO_TITLE + "\n\n")) + F.sum(F.length(fusion.meta_line(F.col("path"), F.col("prepend"), F.col("tag"))) + 1 + F.length("text") + 2) - 2
    return fusion.stats(raw, fusion.deduplicate(raw), kept, length.cast("int")).withColumn("budget_usage_percent", r6("budget_usage_percent"))


_RENDER = """, dd AS (SELECT *, min(seq) OVER (PARTITION BY id) AS fst, row_number() OVER (PARTITION BY id ORDER BY CASE source_type WHEN 'anchor' THEN 1 WHEN 'finding' THEN 4 WHEN 'evidence' THEN 5 ELSE 6 END, seq) AS rn FROM macro),
ps AS (SELECT *, source_type IN ('finding', 'evidence') AS claim, row_number() OVER (ORDER BY score DESC, fst) AS position FROM dd WHERE rn = 1),
sf AS (SELECT *, sum(length(text) + CASE WHEN claim THEN 100 ELSE 50 END) OVER (ORDER BY position) AS used FROM ps),
nb AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY position) AS i FROM sf WHERE used <= 32000),
cl AS (SELECT string_agg('### Claim ' || i || ': ' || left(text, 100) || '... (Score: ' || printf('%.2f', score) || ')' || chr(10) || CASE WHEN coalesce(community_id, '') <> '' THEN '- **Context**: From Community [' || community_id || ']' || chr(10) ELSE '' END
  || '- **Supporting Evidence**:' || chr(10) || '  1. [证据占位]' || chr(10), chr(10) ORDER BY i) AS t FROM nb WHERE claim),
ot AS (SELECT string_agg(i || '. [' || id || ']: "' || CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END || '"', chr(10) ORDER BY i) AS t FROM nb WHERE NOT claim)
SELECT CASE WHEN (SELECT count(*) FROM nb) = 0 THEN '' ELSE '# Macro Overview (宏观综述)' || chr(10) || chr(10)
  || CASE WHEN cl.t IS NULL THEN '' ELSE '## I. Structural Logic & Claims (逻辑与观点)' || chr(10) || '基于图谱分析，发现以下核心观点及其关联：' || chr(10) || chr(10) || cl.t || chr(10) END
  || '## II. Supplementary Historical Records (补充史料)' || chr(10) || '原典记载：' || chr(10) || coalesce(chr(10) || ot.t, '') END AS context FROM cl, ot"""


@query(_MACRO + _RENDER)
def render_macro(s, d):
    found = retrieve.macro(views.vectors(s, d), with_findings(s, d), edges_of(s, d), views.query_vector(s, d), MACRO)
    return answer.fuse(found, views.units(s, d), "macro")[1]


@query(_CHUNK + """, b AS (SELECT doc_id, k FROM o WHERE rn = 1)
SELECT u.doc_id, length(r) AS processed_length, md5(r) AS processed FROM (
  SELECT u.doc_id, '[' || u.l0 || '·' || CASE WHEN u.l2 = '' THEN u.l1 ELSE u.l2 END || '] ' || CASE WHEN length(u.text) > 700 THEN
    left(u.text, 200) || ' ...[检索定位] ' || CASE WHEN b.k = c.n THEN right(u.text, 300) ELSE substring(u.text, CAST(200 * b.k + 1 AS INT), 300) END || ' ... ' || right(u.text, 100) ELSE u.text END AS r
  FROM units u LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)) u""")
def reassemble(s, d):
    rows = chunked(s, d)
    x, ch = F.col("text"), F.col("text_chunks")
    best = search.best_chunk(ch, F.col("chunk_vectors"), x, views.query_vector(s, d))["chunk"]
    out = fusion.reassemble(x, t.head(x), t.tail(x), best, F.try_element_at(ch, F.lit(1)), F.try_element_at(ch, F.lit(-1)), t.title_prefix(F.lit(""), F.col("path")))
    return rows.select("doc_id", out.alias("r")).select("doc_id", F.length("r").alias("processed_length"), F.md5("r").alias("processed"))


# --- reports and work logs -------------------------------------------------------------------------


@query(""", l AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, sum(length(text)) OVER (PARTITION BY source) AS total FROM units),
b AS (
  SELECT source, k, doc_id, n, total, CAST(0 AS INT) AS bin, CAST(n AS BIGINT) AS cur FROM l WHERE k = 1
  UNION ALL SELECT l.source, l.k, l.doc_id, l.n, l.total, CAST(CASE WHEN l.total > 15000 AND b.cur > 0 AND b.cur + l.n > CAST(l.total AS DOUBLE) / ceil(l.total / 12000.0) * 1.1 THEN b.bin + 1 ELSE b.bin END AS INT),
    CASE WHEN l.total > 15000 AND b.cur > 0 AND b.cur + l.n > CAST(l.total AS DOUBLE) / ceil(l.total / 12000.0) * 1.1 THEN l.n ELSE b.cur + l.n END FROM b JOIN l ON l.source = b.source AND l.k = b.k + 1)
SELECT source, doc_id, CAST(n AS INT) AS n, bin FROM b""")
def bin_packing(s, d):
    return reports.packed(views.units(s, d), "source", "doc_id", F.length("text"))


@query(", x AS (SELECT 1) SELECT f.id, count(c.id) AS n_children FROM flat f LEFT JOIN flat c ON c.parent_id = f.id WHERE f.level = 0 GROUP BY 1")
def dependencies(s, d):
    return reports.dependencies(views.communities(s, d))


@query(""", lf AS (SELECT u.community_id, string_agg(u.text, chr(10) || chr(10) ORDER BY doc_id, u.text) AS context, sum(length(u.text)) AS n FROM units u JOIN comm c ON c.id = u.community_id WHERE c.is_leaf AND c.level > 0 GROUP BY 1),
br AS (SELECT c.parent_id AS community_id, string_agg('【小类：' || c.title || '】' || u.text, chr(10) || chr(10) ORDER BY doc_id) AS context, sum(length('【小类：' || c.title || '】' || u.text)) AS n
  FROM units u JOIN comm c ON c.id = u.community_id JOIN comm p ON p.id = c.parent_id WHERE p.level > 0 GROUP BY 1)
SELECT community_id, md5(context) AS context, CAST(n AS BIGINT) AS n_tokens, CASE WHEN n < 200 THEN 'sparse' ELSE 'standard' END AS route FROM (SELECT * FROM lf UNION ALL SELECT * FROM br)""")
def node_contexts(s, d):
    u, c = views.units(s, d), views.communities(s, d)
    rows = reports.leaf_context(u, c).unionByName(reports.branch_context(u, c))
    return rows.select("community_id", F.md5("context").alias("context"), "n_tokens", reports.route(F.col("n_tokens"), F.lit(1)).alias("route"))


@query(""", rt AS (SELECT c.parent_id AS community_id, string_agg('【' || r.title || '】: ' || r.summary, chr(10) || chr(10) ORDER BY c.id) AS context, sum(length('【' || r.title || '】: ' || r.summary)) AS n
  FROM comm c JOIN reports r ON r.community_id = c.id WHERE c.level = 1 GROUP BY 1)
SELECT f.id AS community_id, md5(coalesce(context, '无内容')) AS context, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens FROM flat f LEFT JOIN rt ON rt.community_id = f.id WHERE f.level = 0""")
def root_contexts(s, d):
    return reports.root_context(views.communities(s, d), views.reports(s, d)).select("community_id", F.md5("context").alias("context"), F.col("n_tokens").cast("long").alias("n_tokens"))


def _prompt_sql(name: str) -> str:
    """A report prompt as SQL over title and context."""
    return "'" + build.PROMPTS[name].replace("{title}", "' || title || '").replace("{context}", "' || context || '") + "'"


_ASK = f"md5(CASE WHEN coalesce(n, 0) < 200 THEN {_prompt_sql('sparse')} ELSE {_prompt_sql('standard')} END)"


@query(f""", parts AS (
  SELECT c.id, CAST(u.doc_id AS VARCHAR) AS k, u.text FROM units u JOIN comm c ON c.id = u.community_id WHERE c.is_leaf AND c.level > 0
  UNION ALL SELECT p.id, CAST(u.doc_id AS VARCHAR), '【小类：' || c.title || '】' || u.text FROM units u JOIN comm c ON c.id = u.community_id JOIN comm p ON p.id = c.parent_id WHERE p.level > 0),
ctx AS (SELECT id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS context, sum(length(text)) AS n FROM parts GROUP BY 1),
low AS (SELECT id, level, parent_id, {_ASK} AS summary FROM (SELECT c.id, c.level, c.parent_id, c.title, coalesce(context, '无内容') AS context, n FROM comm c LEFT JOIN ctx USING (id) WHERE c.level > 0)),
top AS (SELECT id, level, {_ASK} AS summary FROM (
  SELECT c.id, c.level, any_value(c.title) AS title, coalesce(string_agg('【T】: ' || l.summary, chr(10) || chr(10) ORDER BY l.id), '无内容') AS context, sum(length('【T】: ' || l.summary)) AS n
  FROM comm c LEFT JOIN low l ON l.parent_id = c.id AND l.level = 1 WHERE c.level = 0 GROUP BY 1, 2))
SELECT id AS community_id, 'T' AS title, CAST(level AS INT) AS level, summary FROM low UNION ALL SELECT id, 'T', CAST(level AS INT), summary FROM top""")
def report_build(s, d):
    """All reports bottom-up by a stand-in model that tells its prompt's md5; contexts whole, in one bin each."""
    whole = ReportParams(single_bin=1 << 60)
    return build.build_reports(views.units(s, d), views.communities(s, d), reports.stub_model, p=whole).select("community_id", "title", "level", "summary")


@query(", x AS (SELECT 1) SELECT u.doc_id FROM units u WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_pending(s, d):
    done = s.read.parquet(f"{d}/labels.parquet")
    return io.pending(views.units(s, d).select("doc_id"), done, ["doc_id"], F.col("quality") == 1)


@query(""", x AS (SELECT count(*) AS n_reports, count(*) FILTER (summary IN ('处理错误')) AS n_errors FROM reports), y AS (SELECT count(*) AS n_communities FROM flat)
SELECT n_reports, n_errors, n_communities, n_reports = n_communities AND n_errors = 0 AS complete FROM x, y""")
def completeness(s, d):
    return io.complete(views.reports(s, d), views.communities(s, d), ["处理错误"])


@query(", x AS (SELECT 1) SELECT u.doc_id, e.vec_id IS NOT NULL AS stored FROM units u LEFT JOIN embeddings e ON e.vec_id = u.doc_id")
def vector_backfill(s, d):
    """Every unit ends with a valid vector; which were stored before is kept for the record."""
    u = views.units(s, d).select("doc_id", F.col("doc_id").cast("string").alias("id"), "text")
    old = views.vectors(s, d).select(F.col("doc_id").cast("string").alias("id"), "vector")
    log = old.limit(0).select("id", F.lit("").alias("timestamp"), "vector")
    out = reports.backfill(u, old, log, reports.stub_embedder())
    return out.filter(~v.is_placeholder(F.col("vector"))).join(old.select("id", F.col("vector").isNotNull().alias("stored")), "id").select("doc_id", "stored")


@query(", x AS (SELECT count(*) AS n FROM units), y AS (SELECT count(*) AS n FROM vecs) SELECT x.n - y.n AS n_null, CAST(0 AS BIGINT) AS n_zero, y.n AS n_valid FROM x, y")
def vector_audit(s, d):
    return reports.vector_audit(views.vectors(s, d))


@query("SELECT doc_id, sha256(source || ':True') AS cache_key FROM documents")
def cache_keys(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", io.cache_key(F.col("source"), True).alias("cache_key"))


@query(r", x AS (SELECT 1) SELECT doc_id, CASE WHEN len(k) > 0 THEN source || ' ' || array_to_string(k, ' ') ELSE source END AS enhanced FROM (SELECT doc_id, source, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS k FROM units)")
def query_enhance(s, d):
    return views.units(s, d).select("doc_id", t.enhance(F.col("source"), t.keywords(F.col("text"))).alias("enhanced"))


_ANSWER = _MICRO + _CHUNK + """, b AS (SELECT doc_id, k FROM o WHERE rn = 1),
whole AS (SELECT u.id, any_value(u.path) AS path, any_value('[' || u.l0 || '·' || CASE WHEN u.l2 = '' THEN u.l1 ELSE u.l2 END || '] ' || CASE WHEN length(u.text) > 700 THEN
    left(u.text, 200) || ' ...[检索定位] ' || CASE WHEN b.k = c.n THEN right(u.text, 300) ELSE substring(u.text, CAST(200 * b.k + 1 AS INT), 300) END || ' ... ' || right(u.text, 100) ELSE u.text END) AS t
  FROM units u LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY u.id),
pr AS (SELECT m.seq, m.id, coalesce(w.t, m.text) AS text, m.score, m.source_type, m.relation_type, m.weight, m.anchor_title, coalesce(w.path, m.title) AS path FROM micro m LEFT JOIN whole w USING (id)),
dd AS (SELECT *, min(seq) OVER (PARTITION BY id) AS fst, row_number() OVER (PARTITION BY id ORDER BY CASE source_type WHEN 'anchor' THEN 1 WHEN 'neighbor' THEN 2 ELSE 3 END, seq) AS dn FROM pr),
rk AS (SELECT *, CASE WHEN source_type = 'neighbor' THEN score * weight * 0.9 ELSE score END AS adjusted FROM dd WHERE dn = 1),
ps AS (SELECT *, row_number() OVER (ORDER BY adjusted DESC, fst) AS position, '[Source: ' || path || ']' || CASE WHEN source_type = 'neighbor' THEN ' [关联证据: 通过 "' || relation_type || '" 关联到 "' || anchor_title || '"]' ELSE '' END AS meta FROM rk),
sf AS (SELECT *, sum(length(meta) + 1 + length(text) + 1) OVER (ORDER BY position) AS used FROM ps)
"""


@query(_ANSWER + "SELECT CAST(position AS INT) AS position, id, source_type, round(adjusted, 6) AS adjusted, CAST(used AS BIGINT) AS used FROM sf WHERE used <= 32000")
def micro_answer(s, d):
    """The context of a whole detail-first retrieval."""
    u = views.vectors(s, d)
    q = views.query_vector(s, d)
    found = answer.process(retrieve.micro(u, views.reports(s, d), edges_of(s, d), q, MICRO), chunked(s, d), q)
    entries, _ = answer.fuse(found, u, "micro")
    return entries.select("position", "id", "source_type", r6("adjusted").alias("adjusted"), "used")


def flagship(s: SparkSession, d: str) -> DataFrame:
    return micro_answer(s, d)
