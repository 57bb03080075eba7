"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyloom.llm import attribution, decontam, lines, maintext, neardup, nndescent, packing, quality, warc, wavelet
from canopyloom.llm.tables import table, tokenizer_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), bare AS (
  SELECT *, trim(line, E' \t\r' || chr(11) || chr(12)) AS key FROM lines
), totals AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), common AS (
  SELECT l.source, l.key FROM bare l JOIN totals t USING (source)
  WHERE l.key <> '' GROUP BY l.source, l.key, t.pages
  HAVING count(DISTINCT doc_id) > 0.01 * t.pages AND count(DISTINCT doc_id) >= 3
)
SELECT d.doc_id, d.source,
  coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.pos) FROM bare l
            WHERE l.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM common c WHERE c.source = l.source AND c.key = l.key)), '') AS text
FROM documents d
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM q
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return attribution.attribute(docs, tokenizer_path("byte_bpe_50k.json"), fields=("lang", "source", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS g FROM w
), x AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)
), e AS (
  SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS label FROM documents
  UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.id
), c AS (
  SELECT id, min(label) AS label FROM r GROUP BY id
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.label AS component_id, s.doc_id = c.label AS kept FROM s JOIN c ON c.id = s.doc_id
"""


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nndescent.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_quality, op4_token_counts, op5_packing, op6_decontamination, op7_main_text, op8_wavelet, op9_minhash, op10_nn_descent)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op9_minhash": OP9_SQL}
