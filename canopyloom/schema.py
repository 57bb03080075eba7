"""The tables' schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in ("l0", "l1", "l2", "text", "source", "note")])
TEXT_UNITS = "id string, text string, n_tokens int, vector array<float>, community_id string, text_chunks array<string>, chunk_vectors array<array<float>>, head string, tail string, source_metadata string, hierarchy_path string, prepend_source boolean"
COMMUNITIES = "id string, title string, level int, parent_id string, child_ids array<string>, is_leaf boolean"
RELATIONSHIPS = "source_id string, target_id string, weight double, relation_type string, description string, vector_score double"
REPORTS = "community_id string, title string, level int, summary string, findings string, full_content string, embedding array<float>, finding_vectors array<array<float>>"
RESULTS = "seq long, id string, text string, score double, source_type string, relation_type string, weight double, community_id string, title string"
EVENTS_LOG = "index string, status string, timestamp string, vector_norm double, sample array<double>, is_zero boolean, chunk_count int"
