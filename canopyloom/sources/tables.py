"""Loading the stored tables of a built corpus, saving them, and the persistent cache of expanded queries."""

from __future__ import annotations

import json
from collections.abc import MutableMapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyloom import schema
from canopyloom.functions import text as t
from canopyloom.functions import vectors as v
from canopyloom.operators import graph
from canopyloom.sources import io
from canopyloom.storage import open_fs

NAMES = ("communities", "text_units", "reports", "relationships")


@dataclass
class Corpus:
    """A loaded corpus; ``relationships`` is None where there is no such table."""

    communities: DataFrame
    text_units: DataFrame
    reports: DataFrame
    relationships: DataFrame | None


def shaped(df: DataFrame, kind: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``df`` in the columns of a schema: missing ones become their default or null, nested ones may arrive as JSON text."""
    out, have = [], dict(df.dtypes)
    for f in T.StructType.fromDDL(kind).fields:
        name, want = f.name, f.dataType.simpleString()
        if name not in have:
            x = (defaults or {}).get(name, F.lit(None)).cast(want)
        elif isinstance(f.dataType, T.ArrayType) and have[name] == "string":
            x = t.list_column(F.col(name), want)
        elif isinstance(f.dataType, T.StringType) and have[name].startswith(("array", "struct", "map")):
            x = F.to_json(name)
        else:
            x = F.col(name).cast(want)
        if defaults and name in defaults:
            x = F.coalesce(x, defaults[name].cast(want))
        out.append(x.alias(name))
    return df.select(*out)


def load_communities(spark: SparkSession, path: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    rows = shaped(io.read_parquet(spark, path), schema.COMMUNITIES, {"title": F.lit(""), "level": F.lit(0), "child_ids": empty})
    return rows.withColumn("is_leaf", F.coalesce("is_leaf", F.size("child_ids") == 0))


def load_units(spark: SparkSession, path: str) -> DataFrame:
    """Units; a placeholder vector becomes null, as do chunk vectors in another number than the chunks."""
    empty = F.array().cast("array<string>")
    rows = shaped(io.read_parquet(spark, path), schema.TEXT_UNITS, {"text": F.lit(""), "text_chunks": empty, "head": F.lit(""), "tail": F.lit(""), "hierarchy_path": F.lit(""), "prepend_source": F.lit(False)})
    rows = rows.withColumn("vector", F.when(~v.is_placeholder(F.col("vector")), F.col("vector")))
    return rows.withColumn("chunk_vectors", F.when(F.size("chunk_vectors") == F.size("text_chunks"), F.col("chunk_vectors")))


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports, one a community: of several rows the last one written counts.

    The last is the row of the largest file name and then the largest place in it, as
    writers number their files in order.
    """
    raw = io.read_parquet(spark, path)
    order = F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = shaped(raw.withColumn("_cl_order", order), schema.REPORTS + ", _cl_order struct<f:string,n:bigint>", {"title": F.lit(""), "summary": F.lit(""), "findings": F.lit("[]"), "full_content": F.lit("")})
    last = rows.groupBy("community_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("community_id", "_cl_order")]), "_cl_order").alias("r"))
    return last.select("community_id", "r.*")


def load_relationships(spark: SparkSession, path: str) -> DataFrame | None:
    """Edges, or None without the table."""
    fs, at = open_fs(path)
    from pyarrow.fs import FileType

    if fs.get_file_info(at).type == FileType.NotFound:
        return None
    return shaped(io.read_parquet(spark, path), schema.RELATIONSHIPS, {"weight": F.lit(0.0), "relation_type": F.lit(""), "description": F.lit("")})


def load_all(spark: SparkSession, folder: str) -> Corpus:
    """All tables of a folder, one Parquet table each under its name."""
    at = {n: f"{folder.rstrip('/')}/{n}.parquet" for n in NAMES}
    return Corpus(load_communities(spark, at["communities"]), load_units(spark, at["text_units"]), load_reports(spark, at["reports"]), load_relationships(spark, at["relationships"]))


def retrieval_views(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """(units, reports) in the columns that retrieval and answers read."""
    units = corpus.text_units.select("id", "text", F.col("hierarchy_path").alias("path"), "community_id", "vector", "text_chunks", "chunk_vectors", F.when(F.col("prepend_source"), F.coalesce(F.get_json_object("source_metadata", "$.source"), F.lit(""))).otherwise("").alias("prepend"))
    places = corpus.communities.select(F.col("id").alias("community_id"), "is_leaf", "parent_id")
    reports = corpus.reports.join(places, "community_id", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(True)))
    return units, reports


def write_graph(comm: DataFrame, lineage: DataFrame, edges: DataFrame, folder: str) -> dict[str, tuple[str, str]]:
    """The map and network files (TSV) for level 1 alone and for levels 1 and 2; gives their paths."""
    out = {}
    for name, levels in (("macro", [1]), ("full", [1, 2])):
        nodes = graph.export_nodes(comm, lineage, edges, levels)
        at = f"{folder.rstrip('/')}/{name}_map", f"{folder.rstrip('/')}/{name}_network"
        rows = nodes.select(F.col("vos_id").alias("id"), "label", "description", "cluster", "weight")
        io.write_tsv(rows.coalesce(1).sortWithinPartitions("id"), at[0], header=True)
        io.write_tsv(graph.export_edges(edges, nodes), at[1], header=False)
        out[name] = at
    return out


class QueryCache(MutableMapping):
    """Expanded queries by key, each a JSON file in a folder that outlives the process."""

    def __init__(self, folder: str):
        self._fs, self._root = open_fs(folder.rstrip("/"))
        self._fs.create_dir(self._root, recursive=True)

    def _at(self, key: str) -> str:
        return f"{self._root}/{key}.json"

    def __getitem__(self, key: str):
        try:
            with self._fs.open_input_stream(self._at(key)) as f:
                return json.loads(f.read().decode())
        except (FileNotFoundError, ValueError):  # a broken file counts as none
            raise KeyError(key) from None

    def __setitem__(self, key: str, value: dict) -> None:
        with self._fs.open_output_stream(self._at(key)) as f:
            f.write(json.dumps(value, ensure_ascii=False).encode())

    def __delitem__(self, key: str) -> None:
        self._fs.delete_file(self._at(key))

    def __iter__(self):
        from pyarrow.fs import FileSelector

        return (x.base_name.removesuffix(".json") for x in self._fs.get_file_info(FileSelector(self._root)) if x.base_name.endswith(".json"))

    def __len__(self) -> int:
        return sum(1 for _ in self)
