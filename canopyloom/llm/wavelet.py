"""Token ids as wavelet matrices: succinct bit-planes in one compressed file per shard.

A file holds documents in order. Its planes (most significant bit first) are those
of a wavelet matrix over all their ids: at each level the ids' bits are stored in
the level's order, and the next level takes the ids with bit 0 before those with
bit 1. A plane is cut into blocks of ``BLOCK`` bytes, each compressed alone, and
the directory at the end holds where each block lies and how many ones precede
it, so that rank and select touch one block a level: a token at a position, a
token's count up to a position and its k-th occurrence are answered without
reading the file as a whole.

Layout: blocks, then the compressed directory, its length as an unsigned
little-endian 64-bit number, and ``MAGIC``.

Shards are ranges of the documents' ids. A document with a null id comes first;
repeated ids are documents of their own, in the order of their texts' hashes. A
null or empty text is the end id alone. An empty table makes no files and gives an
empty table. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyloom.storage import cut, fresh_path, open_fs

MAGIC = b"CLWAVE01"
BLOCK = 1 << 16
MANIFEST = "shard long, part int, path string, n_docs long, n_tokens long"


def partition(ids: np.ndarray, k: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Bit k of each id, packed, and the ids with bit 0 before those with bit 1. In steps that fit a processor's cache."""
    bit, n = ids.dtype.type(1 << k), len(ids)
    packed = np.empty(-(-n // 8), np.uint8)
    for i in range(0, n, step):
        packed[i // 8 : (min(n, i + step) + 7) // 8] = np.packbits((ids[i : i + step] & bit) != 0, bitorder="little")
    low, out = 0, np.empty_like(ids)
    high = n - int(np.bitwise_count(packed).sum())
    for i in range(0, n, step):
        part = ids[i : i + step]
        ones = (part & bit) != 0
        a, b = part.take(np.flatnonzero(~ones)), part.take(np.flatnonzero(ones))
        out[low : low + len(a)], out[high : high + len(b)] = a, b
        low, high = low + len(a), high + len(b)
    return packed, out


def spread(ones: np.ndarray, below: np.ndarray, zeros: int, bit: int, step: int = 1 << 18) -> np.ndarray:
    """A level's ids from those of the level below it: what ``partition`` took apart."""
    out, low, high = np.empty_like(below), 0, zeros
    for i in range(0, len(below), step):
        part = np.unpackbits(ones[i // 8 : (i + step) // 8], count=min(step, len(below) - i), bitorder="little").view(bool)
        a, b = np.flatnonzero(~part), np.flatnonzero(part)
        own = out[i : i + step]
        own[a], own[b] = below[low : low + len(a)], below[high : high + len(b)] | below.dtype.type(bit)
        low, high = low + len(a), high + len(b)
    return out


def build(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> Iterator[bytes]:
    """The bytes of a file over ``ids`` (unsigned), which belong to documents of ``lengths``."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    width, at = max(1, int(ids.max(initial=0)).bit_length()), 0
    planes = []
    for k in range(width - 1, -1, -1):
        packed, ids = partition(ids, k)
        blocks, before, seen = [], [], 0
        for i in range(0, len(packed), BLOCK):
            part = packed[i : i + BLOCK]
            before.append(seen)
            seen += int(np.bitwise_count(part).sum())
            data = squeeze(part.tobytes())
            blocks.append(at)
            at += len(data)
            yield data
        planes.append({"blocks": [*blocks, at], "before": [*before, seen], "zeros": len(ids) - seen})
    known = [x is not None for x in doc_ids]
    head = {"n": len(ids), "docs": [x if x is not None else 0 for x in doc_ids], "known": None if all(known) else known, "lengths": lengths, "planes": planes}
    data = squeeze(json.dumps(head).encode())
    yield data + struct.pack("<Q", len(data)) + MAGIC


class Reader:
    """Answers from a file: ``source`` is a seekable file open for reading."""

    def __init__(self, source):
        import zstandard

        self.source, self._unzip = source, zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a wavelet file")
        size = struct.unpack("<Q", tail[:8])[0]
        source.seek(end - 16 - size)
        head = json.loads(self._unzip(source.read(size)))
        self.n, self.planes, self.lengths = head["n"], head["planes"], head["lengths"]
        self.docs = [x if k else None for x, k in zip(head["docs"], head["known"] or [True] * len(head["docs"]), strict=True)]
        self._block = lru_cache(64)(self._load)

    def __len__(self) -> int:
        return self.n

    def _load(self, level: int, i: int) -> np.ndarray:
        at = self.planes[level]["blocks"]
        self.source.seek(at[i])
        return np.frombuffer(self._unzip(self.source.read(at[i + 1] - at[i])), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // (8 * BLOCK))[i // 8 % BLOCK] >> i % 8 & 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, within = divmod(i, 8 * BLOCK)
        seen = self.planes[level]["before"][block]
        if within:
            own = self._block(level, block)
            seen += int(np.bitwise_count(own[: within // 8]).sum())
            if within % 8:
                seen += int(own[within // 8] & (1 << within % 8) - 1).bit_count()
        return seen

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of a plane's k-th (from 0) one or zero."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def token(self, i: int) -> int:
        """The token at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, plane in enumerate(self.planes):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = plane["zeros"] + ones if bit else i - ones
        return out

    def count(self, token: int, end: int | None = None) -> int:
        """How often a token occurs before position ``end``."""
        lo, hi = self._interval(token, self.n if end is None else end)
        return hi - lo

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if token >> len(self.planes):
            return 0, 0
        for level, plane in enumerate(self.planes):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (plane["zeros"] + a, plane["zeros"] + b) if token >> len(self.planes) - 1 - level & 1 else (lo - a, hi - b)
        return lo, hi

    def occurrence(self, token: int, k: int) -> int:
        """Position of a token's k-th occurrence, from 0."""
        lo, hi = self._interval(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> len(self.planes) - 1 - level & 1
            at = self._select(level, bit, at - self.planes[level]["zeros"] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All ids in order."""
        wide = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, wide)
        for level in range(len(self.planes) - 1, -1, -1):
            plane = self.planes[level]
            packed = [self._load(level, i) for i in range(len(plane["blocks"]) - 1)]
            if packed:
                out = spread(np.concatenate(packed), out, plane["zeros"], 1 << len(self.planes) - 1 - level)
        return out


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    shard_chars: int = 12_000_000,
    file_tokens: int = 12_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write shards below ``folder``; gives the manifest (MANIFEST), of which shard and part are the order.

    A task that runs again writes files with new names; only files in the manifest count.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    mix = F.xxhash64("text")
    ordered = docs.repartitionByRange(1 + chars // shard_chars, F.col("doc_id").asc_nulls_first(), mix).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), mix)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from canopyloom.llm.pieces import arrow, columns, encoder

        codec = encoder(tokenizer)
        wide = codec.dtype if end_id <= np.iinfo(codec.dtype).max else np.dtype("<u4")
        end, shard, part = np.array([end_id], wide), TaskContext.get().partitionId(), 0
        keys: list = []

        def texts():
            for k, t in columns(batches):
                keys.append(k)
                yield t

        def save(ids, lengths):
            fs, at = open_fs(folder)
            fs.create_dir(at, recursive=True)
            name = f"{shard:08d}-{part:04d}-{uuid.uuid4().hex}.wave"
            n = sum(lengths)
            with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
                for data in build(np.concatenate(ids), keys[: len(lengths)], lengths):
                    f.write(data)
            del keys[: len(lengths)]
            return arrow(pd.DataFrame([(shard, part, f"{folder}/{name}", len(lengths), n)], columns=[c.split()[0] for c in MANIFEST.split(", ")]), MANIFEST)

        held, lengths, n = [], [], 0
        for ids in codec.stream(texts()):
            held += [ids, end]
            lengths.append(len(ids) + 1)
            n += lengths[-1]
            if n >= file_tokens:
                yield save(held, lengths)
                held, lengths, n, part = [], [], 0, part + 1
        if lengths:
            yield save(held, lengths)

    return cut(ordered.mapInArrow(task, MANIFEST), "wavelet-manifest")


def with_base(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """The manifest with ``base``, the tokens before each file, by sums within and over groups of shards."""
    inner = Window.partitionBy("grp").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.withColumn("grp", F.floor(F.col("shard") / group))
    before = rows.groupBy("grp").agg(F.sum("n_tokens").alias("n")).select("grp", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("grp_base"))
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, "grp").withColumn("base", F.col("own") + F.col("grp_base")).drop("grp", "own", "grp_base")


def read(manifest: DataFrame, tasks: int) -> DataFrame:
    """Each document from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, base in zip(b["path"], b["base"], strict=True):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    reader = Reader(f)
                    ids, docs, lengths = reader.all(), reader.docs, np.array(reader.lengths, np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "start": base + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    return with_base(manifest).select("path", "base").repartition(tasks).mapInPandas(task, schema)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents' ids as shards in the shared folder and read them back."""
    manifest = write(docs, fresh_path(spark, "wavelet"), tokenizer, **options)
    return read(manifest, max(1, manifest.count()))
