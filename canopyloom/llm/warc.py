"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes`` that are compressed each
alone; a skippable frame at the end holds the seek table (each frame's compressed
and uncompressed size, as the seekable Zstandard format lays it down). A record is
found by its frame and its offset within the frame: the index has both for each
record, and ``read_record`` reads one frame for one record.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the
largest id keeps the payload (``response``); the others are ``revisit`` records
that refer to it and hold headers only. Smaller payloads are all kept.

A null payload is an empty one. Rows that repeat the largest id with an equal
payload are all responses. A null id counts as smaller than any other; a record
without an id has no id in its header. An empty table gives no archives and an
empty table. Columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyloom.storage import cut, fresh_path, open_fs, small_side

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "archive string, frame int, offset long, length long, page_id long, payload_digest string"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, frame int, offset long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block holds the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line is under ''."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    out = {"": first}
    for line in lines:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """The record at an offset: its headers, its HTTP headers, its payload, and where it ends."""
    cut_at = data.index(b"\r\n\r\n", at)
    head = headers(data[at:cut_at])
    if not head[""].startswith("WARC/"):
        raise ValueError("no record at this offset")
    end = cut_at + 4 + int(head["content-length"])
    block = data[cut_at + 4 : end]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, headers(http), payload, end + 4


def number(urn: str | None) -> int | None:
    """The id in ``<urn:page:ID>``."""
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


class Bundle:
    """Writes frames and, at its end, the seek table to an open stream."""

    def __init__(self, out, level: int):
        import zstandard

        self.out, self.squeeze, self.sizes = out, zstandard.ZstdCompressor(level=level).compress, []

    def frame(self, data: bytes) -> None:
        packed = self.squeeze(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))

    def finish(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of each frame of a seekable file."""
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    source.seek(end - 9 - n * entry)
    table, out, at = source.read(n * entry), [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", table, i * entry)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(source, where: tuple[int, int, int]) -> bytes:
    import zstandard

    source.seek(where[0])
    return zstandard.ZstdDecompressor().decompress(source.read(where[1]), max_output_size=where[2])


def read_record(archive: str, frame: int, offset: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record of an archive by its place in the index."""
    fs, path = open_fs(archive)
    with fs.open_input_file(path) as f:
        return parse(read_frame(f, seek_table(f)[frame]), offset)[:3]


def with_refers_to(pages: DataFrame, min_revisit: int) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and refers_to.

    Payloads aren't shuffled while the table of repeated digests fits a broadcast;
    beyond that the digest join carries them and AQE splits a hot digest.
    """
    pages = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = pages.filter(F.octet_length("html") >= min_revisit)
    copies = cut(large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1 and kept is not null").drop("n"), "warc-copies")
    joined = pages.join(small_side(copies, 120), "digest", "left")
    return joined.withColumn("refers_to", F.when((F.octet_length("html") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))).drop("kept")


def write(
    pages: DataFrame,
    folder: str,
    frame_bytes: int = 1 << 20,
    archive_bytes: int = 256 << 20,
    min_revisit: int = 1000,
    level: int = 3,
    date: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Write archives below ``folder``; gives the index, one row per record (INDEX).

    A task that runs again writes archives with new names; only those in the index count.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out = bundle = None
        frame, held, written, index, name = [], 0, 0, [], ""

        def rows():
            return pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})

        def flush():
            nonlocal frame, held, written
            if frame:
                bundle.frame(b"".join(frame))
                written += held
                frame, held = [], 0

        for b in batches:
            for page_id, url, html, digest, refers in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"], strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    bundle, written = Bundle(out, level), 0
                page_id = None if pd.isna(page_id) else int(page_id)
                data = record(page_id, url, html.encode("utf-8"), digest, None if pd.isna(refers) else int(refers), date)
                if held and held + len(data) > frame_bytes:
                    flush()
                index.append((f"{folder}/{name}", len(bundle.sizes), held, len(data), page_id, digest))
                frame.append(data)
                held += len(data)
                if written + held > archive_bytes:
                    flush()
                    bundle.finish()
                    out.close()
                    bundle = None
            if bundle is None and index:
                yield rows()
                index = []
        if bundle is not None:
            flush()
            bundle.finish()
            out.close()
            yield rows()

    return cut(with_refers_to(pages, min_revisit).select("page_id", "url", "html", "digest", "refers_to").mapInPandas(task, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """All records of the archives in an index, read from the archives (OUT).

    Digest and length of a response are those of the payload that was read; a
    revisit has them in its headers.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                fs, path = open_fs(archive)
                with fs.open_input_file(path) as f:
                    for k, where in enumerate(seek_table(f)):
                        data, at, rows = read_frame(f, where), 0, []
                        while at < len(data):
                            head, http, payload, end = parse(data, at)
                            kind, told = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                            size = len(payload) if kind == "response" else int(http["content-length"])
                            digest = hashlib.sha1(payload).hexdigest() if kind == "response" else told
                            if digest != told:
                                raise ValueError(f"{archive}, frame {k}, offset {at}: the payload's digest is {digest}, its header says {told}")
                            rows.append((number(head["warc-record-id"]), size, digest, kind, number(head.get("warc-refers-to")), archive, k, at))
                            at = end
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    archives = index.select("archive").distinct()
    return archives.repartition(max(1, archives.count())).mapInPandas(task, OUT)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    return read(write(pages, fresh_path(spark, "warc"), **options))
