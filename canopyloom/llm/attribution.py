"""Token counts by offset-mapped attribution.

A document is its fields' texts joined by a separator. It is encoded once, as a
whole; byte-level tokens spell the text's UTF-8 bytes, so running sums of their
lengths are their spans. These spans are interval-joined to the sections (fields,
or lines of fields), which are disjoint and in order.

A token that lies in one section counts there. One that overlaps several sections
goes by ``rule``: ``start`` (the first of them), ``end`` (the last), ``majority``
(most bytes; ties to the earlier) or ``proportional`` (shared out by bytes). A
token that touches no section, such as a separator, goes to the section before
it. Shares are whole numbers except under ``proportional``; they add up to the
document's tokens exactly.

A null field is a section of no bytes, and so is an empty one; a document without
any token has sections with count 0. Repeated rows are counted as rows of their
own. An empty table gives an empty table. Only the id and the fields are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "majority", "proportional")


def allocate(ends: np.ndarray, starts_s: np.ndarray, ends_s: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens that touch it cross a boundary.

    ends: where each token ends, in bytes; a token starts where the one before it
    ends. starts_s, ends_s: the sections' spans, in order and disjoint.
    """
    n = len(starts_s)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    full = np.flatnonzero(ends_s > starts_s)  # sections of no bytes get nothing while there are others
    if not len(full):
        if n:
            counts[0] = len(ends)
        return counts, crossing
    a, b = starts_s[full], ends_s[full]
    s = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(b, s, "right")  # the first section that ends after the token starts
    last = np.searchsorted(a, ends, "left") - 1  # the last section that starts before the token ends
    to = np.where(last < first, np.maximum(last, 0), last if rule == "end" else first)
    many = np.flatnonzero(last > first)
    shares: list[tuple[int, float]] = []
    for t in many:
        own = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(ends[t], b[own]) - np.maximum(s[t], a[own])
        crossing[full[own]] += 1
        if rule == "majority":
            to[t] = own[np.argmax(overlap)]
        elif rule == "proportional":
            shares += zip(own, overlap / overlap.sum(), strict=True)
    keep = np.ones(len(ends), bool)
    if rule == "proportional":
        keep[many] = False
    counts[full] += np.bincount(to[keep], minlength=len(full))
    for i, x in shares:
        counts[full[i]] += x
    return counts, crossing


def sections(texts: Sequence[str], sep: str, by_line: bool) -> tuple[list[int], list[int], np.ndarray, np.ndarray, list[int]]:
    """Field and line number, start, end (bytes) and characters of each section."""
    field, line, start, end, chars = [], [], [], [], []
    at, gap = 0, len(sep.encode())
    for i, t in enumerate(texts):
        for k, x in enumerate(t.split("\n") if by_line else [t]):
            if k:
                at += 1
            n = len(x) if x.isascii() else len(x.encode())
            field.append(i)
            line.append(k)
            start.append(at)
            at += n
            end.append(at)
            chars.append(len(x))
        at += gap
    return field, line, np.array(start, np.int64), np.array(end, np.int64), chars


def attribute(
    docs: DataFrame,
    tokenizer: str,
    fields: Sequence[str] = ("text",),
    sep: str = "\n",
    by_line: bool = True,
    rule: str = "majority",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per section: doc_id, field, line, n_bytes, n_chars, n_tokens (double), crossing.

    tokenizer: the file of a byte-level BPE.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = "doc_id long, field string, line int, n_bytes long, n_chars long, n_tokens double, crossing long"
    names = list(fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from canopyloom.llm.pieces import arrow, columns, encoder

        codec = encoder(tokenizer)
        if codec.kind == "words":
            raise ValueError("attribution needs a byte-level tokenizer, whose tokens spell the text")
        vocab = codec.tokenizer.get_vocab(with_added_tokens=True)
        size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            size[i] = len(token)  # one sign a byte
        waiting: deque = deque()

        def texts():
            for key, *own in columns(batches):
                own = [x or "" for x in own]
                waiting.append((key, own))
                yield sep.join(own)

        parts: list[tuple] = []
        rows = 0

        def frame():
            cols = list(zip(*parts, strict=True))
            ids = np.repeat(np.array(cols[0], object), [len(x) for x in cols[2]])
            return arrow(pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"), "field": np.array(names, object)[np.concatenate(cols[1])],
                "line": np.concatenate(cols[2]), "n_bytes": np.concatenate(cols[3]), "n_chars": np.concatenate(cols[4]),
                "n_tokens": np.concatenate(cols[5]), "crossing": np.concatenate(cols[6]),
            }), schema)

        for ids in codec.stream(texts()):
            key, own = waiting.popleft()
            field, line, a, b, chars = sections(own, sep, by_line)
            counts, crossing = allocate(np.cumsum(size[ids]), a, b, rule)
            parts.append((key, np.array(field), np.array(line, np.int32), b - a, np.array(chars, np.int64), counts, crossing))
            rows += len(line)
            if rows > 50_000:
                yield frame()
                parts, rows = [], 0
        if parts:
            yield frame()

    cols = [F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(names))]
    return docs.select(*cols).mapInArrow(task, schema)
