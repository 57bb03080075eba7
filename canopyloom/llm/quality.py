"""A quality classifier by compression with two Zstandard dictionaries.

One dictionary is built from texts labelled bad, one from texts labelled good. A
text is cut into chunks of ``chunk`` bytes, each compressed with either dictionary;
the sizes are summed over the whole text. The difference of the two sums, divided by
their sum and by the text's length, with the compression ratio and the length's
logarithm, goes through a logistic regression (second order, weighted to the
labels' true shares), which calibrates it to a probability.

Fitting is bounded and documented: at most ``per_class`` labelled rows of each
class, in the order of a hash of their ids, of at most ``fit_chars`` characters.
Half of them build the dictionaries, the other half calibrates. Every text is then
scored whole, in one pass without a shuffle.

A null or empty text is scored like any text, from its sizes of nothing. Where the
labels hold one class only (or none), the score is that class's share (or 0.5).
Repeated rows get equal scores; a null id is never held out. An empty table gives
an empty table. Columns other than the id and the text are ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The threshold of ``predicted``.
KEEP = 0.3


@dataclass
class Model:
    bad: bytes
    good: bytes
    level: int
    chunk: int
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None


def chunks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def squeezers(model: Model) -> list:
    import zstandard

    out = []
    for data in (model.bad, model.good):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return out


def sizes(texts, chunk: int, squeeze: list) -> np.ndarray:
    """Bytes, compressed with the bad and with the good dictionary (without frames' fixed 6 bytes), one row a text."""
    rows = []
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass") if isinstance(t, str) or t is None else b""
        parts = chunks(data, chunk)
        rows.append((len(data), *(sum(map(len, map(s, parts))) - 6 * len(parts) for s in squeeze)))
    return np.array(rows, float).reshape(-1, 3)


def basis(counts: np.ndarray) -> np.ndarray:
    n, bad, good = counts[:, 0] + 1, np.maximum(counts[:, 1], 1), np.maximum(counts[:, 2], 1)
    return np.stack([(bad - good) / (bad + good), (bad - good) / n, np.log((bad + good) / 2 / n), np.log(n)], 1)


def design(x: np.ndarray, model: Model) -> np.ndarray:
    x = np.clip(x, model.low, model.high)  # beyond what was fitted the curve stays level
    k = x.shape[1]
    square = [x[:, i] * x[:, j] for i in range(k) for j in range(i, k)]
    return np.stack([*x.T, *square], 1)


def score_texts(texts, model: Model, squeeze: list) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = (design(basis(sizes(texts, model.chunk, squeeze)), model) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[1:] + model.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (the constant first) by Newton's method; a step is halved until it lowers the loss, as whole ones diverge where classes separate."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        slope, size = float(gradient @ step), 1.0
        while loss(w - size * step) > now - 1e-4 * size * slope and size > 1e-9:
            size /= 2
        w = w - size * step
        now = loss(w)
        if size * np.abs(step).max() < 1e-6:
            break
    return w


def fit_rows(rows: list[tuple[str, int]], shares: dict[int, float], dictionary_bytes: int = 65_536, level: int = 3, chunk: int = 2000) -> Model:
    """rows: (text, label). shares: each label's share of all labelled rows."""
    import zstandard

    empty = np.zeros(4)
    build, calibrate, parts = {0: [], 1: []}, [], {0: 0, 1: 0}
    for text, label in rows:
        if parts[label] % 2:
            calibrate.append((text, label))
        else:
            build[label].append(text)
        parts[label] += 1
    if not all(build.values()) or len({y for _, y in calibrate}) < 2:
        known = shares.get(1, 0.0) if sum(shares.values()) else 0.5
        return Model(b"", b"", level, chunk, empty, empty, empty, empty, empty, constant=float(known))
    dictionaries = []
    for label in (0, 1):
        samples = [c for t in build[label] for c in chunks(t.encode("utf-8", "surrogatepass"), chunk) if len(c) > 7]
        try:
            data = zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples to select from: they are the dictionary
            data = b"".join(samples)[-dictionary_bytes:] or b"\0" * 8
        dictionaries.append(data)
    model = Model(*dictionaries, level, chunk, empty - np.inf, empty + np.inf, empty, empty + 1, empty)
    x = basis(sizes([t for t, _ in calibrate], chunk, squeezers(model)))
    y = np.array([label for _, label in calibrate], float)
    model.low, model.high = x.min(0), x.max(0)
    x = design(x, model)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([shares[int(k)] / taken[int(k)] for k in y]) * len(y)
    model.weights = logistic((x - model.mean) / model.scale, y, weight, ridge=0.1)
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 4000, fit_chars: int = 20_000, **options) -> Model:
    """A model from labelled rows outside the held-out fold."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    own = own.filter(~held_out(F.col("id"))).distinct()
    shares = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    picked = None
    for label in (0, 1):
        some = own.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.length("text") <= fit_chars)
    rows = texts.join(F.broadcast(picked), "id").dropDuplicates(["id", "label"]).select("id", "text", "label").collect()  # per_class rows of either class at most
    rows.sort(key=lambda r: (r["id"], r["label"]))
    return fit_rows([(r["text"], r["label"]) for r in rows], {k: shares.get(k, 0) / total if total else 0.0 for k in (0, 1)}, **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = squeezers(model) if model.constant is None else []
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": score_texts(b["text"].tolist(), model, squeeze)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(task, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = KEEP) -> DataFrame:
    """``docs``, all columns, without the rows that score below the threshold."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = squeezers(model) if model.constant is None else []
        for b in batches:
            yield pd.Series(score_texts(b.tolist(), model, squeeze))

    return docs.filter(scored(F.col(f"`{text_col}`")) >= threshold)
