"""Quality classifier: naive Bayes support vectors.

The features of a text are indicators of its byte n-grams, hashed into ``SLOTS`` slots,
and of the word bigrams of a word with itself, which share three indicators: whether a text
has one, four or sixteen of them (``TWINS``). Without these three the method still works,
less well on texts whose fault is stuttering: the README has the figures.
Each indicator is scaled by the class log-count ratio of its n-gram, and a linear
hinge-loss model is fitted to the scaled, length-normalised indicators by dual
coordinate descent (Hsieh et al., 2008). A logistic curve fitted to the margins of
training rows that the model did not see turns margins into scores from 0 to 1.

Fitting uses at most ``SAMPLE`` labelled rows of each class, taken in the order of a
hash of the id; ids are the only thing ordered for this, and the sample is the only
table broadcast. Features are taken where the texts are; the one task that fits gets no
texts, but at most ``DIMS`` / 8 bytes (16 KB) a row, 131 MB in all, however long the texts. Scoring is one pass over
all documents, whole texts, without a shuffle; the fitted model has a fixed size.

Defined results: null or empty text has no features and is scored by the bias alone;
rows without id are scored like any other; labels that are null or belong to no document
are not used; with no label of one of the classes every text scores 0.5; an empty table
gives an empty table; repeated rows score alike; label, language, source and id are
never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import release, slices, text_bytes, word_hashes, word_spans

BITS = 17
SLOTS = 1 << BITS
TWINS = (1, 4, 16)
DIMS = SLOTS + len(TWINS)
ORDERS = (1, 2, 3, 4)
SAMPLE = 4000
SMOOTH = 1.0
COST = 1.0
PASSES = 12


def features(text: pa.Array) -> Iterator[np.ndarray]:
    """Slots of the distinct byte n-grams of each text, sorted; a large text is read in blocks, so memory is bounded."""
    for part in slices(pa.RecordBatch.from_arrays([text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text], ["text"]), "text"):
        yield from _features(part.column(0))


def _features(text: pa.Array) -> Iterator[np.ndarray]:
    data, at = text_bytes(text)
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends, lower=True)
    twin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words[1:] == words[:-1], out=twin[2:])
    seen = np.zeros(DIMS, bool)
    for i in range(len(at) - 1):
        seen[:] = False
        if first[i + 1] > first[i]:
            seen[SLOTS:] = twin[first[i + 1]] - twin[first[i] + 1] >= np.array(TWINS)
        for a in range(at[i], at[i + 1], 1 << 20):
            d = data[a : min(at[i + 1], a + (1 << 20) + max(ORDERS) - 1)].astype(np.uint32)
            for n in ORDERS:
                if len(d) >= n:
                    h = np.full(len(d) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                    for j in range(n):
                        h = (h ^ d[j : len(d) - n + 1 + j]) * np.uint32(0x01000193)
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x85EBCA6B)
                    seen[h >> np.uint32(32 - BITS)] = True
        yield np.flatnonzero(seen)


class Rows:
    """Slots of many texts, packed: as 32-bit numbers, or as a bitmap where that is shorter."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    @staticmethod
    def pack(row: np.ndarray) -> bytes:
        if 4 * len(row) <= DIMS // 8:
            return b"n" + row.astype("<i4").tobytes()
        bits = np.zeros(DIMS, np.uint8)
        bits[row] = 1
        return b"b" + np.packbits(bits).tobytes()

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self.packed[i]
        return np.frombuffer(raw, "<i4", offset=1) if raw[:1] == b"n" else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=DIMS))

    def at(self, which: np.ndarray) -> Rows:
        return Rows([self.packed[i] for i in which])


def log_count_ratio(rows, y: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed counts p and q of each indicator in the two classes."""
    total = {label: np.full(DIMS, SMOOTH) for label in (1, 0)}
    for i in range(len(rows)):
        total[int(y[i])][rows[i]] += 1
    return np.log((total[1] / total[1].sum()) / (total[0] / total[0].sum()))


def lengths(rows, ratio: np.ndarray) -> np.ndarray:
    """One over the length of each text's scaled indicators."""
    return np.array([1 / max(1e-12, float(np.sqrt((ratio[rows[i]] ** 2).sum()))) for i in range(len(rows))])


def dual_descent(rows, ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = PASSES, seed: int = 7, least: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss; one dual variable is solved at a time, in a new random order each pass."""
    sign = np.where(y == 1, 1.0, -1.0)
    scale = lengths(rows, ratio)
    w, alpha = np.zeros(DIMS + 1), np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = ratio[r] * scale[i]
            gradient = sign[i] * (w[r] @ v + w[DIMS]) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                w[r] += step * sign[i] * v
                w[DIMS] += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < least:
            break
    return w


def margins(rows, ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    scale = lengths(rows, ratio)
    return np.array([w[rows[i]] @ (ratio[rows[i]] * scale[i]) + w[DIMS] for i in range(len(rows))])


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a m + b))) by Newton steps on the smoothed targets of Platt's method."""
    target = np.where(y == 1, (np.sum(y == 1) + 1) / (np.sum(y == 1) + 2), 1 / (np.sum(y == 0) + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(rows: Rows, y: np.ndarray, odds: float | None = None) -> tuple[np.ndarray, float]:
    """Weights to sum over a text's scaled indicators, folded with the ratio: (2, DIMS), and the bias; margins already carry the logistic curve.

    ``odds`` are those of label 1 among all labelled rows; the curve is shifted to them from the sample's.
    """
    if len(set(y.tolist())) < 2:
        return np.zeros((2, DIMS), np.float32), 0.0
    # every class weighs as it occurs; folds for the curve are dealt by position, which is by hash
    part = np.arange(len(y)) % 3
    seen, held = [], []
    for k in range(3):
        a, b = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(y[a].tolist())) < 2 or not len(b):
            continue
        ratio = log_count_ratio(rows.at(a), y[a])
        w = dual_descent(rows.at(a), ratio, y[a], np.full(len(a), COST))
        seen.append(margins(rows.at(b), ratio, w))
        held.append(y[b])
    ratio = log_count_ratio(rows, y)
    w = dual_descent(rows, ratio, y, np.full(len(y), COST))
    a, b = logistic(np.concatenate(seen), np.concatenate(held)) if seen else (1.0, 0.0)
    b += np.log(odds / ((y == 1).sum() / (y == 0).sum())) if odds else 0.0
    return np.stack([a * w[:DIMS] * ratio, ratio * ratio]).astype(np.float32), float(a * w[DIMS] + b)


def score_texts(text: pa.Array, model: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(text))
    for i, r in enumerate(features(text)):
        out[i] = bias + (float(model[0][r].sum()) / max(1e-12, float(np.sqrt(model[1][r].sum()))) if len(r) else 0.0)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def usable(labels: DataFrame, learn: Column, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of the rows to learn from; ids with two different labels are left out."""
    return labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("__y")).where("y = __y").select("id", "y")


def training_sample(one: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows of each class, in the order of a hash of the id."""
    first = lambda k: one.where(F.col("y") == k).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    return first(1).unionByName(first(0))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on the sample in one task; the model that comes back has a fixed size."""
    one = usable(labels, learn, id_col, label_col)
    n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    odds = n[1] / n[0] if len(n) == 2 else None
    chosen = training_sample(one, sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").where(F.col("text").isNotNull())
    rows = rows.select(F.md5(F.col("id").cast("string")).alias("key"), F.xxhash64("text").alias("version"), "y", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [Rows.pack(r) for r in features(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("version"), b.column("y"), pa.array(packed, pa.binary())], ["key", "version", "y", "slots"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "version"], kind="stable").drop_duplicates("key")
        model, bias = fit(Rows(pdf["slots"].tolist()), pdf["y"].to_numpy(), odds)
        return pd.DataFrame({"model": [model.tobytes()], "bias": [bias]})

    got = rows.mapInArrow(read, "key string, version long, y int, slots binary").groupBy().applyInPandas(run, "model binary, bias double").collect()
    return (np.frombuffer(got[0]["model"], np.float32).reshape(2, DIMS), got[0]["bias"]) if got else (np.zeros((2, DIMS), np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    own = text_col if text_col in keep else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for b in slices(whole, own):
                s = score_texts(b.column(own), weights, bias)
                rest = [c for c in b.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rest, "score", "predicted"])
        release()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *([F.col(text_col).alias("__text")] if own == "__text" else []))
    return rows.mapInArrow(run, f"{kinds}score double, predicted int")


def keep(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    every = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    scored = score(every, model, f"c{docs.columns.index(text_col)}", tuple(every.columns))
    return scored.where("predicted = 1").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
