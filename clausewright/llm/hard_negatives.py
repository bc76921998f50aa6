"""Hard negatives for contrastive training, by a secondary-sort shuffle.

Every anchor is scored against every row, in blocks: rows are dealt into row blocks of
about ``ROWS``, a copy of each anchor goes to each row block, and the task that holds a
block streams the anchors past it. What a block sends on is a key that holds everything:
(anchor, descending score, positives before negatives, id), packed so that its bytes sort
in that order. ``repartitionAndSortWithinPartitions`` brings the keys of an anchor
together in order, and an iterator reads them once: a positive opens a window, a negative
is given to each open window that still wants one, and a window closes when its scores
are passed or it is full. The iterator holds an anchor's open windows, never its rows.

There are two such passes, so that a block need not send every pair. The first finds each
anchor's positives; a block sends at most ``positives`` keys for each anchor. The second
knows the positives, so a block sends at most ``negatives`` keys for each window: the best
of a whole table are among the best of its blocks.

Scores are exact integers: in doubles while every product stays below 2^53, otherwise in
Python integers, and then held to 2^63 - 1 either way.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part. Only vectors of one dimension are compared; empty vectors have the score 0.
Ties go to the smaller id; rows without id come last among them and are never anchors.
Repeated rows count as rows: each may be the other's positive, and each repeated anchor
has its own negatives. Anchors without positive, and windows without negative, give no
rows; a positive with a negative score has none. An empty table gives an empty table;
other columns are ignored. One label may hold any share of the rows: blocks are dealt by
row number, not by label.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import shuffle_partitions, written

ROWS = 8192
ANCHORS = 64
MOST = 2**63 - 1
_KEY = struct.Struct(">QQBQQ")
_FLIP = 1 << 63


def pack(anchor: int, score: int, negative: bool, row_id: int | None, uid: int) -> bytes:
    """The key of a pair; its bytes sort by anchor, falling score, positives first, id with null last, row."""
    kind = 2 * negative + (row_id is None)
    return _KEY.pack(anchor, _FLIP - 1 - score, kind, (row_id or 0) + _FLIP, uid)


def unpack(key: bytes) -> tuple[int, int, bool, int | None, int]:
    anchor, score, kind, row_id, uid = _KEY.unpack(key)
    return anchor, _FLIP - 1 - score, kind >= 2, None if kind % 2 else row_id - _FLIP, uid


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of integers that are held as doubles."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2**53:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a).dot(whole(x).T), -MOST, MOST).astype(np.int64)


def _best(score: np.ndarray, fits: np.ndarray, k: int) -> list[np.ndarray]:
    """Per anchor the places of the first k of the rows that fit, by falling score; ties by place."""
    out, n = [], score.shape[1]
    if k < n:
        edge = -np.partition(np.where(fits, -score, MOST), k - 1, axis=1)[:, k - 1]
        fits = fits & (score >= edge[:, None])
    for row, fit in zip(score, fits, strict=True):
        c = np.flatnonzero(fit)
        out.append(c[np.argsort(-row[c], kind="stable")][:k])
    return out


class _Block:
    """The rows of one row block and dimension, in order of id."""

    def __init__(self, part: pa.Table, dim: int) -> None:
        ids = part.column("id").to_pylist()
        uid = part.column("uid").to_numpy()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, uid[i])), np.int64)
        self.x = _matrix(part.column("x").combine_chunks(), dim)[order]
        self.ids, self.uid, self.label = [ids[i] for i in order], uid[order], part.column("label").to_numpy()[order]

    def positives(self, anchors: pa.Table, dim: int, k: int) -> Iterator[bytes]:
        uid, label = anchors.column("uid").to_numpy(), anchors.column("label").to_numpy()
        s = scores(_matrix(anchors.column("x").combine_chunks(), dim), self.x)
        for a, row, picked in zip(uid.tolist(), s, _best(s, (label[:, None] == self.label) & (uid[:, None] != self.uid), k), strict=True):
            for i in picked.tolist():
                yield pack(a, int(row[i]), False, self.ids[i], int(self.uid[i]))

    def negatives(self, anchors: pa.Table, dim: int, k: int, low: int, high: int) -> Iterator[bytes]:
        """At most k keys for each window of each anchor; a window is the span of scores that a positive admits."""
        uid, label, windows = anchors.column("uid").to_numpy().tolist(), anchors.column("label").to_numpy(), anchors.column("windows").to_pylist()
        s = scores(_matrix(anchors.column("x").combine_chunks(), dim), self.x)
        other = label[:, None] != self.label
        sent: list[set[int]] = [set() for _ in uid]
        for turn in range(max(map(len, windows), default=0)):
            p = np.array([w[turn] if turn < len(w) else -1 for w in windows], object)
            bottom, top = -((-p * low) // 100), (p * high) // 100
            spans = np.array([[min(b, MOST), min(t, MOST)] if w >= 0 else [1, 0] for b, t, w in zip(bottom, top, p, strict=True)], np.int64)
            for i, picked in enumerate(_best(s, other & (s >= spans[:, :1]) & (s <= spans[:, 1:]), k)):
                sent[i].update(picked.tolist())
        for a, row, picked in zip(uid, s, sent, strict=True):
            for i in picked:
                yield pack(a, int(row[i]), True, self.ids[i], int(self.uid[i]))


def _streamed(batches: Iterable[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """Rows arrive as (row block, dimension, rows before anchors); ``find(block, anchors, dim)`` gives keys."""
    held, block, at, waiting, keys = [], None, None, [], []

    def flush():
        nonlocal block, held, waiting
        if waiting and (held or block is not None):
            if block is None:
                block, held = _Block(pa.Table.from_batches(held), at[1]), []
            table = pa.Table.from_batches(waiting)
            for i in range(0, table.num_rows, ANCHORS):
                keys.extend(find(block, table.slice(i, ANCHORS), at[1]))
        waiting = []

    for b in batches:
        marks = np.stack([b.column(c).to_numpy() for c in ("block", "dim", "anchor")])
        edges = [0, *(1 + np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))).tolist(), b.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            place, part = (int(marks[0, i]), int(marks[1, i])), b.slice(i, j - i)
            if place != at:
                flush()
                at, block, held = place, None, []
            if marks[2, i]:
                waiting.append(part)
                if sum(w.num_rows for w in waiting) >= ANCHORS:
                    flush()
            else:
                held.append(part)
        if len(keys) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])
            keys.clear()
    flush()
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    return _streamed(batches, lambda block, anchors, dim: block.positives(anchors, dim, k))


def _negatives(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    return _streamed(batches, lambda block, anchors, dim: block.negatives(anchors, dim, k, low, high))


def first_positives(keys: Iterable[tuple[bytes, None]], k: int) -> Iterator[tuple[int, int, int | None, int]]:
    """(anchor, score, id, row) of the first k keys of each anchor, from keys in order."""
    anchor, left = None, 0
    for key, _ in keys:
        a, score, _, row_id, uid = unpack(key)
        anchor, left = (anchor, left) if a == anchor else (a, k)
        if left:
            left -= 1
            yield a, score, row_id, uid


def windowed(keys: Iterable[tuple[bytes, None]], k: int, low: int, high: int) -> Iterator[tuple[int, int | None, int, int, int | None, int, int]]:
    """(anchor, positive, its row, rank, negative, both scores), from keys in order; only open windows are held."""
    anchor, opened = None, []
    for key, _ in keys:
        a, score, negative, row_id, uid = unpack(key)
        if a != anchor:
            anchor, opened = a, []
        if not negative:
            opened.append([score, row_id, uid, 0])
            continue
        opened = [w for w in opened if w[3] < k and 100 * score >= low * w[0]]
        for w in opened:
            if 100 * score <= high * w[0]:
                w[3] += 1
                yield a, w[1], w[2], w[3], row_id, w[0], score


def _sorted_keys(keys: DataFrame, spark: SparkSession):
    parts = shuffle_partitions(spark)
    return keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, lambda key: int.from_bytes(key[:8], "big") % parts)


def mine(
    vectors: DataFrame, anchors: Column, label: Column, component=lambda x: x, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` and ``label`` are columns of ``vectors``: which rows ask, and what a row is;
    ``component`` gives the integer to use for a component. A positive with score p admits the
    negatives whose score is ``low`` to ``high`` (at most 100) hundredths of p.
    """
    spark, v = vectors.sparkSession, F.col(vector_col)
    sound = label.isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    picked = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: component(x.cast("double")).cast("double")).alias("x"), F.coalesce(anchors & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"))
    rows = written(picked.withColumn("uid", F.monotonically_increasing_id()))
    blocks = max(1, -(-rows.count() // ROWS))
    kept = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.size("x").alias("dim"), F.lit(0).alias("anchor"), "uid", "id", "label", "x", F.lit(None).cast("array<long>").alias("windows"))

    def met(asking: DataFrame, find) -> DataFrame:
        """Keys of the pairs that ``find`` sends on; an anchor is copied to each row block."""
        asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("x").alias("dim"), F.lit(1).alias("anchor"), "uid", "id", "label", "x", "windows")
        both = kept.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "dim", "anchor")
        return both.mapInArrow(find, "key binary")

    asking = rows.where("asks").withColumn("windows", F.lit(None).cast("array<long>"))
    near = _sorted_keys(met(asking, partial(_positives, k=positives)), spark).mapPartitions(partial(first_positives, k=positives))
    best = written(spark.createDataFrame(near, "uid long, score long, id long, row long", verifySchema=False))
    windows = best.where("score >= 0").groupBy("uid").agg(F.array_distinct(F.collect_list("score")).alias("windows"))  # at most ``positives`` scores
    keys = met(rows.where("asks").join(windows, "uid"), partial(_negatives, k=negatives, low=low, high=high))
    opening = best.where("score >= 0").rdd.map(lambda r: (pack(r[0], r[1], False, r[2], r[3]),))
    all_keys = keys.unionAll(spark.createDataFrame(opening, "key binary", verifySchema=False))
    found = _sorted_keys(all_keys, spark).mapPartitions(partial(windowed, k=negatives, low=low, high=high))
    out = spark.createDataFrame(found, "uid long, positive_id long, row long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
    return out.join(rows.where("asks").select("uid", F.col("id").alias("anchor_id")), "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
