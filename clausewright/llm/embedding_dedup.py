"""Embedding near-duplicates by collision-counting projections.

Only vectors of one label and one dimension are compared. Equal vectors are one class
with a multiplicity. Classes are dealt into cells of at most ``CELL``: while a cell is
larger it is split at the median of a random projection, and classes within a margin of
the median go to both sides, so that a pair at the threshold is parted with a chance
below three in a thousand; a pair that meets in both sides counts in the lower one. What
no projection can part (a dense group) is dealt into blocks, and blocks meet in pairs.

Within a cell every class is a query: ``LINES`` one-dimensional projections are sorted,
each query has a window of fixed width around its own value on each, and a pair's
collisions are the windows in which it meets. Pairs with enough collisions are verified
by cosine in double precision. "Enough" is the largest count that a pair exactly at the
threshold reaches with probability ``RECALL`` or more; closer pairs reach it more often.

A cell returns sums of links per class and a spanning forest of its links, never the
pairs, so a group of n copies costs n rows.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
vectors without label, link with nothing and keep their own id; vectors of different
dimensions never link; repeated rows count as vectors; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import connected_components, cut, written

CELL = 3000
LINES = 32
SPLITS = 40
WIDTH = 1.5
MARGIN = 1.5
RECALL = 0.995
SEED = 11


def needed_collisions(lines: int = LINES, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with the wanted probability; its gap on a line is normal."""
    p = erf(width / sqrt(2))
    tail, c = 0.0, lines + 1
    while tail < recall:
        c -= 1
        tail += comb(lines, c) * p**c * (1 - p) ** (lines - c)
    return c


def lines_for(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, n))


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def collisions(x: np.ndarray, gap: float, lines: int = LINES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """How often each pair meets in query-centred windows on sorted projections."""
    values = x @ lines_for(x.shape[1], lines, seed)
    met = np.zeros((len(x), len(x)), np.uint8)
    for k in range(lines):
        order = np.argsort(values[:, k], kind="stable")
        v = values[order, k]
        low, high = np.searchsorted(v, v - width * gap, "left"), np.searchsorted(v, v + width * gap, "right")
        for q, a, b in zip(order.tolist(), low.tolist(), high.tolist(), strict=True):
            met[q, order[a:b]] += 1
    return met


def _links(threshold: float):
    gap, least = sqrt(2 - 2 * threshold), needed_collisions()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x, key, mult, mask, block = unit(pdf["v"]), pdf["key"].to_numpy(), pdf["mult"].to_numpy(), pdf["mask"].to_numpy(), pdf["block"].to_numpy()
        across = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        enough = collisions(x, gap) >= least
        weight, parent, edges = np.zeros(len(x), np.int64), list(range(len(x))), []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for q in range(len(x) - 1):
            c = q + 1 + np.flatnonzero(enough[q, q + 1 :])
            c = c[(mask[c] & mask[q]) == 0]
            if across:
                c = c[block[c] != block[q]]
            c = c[x[c] @ x[q] >= threshold] if len(c) else c
            if len(c):
                weight[q] += mult[c].sum()
                weight[c] += mult[q]
                for i in c.tolist():
                    if (a := root(q)) != (b := root(i)):
                        parent[b] = a
                        edges.append((key[q], key[i]))
        linked = np.flatnonzero(weight)
        return pd.DataFrame({"a": np.concatenate([key[linked], [e[0] for e in edges]]).astype(np.int64), "b": pd.array([None] * len(linked) + [e[1] for e in edges], "Int64"), "w": np.concatenate([weight[linked], np.zeros(len(edges), np.int64)]).astype(np.int64)})

    return run


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim in set(b.column("dim").to_pylist()):
            own = b.filter(pa.compute.equal(b.column("dim"), dim))
            values = unit(own.column("v").to_pylist()) @ lines_for(dim, SPLITS, SEED + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, SPLITS, dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([own.column("key"), own.column("cell"), own.column("v"), own.column("mult"), lists], ["key", "cell", "v", "mult", "at"])


def cells(classes: DataFrame, gap: float, most: int = CELL) -> DataFrame:
    """(cell, key, v, mult, mask): every class in one cell or, near a split, in more; mask marks the splits where it stands below too."""
    rows = cut(classes.mapInArrow(_projected, f"key long, cell long, v {classes.schema['v'].dataType.simpleString()}, mult long, at array<double>").withColumn("mask", F.lit(0).cast("long")))
    idle, reach = 0, MARGIN * gap
    for level in range(SPLITS):
        value = F.col("at")[level]
        big = rows.groupBy("cell").agg(F.count("*").alias("c"), F.percentile_approx(value, [0.25, 0.5, 0.75], 1000).alias("q")).where(F.col("c") > most)
        big = cut(big.select("cell", F.when(F.col("q")[2] - F.col("q")[0] >= 2.5 * reach, F.col("q")[1]).alias("median")))
        if not big.take(1):
            break
        if not big.where("median is not null").take(1):
            idle += 1
            if idle >= 4:
                break
            continue
        idle = 0
        below, above = value <= F.col("median") + reach, value > F.col("median") - reach
        sides = F.when(F.col("median").isNull(), F.array(F.struct(F.col("cell").alias("cell"), F.col("mask").alias("mask")))).otherwise(
            F.filter(
                F.array(
                    F.when(below, F.struct(F.xxhash64("cell", F.lit(2 * level)).alias("cell"), F.col("mask").alias("mask"))),
                    F.when(above, F.struct(F.xxhash64("cell", F.lit(2 * level + 1)).alias("cell"), F.when(below, F.col("mask").bitwiseOR(F.lit(1 << level))).otherwise(F.col("mask")).alias("mask"))),
                ),
                lambda s: s.isNotNull(),
            )
        )
        rows = cut(rows.join(big, "cell", "left").withColumn("__side", F.explode(sides)).select("key", "__side.cell", "v", "mult", "at", "__side.mask"))
    return rows.drop("at")


def dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    v, gap = F.col(vector_col), sqrt(2 - 2 * threshold)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    sound = F.col(label_col).isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, F.xxhash64(F.col(label_col), F.size(v), v)).alias("key"), F.col(label_col).alias("label"), v.cast(kind).alias("v"))
    classes = written(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("mult"), F.min_by("v", "id").alias("v"), F.min("label").alias("label")))
    dealt = cells(classes.select("key", F.xxhash64("label", F.size("v")).alias("cell"), "v", "mult", F.size("v").alias("dim")), gap)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("c")).select("cell", F.ceil(F.col("c") / CELL).cast("int").alias("blocks"))
    blocked = dealt.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "v", "mult", "mask")
    found = written(met.groupBy("cell", "i", "j").applyInPandas(_links(threshold), "a long, b long, w long"))
    sums = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("w").alias("w"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    placed = classes.select("key", "first", "mult").join(sums, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("key", (F.col("mult") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "key").join(named, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
