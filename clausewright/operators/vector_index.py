"""Approximate neighbours by an inverted-file index that is kept as tables.

Vectors are dealt to lists by their nearest centroid, and a list stores for each vector the
residual from its centroid as one byte per number. A search reads the lists whose centroids
are nearest to a query, ranks their vectors by the coded distance, and ranks the best of
these again by the exact cosine in doubles.

Tables below ``path``: ``codes`` (list, id, code), sorted by list so that readers skip what no query
asks for; ``vectors`` (id, vector); ``lists`` (list, centroid, step, rows). The centroids are fitted by
k-means on a sample of at most ``SAMPLE`` vectors; every vector is indexed. At most ``LISTS`` lists
and their centroids reach a task; a list may hold any share of the rows, as the rows of a
list are spread over tasks and each task keeps its best for each query.

Null and zero vectors, and those of another dimension than most of the sample's, are in no
list; they are near nothing. Ties go to the smaller id. An empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import cut

SAMPLE, LISTS = 65_536, 4096


def _sound(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector as doubles) of usable rows."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), v.alias("vector"))
    return rows.where(F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False)))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(vectors: DataFrame, path: str, id_col: str, vector: str, lists: int | None = None, seed: int = 7) -> None:
    """Writes the index of all rows; the number of lists is about the root of theirs unless it is given."""
    spark = vectors.sparkSession
    rows = _sound(vectors, id_col, vector)
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = cut(rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select("vector"))
    common = sample.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    dim = common["dim"] if common else 0
    k = min(lists or isqrt(max(n, 1)), LISTS, max(common["count"] if common else 1, 1))
    centroids = np.zeros((1, dim))
    if k > 1:
        unit = sample.where(F.size("vector") == dim).select(array_to_vector("vector").alias("features"))
        found = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(unit)
        centroids = np.array(found.clusterCenters())
    elif dim:
        centroids = np.array([sample.where(F.size("vector") == dim).head()["vector"]])
    if dim:
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    step = 1.0 / 127  # a residual of unit vectors that are in one half space is below one in each place

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _units(b.column("vector"), dim)
                own = (x @ centroids.T).argmax(axis=1)
                code = np.clip(np.rint((x - centroids[own]) / step), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column("id"), pa.array([c.tobytes() for c in code], pa.binary())], ["list", "id", "code"])

    kept = rows.where(F.size("vector") == dim)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = kept.mapInArrow(coded, f"list int, id {kind}, code binary")
    dealt.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.mode("overwrite").parquet(f"{path}/codes")
    kept.write.mode("overwrite").parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/codes").groupBy("list").agg(F.count("*").alias("rows"))
    table = spark.createDataFrame([(i, c.tolist(), step) for i, c in enumerate(centroids)], "list int, centroid array<double>, step double")
    table.join(sizes, "list", "left").na.fill(0, ["rows"]).write.mode("overwrite").parquet(f"{path}/lists")


def _centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, float, np.ndarray]:
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # at most LISTS
    return np.array([r["centroid"] for r in rows]), rows[0]["step"], np.array([r["rows"] for r in rows])


def probes(queries: DataFrame, path: str, query_id: str, vector: str, nprobe: int) -> DataFrame:
    """(query, qv, lists): for each usable query its unit vector and its ``nprobe`` nearest lists."""
    spark = queries.sparkSession
    centroids, _, _ = _centroids(spark, path)
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _units(b.column("vector"), dim)
                near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x.tolist()), pa.array(near.tolist(), pa.list_(pa.int32()))], ["query", "qv", "lists"])

    rows = _sound(queries, query_id, vector).where(F.size("vector") == dim)
    return rows.mapInArrow(run, f"query {rows.schema['id'].dataType.simpleString()}, qv array<double>, lists array<int>")


def search(queries: DataFrame, path: str, query_id: str, vector: str, k: int = 10, nprobe: int = 8, again: int = 8, most_queries: int = 4096) -> DataFrame:
    """(query, doc, score, rank, scanned): about the k nearest by cosine, and how many coded vectors were read for the query.

    ``again`` times k of the coded best are ranked by their exact cosine. Queries are broadcast,
    their number is checked first, and larger sets are searched in blocks of ``most_queries``.
    """
    spark = queries.sparkSession
    centroids, step, sizes = _centroids(spark, path)
    dim, pool = centroids.shape[1], k * again
    asked = cut(probes(queries, path, query_id, vector, nprobe))
    n = asked.count()
    parts, out = max(1, -(-n // most_queries)), None
    codes = spark.read.parquet(f"{path}/codes")
    kind, own = (t.schema[c].dataType.simpleString() for t, c in ((asked, "query"), (codes, "id")))
    for part in range(parts):
        block = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        held = block.collect()  # at most about most_queries vectors
        wanted: dict[int, list[int]] = {}
        for i, r in enumerate(held):
            for x in r["lists"]:
                wanted.setdefault(x, []).append(i)
        shared = spark.sparkContext.broadcast((np.array([r["qv"] for r in held]).reshape(len(held), dim), wanted, [r["query"] for r in held]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vectors, wanted, names = shared.value
            best: dict[int, list[tuple[float, object]]] = {}
            for b in batches:
                lists, ids = b.column("list").to_numpy(), b.column("id").to_pylist()
                edge = [0, *(1 + np.flatnonzero(lists[1:] != lists[:-1])).tolist(), len(lists)]
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    who = wanted.get(int(lists[i])) if i < j else None
                    if not who:
                        continue
                    code = np.frombuffer(b"".join(b.column("code").slice(i, j - i).to_pylist()), np.int8).reshape(j - i, dim)
                    x = centroids[lists[i]] + code * step
                    # rounded, so that equal codes tie whatever the order of the sums
                    scores = np.round((vectors[who] @ x.T) / np.linalg.norm(x, axis=1), 9)
                    for q, row in zip(who, scores, strict=True):
                        top = np.flatnonzero(row >= -np.partition(-row, pool)[pool]) if len(row) > pool else np.arange(len(row))
                        top = top[np.argsort(-row[top], kind="stable")][:pool]
                        both = best.get(q, []) + [(-float(row[t]), ids[i + t]) for t in top]
                        best[q] = sorted(both)[:pool]
            rows = [(names[q], i, -s) for q, found in best.items() for s, i in found]
            for at in range(0, len(rows), 10_000):
                query, doc, score = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc), pa.array(score, pa.float64())], ["query", "doc", "coarse"])

        rows = codes.where(F.col("list").isin(sorted(wanted)))
        found = rows.mapInArrow(scan, f"query {kind}, doc {own}, coarse double")
        best = found.withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("coarse"), "doc"))).where(F.col("rn") <= pool)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        exact = best.join(spark.read.parquet(f"{path}/vectors").withColumnRenamed("id", "doc"), "doc").join(F.broadcast(block.select("query", "qv")), "query")
        scored = exact.select("query", "doc", (dot(F.col("vector"), F.col("qv")) / F.sqrt(dot(F.col("vector"), F.col("vector"))) / F.sqrt(dot(F.col("qv"), F.col("qv")))).alias("score"))
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
        count = F.create_map(*(F.lit(x) for i, s in enumerate(sizes.tolist()) for x in (i, s)))
        read = block.select("query", F.aggregate("lists", F.lit(0).cast("long"), lambda s, x: s + F.element_at(count, x).cast("long")).alias("scanned"))
        each = ranked.join(F.broadcast(read), "query")
        out = each if out is None else out.unionAll(each)
    return out


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of ``exact`` (query, doc) that ``found`` has."""
    hits = exact.select("query", "doc").join(found.select("query", "doc"), ["query", "doc"], "left_semi").count()
    return hits / max(exact.count(), 1)


def calibrate(queries: DataFrame, exact: DataFrame, path: str, query_id: str, vector: str, k: int = 10, wanted: float = 0.95) -> tuple[int, float]:
    """The smallest number of lists among the powers of two that reaches the recall on these queries, and what it reaches; all lists reach the most."""
    lists, nprobe = queries.sparkSession.read.parquet(f"{path}/lists").count(), 1
    while True:
        got = recall(search(queries, path, query_id, vector, k, nprobe), exact)
        if got >= wanted or nprobe >= lists:
            return nprobe, got
        nprobe *= 2
