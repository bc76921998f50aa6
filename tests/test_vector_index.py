"""The inverted-file index against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import search, vector_index


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((40, 24))
    x = centre[rng.integers(0, 40, 3000)] + 0.5 * rng.standard_normal((3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[7].tolist()) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, v array<float>")


def test_recall_and_scanned_rows(spark, clustered, tmp_path):
    vector_index.build(clustered, f"{tmp_path}/ivf", "id", "v")
    asked = clustered.where("id % 97 = 0")
    exact = search.nearest(clustered, asked, "id", "id", "v", 10).cache()
    nprobe, share = vector_index.calibrate(asked, exact, f"{tmp_path}/ivf", "id", "v")
    got = vector_index.search(asked, f"{tmp_path}/ivf", "id", "v", 10, nprobe).toPandas()
    assert share >= 0.95 and got["scanned"].median() < 4500 / 2 and spark.read.parquet(f"{tmp_path}/ivf/codes").count() == 4500
    both = got.merge(exact.toPandas(), on=["query", "doc"])
    assert np.abs(both["score_x"] - both["score_y"]).max() < 1e-12 and got.groupby("query")["rank"].max().eq(10).all()
    # every list read and every coded row ranked again: the exact answer, ties by id
    whole = vector_index.search(asked.where("id < 1000"), f"{tmp_path}/ivf", "id", "v", 10, 10**6, 500)
    show = lambda df: sorted((r["query"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert show(whole) == show(exact.where("query < 1000"))
    # in blocks of queries: the same
    blocks = vector_index.search(asked, f"{tmp_path}/ivf", "id", "v", 10, nprobe, most_queries=7).toPandas()
    assert sorted(map(tuple, blocks[["query", "doc"]].values)) == sorted(map(tuple, got[["query", "doc"]].values))


def test_query_over_the_given_table(spark, tiny):
    from clausewright.queries import QUERIES

    exact = QUERIES["knn"](spark, tiny)
    got = QUERIES["knn_index"](spark, tiny).toPandas()
    assert vector_index.recall(spark.createDataFrame(got), exact) >= 0.9 and len(got) == exact.count()


def test_unusable_and_few_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    vector_index.build(df, f"{tmp_path}/few", "id", "v")
    got = [(r["query"], r["doc"]) for r in vector_index.search(df, f"{tmp_path}/few", "id", "v", 1, 99).orderBy("query").collect()]
    assert got == [(1, 1), (2, 2)]
    vector_index.build(df.where("id = 1"), f"{tmp_path}/one", "id", "v")
    assert vector_index.search(df.where("id < 3"), f"{tmp_path}/one", "id", "v").select(F.max("scanned")).head()[0] == 1
    assert vector_index.search(df.where("id = 4"), f"{tmp_path}/one", "id", "v").count() == 0
