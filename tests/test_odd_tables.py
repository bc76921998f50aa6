"""Queries equal their SQL on tables with odd rows."""

import duckdb
import pytest

from clausewright.queries import ORACLES, QUERIES


def same_as_sql(spark, name, folder, tables):
    """Writes ``tables`` (name to DataFrame) to ``folder``; the query's rows there equal those of its SQL."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    out = QUERIES[name](spark, str(folder))
    want = c.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and want


def test_ingest_gives_every_document(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(1400))
    texts = [(0, "a b", "s"), (1, "", "s"), (2, None, "s"), (3, " \n ", "s"), (4, long, "s"), (4, long, "s"), (4, "short", "s"), (4, None, "s"), (5, "a b " * 500, "s"), (6, "x", None)]
    docs = spark.createDataFrame([(i, t, lang, s) for i, t, s in texts for lang in ("en", None)], "doc_id long, text string, lang string, source string")
    same_as_sql(spark, "incremental_ingest", tmp_path, {"documents": docs})


def test_neighbours_tie_by_id_in_the_doubles_of_the_sql(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 7)).astype(np.float32)
    rows = [(i + 1000 * c, v.tolist()) for i, v in enumerate(x) for c in range(1 + 25 * (i % 60 == 0))]
    # the same direction at another length: equal as numbers, apart or equal in doubles as the SQL says
    rows += [(50_000 + i, (v * np.float32(s)).tolist()) for i, v in enumerate(x[:120]) for s in (3.0,)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    same_as_sql(spark, "knn", tmp_path, {"embeddings": vectors})


def test_neighbours_in_small_blocks(spark, monkeypatch):
    import numpy as np

    from clausewright.operators import search

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((200, 5)), np.ones((60, 5)), [[np.nan, 1, 1, 1, 1]]])
    df = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0, 2.0]), ("none", None), ("zero", [0.0] * 5)], "id string, v array<double>")
    inner = search._nearest_in
    monkeypatch.setattr(search, "_nearest_in", lambda s, q, k, digits: inner(s, q, k, digits, some=7, rows=13, pairs=11))
    got = {}
    for r in search.nearest(df, df, "id", "id", "v", 6, most_queries=50).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["doc"])
    assert got["short"] == ["short"] and "none" not in got and "zero" not in got
    unit = x[:260] / np.linalg.norm(x[:260], axis=1, keepdims=True)
    for i in range(200, 260):
        assert got[f"v{i:03}"] == ["v260", *(f"v{j:03}" for j in range(200, 205))]
    for i in range(200):
        assert got[f"v{i:03}"][1] == f"v{i:03}" and set(got[f"v{i:03}"][1:]) <= {f"v{j:03}" for j in np.argsort(-(unit @ unit[i]))[:70]}


def test_neighbours_are_met_in_blocks_and_not_pair_by_pair(spark, tiny):
    plan = QUERIES["knn"](spark, tiny)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hybrid_keeps_the_first_of_what_ties(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(8)
    words, x = [f"w{i}" for i in range(40)], rng.standard_normal((30, 6)).astype(np.float32)
    rows = [(i, "en" if i % 3 else "de", " ".join(rng.choice(words, 5 + i % 30)) if i % 11 else (None, "", "w1 w1")[i % 3]) for i in range(60)]
    # texts and directions that come again, under later and under earlier ids
    rows = [(i + 60 * c, lang, t) for i, lang, t in rows for c in range(5)]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, lang, t in rows], "doc_id long, text string, lang string, source string").repartition(5)
    vectors = spark.createDataFrame([(i, (x[i % 30] * np.float32(1 + i % 7)).tolist()) for i, _, _ in rows], "vec_id long, embedding array<float>").repartition(3)
    asked = docs.na.fill("").where("doc_id % 9 = 0").selectExpr("doc_id as item_id", "text")
    same_as_sql(spark, "hybrid_filtered", tmp_path, {"documents": docs, "embeddings": vectors})
    docs = docs.na.fill("")  # the SQL of this one leaves null texts out of the mean length
    same_as_sql(spark, "hybrid_rrf", tmp_path / "filled", {"documents": docs, "embeddings": vectors, "benchmark": asked})


def test_keyword_scores_meet_in_blocks(spark, tiny):
    from clausewright.operators import search
    from clausewright.queries import views

    docs = views.table(spark, tiny, "documents")
    asked = docs.where("doc_id % 7 = 0")
    best = search.bm25_best(docs, asked, "doc_id", "doc_id", 9, most_queries=11)
    assert not any(x in best._jdf.queryExecution().toString() for x in ("SortMergeJoin", "Generate", "NestedLoop"))
    want = search.ranked(search.bm25(docs, asked, "doc_id", "doc_id").selectExpr("query", "doc", "round(score, 9) as score"), 9)
    show = lambda df: sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in df.collect())
    assert show(best) == show(want)
