import random

from pyspark.sql import functions as F

from clausewright.llm import jaccard_join

from .brute import jaccard


def frame(spark, docs, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    return df.withColumns({"node": F.lit("x"), "tokens": F.lit(1)}) if extra else df


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))] for _ in range(12)]
    texts = [edited(rng, b, rng.randrange(0, 4)) for b in base for _ in range(12)]
    texts += [" ".join(base[0][:20] + b) for b in base] + ["", None, " \t\n", "one", "One", "one two", "A b C d", "a B c D", "é É"]
    docs = dict(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame(spark, docs.items(), extra=True)).collect()}
    assert got == jaccard(docs)
    assert len({c for _, c in got.values()}) < len(docs) - 30


def test_group_of_near_copies_without_its_original(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 0.01)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    docs = {i: edited(rng, base, 3) for i in range(80)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame(spark, docs.items())).collect()}
    assert got == jaccard(docs)


def test_threshold_is_inclusive(spark):
    a = " ".join(f"w{i}" for i in range(11))  # 7 shingles
    b = a.rsplit(" ", 1)[0] + " other"  # 6 of them shared: 6 / 8 = 0.75
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(frame(spark, [(4, a), (9, b), (7, a.upper())])).collect()}
    assert got == {4: 4, 9: 4, 7: 4}


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None)], key=str)


def test_empty_table_and_long_text(spark):
    assert jaccard_join.join(frame(spark, [])).count() == 0
    long = " ".join(f"x{i}" for i in range(60_000))
    got = jaccard_join.join(frame(spark, [(2, long), (1, long + " end")])).collect()
    assert {(r["n_shingles"], r["component_id"]) for r in got} == {(59_996, 1), (59_997, 1)}
