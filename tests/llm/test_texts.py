"""Quality rules, classifier, token counts, packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewright.llm import packing, quality_classifier, quality_rules, token_counts
from clausewright.llm.queries import vocabulary

from .brute import WORD, statistics

ODD = ["a", "b", "é ", "\n", "\t", "x#", " ", "日", " ab", "　", "\x0b", "$$", "the the", "\r\n", "</s>", "<|endoftext|>", "▁", "\x1c", "İ", "1", "→", "'s"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return [None, "", " ", "\n"] + ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_statistics(spark):
    texts = odd_texts(400) + ["a b c " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, "en"), "source": F.when(F.col("doc_id") % 2 == 0, "s")})
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality_rules.judge(df).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def rules_frame(spark):
    clean = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(40)]
    junk = [" ".join(f"w{i}*** $$x{j} ##" for j in range(80)) for i in range(4)]
    rows = [(i, t, "en", "s1") for i, t in enumerate(clean + junk)] + [(100, None, None, None), (101, "short text", "en", None), (102, "a b c " * 100, None, "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_rules_keep_clean_and_reject_junk(spark):
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(rules_frame(spark)).collect()}
    assert all(got[i] == (False, True) for i in range(40)) and all(got[i] == (False, False) for i in range(40, 44))
    assert got[100] == got[101] == got[102] == (True, False)


def habit_frame(spark):
    """Two sources of 600 texts: in "code" every text has symbols in 1 to 30 of 80 words, in "prose" one text in 50 has."""
    text = lambda i, k: " ".join(f"w{i:04}x{j}" + ("##" if j < k else "") for j in range(80))
    rows = [(i, text(i, 1 + i % 30), "en", "code") for i in range(600)] + [(1000 + i, text(i, 20 if i % 50 == 0 else 0), "en", "prose") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_a_rate_passes_where_it_is_habit(spark):
    judged = {r["doc_id"]: r for r in quality_rules.judge(habit_frame(spark)).collect()}
    code, prose = judged[19], judged[1000]
    assert abs(code["symbol_ratio"] - prose["symbol_ratio"]) < 0.01 and code["kept"] and not prose["kept"]
    assert code["max_symbol_ratio"] > 2 * prose["max_symbol_ratio"] > 0
    assert sum(not judged[i]["kept"] for i in range(600)) <= 6 and [i for i in range(1000, 1600) if not judged[i]["kept"]] == list(range(1000, 1600, 50))


def test_a_rate_equal_to_its_threshold_passes(spark):
    rows = quality_rules.with_ratios(spark.sql("SELECT id, 'en' AS lang, 's' AS source, 100L AS n_words, 400L AS word_chars, 0L AS n_symbols, 0L AS n_dup_lines, 0L AS n_repeat_words, 9L AS n_lines FROM range(50)"))
    own = quality_rules.adaptive_thresholds(rows, ["lang", "source"])
    assert own.count() == 1 and own.head()["max_symbol_ratio"] == 0.0
    assert quality_rules._joined(rows, quality_rules._limits(rows)).where("kept").count() == 50


def test_small_groups_lean_on_their_language(spark):
    rows = quality_rules.with_ratios(spark.sql("SELECT 'en' AS lang, if(id < 5, null, 's') AS source, 1000L AS n_words, 1000L AS word_chars, if(id < 5, 500L, id % 10) AS n_symbols, 0L AS n_dup_lines, 0L AS n_repeat_words, 9L AS n_lines FROM range(2005)"))
    got = {r["source"]: r["max_symbol_ratio"] for r in quality_rules.adaptive_thresholds(rows, ["lang", "source"]).collect()}
    assert 0 < got["s"] < got[None] < 0.05


def test_rules_keep_all_columns(spark):
    df = rules_frame(spark).withColumns({"n_words": F.lit("mine"), "c0": F.lit(1)})
    out = quality_rules.keep(df)
    assert out.columns == df.columns and out.count() == 40 and {r["n_words"] for r in out.collect()} == {"mine"}
    assert quality_rules.keep(df.where("false")).count() == 0 == quality_rules.judge(df.where("false")).count()


def test_sketches_merge_to_the_sketch_of_all(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000 / 1000).alias("v"))
    parts = [quality_rules.sketch(df.where(f"v {op} 0.4"), ["g"], ["v"]) for op in ("<", ">=")]
    key = lambda s: sorted(map(tuple, s.select("g", "metric", "bucket", "n").collect()))
    assert key(quality_rules.merge(*parts)) == key(quality_rules.sketch(df, ["g"], ["v"]))
    q = quality_rules.quantiles(quality_rules.sketch(df, ["g"], ["v"]), ["g"], {"mid": 0.5}).collect()
    assert all(abs(r["mid"] - 0.5) < 0.02 for r in q)


def test_classifier_learns_and_holds_out(spark, tiny):
    from clausewright.llm.queries import op2_quality_classifier

    got = op2_quality_classifier(spark, tiny)
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{tiny}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (3, ""), (None, "x"), (1, "good words here")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 0)], "doc_id long, quality int")
    none = quality_classifier.train(docs, labels, F.lit(True))
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(docs.where("false"), none).count() == 0
    kept = quality_classifier.keep(docs, none)
    assert kept.columns == docs.columns and kept.count() == 5


def plain_slots(text):
    """Slots of a text's byte n-grams and twins, one at a time."""
    q, d, out = quality_classifier, (text or "").encode(), set()
    for n in q.ORDERS:
        for i in range(len(d) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in d[i : i + n]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
            h ^= h >> 15
            out.add((h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - q.BITS)
    w = WORD.findall((text or "").lower())
    twins = sum(a == b for a, b in zip(w, w[1:]))
    return out | {q.SLOTS + i for i, k in enumerate(q.TWINS) if twins >= k}


def test_features_equal_plain_ones():
    texts = [None, "", "a", "the the the the the cat", "Ab ab x", "é日\n\n$$", "word " * 20]
    got = [set(r.tolist()) for r in quality_classifier.features(pa.array(texts))]
    assert got == [plain_slots(t) for t in texts]
    for r in ([], [3, 7], list(range(0, quality_classifier.DIMS, 2))):
        rows = quality_classifier.Rows([quality_classifier.Rows.pack(np.array(r, np.int64))])
        assert rows[0].tolist() == r and len(rows.packed[0]) <= quality_classifier.DIMS // 8 + 2


def small_problem():
    rng = np.random.default_rng(0)
    y = np.array([1] * 40 + [0] * 40)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 8), 60 + rng.integers(0, 3, 1) + 3 * (k if rng.random() < 0.9 else 1 - k)])) for k in y]
    return quality_classifier.Rows([quality_classifier.Rows.pack(r) for r in rows]), rows, y


def test_ratio_equals_counting():
    packed, rows, y = small_problem()
    ratio = quality_classifier.log_count_ratio(packed, y)
    count = lambda j, k: 1 + sum(j in r for r, label in zip(rows, y, strict=True) if label == k)
    total = {k: quality_classifier.DIMS + sum(len(r) for r, label in zip(rows, y, strict=True) if label == k) for k in (0, 1)}
    assert all(abs(ratio[j] - np.log(count(j, 1) / total[1] / (count(j, 0) / total[0]))) < 1e-12 for j in (0, 7, 60, 63, 99))


def test_dual_descent_reaches_the_optimum():
    packed, rows, y = small_problem()
    ratio = quality_classifier.log_count_ratio(packed, y)
    w = quality_classifier.dual_descent(packed, ratio, y, np.ones(80), passes=400, least=1e-9)
    x = np.zeros((80, 101))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 100] = 1.0
    own = np.append(w[:100], w[quality_classifier.DIMS])
    sign = np.where(y == 1, 1.0, -1.0)
    objective = lambda v: v @ v / 2 + np.maximum(0, 1 - sign * (x @ v)).sum()
    # the dual by projected gradient on the whole matrix; its value bounds the primal from below
    gram, alpha = (sign[:, None] * x) @ (sign[:, None] * x).T, np.zeros(80)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, 1)
    bound = alpha.sum() - alpha @ gram @ alpha / 2
    assert bound - 1e-6 <= objective(own) <= bound * 1.001
    assert abs(quality_classifier.margins(packed, ratio, w) - x @ own).max() < 1e-9
    # the passes that production takes
    rough = quality_classifier.dual_descent(packed, ratio, y, np.ones(80))
    assert objective(np.append(rough[:100], rough[quality_classifier.DIMS])) <= bound * 1.05


def test_scores_equal_the_formula():
    texts = ["good words here", "bad bad bad bad bad", "", "more good words", "bad things bad bad"] * 6
    y = np.array([1, 0, 1, 1, 0] * 6)
    rows = [np.array(sorted(plain_slots(t)), np.int64) for t in texts]
    model, bias = quality_classifier.fit(quality_classifier.Rows([quality_classifier.Rows.pack(r) for r in rows]), y)
    for t, r, s in zip(texts, rows, quality_classifier.score_texts(pa.array(texts), model, bias), strict=True):
        m = bias + (model[0][r].sum() / np.sqrt(model[1][r].sum()) if len(r) else 0.0)
        assert abs(s - 1 / (1 + np.exp(-m))) < 1e-5, t


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(spark, tiny, name):
    texts = odd_texts(300) + [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()] + ["word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in token_counts.token_counts(df, vocabulary(name)).collect()}
    path = vocabulary(name)()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False))
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == count(t or "") and got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (count(t or "") > 4096)
    assert token_counts.token_counts(df.where("false"), vocabulary(name)).count() == 0


def test_word_ids_equal_the_library(spark, tiny):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")()
    model, own = Tokenizer.from_file(path), packing.WordIds(path)
    assert own.fast
    texts = [t or "" for t in odd_texts(2000)] + [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark, tiny):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json")())
    texts = [None, "", "a"] + [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + ["word and " * 6000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = packing.pack(df, vocabulary("word_bpe_49k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.03 * total / 4096 + 2
    assert packing.pack(df.where("false"), vocabulary("word_bpe_49k.json")).count() == 0


def test_sum_of_squares_takes_the_smallest_step():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 30, 200)
    where, offset = packing.sum_of_squares(lengths, 30)
    count, gap = {}, {}
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        total = lambda c: sum(v * v for g, v in c.items() if g)

        def after(g, s=s):
            c = dict(count)
            if g != 30:
                c[g] -= 1
            c[g - s] = c.get(g - s, 0) + 1
            return total(c)

        best = min(after(g) for g in [30, *(g for g, v in count.items() if v and g >= s)])
        g = gap.get(where[i], 30)
        assert after(g) == best and offset[i] == 30 - g
        if g != 30:
            count[g] -= 1
        gap[where[i]] = g - s
        count[g - s] = count.get(g - s, 0) + 1


def test_features_do_not_depend_on_batches():
    t = pa.array(["abc abc abc", None, "", "é" * 10, "x" * 3_000_000])
    whole = [f.tolist() for f in quality_classifier.features(t)]
    assert whole == [next(quality_classifier.features(t.slice(i, 1))).tolist() for i in range(5)]
