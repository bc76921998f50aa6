"""Hard negatives, whitening and language-model scores against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import chat_format, context_tree, hard_negatives, html_extract, spark_io, textnum, whitening

from .brute import WORD

INF, NAN = float("inf"), float("nan")


# --- Hard negatives


def plain_negatives(rows, k=5):
    """rows: (id, vector, label); every row of a list is a row, repeated or not."""
    held = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y, n) for n, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda r: (r[0] is None, r[0] or 0, r[3])
    out = []
    for a in held:
        if a[0] is None or a[0] % 100:
            continue
        dot = sorted(((-sum(p * q for p, q in zip(a[1], r[1])), last(r), r) for r in held if r is not a and len(r[1]) == len(a[1])), key=lambda x: x[:2])
        for p, _, r in [x for x in dot if x[2][2] == a[2]][:k]:
            fits = [x for x in dot if x[2][2] != a[2] and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(a[0], r[0], n + 1, x[2][0], -p, -x[0]) for n, x in enumerate(fits)]
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("uid", F.lit("clash")).withColumn("x", F.lit(1))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label, lambda x: F.floor(256 * x), **more)
    return sorted(map(tuple, got.collect()), key=str)


def vectors(rng, n, dim=6, step=8):
    return [[rng.randrange(-step, step + 1) / step for _ in range(dim)] for _ in range(n)]


def test_negatives_equal_brute_force_with_ties_and_nulls(spark):
    rng = random.Random(5)
    v = vectors(rng, 260, step=2)
    rows = [(i * 5, x, rng.choice([0, 0, 0, 1, 2, 3])) for i, x in enumerate(v)]
    rows += [(None, v[3], 1), (None, v[4], 2), (900, None, 1), (1000, v[0], None), (1100, [NAN] * 6, 0), (1200, [INF] * 6, 0), (1300, [None] * 6, 0), (1400, [], 0), (1500, [0.5, 0.5], 0), (1501, [0.5, 0.5], 1), (1502, [0.25, 1.0], 0)]
    assert mined(spark, rows) == sorted(plain_negatives(rows), key=str) != []


def test_repeated_rows_and_block_edges(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, x, i % 3) for i, x in enumerate(vectors(rng, 150))]
    rows += rows[:40] + [(100, rows[100][1], 1)] * 3
    monkeypatch.setattr(hard_negatives, "ROWS", 17)  # read on the driver: a dozen blocks instead of one
    assert mined(spark, rows) == sorted(plain_negatives(rows), key=str) != []
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[:1]) == []


def test_large_components_stay_exact():
    a, x = np.array([[2.0**40 + 3, 5.0]]), np.array([[2.0**40 - 7, -1.0], [1e300, 0.0]])
    got = hard_negatives.scores(a, x)
    exact = (2**40 + 3) * (2**40 - 7) - 5
    assert got[0].tolist() == [min(exact, 2**63 - 1), 2**63 - 1]
    assert hard_negatives.scores(np.array([[2.0**30, 1.0]]), np.array([[2.0**30 + 1, 3.0]]))[0, 0] == 2**30 * (2**30 + 1) + 3


def test_keys_sort_as_they_should():
    rng = random.Random(1)
    pairs = [(rng.randrange(3), rng.choice([-(2**63) + 1, -5, 0, 5, 2**63 - 1]), rng.random() < 0.5, rng.choice([None, -9, 0, 4]), rng.randrange(5)) for _ in range(400)]
    assert all(hard_negatives.unpack(hard_negatives.pack(*p)) == p for p in pairs)
    order = lambda p: (p[0], -p[1], p[2], p[3] is None, p[3] or 0, p[4])
    assert [hard_negatives.unpack(k) for k in sorted(hard_negatives.pack(*p) for p in pairs)] == sorted(pairs, key=order)


def test_windows_are_read_from_an_iterator():
    """A million keys of one anchor: what is held does not grow, and full windows are left."""
    keys = ((hard_negatives.pack(0, 10**6 - i, i > 0, i, i), None) for i in range(10**5))
    assert [r[4] for r in hard_negatives.windowed(keys, 5, 80, 100)] == [1, 2, 3, 4, 5]


# --- Whitening


def plain_whitening(rows, k=16):
    x = {n: np.floor(64 * np.array(v, float)) + 10**6 for n, (_, v) in enumerate(rows)}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    c = fit - fit.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / len(fit))
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    white = {n: (v - fit.mean(axis=0)) @ q / np.sqrt(e) for n, v in x.items()}
    s = [sum(map(int, col)) for col in fit.T]
    dev = {n: sum((len(fit) * int(a) - b) ** 2 for a, b in zip(v, s)) for n, v in x.items()}
    return len(fit), white, dev, e / c.var(axis=0).sum()


@pytest.mark.parametrize("dim", [3, 20, 70])
def test_whitening_equals_the_plain_eigenvectors(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((300, dim)) * (1 + np.arange(dim) / 7)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    n, white, dev, share = plain_whitening(rows)
    odd = [(-1, None), (-2, []), (-3, [NAN] * dim), (-4, [None] * dim), (-5, [INF] * dim), (-6, [1.0])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    got = whitening.whiten(df).toPandas()
    k = min(16, dim)
    assert len(got) == len(rows) * k and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    assert {i: d for i, d in zip(got["vec_id"], got["deviation"])} == {i: dev[m] for m, (i, _) in enumerate(rows)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    plain = np.stack([white[m] for m, (i, _) in sorted(enumerate(rows), key=lambda r: r[1][0])])
    assert np.minimum(np.abs(wide - plain).max(), np.abs(wide + plain).max()).max() < 1e-7
    assert np.abs(got.groupby("component")["explained"].first() - share).max() < 1e-12


def test_few_and_extreme_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([(1, None)]).count() == 0 and make([(1, [1.0, 2.0])] * 3).count() == 0
    two = make([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [3.0, 4.0])]).orderBy("vec_id").collect()
    assert [r["component"] for r in two] == [1, 1, 1] and sorted(abs(r["whitened"]) for r in two) == pytest.approx([1, 1, 1]) and two[0]["explained"] == pytest.approx(1)
    big = make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 0.0])]).collect()
    assert {r["deviation"] for r in big} >= {None} and all(math.isfinite(r["whitened"]) for r in big)


def test_no_larger_eigenvalue_is_missed():
    """A start that is orthogonal to the largest eigenvector still ends with it."""
    e = np.array([9.0, *np.linspace(3, 0.1, 59)])

    class Blind:
        def __init__(self):
            self.rng, self.calls = np.random.default_rng(0), 0

        def standard_normal(self, shape):
            out, self.calls = self.rng.standard_normal(shape), self.calls + 1
            if self.calls == 1:
                out[0] = 0
            return out

    values, vectors, residual = whitening.eigenpairs(lambda q: e[:, None] * q, 60, 4, Blind())
    assert values == pytest.approx(sorted(e)[::-1][:4], rel=1e-12) and abs(vectors[0, 0]) == pytest.approx(1) and residual < 1e-10


def test_filter_damps_what_is_unwanted():
    e = np.array([4.0, 1.0, 0.5, 0.0])
    got = whitening.chebyshev(lambda q: e[:, None] * q, np.ones((4, 1)), 1.0, 4.0, 8)[:, 0]
    assert got[0] == pytest.approx(1) and np.abs(got[1:]).max() < 1e-4


# --- Language-model scores


def plain_tree(train, text, depth=context_tree.DEPTH):
    """log10 probability of text: every bit under the context tree of its place, by the textbook."""
    symbols = lambda t: [*t.encode().lower(), 255] if t else [255]
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def walk(t):
        past = [255] * depth
        for s in symbols(t):
            for j in range(8):
                yield (j, s >> (8 - j)), tuple(past), (s >> (7 - j)) & 1
            past = [s, *past][:depth]

    for t in train:
        for tree, past, bit in walk(t):
            for d in range(depth + 1):
                counts[tree, past[:d]][bit] += 1
                if d:
                    children[tree, past[: d - 1]].add(past[:d])
    memo = {}

    def own(tree, c):
        a, b = counts[tree, c]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(tree, c):
        if (tree, c) not in memo:
            memo[tree, c] = own(tree, c) if len(c) == depth else np.logaddexp(own(tree, c), sum(weighted(tree, x) for x in children[tree, c])) - math.log(2)
        return memo[tree, c]

    total = 0
    for tree, past, bit in walk(text):
        p = None
        for d in range(depth, -1, -1):
            c = past[:d]
            if (tree, c) in counts:
                n = counts[tree, c]
                k = (n[bit] + 0.5) / (sum(n) + 1)
                w = 1 if d == depth else math.exp(own(tree, c) - math.log(2) - weighted(tree, c))
                p = k if p is None else w * k + (1 - w) * p
        total += math.log10(0.5 if p is None else p)
    return total


def plain_base(rows, held):
    tokens = [(i, [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens]


def checked(spark, rows, **more):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("clash")).withColumn("kind", F.lit(3)).repartition(3)
    got = context_tree.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, **more).collect()
    train = [t or "" for i, t in rows if not held(i)]
    want = [(i, held(i), a, b, c, base, plain_tree(train, t or "") if more.get("score", True) else 0) for (i, a, b, c, base), (_, t) in zip(plain_base(rows, held), rows)]
    show = lambda r: (str(r[0]), r[2], round(r[5], 6), round(r[6], 6))
    got, want = sorted((tuple(r)[:7] for r in got), key=show), sorted(want, key=show)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9) and [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-9)


def prose(rng, n):
    words = ["the", "Thing", "hath", "oh", "été", "naïve", "über", "日本", "a", "then", "other"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", ", "]) for _ in range(n))


def test_scores_equal_the_plain_tree_in_any_blocks(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 30))) for i in range(30)] + [(40, None), (41, ""), (42, " \n"), (None, "null id"), (None, None), (1, "the thing"), (1, "the thing"), (43, "x" * 200 + " " + "y" * 90)]
    checked(spark, rows)
    checked(spark, rows, block=90, piece=20)


def test_without_training_texts_or_rows(spark):
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(i, "ab")], "doc_id long, text string")
    r = context_tree.score(df, F.lit(True)).head()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 2, 0, 0, 0.0) and r["score"] == pytest.approx(-24 * math.log10(2)) and r["bits_per_byte"] == pytest.approx(8)
    assert context_tree.score(df.where("false"), F.lit(False)).count() == 0


def test_next_bytes_have_probabilities_that_sum_to_one():
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 3, (400, context_tree.DEPTH)) @ (256 ** np.arange(1, context_tree.DEPTH + 1)) + rng.choice([97, 98, 200, 255], 400))
    n = rng.integers(0, 5, len(key))
    context = key[7] >> 8 << 8
    asked = np.unique(np.concatenate([key, context + np.arange(256)]))
    tree = context_tree.Subtree(asked, np.where(np.isin(asked, key), n[np.searchsorted(key, asked).clip(max=len(key) - 1)], 0), 0)
    p = np.prod([np.where(np.isnan(v), 0.5, v) for v in (tree.bit(j)[1] for j in range(8))], axis=0)
    assert p[(asked >> 8 << 8) == context].sum() == pytest.approx(1)


def test_word_hashes_do_not_depend_on_runs():
    data = np.frombuffer(b"ab cd " + b"x" * 5000 + b" ab q", np.uint8)
    starts, ends, _ = textnum.word_spans(data, np.array([0, len(data)]))
    whole = textnum.word_hashes(data, starts, ends, True, 1 << 19)
    for most in (7, 64, 4096):
        textnum.release()
        assert (textnum.word_hashes(data, starts, ends, True, most) == whole).all()
    assert whole[0] == whole[3] and len(set(whole.tolist())) == 4


# --- Parts of long conversations, the shared folder


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_formatted_chars_do_not_depend_on_parts(spark, most):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["", None, "hey </s> [INST] ", "long " * 30])) for c in range(25) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    parts = chat_format.expand(df, part_chars=most)
    whole = {(r["conv_id"], r["example"]): r for r in chat_format.materialize(parts).collect()}
    got = {r["conv_id"]: r for r in chat_format.digests(parts).collect()}
    for c in range(25):
        turns = sorted((t, r, x or "") for k, t, r, x in rows if k == c)
        shown = [chat_format.format_turn(r, x)[0] for _, r, x in turns]
        ends = [i for i, (_, r, _) in enumerate(turns) if r == "assistant"]
        tail = sum(map(len, shown[ends[-1] + 1 if ends else 0 :]))
        assert got[c]["formatted_chars"] == sum(len("".join(shown[: i + 1])) for i in ends) + tail
        assert [whole[c, n]["text"] for n in range(len(ends))] == ["".join(shown[: i + 1]) for i in ends]


def test_context_of_more_than_a_part(spark):
    rows = [(1, 0, "user", "a" * 700_000), (1, 1, "user", "b" * 700_000), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    r = chat_format.digests(chat_format.expand(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).head()
    assert r["formatted_chars"] == sum(len(chat_format.format_turn(x, t)[0]) for _, _, x, t in rows) and r["n_examples"] == 1


@pytest.mark.parametrize("most", [1, 100, 1 << 20])
def test_every_example_is_written_with_its_prefix(spark, most):
    rows = [(c, t, "assistant" if t % 3 == 1 else "user", f"é<|im_end|>日{t} " * (t % 4)) for c in (1, 2, None) for t in range(30)]
    parts = chat_format.expand(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), part_chars=most).collect()
    for c in (1, 2, None):
        shown = [chat_format.format_turn(r, x)[0] for k, _, r, x in rows if k == c]
        own = [r for r in parts if r["conv_id"] == c]
        for n in range(10):  # prefix and target of each example, in order
            got = [r for r in own if r["example"] == n]
            assert [r["part"] for r in got] == list(range(len(got))) and "".join(r["text"] for r in got) == "".join(shown[: 3 * n + 2])
            assert {(r["loss_start"], r["loss_end"]) for r in got} == {(len("".join(shown[: 3 * n + 2])) - len(chat_format.CLOSE) - 1 - len(chat_format.escape(rows[3 * n + 1][3])), len("".join(shown[: 3 * n + 2])) - len(chat_format.CLOSE) - 1)}
        assert "".join(r["text"] for r in own if r["example"] is None) == shown[-1]
        assert all(len(r["text"]) <= most + max(map(len, shown)) for r in own)
    for r in chat_format.digests(spark.createDataFrame(parts, "conv_id long, part long, example long, prefix_chars long, text string, loss_start long, loss_end long").coalesce(1)).collect():
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{y}\n" for _, _, x, y in rows[:30]).encode()).hexdigest() and r["n_turns"] == 30


def test_digests_read_the_examples(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    parts = chat_format.expand(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    r = chat_format.digests(parts.where("example = 1").withColumn("text", F.regexp_replace("text", "\na<", "\nlonger<")).withColumns({x: F.col(x) + 5 for x in ("loss_start", "loss_end")})).head()
    assert r["formatted_chars"] == sum(len(chat_format.format_turn(x, t)[0]) for _, _, x, t in rows) + 5 and (r["n_turns"], r["loss_chars"]) == (4, 1)


def test_a_cluster_has_to_name_its_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", lambda self: Conf(), lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        spark_io.shared_dir(Session())


# --- HTML: names that only hold a marked word, references across tags


@pytest.mark.parametrize("pages", [1, 20])
def test_articles_keep_sections_whose_names_hold_a_marked_word(spark, pages):
    slots = [("share-of-market", True), ("social-history", True), ("comments-list", False), ("ad", False), ("related posts", False), ("newsletter-box wide", False)]
    page = lambda i: "<html><body><article><h1>Title %d</h1>%s</article></body></html>" % (i, "".join(f'<section class="{c}"><p>part {n} of page {i} ' + "words " * 40 + "</p></section>" for n, (c, _) in enumerate(slots)))
    df = spark.createDataFrame([(i, f"http://h.example.com/{i}", page(i)) for i in range(pages)], "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        assert [f"part {n} of" in r["text"] for n in range(len(slots))] == [keep for _, keep in slots], r["text"]


def test_references_end_at_tags(spark):
    page = "<p>1 &<i>lt;</i> 2 &am<b>p;</b> &lt;b&gt; &amp;lt; &eacute;<i>t</i>&#233; &am<!-- x -->p;</p>"
    df = spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string")
    assert html_extract.extract(df).head()["text"] == "1 &lt; 2 &amp; <b> &lt; été &amp;"
