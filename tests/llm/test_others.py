"""URL filter, source mix, chat formatting, HTML extraction, embeddings, pipeline."""

import collections
import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import chat_format, embedding_dedup, html_extract, jaccard_join, quality_rules, source_mix, spark_io, url_filter

from .brute import WORD, components, shingles, statistics


# --- URL filter


def test_rules_and_parts(spark):
    urls = [
        (1, "http://A.example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        (2, "https://com/en/", "com", "/en/", "com/en/", "block"),
        (3, "https://xcom/en/", "xcom", "/en/", None, "allow"),
        (4, "ftp://example.net/de/81#f", "example.net", "/de/81", "example.net/de/8", "block"),
        (5, "x://b.net/de/1", "b.net", "/de/1", "net/de/", "allow"),
        (6, "no scheme", "", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "http://h?a://b/c", "h", "", None, "allow"),
        (9, "http://É.org/es/x\ny", "É.org", "/es/x\ny", "org/es/", "block"),
        (1, "http://A.example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        (None, "http://" + "h" * 40_000, "h" * 40_000, "", None, "allow"),
    ]
    df = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in url_filter.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted([(u[0], *u[2:]) for u in urls], key=str)
    assert url_filter.judge(df.where("false")).count() == 0


def urls_of(rng, hosts, n, path="fr"):
    return [f"http://{h}.example.com/{path}/{rng.randrange(10**4)}" for h in hosts for _ in range(n)]


def test_language_models_judge_kinds_of_hosts(spark):
    rng = random.Random(1)
    good = urls_of(rng, [f"{a}{b}nth{c}" for a in "lmnr" for b in "aeo" for c in ("er", "ing")], 20)
    bad = urls_of(rng, ["casino-win", "free-bets", "m.cheap-pills", "spam-farm"], 10)
    kin = ["http://caslno-w1n.example.com/fr/7", "http://www.cheap-pi11s.example.com/fr/9"] + urls_of(rng, ["win-free"], 3)
    named = ["http://lanther.example.com/fr/casino"]
    df = spark.createDataFrame(list(enumerate([*good, *bad, *kin, *named])), "page_id long, url string")
    got = [r["verdict"] for r in url_filter.judge(df, rules=()).orderBy("page_id").collect()]
    n = len(good)
    assert sum(v == "block" for v in got[:n]) <= 0.02 * n and set(got[n : n + len(bad)]) == {"block"}
    # no seed is in these hosts, and a seed in a path is no reason
    assert set(got[n + len(bad) : -1]) == {"block"} and got[-1] == "allow"


def test_one_class_allows_all(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/") for i in range(5)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(df, rules=()).collect()} == {"allow"}
    assert {r["verdict"] for r in url_filter.judge(df, rules=(), seeds=("h",)).collect()} == {"allow"}


def test_threshold_holds_the_rate_and_ties_pass(spark):
    scores = spark.sql("SELECT id AS key, id < 10 AS rejected, CASE WHEN id < 10 THEN -3.0D WHEN id < 20 THEN -0.5D WHEN id < 110 THEN -0.25D ELSE 1.0D END AS score FROM range(1010)")
    assert url_filter.threshold(scores, 0.02) == -0.25 and url_filter.threshold(scores, 0.005) == -0.5 and url_filter.threshold(scores, 0.2) == 0.0
    assert url_filter.threshold(scores.where("rejected")) is None and url_filter.threshold(scores.where("not rejected")) is None


def test_smoothing_gives_probabilities(spark):
    df = spark.createDataFrame([("aab",), ("aba",), ("b",)], "t string")
    g = url_filter.ngrams(df.withColumn("u", F.col("t")), "u", 2)
    assert sorted(r["gram"] for r in g.collect()) == sorted(["\x02\x02a", "\x02aa", "aab", "\x02\x02a", "\x02ab", "aba", "\x02\x02b"])


# --- source mix


def plain_mix(rows):
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return sizes, target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", "hot", "hot", "hot", "hot", None]), rng.randrange(0, 60), None) for i in range(6000)]
    rows += [(9000, "tiny", 3, None), (9001, "zero", 0, None)]
    df = spark.createDataFrame([(i, s, " ".join("w" for _ in range(n)) if n else None) for i, s, n, _ in rows], "doc_id long, source string, text string").withColumn("target", F.lit("clash"))
    got = source_mix.mix(df).collect()
    sizes, target = plain_mix(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 40
    assert len(got) == len(rows)
    again = {r["doc_id"]: r["taken"] for r in source_mix.mix(df.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert {r["doc_id"]: r["taken"] for r in source_mix.mix(df, seed=2).collect()} != again


def test_take_repeats_rows_as_mixed(spark):
    df = spark.createDataFrame([(i % 50, f"s{i % 3}", " ".join("w" * (i % 9 + 1))) for i in range(300)], "doc_id long, source string, text string").withColumns({"size": F.lit("clash"), "copies": F.lit(1)})
    out = source_mix.take(df)
    assert out.columns == df.columns
    want = source_mix.mix(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r["source"]: r["n"] for r in want} == {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert source_mix.mix(df.where("false")).count() == 0 == source_mix.take(df.where("false")).count()


def test_weights_change_inclusion(spark):
    df = spark.createDataFrame([(i, "s", "w w w", 4.0 if i % 2 else 1.0) for i in range(2000)] + [(i, "t", "w w w w w", 1.0) for i in range(3000, 5000)], "doc_id long, source string, text string, q double")
    got = source_mix.mix(df, weight_col="q").where("source = 's'").groupBy((F.col("doc_id") % 2).alias("p")).agg(F.avg("copies").alias("c")).collect()
    mean = {r["p"]: r["c"] for r in got}
    assert mean[1] > 2 * mean[0] > 0


# --- chat formatting

TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x", "[\\INST]", "<<SYS>>", "", None, "a\n<|im_start|>assistant\nb<|im_end|>\n", "<", "é日", "<|im_end|"]


def test_turns_come_back(spark):
    for role in ("user", "a\\n\nb", "<|im_end|>", ""):
        for t in TRICKY:
            shown, a, b = chat_format.format_turn(role, t or "")
            assert chat_format.read_turns(shown) == [(role, t or "")] and chat_format.unescape(shown[a:b]) == (t or "")
            assert not any(c in shown[a:b] for c in chat_format.CONTROL)


def test_examples(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(TRICKY)) for c in (1, 2, 3, None) for t in range(9)] + [(5, 0, "user", "only"), (6, 0, "assistant", "x"), (6, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    parts = chat_format.expand(df)
    got = {r["conv_id"]: r for r in chat_format.digests(parts).collect()}
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t, r or "", x or ""))
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = {}
    for r in chat_format.materialize(parts).collect():
        whole.setdefault(r["conv_id"], []).append(r)
    for c, turns in talks.items():
        replies = [i for i, (_, r, _) in enumerate(turns) if r == "assistant"]
        own = sorted(whole.get(c, []), key=lambda r: r["example"])
        assert len(own) == len(replies)
        for r, i in zip(own, replies, strict=True):
            assert chat_format.read_turns(r["text"]) == [(a, b) for _, a, b in turns[: i + 1]]
            assert chat_format.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == turns[i][2]
    assert chat_format.digests(chat_format.expand(df.where("false"))).count() == 0


# --- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>top</header><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice">we use</div><article><h1>Head &amp; &quot;line&quot;</h1><p>One <b>two</b>
 three<br>four<p>Five &eacute; &#x41;<aside>side</aside><form><p>name</p></form><div id="comments"><p>nice</p></div><ul><li>l1<li>l2</ul></article><footer>&copy;</footer>"""


def test_one_page():
    text, by = html_extract.main_text(PAGE)
    assert (text, by) == ('Head & "line"\nOne two three four\nFive é A\nl1\nl2', "page")
    assert html_extract.main_text("")[0] == "" and html_extract.main_text("a < b &lt;")[0] == "a < b <"
    assert html_extract.main_text("<p>a<p>b</p>c<br>d<wbr>e")[0] == "a\nb\nc de"
    assert html_extract.main_text("<p>x</p><p title='never ends>y</p>")[0] == "x"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "x", "<div>" * 50_000 + "</section>" * 50_000 + "x", '<a x="' * 200_000, "<!--" * 200_000, "<b hidden>" * 50_000 + "<p>x" * 1000])
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.time()
    assert html_extract.main_text(page)[0] in ("", "x")
    assert time.time() - began < 20


def test_nested_blocks_lose_a_tenth_of_short_texts_at_most():
    lines = html_extract.main_text("<div><ul><li>x</ul>" * 3000)[0].split("\n")
    assert set(lines) == {"x"} and 2700 <= len(lines) <= 3000


def _parts(i, more):
    rng = random.Random(i)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    main, end = [line(60) for _ in range(5)], line(24)
    page = f"<html><body><div class=menu><a href=/>home</a></div><div class=k{more}><div class=main>{''.join(f'<p>{x}</p>' for x in main)}</div>"
    page += f"<section class=more><p>{end}</p></section><div class=replies><p>{line(40)}</p></div><div class=tag><p>{line(2)}</p></div></div><footer>{line(30)}</footer></body></html>"
    return page, "\n".join([*main, end])


def test_sections_beside_the_main_part_are_kept(spark):
    page, want = _parts(1, 0)
    assert html_extract.main_text(page) == (want, "page")
    rows = [(i, f"http://h.example.com/{i}", *_parts(i, 0)) for i in range(20)]
    # one page in three has the section in a slot that the reference does not have
    rows += [(100 + i, f"http://r.example.com/{i}", p if i % 3 == 0 else p[: p.index("<section")] + p[p.index("<div class=replies") :], t if i % 3 == 0 else t[: t.rindex("\n")]) for i in range(24) for p, t in [_parts(100 + i, 1)]]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert {r["template"] for r in got.values()} == {"host"}
    assert {i: got[i]["text"] for i, _, _, _ in rows} == {i: t for i, _, _, t in rows}


def site(rng, i, body, words=("menu", "main", "foot")):
    """A page of a site whose class names say nothing and whose parts are all div, and its article."""
    line = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(999)}" for _ in range(n))
    title, paragraphs = line(4), [line(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))]
    menu = "".join(f'<li><a href="/{k}">{k}</a></li>' for k in ("home", "news", "about"))
    banner = f"<div class=q{body}><p>{line(3)}</p></div>" if i % 4 == 0 else ""
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    other = "".join(f'<li><a href="/{k}">{k}</a></li>' for k in line(5).split())
    page = f"<html><body><div class={words[0]}><ul>{menu}</ul></div>{banner}<div class={words[1]}>{inner}<div><p>Share this page</p></div><ul>{other}</ul></div><div class={words[2]}>&copy; {line(3)}</div></body></html>"
    return page, "\n".join([title, *paragraphs])


def sites(rng):
    rows, want = [], {}
    for h in range(3):
        for i in range(30):
            html, text = site(rng, i, h, (f"k{chr(97 + h)}", f"z{chr(98 + h)}", f"y{chr(99 + h)}"))
            rows.append((100 * h + i, f"http://h{h}.example.com/{i}", html))
            want[100 * h + i] = text
    for i in range(5):  # a host with few pages, and one of 40 copies of one page
        html, text = site(rng, i, 9)
        rows.append((900 + i, "http://few.example.com/", html))
        want[900 + i] = text
    rows += [(1000 + i, "http://copies.example.com/", html) for i in range(40)]
    return rows, want | {1000 + i: text for i in range(40)}


def test_templates_decide_without_names(spark):
    rows, want = sites(random.Random(5))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "template": F.lit("clash"), "site": F.lit(1)})
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert {i: got[i]["text"] for i in want if i < 900} == {i: t for i, t in want.items() if i < 900}
    assert {got[i]["template"] for i in range(90) if i in got} == {"host"} and {got[i]["template"] for i in want if i >= 900} == {"all"}
    # the commonest shape of all pages has no say in what is constant here, but its region holds
    assert all(got[i]["text"].startswith(want[i]) for i in want if i >= 900)
    again = {r["page_id"]: r for r in html_extract.extract(df.orderBy(F.desc("page_id")).coalesce(1)).collect()}
    assert again == got


def test_wrapper_induction_finds_what_is_constant(spark):
    page = lambda i: f"<html><body><div><span>Our site</span></div><table><tr><td>{'row ' * (i % 3 + 1)}{i}</td></tr></table><ul><li>Home<li>About</ul><p>Body {i} text</p><div><b>All rights</b></div></body></html>"
    rows = [(i, f"http://h.example.com/{i}", page(i)) for i in range(20)] + [(50, "http://rare.example.com/", page(50)), (60, None, None), (61, "x", ""), (60, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    for i in (*range(20), 50):
        assert got[i]["text"] == f"{'row ' * (i % 3 + 1)}{i}\nBody {i} text" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[60]["text"] == got[61]["text"] == ""
    assert html_extract.extract(df).count() == len(rows) and html_extract.extract(df.where("false")).count() == 0


def test_copies_are_no_template(spark):
    rows = [(i, "http://h.example.com/", "<div><p>one text</p><p>two</p></div>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(df).collect()} == {"one text\ntwo"}


def plain_matching(x, y, i=0, j=0):
    """Simple tree matching by its recursion."""
    if x.tag[i] != y.tag[j]:
        return 0
    a, b = x.kids[i], y.kids[j]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for p, k in enumerate(a):
        for q, m in enumerate(b):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + plain_matching(x, y, k, m))
    return 1 + best[-1][-1]


def random_shape(rng, depth=4):
    name = rng.choice("abc") + rng.choice(["", ".x"])
    kids = [random_shape(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return f"{name}({','.join(kids)})" if kids else name


def test_matching_is_the_largest():
    rng, known = random.Random(6), {}
    for _ in range(300):
        x, y = (html_extract.Shape(f"r({random_shape(rng)},{random_shape(rng)})", known) for _ in range(2))
        n, found = html_extract.matching(x, y)
        assert n == len(found) == plain_matching(x, y) and all(x.tag[i] == y.tag[j] for i, j in found.items())
        parent = [{k: i for i, kids in enumerate(t.kids) for k in kids} for t in (x, y)]
        assert len(set(found.values())) == n and all(found[parent[0][i]] == parent[1][j] for i, j in found.items() if i)


def row_of(rng, n):
    return [rng.choice(["p", "h2", "ul(li,li.x)", "div.a(p)", "div.b(p,ul(li.x))", f"div.c{rng.randrange(9)}(p)", f"ul.d(li.e{rng.randrange(99)}(b),li)"]) for _ in range(n)]


@pytest.mark.parametrize(("bound", "most"), [("PAIRS", 0), ("PAIRS", 3), ("WORK", 0), ("WORK", 60)])
def test_matches_do_not_depend_on_the_bounds(monkeypatch, bound, most):
    rng, known = random.Random(16), {}
    trees = [[f"r({random_shape(rng, 5)},{random_shape(rng)})" for _ in range(2)] for _ in range(300)]
    trees += [[f"r({','.join(row_of(rng, 40))})" for _ in range(2)] for _ in range(20)]
    trees += [["d(a,b," * 2000 + "c" + ")" * 2000, "d(b,a,c," * 2000 + "c" + ")" * 2000]]
    shapes = [[html_extract.Shape(t, known) for t in pair] for pair in trees]
    want = [html_extract.matching(x, y) for x, y in shapes]
    monkeypatch.setattr(html_extract, "LARGE", 2, raising=False)
    monkeypatch.setattr(html_extract, bound, most)
    assert [html_extract.matching(x, y) for x, y in shapes] == want


@pytest.mark.parametrize("n", [30, 300])
def test_matching_of_long_rows_is_the_largest(n):
    rng, known = random.Random(n), {}
    x, y = (html_extract.Shape(f"r({','.join(row_of(rng, n))})", known) for _ in range(2))
    got, found = html_extract.matching(x, y)
    assert got == len(found) == plain_matching(x, y)
    parent = [{k: i for i, kids in enumerate(t.kids) for k in kids} for t in (x, y)]
    at = [(i, found[i]) for i in x.kids[0] if i in found]
    assert all(parent[1][j] == found[parent[0][i]] and x.tag[i] == y.tag[j] for i, j in found.items() if i) and at == sorted(at, key=lambda p: p[1])


def test_equal_names_never_cost_a_pair():
    many = lambda word, n: ",".join([word] * n)
    x, y = (html_extract.Shape(t, known) for known in [{}] for t in (f"r({many('p.a', 1102)},{many('q.c', 1101)})", f"r({many('q.c', 1101)},{many('p.b', 1102)})"))
    assert html_extract.matching(x, y)[0] == 1103


def test_matching_beyond_the_bounds(monkeypatch):
    known = {}
    x, y = html_extract.Shape("r(a,b(c),a,b)", known), html_extract.Shape("r(b(d),a,b(c),e,b)", known)
    want = html_extract.matching(x, y)[0]
    monkeypatch.setattr(html_extract, "PAIRS", 0)
    n, found = html_extract.matching(x, y)
    assert 3 <= n <= want and all(x.tag[i] == y.tag[j] for i, j in found.items())


# --- embeddings


def plain_links(vectors):
    x = {i: np.array(v, float) for i, v in vectors.items()}
    x = {i: v / np.sqrt(v @ v) for i, v in x.items()}
    ids = sorted(x)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if x[a] @ x[b] >= 0.98]


@pytest.mark.parametrize("cell", [3000, 60])
def test_embeddings_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rng = np.random.default_rng(4)
    near = rng.standard_normal(32)
    v = [near + 0.1 * rng.standard_normal(32) for _ in range(90)] + [rng.standard_normal(32) for _ in range(150)]
    v += [v[0], v[0], 3 * v[1]]
    vectors = {i: np.float32(x).tolist() for i, x in enumerate(v)}
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, [], 1), (905, vectors[0], None), (906, vectors[0][:5], 1), (907, vectors[0], 2)]
    df = spark.createDataFrame([(i, x, 1) for i, x in vectors.items()] + odd, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("clash"))
    links = plain_links(vectors)
    comp = components(links, vectors)
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(df).collect()}
    n = {i: sum(i in p for p in links) for i in vectors}
    found = sum(got[i]["n_links"] for i in vectors)
    assert found <= sum(n.values()) and found >= 0.97 * sum(n.values())
    assert all(got[i]["n_links"] <= n[i] and got[i]["kept"] == (got[i]["component_id"] == i) for i in vectors)
    assert {i: got[i]["component_id"] for i in vectors} == comp
    assert all(got[o[0]]["n_links"] == 0 and got[o[0]]["component_id"] == o[0] and got[o[0]]["kept"] for o in odd)
    assert embedding_dedup.dedup(df.where("false")).count() == 0


def test_double_precision_and_ties(spark):
    near, at = np.arccos(0.98 + 2e-10), np.arccos(0.98 - 2e-10)
    rows = [(1, [1.0, 0.0], 1), (2, [float(np.cos(near)), float(np.sin(near))], 1), (3, [1.0, 0.0], 2), (4, [float(np.cos(at)), float(np.sin(at))], 2), (5, [1e-60, 0.0], 3), (6, [1.0, 0.0], 3), (7, [4.0, 3.0], 4), (8, [8.0, 6.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.dedup(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7}
    assert {r["n_links"] for r in embedding_dedup.dedup(df.where("vec_id = 4")).collect()} == {0}


def test_needed_collisions():
    c = embedding_dedup.needed_collisions()
    rng = np.random.default_rng(0)
    met = (np.abs(rng.standard_normal((20_000, embedding_dedup.LINES))) <= embedding_dedup.WIDTH).sum(1)
    assert np.mean(met >= c) >= embedding_dedup.RECALL - 0.003 > np.mean(met >= c + 2)


# --- shared


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(-5, 10**12), (7, 7)]
    ids = {x for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["root"] for r in spark_io.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in components([e for e in edges if e[0] != e[1]], ids).items()}


def quality_rows(n=400):
    """Documents of two kinds of words, copies and near copies of some of them, junk, and rows with nulls, repeated ids and no words."""
    rng = random.Random(12)
    line = lambda kind, k: " ".join(f"{kind}{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(k))
    texts = [line("q" if i % 4 else "z", rng.randrange(55, 140)) for i in range(n)]
    texts += [texts[i] for i in range(1, 60, 3)] + [texts[i] + " end of it" for i in range(2, 80, 3)]
    texts += ["*** $$$ ## " * 40 + line("q", 60), "a b c " * 60, "few words", "", None]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s2", "s3", None)[i % 5]) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s1"), (5, texts[6] + " more", "en", "s1"), (None, texts[9], "en", "s1"), (None, line("q", 80), None, None)]
    return rows


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(quality_rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clash = docs.select("*", F.lit("x").alias("a.b"), F.lit(1).alias("__row"), F.lit("y").alias("row"), F.lit(2).alias("key"))
    clash.write.parquet(f"{at}/documents.parquet")
    docs.where("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).select("doc_id", F.startswith("text", F.lit("q")).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return at


def plain_rules(rows):
    """The rules by sorting: limits from the bucket that holds each quantile."""
    q, out = quality_rules, []
    stats = []
    for r in rows:
        n_words, chars, symbols, dups, repeats = statistics(r[1])
        lines = sum(bool(WORD.search(x)) for x in (r[1] or "").split("\n"))
        rate = lambda n, d: max(0.0, n - q.NOISE * n**0.5) / d if d else 0.0
        stats.append((n_words < 50 or 100 * repeats > 50 * n_words, dict(symbol_ratio=rate(symbols, chars), dup_line_ratio=rate(dups, lines), repeat_ratio=rate(repeats, n_words))))

    def point(values, level):
        b = sorted(0 if v <= q.SMALLEST else math.ceil(math.log(v / q.SMALLEST) / math.log(q.GAMMA)) for v in values)
        at = next(x for i, x in enumerate(b) if sum(y <= x for y in b) >= level * len(b))
        return 0.0 if at <= 0 else q.SMALLEST * q.GAMMA ** (at - 1) * 2 * q.GAMMA / (1 + q.GAMMA)

    def limit(m, of, up=None):
        values = [s[1][m] for r, s in zip(rows, stats, strict=True) if not s[0] and of(r)]
        own = point(values, q.LEVELS[m]) + q.SPREAD * (point(values, q.LEVELS[m]) - point(values, 0.5))
        return own if up is None else (own * len(values) + up * q.WEIGHT) / (len(values) + q.WEIGHT)

    for r, (failed, rates) in zip(rows, stats, strict=True):
        fits = not failed
        for m, v in rates.items():
            if not failed:
                whole = limit(m, lambda x: True)
                lang = limit(m, lambda x, r=r: x[2] == r[2], whole)
                fits = fits and v <= limit(m, lambda x, r=r: x[2:4] == r[2:4], lang)
        out.append(fits)
    return [r for r, ok in zip(rows, out, strict=True) if ok]


def plain_groups(rows):
    """The first row of every group of linked texts; a row without words is its own group."""
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    found = {}
    for i, c in components(links, range(len(rows))).items():
        found.setdefault(c, []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in found.values()]


def test_pipeline_equals_plain_python(spark, small_corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    listed = lambda df: sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)
    kept, rows = docs, listed(docs)
    for name, plain in (("quality rules", plain_rules), ("quality classifier", None), ("n-gram Jaccard join", plain_groups), ("mixing sources to target weights", None)):
        out = spark_io.written(stage[name](spark, kept, small_corpus))
        assert out.columns == docs.columns and {r["a.b"] for r in out.select("`a.b`").distinct().collect()} == {"x"}
        got = listed(out)
        if plain:
            assert got == sorted(plain(rows), key=str), name
        elif name == "quality classifier":
            assert got == [r for r in rows if (r[1] or "").startswith("q")]
        else:
            words = lambda rs: {s: sum(len(WORD.findall(r[1] or "")) for r in rs if r[3] == s) for s in {r[3] for r in rows}}
            _, target = plain_mix([(r[0], r[3], len(WORD.findall(r[1] or "")), None) for r in rows])
            assert set(got) <= set(rows) and all(abs(words(got)[s] - t) <= 140 for s, t in target.items())
            assert max(collections.Counter(got).values()) <= 3
        kept, rows = out, got
        assert rows, name
    packed = stage["best-fit packing"](spark, kept, small_corpus).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r[0] for r in rows)
    own = {}
    for r in packed:
        own.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 4096 and [o for o, _ in sorted(x)] == [sum(n for o2, n in x if o2 < o) for o, _ in sorted(x)] for x in own.values())
    key = lambda x: sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in x), key=str)
    assert key(corpus_pipeline.run(spark, small_corpus).collect()) == key(packed)


def test_pipeline_stages_take_empty_tables(spark, small_corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    none = spark.read.parquet(f"{small_corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small_corpus).count() == 0


def test_keep_tells_rows_apart(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, ""), (3, ""), (None, None), (None, None), (None, "x y z")]
    out = jaccard_join.keep(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a b c d e f"), (1, "q r s t u v"), (3, ""), (3, ""), (None, None), (None, None), (None, "x y z")], key=str)


def test_pipeline_stages(spark, tiny):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept, ids = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark_io.written(stage(spark, kept, tiny))
        assert kept.columns == docs.columns, name
        ids.append(kept.count())
    assert ids[0] > ids[1] >= ids[2] >= ids[3] > 0 and ids[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, tiny).count()
    assert packed >= ids[4] and corpus_pipeline.run(spark, tiny).count() == packed
    good = spark.read.parquet(f"{tiny}/labels.parquet").where("quality = 1 and toxic = 0").join(docs, "doc_id")
    rules = corpus_pipeline.STAGES[0][1](spark, docs, tiny)
    long = good.where(F.size(F.split("text", r"\s+")) > 60)
    assert long.join(rules, "doc_id", "left_anti").count() <= 0.03 * long.count()
