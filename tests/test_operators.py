"""Golden values and plain versions of operators that SQL does not cover."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import audit, chunking, graph, model, relational, search
from clausewright.queries import QUERIES


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).head()["x"] if values else spark.range(1).select(column.alias("x")).head()["x"]


# --- audit scores


def scores(spark, obligations, gaps):
    o = spark.createDataFrame(obligations, "document string, id string, regulation string, type string")
    g = spark.createDataFrame(gaps, "document string, obligation_id string, regulation string, severity string, theme string")
    risk = audit.regulation_risk(o, g)
    return {r["regulation"]: r["compliance"] for r in risk.collect()}, audit.document_risk(risk).head()["compliance"]


def test_no_gap_is_full_compliance(spark):
    assert scores(spark, [("d", "OBL-0000", "GDPR", "other")], []) == ({"GDPR": 100.0}, 100.0)


def test_one_critical_gap_of_one_obligation(spark):
    assert scores(spark, [("d", "OBL-0000", "GDPR", "other")], [("d", "OBL-0000", "GDPR", "critical", "other")]) == ({"GDPR": 0.0}, 0.0)


def test_scores_stay_in_range(spark):
    per, total = scores(spark, [("d", f"OBL-{i}", "GDPR", "other") for i in range(2)], [("d", "OBL-0", "GDPR", "critical", "other")] * 10)
    assert 0 <= per["GDPR"] <= 100 and 0 <= total <= 100


def test_obligations(spark):
    rows = [("d", 0, "Article 33(1)", "requires", "breach report in 72 hours", "GDPR"), ("d", 1, "ARTICLE 33(1)", "requires", "breach report in 72 hours", "GDPR"), ("d", 2, "A", "B", "C", ""), ("d", 3, "Controller", "must", "keep records of it", "")]
    t = spark.createDataFrame(rows, "document string, pos int, source string, relation string, target string, regulation string")
    got = {r["id"]: r for r in audit.obligations_from(t, F.array(F.lit("HIPAA"))).collect()}
    assert set(got) == {"OBL-0000", "OBL-0003"}
    assert (got["OBL-0000"]["type"], got["OBL-0000"]["article"], got["OBL-0000"]["regulation"]) == ("breach_notification", "Article 33(1)", "GDPR")
    assert got["OBL-0003"]["regulation"] == "HIPAA" and got["OBL-0003"]["article"] == ""


def test_half_even_rounding(spark):
    assert one(spark, T.risk_to_compliance(F.lit(3.335))) == 66.6 and one(spark, T.risk_to_compliance(F.lit(99.0))) == 0.0


# --- text


def test_jurisdictions(spark):
    assert one(spark, T.detect_jurisdictions(F.lit("What is the right to erasure?"))) == ["GDPR"]
    assert one(spark, T.detect_jurisdictions(F.lit("PHI rules"))) == ["HIPAA"]
    assert one(spark, T.detect_jurisdictions(F.lit("nothing"))) == ["UNKNOWN"]
    assert "GDPR" in one(spark, T.detect_jurisdictions(F.lit("neutral"), word_boundary=False)) and one(spark, T.detect_jurisdictions(F.lit("neutral"), word_boundary=True)) == ["UNKNOWN"]
    assert one(spark, T.detect_jurisdictions(F.lit("x"), F.lit("y"), F.array(F.lit("CCPA")))) == ["CCPA"]


def test_document_names(spark):
    q = lambda text, name: one(spark, T.names_document(F.lit(text), F.lit(name)))
    assert q("does google comply", "google_privacy_policy_latest.pdf") and not q("does the privacy policy comply", "google_privacy_policy_latest.pdf")


def test_model_output(spark):
    kind = "struct<a:int>"
    assert [r["a"] for r in one(spark, T.parsed_list(F.lit('```json\n[{"a":1},{"a":2}]\n```'), kind))] == [1, 2]
    assert one(spark, T.parsed_list(F.lit('{"a":1}'), kind)) == [] == one(spark, T.parsed_list(F.lit("not json"), kind))
    assert one(spark, T.entities_from(F.lit('names: "Data Controller", "x", "Article 5"'))) == ["Data Controller", "Article 5"]
    assert one(spark, T.answer_fields(F.lit("plain")))["answer"] == "plain"


def test_hash_alias_wraps_like_32_bits(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return f"privacy_policy_{abs(h) % 900 + 100}.pdf"

    for name in ("acme_privacy.pdf", "z" * 40, "ab"):
        assert one(spark, T.hash_alias(F.lit(name))) == plain(name)
    assert one(spark, T.pseudonym(F.lit("/x/Meta_Privacy_Policy.pdf"))) == "privacy_policy_2.pdf" and one(spark, T.pseudonym(F.lit(None).cast("string"))) == "privacy_policy.pdf"


# --- chunks


def test_size_chunks_equal_a_fold(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    want = {}
    for r in docs.collect():
        now, n, k = [], 0, 0
        for w in r["text"].split():
            now.append(w)
            n += len(w) + 1
            if n >= 2000:
                want[r["doc_id"], k] = " ".join(now)
                now, n, k = [], 0, k + 1
        if now:
            want[r["doc_id"], k] = " ".join(now)
    assert {(r["doc_id"], r["chunk_index"]): r["chunk_text"] for r in chunking.size_chunks(docs).collect()} == want


def test_token_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(120)))), (2, ""), (3, None), (4, "a b")], "id int, text string")
    got = [(r["id"], r["chunk_text"].split()[0], r["chunk_text"].split()[-1]) for r in chunking.token_chunks(df, size=50, overlap=10).orderBy("id", "chunk_index").collect()]
    assert got == [(1, "0", "49"), (1, "40", "89"), (1, "80", "119"), (4, "a", "b")]
    with pytest.raises(ValueError):
        chunking.chunk(df, "unknown")
    with pytest.raises(ValueError):
        chunking.token_chunks(df, size=10, overlap=10)


def test_articles_of_other_regulations(spark):
    ccpa = "intro\n" + "".join(f"## **§ 7{i:03d}. Title {i}**\nbody {i} {'word ' * 12}\n" for i in range(4))
    hipaa = "contents Subpart A\n## **Subpart A General**\n" + "".join(f"## **§ 16{i}.10 Part {i}**\n{'text ' * 12}\n" for i in range(3))
    nist = "".join(f"**ID.AM-P{i} : ** a | b <br> {'cell ' * 12}\n" for i in range(3))
    df = spark.createDataFrame([("CCPA", ccpa), ("HIPAA", hipaa), ("NIST", nist), ("CCPA", "## **§ 7001. Only one**\nx"), ("OTHER", "plain text")], "regulation string, text string")
    got = [(r["regulation"], r["article_id"], r["heading_level"]) for r in chunking.split_articles(df).collect()]
    assert ("CCPA", "§ 7002. Title 2", 2) in got or ("CCPA", "7002. Title 2", 2) in got
    assert sum(g[0] == "NIST" and g[2] == 2 for g in got) == 3 and sum(g[0] == "HIPAA" and g[2] == 2 for g in got) >= 3
    assert ("OTHER", "section_1", 0) in got and ("CCPA", "section_1", 0) in got


def test_semantic_chunks_cover_the_text(spark):
    text = "A cat sat. A cat ran. Stocks fell. Stocks rose. Stocks fell again."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    out = chunking.semantic_chunks(df, "id", model.hash_embedding).orderBy("section_id").collect()
    assert " ".join(r["chunk_text"] for r in out) == text and len(out) >= 2


# --- search


def test_nearest_blocks_equal_one_block(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)], "id int, v array<double>")
    q = df.where("id < 12")
    key = lambda d: sorted((r["query"], r["doc"], r["rank"]) for r in d.collect())
    assert key(search.nearest(df, q, "id", "id", "v", 5)) == key(search.nearest(df, q, "id", "id", "v", 5, most_queries=5))


# --- graph


def random_graph(spark, n=14, m=24, seed=2):
    rng = random.Random(seed)
    e = sorted({tuple(rng.sample(range(n), 2)) for _ in range(m)})
    return e, spark.createDataFrame([(f"n{a}", "R", f"n{b}", i) for i, (a, b) in enumerate(e)], "src string, rel string, dst string, eid long")


def test_betweenness_equals_path_counting(spark):
    e, df = random_graph(spark)
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = sorted(near)

    def shortest(s, t):
        level = [[s]]
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            seen = {x for p in level for x in p}
            level = [p + [y] for p in level for y in near[p[-1]] if y not in seen]
        return []

    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        ps = shortest(s, t)
        for v in nodes:
            if v not in (s, t) and ps:
                want[v] += sum(v in p for p in ps) / len(ps)
    k = (len(nodes) - 1) * (len(nodes) - 2)
    # few nodes are all sources, so the values are exact whatever error is allowed
    got = graph.betweenness(df).collect()
    assert {r["node"]: r["betweenness"] for r in got} == pytest.approx({f"n{v}": x / k for v, x in want.items()})
    assert {(r["error"], r["sources"]) for r in got} == {(0.0, len(nodes))}


def test_pagerank_keeps_its_mass(spark):
    _, df = random_graph(spark)
    assert sum(r["rank"] for r in graph.pagerank(df, tolerance=1e-3, fold=2).collect()) == pytest.approx(1.0)


def test_pagerank_without_cycles_ends_with_the_longest_path(spark, monkeypatch):
    steps, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: steps.append(df.columns) or cut(df))
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "x")], "src string, dst string")
    got = {r["node"]: r["rank"] for r in graph.pagerank(df).collect()}
    a, b = 1.0, 1 + 0.85 / 2
    c = 1 + 0.85 / 2 + 0.85 * b
    assert got == pytest.approx({"a": a / (a + b + c), "b": b / (a + b + c), "c": c / (a + b + c)})
    assert steps.count(["node", "x", "moves"]) == 3  # the start and two steps
    assert graph.pagerank(df.where("false")).count() == 0


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for g in (range(5), range(5, 10)) for a, b in itertools.combinations(g, 2)] + [(4, 5)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    got = graph.communities(df)
    parts = {}
    for r in got.collect():
        parts.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, parts.values())) == [[f"n{i}" for i in range(5)], [f"n{i}" for i in range(5, 10)]]
    assert graph.modularity(df, got) == pytest.approx(2 * (10 / 21 - (21 / 42) ** 2), abs=1e-6)


def test_communities_leave_one_table(spark, tmp_path, monkeypatch):
    from clausewright.operators import iterate

    monkeypatch.setattr(iterate, "shared_folder", lambda _: str(tmp_path))
    _, df = random_graph(spark)
    got = graph.communities(df)
    assert len([x for x in tmp_path.iterdir() if x.name.startswith("table-")]) == 1
    assert got.count() == graph.undirected(df).select("a").distinct().count()


def test_betweenness_of_a_long_path(spark):
    n = 16
    df = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(n - 1)], "src string, dst string")
    want = {f"n{i:02}": 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(df).collect()} == pytest.approx(want)


def plain_betweenness(pairs):
    """Brandes' algorithm over plain dictionaries, from every node."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        depth, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            total[w] += delta[w]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_sampled_betweenness_is_within_its_error(spark):
    e, df = random_graph(spark, 150, 260, seed=3)
    e += [(0, 200 + i) for i in range(150)] + [(1, 400 + i) for i in range(60)]  # two hubs with leaves
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in e], "src string, dst string")
    want = {f"n{v}": x for v, x in plain_betweenness(e).items()}
    got = {r["node"]: r for r in graph.betweenness(df, error=0.25, first=32, most=64).collect()}
    assert got.keys() == want.keys()
    assert {r["sources"] < len(want) for r in got.values()} == {True}
    assert all(r["error"] <= 0.25 for r in got.values())
    assert all(abs(r["betweenness"] - want[v]) <= r["error"] for v, r in got.items())


def test_betweenness_without_error_takes_every_source(spark):
    e, df = random_graph(spark, 40, 70, seed=5)
    got = graph.betweenness(df, error=0.0, first=20).collect()
    want = plain_betweenness(e)
    assert {r["node"]: r["betweenness"] for r in got} == pytest.approx({f"n{v}": x for v, x in want.items()})
    assert {(r["error"], r["sources"]) for r in got} == {(0.0, len(want))}
    assert graph.betweenness(df.where("false")).count() == 0
    assert [r["betweenness"] for r in graph.betweenness(df.limit(1)).collect()] == [0.0, 0.0]


def test_betweenness_sends_a_row_for_each_node_and_not_for_each_source(spark, monkeypatch):
    from clausewright.operators import brandes

    monkeypatch.setattr(brandes, "CELLS", 500)  # groups of sources
    monkeypatch.setattr(brandes, "EDGES", 16)
    rows, written = [], brandes.written
    monkeypatch.setattr(brandes, "written", lambda df: (out := written(df), "d" in df.columns and rows.append(out.count()))[0])
    e, df = random_graph(spark, 40, 70, seed=5)
    want = plain_betweenness(e)
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(df).collect()} == pytest.approx({f"n{v}": x for v, x in want.items()})
    assert rows and set(rows) == {len(want)}


def test_pagerank_converges(spark):
    e, df = random_graph(spark)
    nodes = sorted({x for p in e for x in p})
    out = {v: [b for a, b in e if a == v] for v in nodes}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(300):
        lost = sum(want[v] for v in nodes if not out[v])
        want = {v: (0.15 + 0.85 * lost) / len(nodes) + 0.85 * sum(want[a] / len(out[a]) for a, b in e if b == v) for v in nodes}
    assert {r["node"]: r["rank"] for r in graph.pagerank(df).collect()} == pytest.approx({f"n{v}": x for v, x in want.items()}, abs=1e-8)


def test_totals_count_communities(spark):
    e, df = random_graph(spark)
    nodes = {x for p in e for x in p}
    member = spark.createDataFrame([(f"n{x}", f"c{x % 3}") for x in nodes], "node string, community string")
    assert graph.totals(df, member=member).head().asDict() == {"edges": len(e), "conflicts": 0, "nodes": len(nodes), "communities": len({x % 3 for x in nodes})}


def test_graph_queries_have_all_nodes(spark, tiny):
    nodes = QUERIES["graph_totals"](spark, tiny).head()["nodes"]
    for name in ("betweenness", "communities"):
        assert QUERIES[name](spark, tiny).count() == nodes, name


def test_paths_use_no_edge_twice(spark):
    df = spark.createDataFrame([(1, "a", "X", "b"), (2, "b", "Y", "c"), (3, "a", "Z", "b")], "eid long, src string, rel string, dst string")
    got = {(r["target"], tuple(r["rels"])) for r in graph.paths(df, spark.createDataFrame([("a",)], "node string"), hops=2).collect()}
    assert got == {("b", ("X",)), ("b", ("Z",)), ("c", ("X", "Y")), ("c", ("Z", "Y"))}


# --- model stages and jobs


def test_failed_batches_become_fallback_gaps(spark):
    o = spark.createDataFrame([("d1", "OBL-0000", "GDPR", "text a", "encryption", ""), ("d2", "OBL-0000", "GDPR", "text b", "encryption", ""), ("d2", "OBL-0001", "GDPR", "text c", "consent", "")], "document string, id string, regulation string, text string, type string, article string")
    p = spark.createDataFrame([("d1", "policy one"), ("d2", "bad policy")], "document string, context string")

    def say(prompts):
        if any("bad" in x for x in prompts):
            raise RuntimeError("no model")
        return ['[{"obligation_id":"OBL-0000","status":"missing","description":"x","severity":"high","theme":"nonsense"}]' for _ in prompts]

    # one prompt a batch, so that one document's failure is its own
    asked = lambda prompts: [y for x in prompts for y in say([x])]
    found, failed = model.gaps(o.repartition(2, "document"), p, asked)
    rows = [tuple(r) for r in found.select("document", "obligation_id", "ob_type", "theme").collect()]
    bad = {r["document"] for r in failed.collect()}
    assert bad >= {"d2"} and set(rows) <= {("d1", "OBL-0000", "encryption", "other")}
    assert {(r["document"], r["obligation_id"]) for r in audit.fallback_gaps(o, failed.where("document = 'd2'")).collect()} == {("d2", "OBL-0000")}


def test_upsert_keeps_old_values_where_new_are_null(spark):
    base = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2")], "k string, v string, w string")
    change = spark.createDataFrame([("a", "y", None, 2), ("a", "z", None, 1), ("", "q", "q", 1), ("c", "n", None, 1)], "k string, v string, w string, seq int")
    got = {r["k"]: (r["v"], r["w"]) for r in relational.upsert(base, change, ["k"], ["seq"]).collect()}
    assert got == {"a": ("z", "1"), "b": ("x", "2"), "c": ("n", None)}


def test_jurisdictions_from_a_model(spark):
    q = spark.createDataFrame([(1, "erasure under gdpr"), (2, "x")], "query long, question string")
    got = {r["query"]: r["jurisdictions"] for r in model.jurisdictions(q, lambda p: ['["all"]' if x == "x" else "no list" for x in p]).collect()}
    assert got == {1: ["GDPR"], 2: ["GDPR", "CCPA", "HIPAA", "NIST"]}
    assert {r["query"]: r["jurisdictions"] for r in model.jurisdictions(q).collect()} == {1: ["GDPR"], 2: ["UNKNOWN"]}


def test_containing_is_a_search_for_substrings(spark):
    from clausewright.operators import relational

    texts = ["", "a", "ab", "abc", "xabcx", "a.b", "aaaa", "über uns", None]
    parts = ["", "a", "b", "ab", "abc", "bcx", "aa", ".", "ber", "zz", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    p = spark.createDataFrame([(x,) for x in parts], "p string")
    got = sorted(tuple(r) for r in relational.containing(t, "t", p, "p").collect())
    assert got == sorted((x, y) for x in texts if x for y in parts if y and y in x)


def test_bm25_counts_documents_without_any_term(spark):
    import math

    from clausewright.operators import search

    docs = spark.createDataFrame([(1, "red fox red"), (2, ""), (3, None), (4, "blue sky")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "Red red?")], "item_id int, text string")
    (row,) = search.bm25(docs, asked, "doc_id", "item_id").collect()
    mean, idf = 5 / 4, math.log(1 + 3.5 / 1.5)
    assert (row["query"], row["doc"]) == (7, 1) and abs(row["score"] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean))) < 1e-9
