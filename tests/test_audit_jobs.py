"""The audit as one job, the feed of runs, and operators that no query calls."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import audit, chunking, graph, relational, search
from clausewright.plans import jobs
from clausewright.sources import files
from clausewright.streaming import ingest

RUN = "run_id string, policy_name string, start_time timestamp, compliance_score double"


def test_audit_with_remediation_and_conflicts(spark):
    rows = [(d, i, f"Article {i}", "requires", "breach notification to the authority", r) for d, r in (("a.pdf", "GDPR"), ("b.pdf", "HIPAA"), ("c.pdf", "GDPR")) for i in range(3)]
    triples = spark.createDataFrame(rows, "document string, pos int, source string, relation string, target string, regulation string")
    policies = spark.createDataFrame([("a.pdf", "we notify"), ("b.pdf", "broken"), ("c.pdf", "all is well")], "document string, context string")

    def gaps(prompts):
        if any("broken" in p for p in prompts):
            raise RuntimeError("no answer")
        return ["[]" if "well" in p else '[{"obligation_id":"OBL-0001","status":"missing","description":"late","severity":"critical","theme":"breach_notification"}]' for p in prompts]

    fixes = lambda prompts: ['[{"theme":"breach_notification","recommendation":"name a contact"}]' for _ in prompts]
    edges = spark.createDataFrame([("GDPR rule", "STRICTER_THAN", "HIPAA rule", "72 hours"), ("CCPA rule", "CONFLICTS_WITH", "GDPR rule", "sale"), ("x", "CONFLICTS_WITH", "y", "none named")], "src string, rel string, dst string, description string")
    out = jobs.audit_documents(triples.repartition(3, "document"), policies.repartition(3), gaps, ("GDPR", "HIPAA"), fixes, edges)
    assert {r["document"] for r in out["failed"].collect()} >= {"b.pdf"}
    found = {(r["document"], r["severity"]) for r in out["gaps"].collect()}
    assert ("a.pdf", "critical") in found or ("a.pdf", "high") in found
    assert {r["document"] for r in out["with_findings"].collect()} == {d for d, _ in found}
    # the edge that names a regulation outside the audit goes, and so does one that names none
    assert sorted((r["document"], r["src"], r["dst"]) for r in out["conflicts"].collect()) == [(d, "GDPR rule", "HIPAA rule") for d in ("a.pdf", "b.pdf", "c.pdf")]
    results = {r["document"]: r for r in out["results"].collect()}
    assert [c["description"] for c in results["c.pdf"]["conflicts"]] == ["72 hours"]
    assert len(results["a.pdf"]["gaps"]) == sum(d == "a.pdf" for d, _ in [(r["document"], 0) for r in out["gaps"].collect()])
    groups = {(r["document"], r["theme"]): r["recommendation"] for r in out["groups"].collect()}
    reports = {r["document"]: r["report"] for r in out["reports"].collect()}
    for (d, _), fix in groups.items():
        assert ("- [ ] " in reports[d]) == any(f for (x, _), f in groups.items() if x == d), fix
    assert "conflicts" not in jobs.audit_documents(triples, policies, gaps)


def test_feed_of_runs_equals_the_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    runs = [(f"r{i:03}", f"p{i % 3}", at + timedelta(hours=i), float(i % 101)) for i in range(60)]
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    # late, shuffled and repeated: the newest come first, and each delivery repeats a part of the one before
    for part in (runs[40:], runs[30:50], runs[:35] + runs[:5], runs[55:]):
        spark.createDataFrame(part[::-1], RUN).write.mode("append").parquet(source)
        ingest.run_feed(spark, source, RUN, sink, checkpoint)
    table = spark.read.schema(RUN).parquet(sink).drop("batch")
    assert table.count() == 60
    for policy in ("p0", None):
        got, want = (audit.trends(t, most=10, policy=policy).collect() for t in (table, spark.createDataFrame(runs, RUN)))
        assert got == want and len(got) == 10
    ingest.run_feed(spark, source, RUN, sink, checkpoint)
    assert spark.read.schema(RUN).parquet(sink).count() == 60


@pytest.mark.parametrize("name", ["HIPAA", "HIPPA", "hippa"])
def test_a_misspelt_regulation_is_split_by_its_articles(spark, name):
    parts = [f"## **§ 164.{i} Rule {i}**\n{'words of the rule ' * 6}\n" for i in range(4)]
    text = "contents\n## **§ 1.1 In the contents**\n" + "x " * 60 + "\n## **Subpart A General**\n" + "y " * 60 + "\n" + "".join(parts)
    got = chunking.split_articles(spark.createDataFrame([("d", name, text)], "doc string, regulation string, text string")).collect()
    assert len(got) == 5 and not any("In the contents" in r["chunk_text"] for r in got)
    assert {r["regulation"] for r in got} == {name}


def test_discovery_of_one_level_in_partitions(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for p in ("a.pdf", "b.pdf", "deep/c.pdf"):
        (tmp_path / p).write_bytes(b"x")
    assert {r["file_name"] for r in files.discover(spark, str(tmp_path), recursive=False).collect()} == {"a.pdf", "b.pdf"}
    deep = files.discover(spark, str(tmp_path), partitions=3)
    assert deep.count() == 3 and deep.rdd.getNumPartitions() == 3


def test_small_functions(spark):
    rows = spark.createDataFrame([("a'b.pdf", "policy", "GDPR"), ("a'b.pdf", "regulation", "GDPR"), ("c.pdf", "policy", "CCPA"), (None, "policy", "CCPA")], "paper_id string, doc_type string, regulation string")
    assert rows.where(T.scope("a'b.pdf")).count() == 1 and rows.where(T.scope()).count() == 3
    assert rows.where(T.scope(doc_class=None, regulation="GDPR")).count() == 2
    done, wanted = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2)], [("b", 0), ("b", 0), ("z", 0)]))
    assert [tuple(r) for r in relational.reusable(wanted, done, ["k"]).collect()] == [("b", 2)]
    label = spark.createDataFrame([("data_retention_policy_of_the_whole_company.pdf",)], "d string").select(T.display_label(F.col("d"))).head()[0]
    assert label == "data retention policy of the whole company"[:30]
    texts = spark.createDataFrame([(1, "the gdpr and hipaa"), (2, "nothing")], "i int, t string")
    named = search.jurisdiction_table(texts, "i", "t", {"GDPR": ("gdpr",), "HIPAA": ("hipaa",)})
    assert {(r["id"], r["jurisdiction"]) for r in named.collect()} >= {(1, "GDPR"), (1, "HIPAA")}


def test_analytics_bundle(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]
    e = spark.createDataFrame([(f"n{a}", "REQUIRES", f"n{b}") for a, b in pairs], "src string, rel string, dst string")
    out = graph.analytics(e, top=2)
    assert {r["node"] for r in out["betweenness"].collect()} == {"n2", "n3"} == {r["node"] for r in out["degree"].collect()}
    assert out["pagerank"].count() == 2
    # the number of communities is that of the table; the moves are bounded, so it need not be the best one
    n = out["communities"].select("community").distinct().count()
    assert out["totals"].head().asDict() == {"edges": 7, "conflicts": 0, "nodes": 6, "communities": n}
