"""Files, streams and end-to-end jobs in temporary folders."""

import time

import pytest
from pyspark.sql import functions as F

from clausewright.plans import jobs
from clausewright.sources import files
from clausewright.streaming import ingest


def reader(content: bytes):
    if content.startswith(b"bad"):
        raise ValueError("not a document")
    return [(i + 1, p) for i, p in enumerate(content.decode().split("\f"))]


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "policies"
    (src / "deep").mkdir(parents=True)
    (src / "gdpr_one.pdf").write_bytes(b"first page words\fsecond page words")
    (src / "deep" / "nist_two.pdf").write_bytes(b"only page")
    (src / "broken.pdf").write_bytes(b"bad bytes")
    (src / "note.txt").write_bytes(b"no")
    return tmp_path


def test_discovery(spark, folder):
    got = {r["file_name"]: r["regulation"] for r in files.discover(spark, f"{folder}/policies").collect()}
    assert got == {"gdpr_one.pdf": "GDPR", "nist_two.pdf": "NIST", "broken.pdf": "UNKNOWN"}
    assert files.discover(spark, f"{folder}/policies", recursive=False).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.discover(spark, f"{folder}/nowhere").count()


def test_ingest_twice(spark, folder):
    run = lambda: jobs.ingest(spark, f"{folder}/policies", f"{folder}/index", f"{folder}/ledger", reader).head().asDict()
    first = run()
    assert (first["files"], first["processed"], first["errors"], first["status"]) == (3, 2, 1, "partial")
    assert spark.read.parquet(f"{folder}/index").count() == 2
    run()
    assert spark.read.parquet(f"{folder}/index").count() == 2
    assert spark.read.parquet(f"{folder}/index_quarantine").select("file_name").distinct().count() == 1
    index = spark.read.parquet(f"{folder}/index")
    assert {r["doc_type"] for r in index.collect()} == {"policy"} and "gdpr_one_0000" in {r["chunk_id"] for r in index.collect()}


def test_documents_of_one_name_stay_apart(spark, tmp_path):
    for d in "ab":
        (tmp_path / "src" / d).mkdir(parents=True)
        (tmp_path / "src" / d / "gdpr.pdf").write_bytes(f"page one of {d}\fpage two of {d}".encode())
    (tmp_path / "src" / "gdpr.pdf").write_bytes(" ".join(f"w{i}" for i in range(600)).encode())
    run = lambda: jobs.ingest(spark, f"{tmp_path}/src", f"{tmp_path}/index", f"{tmp_path}/ledger", reader, log=f"{tmp_path}/log").head()
    got = run()
    index = {r["chunk_id"]: r["content"] for r in spark.read.parquet(f"{tmp_path}/index").collect()}
    assert (got["files"], got["processed"], got["chunks"]) == (3, 3, 4) and set(index) == {"a/gdpr_0000", "b/gdpr_0000", "gdpr_0000", "gdpr_0001"}
    assert index["a/gdpr_0000"] == "page one of a page two of a"
    # a changed file replaces its chunks, also where it has fewer of them
    time.sleep(1.1)
    (tmp_path / "src" / "gdpr.pdf").write_bytes(b"short now")
    run()
    index = {r["chunk_id"]: r["content"] for r in spark.read.parquet(f"{tmp_path}/index").collect()}
    assert set(index) == {"a/gdpr_0000", "b/gdpr_0000", "gdpr_0000"} and index["gdpr_0000"] == "short now"
    assert spark.read.parquet(f"{tmp_path}/log/ingestion_runs").count() == 2


def test_rejected_files_are_kept(spark, folder):
    jobs.ingest(spark, f"{folder}/policies", f"{folder}/index", f"{folder}/ledger", reader, pattern="*.{pdf,txt}", explicit_type="policy").head()
    assert spark.read.parquet(f"{folder}/index_rejected").count() == 4


def test_stream_of_files(spark, folder):
    go = lambda: ingest.ingest_files(spark, f"{folder}/policies", f"{folder}/s_index", f"{folder}/s_check", reader)
    go()
    go()
    assert spark.read.parquet(f"{folder}/s_index").count() == 2 and spark.read.parquet(f"{folder}/s_index_quarantine").count() == 1
    (folder / "policies" / "late.pdf").write_bytes(b"late page")
    go()
    assert spark.read.parquet(f"{folder}/s_index").count() == 3


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("cached content", {"paper_id": "a.pdf", "page": "1"})], "text string, metadata map<string,string>")
    files.write_jsonl(df, f"{tmp_path}/x")
    files.write_jsonl(df, f"{tmp_path}/x", append=True)
    assert [r["metadata"]["paper_id"] for r in files.read_jsonl(spark, f"{tmp_path}/x").collect()] == ["a.pdf"] * 2


def test_scanned(spark):
    df = spark.createDataFrame([("a", 1, "   "), ("a", 4, "x" * 500), ("b", 1, "y" * 300)], "paper_id string, page int, text string")
    assert {r["paper_id"]: r["is_scanned"] for r in files.scanned(df).collect()} == {"a": True, "b": False}


def test_build_or_load(spark, tmp_path):
    rows = lambda n: files.chunk_rows(spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".pdf")).alias("file_name"), F.lit("GDPR").alias("regulation"), F.lit("policy").alias("doc_type"), F.lit(0).alias("chunk_index"), F.lit("text").alias("chunk_text"), F.lit(1).alias("page")), "token")
    at = f"{tmp_path}/index"
    assert files.build_or_load(rows(2), at).count() == 2 and files.build_or_load(rows(5), at).count() == 2 and files.build_or_load(rows(5), at, force=True).count() == 5


def test_run_log(spark, tmp_path):
    at = str(tmp_path)
    assert files.run_history(spark, at).count() == 0
    run = spark.sql("SELECT 'r1' AS run_id, timestamp'2024-01-01' AS start_time, 'p' AS policy_name")
    files.log_run(run, spark.sql("SELECT 'r1' AS run_id, 'risk' AS metric, 1.0D AS value"), at)
    assert files.run_history(spark, at).count() == 1


ARTICLES = "\n" + "".join(f"Article {i} Duties of parties\nThe controller must report a breach within {i} days to the authority.\n" for i in range(1, 5))


def test_graph_build(spark):
    docs = spark.createDataFrame([("GDPR", ARTICLES)], "regulation string, text string")
    said = lambda prompts: ['[{"source":"GDPR","target":"HIPAA","relationship":"STRICTER_THAN","description":"d","value_a":"72 hours","value_b":"60 days"},{"source":" ","target":"x"}]' for _ in prompts]
    t = jobs.build_graph(docs, {"controller": "Entity", "breach": "Concept"}, said)
    assert t["edges"].where("rel = 'REFERENCES'").count() == 8 and t["edges"].where("rel = 'STRICTER_THAN'").select("value_a").head()[0] == "72 hours"
    assert t["nodes"].count() == 6


def test_audit_and_answers(spark):
    triples = spark.createDataFrame([("a.pdf", i, f"Article {i}", "requires", "breach notification to the authority", "GDPR") for i in range(3)], "document string, pos int, source string, relation string, target string, regulation string")
    policies = spark.createDataFrame([("a.pdf", "we notify")], "document string, context string")
    gaps = lambda prompts: ['[{"obligation_id":"OBL-0001","status":"missing","description":"late","severity":"critical","theme":"breach_notification"}]' for _ in prompts]
    out = jobs.audit_documents(triples, policies, gaps)
    assert out["documents"].head()["compliance"] == 66.7 and out["groups"].head()["theme"] == "breach_notification"
    assert "### a.pdf — 66.7/100 MODERATE" in out["reports"].head()["report"]
    from clausewright.operators import model

    chunks = spark.createDataFrame([(f"c{i}", f"chunk about consent number {i}") for i in range(4)], "chunk_id string, content string").withColumn("content_vector", model.hash_embedding(F.col("content")))
    graph_tables = jobs.build_graph(spark.createDataFrame([("GDPR", ARTICLES)], "regulation string, text string"), {"consent": "Concept", "controller": "Entity"})
    q = spark.createDataFrame([(1, "what about consent in gdpr")], "query long, question string")
    got = jobs.retrieve(q, chunks, graph_tables, lambda p: ['["Article 1"]' for _ in p], lambda p: ['{"answer":"yes","gaps":[],"recommendations":["r"]}' for _ in p], k=3).head()
    assert got["answer"] == "yes" and "GDPR" in got["jurisdictions"]
    assert dict(graph_tables["edges"].dtypes)["regulation"] == "string"
    two = spark.createDataFrame([(1, "what of consent"), (2, "what of breaches")], "query long, question string")
    more = {
        "nodes": spark.createDataFrame([("Consent rule", "GDPR"), ("Breach rule", "HIPAA")], "id string, regulation string"),
        "edges": spark.createDataFrame([("Consent rule", "REQUIRES", "form", None), ("Breach rule", "REQUIRES", "notice", None)], "src string, rel string, dst string, regulation string"),
        "mentions": spark.createDataFrame([], "doc_id string, regulation string, node_id string"),
    }
    names = lambda prompts: ['["Consent"]' if "number 0" in p else '["Breach"]' for p in prompts]
    apart = spark.createDataFrame([("c1", "consent number 0"), ("c2", "breaches only")], "chunk_id string, content string").withColumn("content_vector", model.hash_embedding(F.col("content")))
    seen = lambda prompts: ['{"answer":"' + ("form" if "form" in p else "") + ("notice" if "notice" in p else "") + '","gaps":[],"recommendations":[]}' for p in prompts]
    got = {r["query"]: r for r in jobs.retrieve(two, apart, more, names, seen, k=1).collect()}
    assert got[1]["answer"] == "form" and got[2]["answer"] == "notice"
    assert "HIPAA" not in got[1]["jurisdictions"] and "GDPR" not in got[2]["jurisdictions"]


def test_conflict_model_keeps_the_regulation(spark):
    docs = spark.createDataFrame([("GDPR", ARTICLES)], "regulation string, text string")
    said = lambda prompts: ["[]" for _ in prompts]
    t = jobs.build_graph(docs, {"breach": "Concept"}, said)
    terms = spark.createDataFrame([(0, "1")], "batch int, term string")
    from clausewright.operators import graph

    assert {r["regulation"] for r in t["edges"].collect()} == {"GDPR"} and graph.triples_around(t["nodes"], t["edges"], t["mentions"], terms).count() == 1


@pytest.mark.parametrize("strategy", ["token", "size", "section", "article", "semantic"])
def test_every_strategy_makes_chunk_rows(spark, strategy):
    from clausewright.operators import chunking, model

    text = "Opening words.\n" + "".join(f"\nArticle {i} On things\n" + "Some words on it. " * 10 + "###" for i in range(1, 5))
    docs = spark.createDataFrame([(f"{x}.pdf", "GDPR", "regulation", 1, text) for x in "ab"], "file_name string, regulation string, doc_type string, page int, text string")
    options = {"id_col": "file_name", "embed": lambda c: model.hash_embedding(c, 8)} if strategy == "semantic" else {}
    rows = files.chunk_rows(chunking.chunk(docs, strategy, **options), strategy)
    ids = [r["chunk_id"] for r in rows.collect()]
    assert ids and len(set(ids)) == len(ids) and {r["paper_id"] for r in rows.collect()} == {"a.pdf", "b.pdf"}
    with pytest.raises(ValueError, match="unknown strategy"):
        chunking.chunk(docs, "no such")


def test_delivery_counts_failed_batches(spark, tmp_path):
    out = tmp_path / "sent"
    out.mkdir()

    def send(batch: list[dict]) -> None:
        if any(r["chunk_id"] == "bad" for r in batch):
            raise OSError("refused")
        (out / batch[0]["chunk_id"]).write_text(str(len(batch)))

    rows = [(f"c{i}", "words", "ok") for i in range(5)] + [("bad", "words", "ok"), ("blank", " ", "ok"), ("off", "words", "error")]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_text string, status string").coalesce(1)
    assert files.deliver(chunks, send, 2).head().asDict() == {"batches": 3, "uploaded": 4, "errors": 2}
    assert sorted(p.name for p in out.iterdir()) == ["c0", "c2"]
    assert files.deliver(chunks.limit(0), send).head().asDict() == {"batches": 0, "uploaded": 0, "errors": 0}


def test_index_is_read_under_its_schema(spark, folder):
    assert files.index_count(spark, f"{folder}/index") == 0
    jobs.ingest(spark, f"{folder}/policies", f"{folder}/index", f"{folder}/ledger", reader, embed=None)
    index = files.read_index(spark, f"{folder}/index")
    assert files.index_count(spark, f"{folder}/index") == 2 and index.where("content_vector is null").count() == 2
    new = index.limit(1).drop("content_vector").withColumn("score", F.lit(1.0))
    both = files.with_new(index, new)
    assert both.count() == 3 and both.where("score is null").count() == 2
