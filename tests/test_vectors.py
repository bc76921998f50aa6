"""Vectors in the index, their cache, documents that go, extraction by ranges of pages."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from clausewright.operators import model, search
from clausewright.plans import jobs
from clausewright.sources import files
from clausewright.streaming import ingest


def reader(content: bytes):
    return [(i + 1, p) for i, p in enumerate(content.decode().split("\f"))] if content else []


def counting(log):
    """An embedder that appends each text that it is given to a file."""

    @pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        with open(log, "a") as f:
            f.writelines(f"{x!r}\n" for x in t)
        return pd.Series([np.array([len(x), x.count("a"), 1], np.float32) for x in t])

    return run


def calls(log):
    return sorted(log.read_text().splitlines()) if log.exists() else []


def test_ingest_embeds_once_and_both_rankings_answer(spark, tmp_path):
    src, log = tmp_path / "policies", tmp_path / "calls"
    src.mkdir()
    for name, text in (("gdpr_a.pdf", "access to data must be logged"), ("gdpr_b.pdf", "banana banana"), ("ccpa_c.pdf", "access to data must be logged"), ("ccpa_d.pdf", "old text")):
        (src / name).write_bytes(text.encode())
    run = lambda: jobs.ingest(spark, str(src), f"{tmp_path}/index", f"{tmp_path}/ledger", reader, embed=counting(str(log)), embedder="count-3").head()
    run()
    assert calls(log) == ["'access to data must be logged'", "'banana banana'", "'old text'"]
    index = files.read_index(spark, f"{tmp_path}/index")
    assert {r["paper_id"]: r["content_vector"] for r in index.collect()}["ccpa_c.pdf"] == [29.0, 3.0, 1.0]
    # a document that changes to a known text, one that goes blank, one that is new
    time.sleep(1.1)
    (src / "gdpr_b.pdf").write_bytes(b"old text")
    (src / "ccpa_d.pdf").write_bytes(b" ")
    (src / "nist_e.pdf").write_bytes(b"new words here")
    run()
    assert calls(log)[-2:] == ["'new words here'", "'old text'"] and len(calls(log)) == 4
    index = files.read_index(spark, f"{tmp_path}/index")
    assert {(r["paper_id"], r["content"]) for r in index.collect()} == {("gdpr_a.pdf", "access to data must be logged"), ("ccpa_c.pdf", "access to data must be logged"), ("gdpr_b.pdf", "old text"), ("nist_e.pdf", "new words here")}
    run()
    assert len(calls(log)) == 4
    asked = spark.createDataFrame([(1, "access logged", [29.0, 3.0, 1.0])], "query long, content string, content_vector array<float>")
    assert search.nearest(index, asked, "chunk_id", "query", "content_vector", 5).count() == 4
    both = search.hybrid(index, asked, "chunk_id", "query", "content", "content_vector", where=F.col("regulation") == "CCPA").collect()
    assert [(r["doc"], round(r["score"], 9)) for r in both] == [("ccpa_c_0000", round(2 / 61, 9))]
    # a question without a word of any chunk still has a vector ranking to answer from
    graph = {
        "nodes": spark.createDataFrame([("Consent rule", "GDPR")], "id string, regulation string"),
        "edges": spark.createDataFrame([("Consent rule", "REQUIRES", "form", None)], "src string, rel string, dst string, regulation string"),
        "mentions": spark.createDataFrame([], "doc_id string, regulation string, node_id string"),
    }
    questions = spark.createDataFrame([(1, "zzz aaa zzz")], "query long, question string")
    said = lambda prompts: ['{"answer":"' + str(sum(t in p for t in ("old text", "new words", "access to data"))) + '","gaps":[],"recommendations":[]}' for p in prompts]
    got = jobs.retrieve(questions, index, graph, lambda p: ['["Consent"]'] * len(p), said, embed=counting(str(log))).head()
    assert got["answer"] == "3"
    got = jobs.retrieve(questions, index, graph, lambda p: ['["Consent"]'] * len(p), said, where=F.col("regulation") == "CCPA", embed=counting(str(log))).head()
    assert got["answer"] == "1"


def test_models_have_vectors_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "")], "id long, chunk_text string")
    one = {r["id"]: r["content_vector"] for r in model.embedded(rows, model.hash_embedding, f"{tmp_path}/v").collect()}
    two = {r["id"]: r["content_vector"] for r in model.embedded(rows, lambda c: F.array(F.length(c)), f"{tmp_path}/v", "length").collect()}
    assert one[1] == one[3] and sum(map(abs, one[1])) == 2 and sum(map(abs, one[2])) == 0 and two == {1: [3.0], 2: [0.0], 3: [3.0], 4: [0.0]}
    # a cache that holds a text twice, as after a run that was tried again
    again = spark.read.parquet(f"{tmp_path}/v")
    again.write.mode("append").partitionBy("model").parquet(f"{tmp_path}/v")
    assert model.embedded(rows, model.hash_embedding, f"{tmp_path}/v").count() == 4


def test_semantic_chunks_from_the_job(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "gdpr.pdf").write_bytes(b"Cats purr. Cats sleep. Stocks fell. Stocks rose.")
    jobs.ingest(spark, f"{tmp_path}/src", f"{tmp_path}/index", f"{tmp_path}/ledger", reader, strategy="semantic", percentile=0.5).head()
    got = spark.read.parquet(f"{tmp_path}/index")
    assert got.count() > 1 and {r["chunk_strategy"] for r in got.collect()} == {"semantic"}


def test_streams_replace_and_embed(spark, tmp_path):
    put = lambda i, text: spark.createDataFrame([("gdpr.pdf", "GDPR", "policy", text)], "file_name string, regulation string, doc_type string, text string").write.parquet(f"{tmp_path}/src/{i}")
    go = lambda: ingest.ingest_texts(spark, f"{tmp_path}/src/*", f"{tmp_path}/index", f"{tmp_path}/check", embed=model.hash_embedding)
    put(1, "some words")
    go()
    assert [r["content_vector"] is not None for r in files.read_index(spark, f"{tmp_path}/index").collect()] == [True]
    put(2, " ")
    go()
    assert files.read_index(spark, f"{tmp_path}/index").count() == 0


# --- ranges of pages


def split(content: bytes, size: int):
    if content.startswith(b"%broken"):
        raise ValueError("no pages")
    pages = content.split(b"\f") if content else []
    return [(i + 1, b"\f".join(pages[i : i + size])) for i in range(0, len(pages), size)]


def text_of(part: bytes):
    from pyspark import TaskContext

    if b"BAD" in part:
        raise ValueError("bad range")
    return [f"{TaskContext.get().partitionId()}|{p.decode()}" for p in part.split(b"\f")]


READERS = {"text": text_of, "ocr": lambda part: [f"seen {p.decode()}" for p in part.split(b"\f")]}


def test_ranges_spread_and_fail_alone(spark):
    page = "x" * 100
    rows = [
        ("long.pdf", "\f".join(f"{page} {i + 1}" for i in range(2000)).encode()),
        ("holed.pdf", "\f".join(f"{page} {i + 1}" + (" BAD" if i == 45 else "") for i in range(70)).encode()),
        ("scan.pdf", b"\f".join([b""] * 25)),
        ("bad_scan.pdf", b"BAD"),
        ("broken.pdf", b"%broken"),
        ("empty.pdf", b""),
    ]
    got = files.extract_ranges(spark.createDataFrame(rows, "file_name string, content binary").repartition(1), split, READERS).collect()
    of = lambda name, status="ok": sorted((r["page"], r["text"], r["extractor"], r["error"]) for r in got if r["file_name"] == name and r["status"] == status)
    long = of("long.pdf")
    assert [p for p, *_ in long] == list(range(1, 2001)) and all(t.endswith(f" {p}") for p, t, *_ in long) and {k for *_, k, _ in long} == {"text"}
    assert len({t.split("|")[0] for _, t, *_ in long}) > 1
    assert [p for p, *_ in of("holed.pdf")] == [*range(1, 41), *range(61, 71)] and of("holed.pdf", "error") == [(41, "", "text", "ValueError: bad range")]
    assert {k for *_, k, _ in of("scan.pdf")} == {"ocr"} and len(of("scan.pdf")) == 25 and of("bad_scan.pdf") == [(1, "seen BAD", "ocr", "")]
    assert of("broken.pdf", "error") == [(-1, "", "", "ValueError: no pages")] and not [r for r in got if r["file_name"] == "empty.pdf"]


def test_ingest_by_ranges_keeps_the_good_pages(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "gdpr.pdf").write_bytes("\f".join("word " * 60 + (" BAD" if i == 25 else f"page{i}") for i in range(50)).encode())
    read = lambda table: files.extract_ranges(table, split, READERS)
    run = lambda: jobs.ingest(spark, f"{tmp_path}/src", f"{tmp_path}/index", f"{tmp_path}/ledger", read, by_range=True).head()
    first = run()
    text = " ".join(r["content"] for r in spark.read.parquet(f"{tmp_path}/index").collect())
    assert first["errors"] == 1 and "page19" in text and "page45" in text and "page30" not in text
    run()
    assert spark.read.parquet(f"{tmp_path}/index_quarantine").count() == 1
    time.sleep(1.1)
    (tmp_path / "src" / "gdpr.pdf").write_bytes("\f".join("word " * 60 + f"page{i}" for i in range(50)).encode())
    assert run()["errors"] == 0 and "page30" in " ".join(r["content"] for r in spark.read.parquet(f"{tmp_path}/index").collect())
