"""Ingestion, graph build, retrieval and audit as jobs over DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import audit, chunking, graph, model, relational, search
from ..operators.iterate import cut
from ..sources import files


def ingest(
    spark: SparkSession,
    source: str,
    index: str,
    done: str,
    extractor: Callable[[bytes], list[tuple[int, str]]] | Callable[[DataFrame], DataFrame],
    strategy: str = "token",
    explicit_type: str | None = None,
    pattern: str = "*.pdf",
    log: str | None = None,
    embed: Callable[[Column], Column] | None = model.hash_embedding,
    embedder: str = "hash-64",
    by_range: bool = False,
    **options,
) -> DataFrame:
    """Files that the ledger does not know, through extraction, chunking and embedding, to the index; returns the run's summary row.

    Pages are joined before they are chunked, so chunks are numbered per document; a document is
    named by its path below ``source``. Documents that are ingested again replace their chunks, and
    one that has no text any more leaves none (a file of no bytes at all is not listed by Spark's
    reader, so it is not seen as changed). ``extractor`` reads the bytes of a file, or with
    ``by_range`` it is a function of the table of files, such as ``files.extract_ranges`` with its
    readers; then a bad range costs its pages, and its file stays open for the next run.
    Vectors come from ``embed`` by way of the table ``index``_vectors, in which ``embedder`` names the
    model. What was rejected is in ``index``_rejected, what could not be read by the last run in
    ``index``_quarantine, and the run's summary in ``log`` where that is given. ``options`` go to the
    chunker.
    """
    began = time.monotonic()
    named = lambda df: df.withColumn("file_name", files.document_name(F.col("file_path"), source))
    found, rejected = (named(x) for x in files.accepted(files.discover(spark, source, pattern), suffix=pattern.lstrip("*")))
    rejected.write.mode("overwrite").parquet(f"{index}_rejected")
    todo = relational.pending(found, files.ledger(spark, done), ["file_path", "modified"])
    # the scan leaves out the content of files older than the oldest that is new
    oldest = todo.agg(F.min("modified")).head()[0]
    content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(source)
    content = content.where(F.col("modificationTime") >= F.lit(oldest)).select(F.col("path").alias("file_path"), "content")
    given = todo.join(content, "file_path").select("file_name", "content")
    pages = (extractor(given) if by_range else files.extract(given, extractor)).persist()
    texts = files.joined_pages(pages).withColumns({"regulation": T.detect_regulation(T.base_name(F.col("file_name"))), "doc_type": T.doc_type(F.lit(source), explicit_type)})
    if strategy == "semantic":
        options = {"id_col": "file_name", "embed": embed or model.hash_embedding} | options
    chunks = files.chunk_rows(chunking.chunk(texts, strategy, **options), strategy)
    rows = model.embedded(chunks, embed, f"{index}_vectors", embedder) if embed else chunks
    bad = pages.where("status <> 'ok'")
    read = todo.select("file_name").join(bad.where("page = -1").select("file_name"), "file_name", "left_anti")
    files.upsert(rows, index, read.withColumnRenamed("file_name", "paper_id"))
    bad.write.mode("overwrite").parquet(f"{index}_quarantine")  # these files are not committed, so each run meets them all again
    files.commit(todo.join(bad.select("file_name"), "file_name", "left_anti"), done)
    state = chunks.select(F.col("paper_id").alias("file_name"), "status").unionByName(bad.select("file_name", "status"))
    summary = cut(relational.ingest_summary(found, state))
    pages.unpersist()
    if log:
        files.log_ingestion(summary, log, time.monotonic() - began)
    return summary


def build_graph(docs: DataFrame, concepts: dict[str, str], conflict_model: model.Model | None = None) -> dict[str, DataFrame]:
    """Documents (regulation, text) to nodes, edges and mentions."""
    articles = chunking.split_articles(docs)
    found = graph.restricted(model.dictionary_triples(articles, concepts))
    tables = graph.tables_from(found)
    if conflict_model is not None:
        texts = relational.bounded_text(articles, ["regulation"], ["article_id"], "chunk_text")
        extra = model.value_conflicts(texts, conflict_model).withColumn("regulation", F.col("src"))
        wide = tables["edges"].select("src", "rel", "dst", "regulation", *(F.lit(None).cast("string").alias(c) for c in ("concept", "value_a", "value_b", "unit", "description", "source_quote")))
        tables["edges"] = relational.upsert(wide, extra, ["src", "rel", "dst"], ["concept", "description"]).withColumn("eid", F.xxhash64("src", "rel", "dst"))
    return tables


def retrieve(questions: DataFrame, chunks: DataFrame, tables: dict[str, DataFrame], entity_model: model.Model, answer_model: model.Model, k: int = 10, where: Column | None = None, embed: Callable[[Column], Column] = model.hash_embedding) -> DataFrame:
    """(query, answer, gaps, recommendations, jurisdictions) for each question: hybrid search under a filter, entities, graph facts, answer. ``embed`` is what embedded the chunks."""
    asked = questions.withColumn("content_vector", embed(F.col("question"))).select(F.col("query").alias("qid"), F.col("question").alias("content"), "content_vector")
    best = search.hybrid(chunks, asked, "chunk_id", "qid", "content", "content_vector", k, where=where)
    text = best.join(chunks.select(F.col("chunk_id").alias("doc"), F.col("content").alias("text")), "doc").select("query", "rank", "text")
    names = model.entities(text, entity_model)
    terms = names.select("query", F.posexplode("entities").alias("pos", "term")).select("query", F.floor(F.col("pos") / 5).cast("int").alias("batch"), "term")
    facts = graph.triples_around(tables["nodes"], tables["edges"], tables["mentions"], terms, by=["query"])
    evidence = facts.groupBy("query").agg(F.array_join(F.array_sort(F.collect_list(T.triple_text(F.col("source"), F.col("relation"), F.col("target"), F.col("regulation")))), "\n").alias("facts"), F.collect_set("regulation").alias("known"))
    contexts = relational.joined_text(text, ["query"], ["rank"], "text", "\n\n---\n\n").join(evidence, "query", "left").select("query", F.concat_ws("\n\n", "context", "facts").alias("context"), F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    said = model.answers(questions, contexts.select("query", "context"), answer_model)
    return said.join(questions.join(contexts.select("query", "known"), "query", "left").select("query", T.detect_jurisdictions(F.col("question"), None, F.col("known")).alias("jurisdictions")), "query")


def audit_documents(triples: DataFrame, policies: DataFrame, gap_model: model.Model, jurisdictions: Sequence[str] = tuple(vocab.REGULATION_WEIGHTS), remediation_model: model.Model | None = None, conflicts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Triples (document, pos, source, relation, target, regulation) and policy texts (document, context) to every table of an audit.

    ``remediation_model`` gives each theme group its recommendation, which reports list as a
    checklist. ``conflicts`` are edges (src, rel, dst, description) of the graph: those whose ends
    name audited regulations only are kept, and a document has those that name one of its own.
    What the models said is cut, so that a model is asked once however many tables are read.
    """
    obligations = cut(audit.obligations_from(triples, F.array(*map(F.lit, jurisdictions))))
    found, failed = (cut(x) for x in model.gaps(obligations, policies, gap_model))
    fallback = audit.fallback_gaps(obligations, failed)
    gaps = found.select("document", "obligation_id", "regulation", "status", "description", "severity", "theme", "ob_type").unionByName(fallback)
    risks = audit.regulation_risk(obligations, gaps)
    documents = audit.document_risk(risks)
    groups = audit.gap_groups(gaps)
    if remediation_model is not None:
        groups = audit.with_remediation(groups, cut(model.remediations(groups, remediation_model)))
    own = None
    if conflicts is not None:
        own = audit.document_conflicts(audit.scoped_conflicts(conflicts, jurisdictions), obligations)
    reports, results = audit.reports(risks, documents, groups, jurisdictions), audit.results(groups, audit.obligation_counts(obligations), risks, gaps, own)
    out = {"obligations": obligations, "gaps": gaps, "risks": risks, "documents": documents, "groups": groups, "overall": audit.audit_scores(risks, documents), "with_findings": audit.with_findings(documents, gaps), "failed": failed, "reports": reports, "results": results}
    return out if own is None else out | {"conflicts": own}
