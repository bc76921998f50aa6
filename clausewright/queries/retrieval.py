"""Facets, keyword and vector search, fusion, and targets of questions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import postings, relational, search, vector_index
from ..operators.iterate import cut, shared_folder, written
from . import query, views


@query(f"WITH {views.CORPUS} SELECT paper_id, count(*) AS n FROM corpus WHERE doc_type = 'policy' GROUP BY paper_id ORDER BY n DESC, paper_id LIMIT 1000")
def facet_documents(spark, d):
    return search.facet(views.corpus(spark, d), "paper_id", F.col("doc_type") == "policy", 1000)


@query(f"WITH {views.CORPUS} SELECT regulation, count(*) AS n FROM corpus WHERE doc_type = 'regulation' GROUP BY regulation ORDER BY n DESC, regulation LIMIT 100")
def facet_regulations(spark, d):
    return search.facet(views.corpus(spark, d), "regulation", F.col("doc_type") == "regulation", 100)


@query(f"WITH {views.CORPUS} SELECT paper_id, regulation, substr(text, 1, 1200) AS content FROM corpus WHERE doc_type = 'policy' AND regulation = 'CCPA' ORDER BY paper_id LIMIT 50")
def browse_chunks(spark, d):
    c = views.corpus(spark, d).withColumn("content", F.substring("text", 1, 1200))
    return search.browse(c, ["paper_id", "regulation", "content"], (F.col("doc_type") == "policy") & (F.col("regulation") == "CCPA"), "paper_id")


_COSINE = "list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))"
_KNN = f"knn AS (SELECT query, doc, score, rank FROM (SELECT q.vec_id AS query, v.vec_id AS doc, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10)"


def _knn(spark, d, k=10):
    e = views.table(spark, d, "embeddings")
    return search.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "vec_id", "embedding", k)


@query(f"WITH {_KNN} SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM knn")
def knn(spark, d):
    """Queries are the vectors whose id is divisible by 20, against all vectors."""
    return _knn(spark, d).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query()
def knn_index(spark, d):
    """The same queries through the inverted-file index, which is built from the whole table; the lists to read are calibrated on every eighth of them."""
    e, at = views.table(spark, d, "embeddings"), f"{shared_folder(spark).rstrip('/')}/ivf-{uuid.uuid4().hex}"
    vector_index.build(e, at, "vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0")
    some = asked.where("vec_id % 160 = 0")
    nprobe, _ = vector_index.calibrate(some, cut(search.nearest(e, some, "vec_id", "vec_id", "embedding", 10)), at, "vec_id", "embedding")
    return vector_index.search(asked, at, "vec_id", "embedding", 10, nprobe).select("query", "doc", F.round("score", 6).alias("score"), "rank", "scanned")


_BM25 = """terms AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM terms),
want AS (SELECT item_id AS query, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS term FROM benchmark),
tf AS (SELECT term, doc, len, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM terms) WHERE term IN (SELECT term FROM want) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM want JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query, doc)"""


def _bm25(spark, d):
    return search.bm25(views.table(spark, d, "documents"), views.table(spark, d, "benchmark"), "doc_id", "item_id")


@query(f"WITH {_BM25} SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM bm) WHERE rank <= 10")
def bm25(spark, d):
    return search.ranked(_bm25(spark, d).withColumn("score", F.round("score", 9)), 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25}, {_KNN}, a AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM bm), u AS (SELECT query, doc, rank FROM a WHERE rank <= 10 UNION ALL SELECT query, doc, rank FROM knn), f AS (SELECT query, doc, sum(1 / (60 + rank)) AS score FROM u GROUP BY ALL) SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, doc) AS rank FROM f) WHERE rank <= 10")
def hybrid_rrf(spark, d):
    keyword = search.bm25_best(views.table(spark, d, "documents"), views.table(spark, d, "benchmark"), "doc_id", "item_id", 10)
    return search.fuse([keyword, _knn(spark, d)], 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM bm) WHERE rank <= 10")
def bm25_index(spark, d):
    """The same ranking from a stored index, to which the documents come in two segments, some of them twice, with another text at first."""
    docs, at = views.table(spark, d, "documents").select("doc_id", "text"), f"{shared_folder(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    early = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text")))
    postings.add(early, at, "doc_id")
    postings.add(docs.where("doc_id % 3 = 0 or doc_id % 5 = 1"), at, "doc_id")
    found = postings.search(views.table(spark, d, "benchmark"), at, "item_id")
    return found.select("query", "doc", F.round("score", 6).alias("score"), "rank")


_MIXED = """m AS (SELECT doc_id, lang, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
t AS (SELECT doc_id AS doc, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM m),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM t WHERE lang = 'en'),
want AS (SELECT doc AS query, unnest(list_distinct(t)) AS term FROM t WHERE doc % 20 = 0),
tf AS (SELECT term, doc, len, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM t WHERE lang = 'en') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM want JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query, doc),
vs AS (SELECT q.doc_id AS query, v.doc_id AS doc, round(list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 9) AS score FROM m v JOIN m q ON q.doc_id % 20 = 0 AND v.lang = 'en'),
u AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 50 UNION ALL SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM vs QUALIFY rank <= 50),
f AS (SELECT query, doc, round(sum(1 / (60 + rank)), 12) AS score FROM u GROUP BY ALL)"""


@query(f"WITH {_MIXED} SELECT query, doc, round(score, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc))::INT AS rank FROM f QUALIFY rank <= 10")
def hybrid_filtered(spark, d):
    """Keyword and vector search over the English documents that have a vector, asked by those whose id is divisible by 20."""
    rows = views.table(spark, d, "documents").select("doc_id", "lang", "text").join(views.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    rows = written(rows)
    out = search.hybrid(rows, rows.where("doc_id % 20 = 0"), "doc_id", "doc_id", "text", "embedding", where=F.col("lang") == "en")
    return out.select("query", "doc", F.round("score", 6).alias("score"), "rank")


def _questions(spark, d):
    c = views.table(spark, d, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.when(F.col("turn") == 0, F.concat(F.lit("does src"), (F.col("conv_id") % 25).cast("string"), F.lit(" say so"))).when(F.col("turn") == 2, F.lit("compare all of it")).otherwise(F.lit("what now")).alias("question"), F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit("src"), (F.col("conv_id") % 22).cast("string"), F.lit("_policy.pdf"))).alias("explicit"))


_QUESTIONS = "q AS (SELECT conv_id * 1000 + turn AS query, CASE WHEN turn = 0 THEN 'does src' || (conv_id % 25) || ' say so' WHEN turn = 2 THEN 'compare all of it' ELSE 'what now' END AS question, CASE WHEN conv_id % 3 = 1 THEN 'src' || (conv_id % 22) || '_policy.pdf' END AS explicit FROM conversations WHERE role = 'user'), r AS (SELECT DISTINCT source || '_policy.pdf' AS document, source AS s FROM documents)"


def _registry(spark, d):
    return views.table(spark, d, "documents").select(F.concat("source", F.lit("_policy.pdf")).alias("file_name")).distinct()


@query(f"WITH {_QUESTIONS} SELECT DISTINCT query, document FROM q, r WHERE contains(question, s)")
def doc_match(spark, d):
    return search.document_matches(_questions(spark, d), _registry(spark, d), "query", "question", "file_name")


@query(f"WITH {_QUESTIONS}, n AS (SELECT count(*) AS n FROM r), m AS (SELECT query, explicit, count(*) FILTER (contains(question, s)) AS nm, count(*) FILTER (explicit = document) AS ne, count(*) FILTER (contains(explicit, s)) AS nf, any_value(question) AS question FROM q, r GROUP BY ALL), x AS (SELECT *, CASE WHEN explicit IS NOT NULL AND ne > 0 THEN 'exact' WHEN explicit IS NOT NULL AND nf > 0 THEN 'fuzzy' WHEN explicit IS NOT NULL THEN 'unknown_document' WHEN nm > 0 THEN 'matched' WHEN contains(question, 'compare') THEN 'cross_document' WHEN n = 1 THEN 'single' ELSE 'ambiguous' END AS decision FROM m, n) SELECT query, decision, (CASE decision WHEN 'exact' THEN 1 WHEN 'fuzzy' THEN nf WHEN 'matched' THEN nm WHEN 'cross_document' THEN n WHEN 'single' THEN n ELSE 0 END)::BIGINT AS n_targets FROM x")
def target_resolution(spark, d):
    return search.resolve_targets(_questions(spark, d), _registry(spark, d), "query", "question", "explicit", "file_name")


@query("SELECT source AS batch, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS context FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10 GROUP BY source")
def context_build(spark, d):
    best = relational.top_per_group(views.table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 10)
    texts = best.join(views.table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumnRenamed("source", "batch")
    return relational.joined_text(texts, ["batch"], ["doc_id"], "text", "\n\n---\n\n").withColumn("context", F.md5("context"))


@query("""WITH x AS (SELECT source, doc_id, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, md5(substr(string_agg(substr(text, 1, 16000), chr(10) || chr(10) ORDER BY doc_id), 1, 16000)) AS context FROM x WHERE before < 16000 GROUP BY source""")
def bounded_text(spark, d):
    return relational.bounded_text(views.table(spark, d, "documents"), ["source"], ["doc_id"], "text").select("source", F.md5("context").alias("context"))
