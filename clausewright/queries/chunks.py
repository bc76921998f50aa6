"""Chunkers over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, model
from ..sources import files
from . import query, views

_TOKENS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 512) / 412.0)::BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)"""


@query(f"WITH {_TOKENS} SELECT doc_id, i::INT AS chunk_index, array_to_string(w[i * 412 + 1:i * 412 + 512], ' ') AS chunk_text FROM t")
def token_chunks(spark, d):
    return chunking.token_chunks(views.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk_text")


@query(f"WITH {_TOKENS}, r AS (SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'GDPR' WHEN contains(source, 'src2') OR contains(source, 'src3') THEN 'CCPA' WHEN contains(source, 'src15') OR contains(source, 'src4') THEN 'HIPAA' WHEN contains(source, 'src5') THEN 'NIST' ELSE 'UNKNOWN' END AS regulation FROM documents) SELECT regulation, count(*) AS n FROM t JOIN r USING (doc_id) GROUP BY regulation")
def chunk_facet(spark, d):
    """Chunks per regulation."""
    from ..functions import text as T

    docs = views.table(spark, d, "documents").select("doc_id", T.detect_regulation(F.col("source"), views.FIXTURE_PATTERNS).alias("regulation"), "text")
    return chunking.token_chunks(docs).groupBy("regulation").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '###'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: length(x) > 100) AS s FROM documents) SELECT doc_id, (i - 1)::INT AS section_id, s[i] AS chunk_text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def delimiter_sections(spark, d):
    return chunking.delimiter_sections(views.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "section_id", "chunk_text")


@query()
def size_chunks(spark, d):
    return chunking.size_chunks(views.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "article_id", "chunk_text")


def articles_source(spark, d):
    """Documents of the same source as articles of one text each, under header lines."""
    x = views.table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("\nArticle "), F.col("doc_id").cast("string"), F.lit(" Section text\n"), F.regexp_replace("text", "\n", " "), F.lit("\nArticle "), F.col("doc_id").cast("string"), F.lit("b Another part\nshort\nArticle "), F.col("doc_id").cast("string"), F.lit("c Third part of it\n"), F.regexp_replace("text", "\n", " ")).alias("text"))
    return x.withColumn("regulation", F.when(F.col("doc_id") % 10 == 0, "NONE").otherwise("GDPR"))


@query("""WITH b AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents WHERE doc_id % 10 <> 0), a AS (
SELECT doc_id, 'Article ' || doc_id || ' Section text' AS article_id, t FROM b UNION ALL SELECT doc_id, 'Article ' || doc_id || 'b Another part', 'short' FROM b UNION ALL SELECT doc_id, 'Article ' || doc_id || 'c Third part of it', t FROM b)
SELECT doc_id, article_id, article_id || chr(10) || chr(10) || t AS chunk_text FROM a WHERE length(article_id || chr(10) || chr(10) || t) >= 50""")
def article_split(spark, d):
    return chunking.split_articles(articles_source(spark, d)).where("regulation = 'GDPR'").select("doc_id", "article_id", "chunk_text")


@query()
def semantic_chunks(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    return chunking.semantic_chunks(docs, "doc_id", lambda c: model.hash_embedding(c, 16)).select("doc_id", "section_id", "chunk_text")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, d):
    return files.page_text(views.table(spark, d, "pages")).select("page_id", "text")


@query("SELECT conv_id AS paper_id, (turn // 20)::INT AS batch, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, count(*) AS n_pages FROM conversations GROUP BY ALL")
def page_batches(spark, d):
    return files.page_batches(views.paged(spark, d))


@query("SELECT conv_id AS paper_id, coalesce(sum(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))) FILTER (turn < 3), 0) < 200 AS is_scanned FROM conversations GROUP BY conv_id")
def scanned_files(spark, d):
    """Turns stand for pages; the first three decide."""
    return files.scanned(views.paged(spark, d))
