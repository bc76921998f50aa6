"""Batch model stages: a callable over batches of rows, run where the rows are.

The callable is the user's. It gets a list of inputs and returns as many strings; a batch
that raises gives null outputs and its error, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from .relational import batches, exists, joined_text

Model = Callable[[list[str]], list[str]]


def infer(rows: DataFrame, prompt_col: str, model: Model, batch: int = 16) -> DataFrame:
    """Adds output and error."""
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), batch):
                x = p.iloc[at : at + batch].copy()
                try:
                    out = model(x[prompt_col].tolist())
                    x["output"], x["error"] = list(out), None
                except Exception as e:  # noqa: BLE001
                    x["output"], x["error"] = None, f"{type(e).__name__}: {e}"[:500]
                yield x[[*names, "output", "error"]]

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "output string", "error string"]))


def embed_with(model: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from texts to vectors; the model is made once per worker by the callable."""

    @pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(list(np.asarray(model(t.fillna("").tolist()), np.float32)))

    return run


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Signed feature hashing of words to ``dim`` numbers, native; the default embedder."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marks = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("i"), F.when(F.xxhash64(w, F.lit(1)) > 0, 1.0).otherwise(-1.0).alias("s")))
    zero = F.array_repeat(F.lit(0.0), dim)
    summed = F.aggregate(marks, zero, lambda v, m: F.transform(v, lambda x, i: x + F.when(i == m["i"], m["s"]).otherwise(0.0)))
    return F.transform(summed, lambda x: x.cast("float"))


def embedded(chunks: DataFrame, embed: Callable[[Column], Column], cache: str, name: str = "hash-64", text_col: str = "chunk_text", out: str = "content_vector") -> DataFrame:
    """Adds a vector to each row, from a table of what is known; ``embed`` sees each new text once.

    ``cache`` has a vector by SHA-256 of the text for each model ``name``, so texts that come again,
    in other documents or runs, are never embedded again. New texts are told by an anti-join on
    the hash and written before they are read back; if a run is tried again, or two runs meet,
    a text may stand there twice, and one of its vectors is taken.
    """
    spark = chunks.sparkSession
    text, kind = F.coalesce(F.col(text_col), F.lit("")), "key string, vector array<float>, model string"
    keyed = chunks.withColumn("__key", F.sha2(text, 256))
    known = lambda: spark.read.schema(kind).parquet(cache).where(F.col("model") == name).select(F.col("key").alias("__key"), "vector")
    texts = keyed.groupBy("__key").agg(F.first(text).alias("__text"))
    fresh = texts.join(known(), "__key", "left_anti") if exists(spark, cache) else texts
    rows = fresh.select(F.col("__key").alias("key"), embed(F.col("__text")).cast("array<float>").alias("vector"), F.lit(name).alias("model"))
    rows.write.mode("append").partitionBy("model").parquet(cache)
    asked = known().join(keyed.select("__key").distinct(), "__key", "left_semi").groupBy("__key").agg(F.first("vector").alias(out))
    return keyed.drop(out).join(asked, "__key").drop("__key")


def dictionary_triples(articles: DataFrame, concepts: dict[str, str], relation: str = "REFERENCES") -> DataFrame:
    """The built-in extractor of graph facts: concepts of a dictionary (name: label) that an article names."""
    hit = F.filter(F.array(*(F.when(F.contains(F.lower("chunk_text"), F.lit(n.lower())), F.struct(F.lit(n).alias("dst"), F.lit(label).alias("dst_label"))) for n, label in concepts.items())), lambda x: x.isNotNull())
    return articles.select(F.concat_ws(":", "regulation", "article_id").alias("doc_id"), "regulation", F.col("article_id").alias("src"), F.lit("Article").alias("src_label"), F.lit(relation).alias("rel"), F.explode(hit).alias("x")).select("doc_id", "regulation", "src", "src_label", "rel", "x.dst", "x.dst_label")


def entities(chunks: DataFrame, model: Model, first: int = 6, most: int = 15) -> DataFrame:
    """(query, entities) from the first chunks of each query: (query, rank, text) in."""
    context = joined_text(chunks.where(F.col("rank") <= first), ["query"], ["rank"], "text", "\n\n")
    return infer(context, "context", model).select("query", T.entities_from(F.coalesce("output", F.lit("")), most).alias("entities"), "error")


def gaps(obligations: DataFrame, policies: DataFrame, model: Model, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(gaps, failed documents): obligations in batches of ``size`` against each document's text."""
    kind = "struct<obligation_id:string,status:string,description:string,severity:string,theme:string>"
    cut = batches(obligations, ["document"], ["id"], size).groupBy("document", "batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "regulation", "text", "type")))).alias("obligations"))
    asked = cut.join(policies.select("document", F.col("context").alias("policy")), "document").withColumn("prompt", F.concat_ws("\n\n", "policy", "obligations"))
    out = infer(asked.select("document", "batch", "prompt"), "prompt", model)
    found = out.where("error is null").select("document", F.explode(T.parsed_list(F.col("output"), kind)).alias("g")).select("document", "g.*")
    typed = found.join(obligations.select("document", F.col("id").alias("obligation_id"), "regulation", F.col("type").alias("ob_type"), "article"), ["document", "obligation_id"], "left")
    return typed.withColumns({"ob_type": F.coalesce("ob_type", F.lit("other")), "theme": T.theme_or_other(F.col("theme"))}), out.where("error is not null").select("document").distinct()


def remediations(groups: DataFrame, model: Model, size: int = 10) -> DataFrame:
    """(document, theme, recommendation) for theme groups in batches of ``size``."""
    kind = "struct<theme:string,recommendation:string>"
    cut = batches(groups, ["document"], ["position"], size).groupBy("document", "batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct("position", "theme", "label", "severity")))).alias("prompt"))
    out = infer(cut, "prompt", model).where("error is null")
    return out.select("document", F.explode(T.parsed_list(F.col("output"), kind)).alias("r")).select("document", "r.theme", "r.recommendation")


def value_conflicts(texts: DataFrame, model: Model) -> DataFrame:
    """(src, rel, dst, ...) from regulation texts: (regulation, context) in; blank ends are left out."""
    kind = "struct<source:string,target:string,relationship:string,concept:string,value_a:string,value_b:string,unit:string,description:string,source_quote:string>"
    out = infer(texts, "context", model).select(F.explode(T.parsed_list(F.col("output"), kind)).alias("c")).select("c.*")
    rel = F.when(F.upper("relationship") == "STRICTER_THAN", "STRICTER_THAN").otherwise("CONFLICTS_WITH")
    return out.where((T.strip(F.col("source")) != "") & (T.strip(F.col("target")) != "")).select(F.col("source").alias("src"), rel.alias("rel"), F.col("target").alias("dst"), "concept", "value_a", "value_b", "unit", "description", "source_quote")


def answers(questions: DataFrame, contexts: DataFrame, model: Model) -> DataFrame:
    """(query, answer, gaps, recommendations)."""
    asked = questions.join(contexts, "query", "left").withColumn("prompt", F.concat_ws("\n\n", "question", "context"))
    return infer(asked.select("query", "prompt"), "prompt", model).select("query", T.answer_fields(F.coalesce("output", F.lit(""))).alias("a")).select("query", "a.*")


def jurisdictions(questions: DataFrame, model: Model | None = None) -> DataFrame:
    """(query, jurisdictions): those that the words name; where a model is given, its list, with the words' as fallback."""
    named = questions.withColumn("__words", T.detect_jurisdictions(F.col("question")))
    if model is None:
        return named.select("query", F.col("__words").alias("jurisdictions"))
    out = infer(named.select("query", "question", "__words"), "question", model)
    return out.select("query", T.normalize_jurisdictions(T.parsed_list(F.coalesce("output", F.lit("")), "string"), F.col("__words")).alias("jurisdictions"))
