"""A training-data pipeline: five of the operators in a row, from documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Repeated rows, nulls and empty texts are treated as each
operator says; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewright.llm import jaccard_join, packing, quality_classifier, quality_rules, source_mix
from clausewright.llm.queries import classifier, vocabulary
from clausewright.llm.spark_io import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from labelled rows of the whole table; what an earlier stage rejected is what bad looks like."""
    return quality_classifier.keep(docs, classifier(spark, sf_dir))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component stays, once; rows without words all stay."""
    return jaccard_join.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: The classifier is not SQL. Tests hold the ids that every stage keeps, and the pieces that the last one packs, against plain Python, the classifier's scores taken as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
