"""Incremental ingestion: a file source, one pass over what is new, and a checkpoint that remembers it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, model
from ..operators.relational import exists, first_wins
from ..sources import files


def _new_rows(spark: SparkSession, source: str, schema: str, kind: str) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(source)


def incremental(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "parquet") -> None:
    """Runs ``step`` on what has arrived since the last call and returns; a second call without new files does nothing."""
    q = _new_rows(spark, source, schema, kind).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_texts(spark: SparkSession, source: str, index: str, checkpoint: str, size: int = 512, overlap: int = 100, embed: Callable[[Column], Column] | None = None, embedder: str = "hash-64", tokens: Callable[[Column], Column] = chunking.words) -> None:
    """New (file_name, regulation, doc_type, text) rows to token chunks in the index, with vectors where ``embed`` is given."""
    embedded = lambda rows: model.embedded(rows, embed, f"{index}_vectors", embedder) if embed else rows

    def step(batch: DataFrame, _: int) -> None:
        cut = chunking.token_chunks(batch, "text", size, overlap, tokens).withColumn("page", F.lit(0))
        files.upsert(embedded(files.chunk_rows(cut, "token")), index, batch.select(F.col("file_name").alias("paper_id")))

    incremental(spark, source, "file_name string, regulation string, doc_type string, text string", step, checkpoint)


def ingest_files(spark: SparkSession, source: str, index: str, checkpoint: str, extractor: Callable[[bytes], list[tuple[int, str]]], pattern: str = "*.pdf", embed: Callable[[Column], Column] | None = None, embedder: str = "hash-64") -> None:
    """New binary files through an extractor to token chunks of whole documents; failures go to a quarantine table beside the index. A batch may be tried again."""
    embedded = lambda rows: model.embedded(rows, embed, f"{index}_vectors", embedder) if embed else rows

    def step(batch: DataFrame, number: int) -> None:
        named = batch.select(files.document_name(F.col("path"), source).alias("file_name"), "content")
        pages = files.extract(named, extractor).persist()
        text = files.joined_pages(pages).withColumns({"regulation": files.X.detect_regulation(files.X.base_name(F.col("file_name"))), "doc_type": files.X.doc_type(F.col("file_name"))})
        read = named.select("file_name").join(pages.where("page = -1").select("file_name"), "file_name", "left_anti")
        files.upsert(embedded(files.chunk_rows(chunking.token_chunks(text, "text"), "token")), index, read.withColumnRenamed("file_name", "paper_id"))
        # a batch that is tried again writes its own folder again
        pages.where("status <> 'ok'").write.mode("overwrite").parquet(f"{index}_quarantine/batch={number}")
        pages.unpersist()

    q = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(source)
    q.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_feed(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("start_time",)) -> None:
    """Audit runs as they are logged, once each, in the history table that ``audit.trends`` reads.

    A run that comes again, in one batch or in a later one, is left out; the first by ``order`` of
    a batch stays. Runs may come in any order and as late as they like, since a batch is compared with
    the keys of the whole table and not with a window. A batch that is tried again writes its own
    folder again. The table has a column ``batch`` more.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = first_wins(batch, keys, [*order, F.xxhash64(*batch.columns)])
        if exists(spark, sink):
            known = spark.read.schema(f"{schema}, batch int").parquet(sink).where(F.col("batch") != number)
            rows = rows.join(known.select(*keys).distinct(), list(keys), "left_anti")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    incremental(spark, source, schema, step, checkpoint)
