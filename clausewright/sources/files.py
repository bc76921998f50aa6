"""File discovery, extraction, chunk and article tables, the ingestion ledger and the chunk index."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.iterate import cut
from ..operators.relational import exists

MANIFEST = "file_path string, file_name string, regulation string, modified timestamp, length long"
CHUNKS = T.StructType([T.StructField(n, T.IntegerType() if n in ("chunk_index", "page") else T.StringType(), False) for n in ("chunk_id", "paper_id", "regulation", "doc_type", "chunk_text", "chunk_index", "page", "extractor", "chunk_strategy", "status", "error")])
INDEX = "chunk_id string, paper_id string, content string, content_vector array<float>, page int, doc_type string, regulation string"


def discover(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True, partitions: int | None = None) -> DataFrame:
    """The manifest: one row per file, from the scan's own listing, without its content. A missing folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    out = files.select(F.col("path").alias("file_path"), X.base_name(F.col("path")).alias("file_name"), X.detect_regulation(X.base_name(F.col("path"))).alias("regulation"), F.col("modificationTime").alias("modified"), "length")
    return out.repartition(partitions) if partitions else out


def accepted(files: DataFrame, most_bytes: int = 50 << 20, suffix: str = ".pdf") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason)."""
    reason = F.when(~F.endswith(F.lower("file_name"), F.lit(suffix)), "media type").when(F.col("length") > most_bytes, "too large")
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def scanned(pages: DataFrame, id_col: str = "paper_id", sample: int = 3, fewer: int = 200) -> DataFrame:
    """(id, is_scanned): whether the first pages hold fewer than so many characters besides white space at their ends."""
    first = pages.where(F.col("page") <= sample).groupBy(id_col).agg(F.sum(F.length(X.strip(F.coalesce("text", F.lit(""))))).alias("chars"))
    return pages.select(id_col).distinct().join(first, id_col, "left").select(id_col, (F.coalesce("chars", F.lit(0)) < fewer).alias("is_scanned"))


def page_batches(pages: DataFrame, id_col: str = "paper_id", size: int = 20) -> DataFrame:
    """Pages in batches of ``size``, joined by blank lines in page order; a batch is bounded by its size."""
    batch = F.floor((F.col("page") - 1) / size).cast("int")
    return pages.withColumn("batch", batch).groupBy(id_col, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))


def document_name(path: Column, source: str) -> Column:
    """The path below ``source``, which tells files of one base name in different folders apart; else the base name."""
    root = re.sub(r"^[a-z0-9]+:/*", "/", source).rstrip("/").replace("\\E", "")
    below = F.regexp_extract(path, "\\Q" + root + "\\E/+(.*)$", 1)
    return F.when(below != "", below).otherwise(X.base_name(path))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(file_name, text, page): the good pages of each file in order as one text, with its first page; a file is as large as its reader could hold."""
    good = pages.where("status = 'ok'").groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return good.select("file_name", F.array_join(F.transform("p", lambda s: s["text"]), "\n\n").alias("text"), F.col("p")[0]["page"].alias("page"))


def extract(files: DataFrame, extractor: Callable[[bytes], list[tuple[int, str]]], name: str = "text") -> DataFrame:
    """Runs an extractor over (file_name, content): (file_name, page, text, extractor, status, error).

    A file that fails is one row with page -1 and its error; the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for file_name, content in zip(b["file_name"], b["content"], strict=True):
                try:
                    rows += [(file_name, page, text, name, "ok", "") for page, text in extractor(content)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((file_name, -1, "", name, "error", f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["file_name", "page", "text", "extractor", "status", "error"])

    return files.select("file_name", "content").mapInPandas(run, "file_name string, page int, text string, extractor string, status string, error string")


def extract_ranges(
    files: DataFrame, split: Callable[[bytes, int], list[tuple[int, bytes]]], readers: Mapping[str, Callable[[bytes], list[str]]], size: int = 20, sample: int = 3, fewer: int = 200
) -> DataFrame:
    """Runs extractors over ranges of ``size`` pages of (file_name, content), with the columns of ``extract``.

    ``split`` gives the ranges of a file as (number of the first page, bytes), so each part of a
    file moves once; ``readers`` has ``text`` and ``ocr``, from the bytes of a range to the texts of
    its pages. A file whose first ``sample`` pages give the text reader fewer than so many
    characters, or fail it, is scanned and goes to ``ocr``. Ranges are rows of their own: a long
    file is read by many tasks, and a range that fails is one row with its first page and its
    error, beside the pages of the others. A file that cannot be split is one row with page -1.
    """

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file_name, content in zip(b["file_name"], b["content"], strict=True):
                try:
                    parts = split(content, size)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(file_name, -1, b"", "", f"{type(e).__name__}: {e}"[:500])], columns=["file_name", "first", "part", "kind", "error"])
                    continue
                try:
                    found = sum(len(t.strip()) for t in readers["text"](parts[0][1])[:sample]) if parts else 0
                except Exception:  # noqa: BLE001
                    found = 0
                kind = "ocr" if found < fewer else "text"
                for first, part in parts:
                    yield pd.DataFrame([(file_name, first, part, kind, None)], columns=["file_name", "first", "part", "kind", "error"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.itertuples(index=False):
                try:
                    if isinstance(r.error, str):
                        raise ValueError(r.error)
                    rows += [(r.file_name, r.first + i, text, r.kind, "ok", "") for i, text in enumerate(readers[r.kind](r.part))]
                except Exception as e:  # noqa: BLE001  one bad range must not end the file
                    rows.append((r.file_name, r.first, "", r.kind, "error", r.error if isinstance(r.error, str) else f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["file_name", "page", "text", "extractor", "status", "error"])

    ranges = files.select("file_name", "content").mapInPandas(parted, "file_name string, first int, part binary, kind string, error string")
    spread = ranges.repartition(max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file_name", "first")
    return spread.mapInPandas(read, "file_name string, page int, text string, extractor string, status string, error string")


def page_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Visible text of HTML pages, native: scripts, styles, comments and tags go, white space folds."""
    bare = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ")
    return pages.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " ")))


def read_jsonl(spark: SparkSession, path: str, schema: str = "text string, metadata map<string,string>") -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def article_dump(articles: DataFrame, order: Sequence[str]) -> DataFrame:
    """Articles with chunk_index, char_count and text_preview."""
    from pyspark.sql import Window as W

    return articles.withColumns({"chunk_index": F.row_number().over(W.partitionBy("regulation").orderBy(*order)) - 1, "char_count": F.length("chunk_text"), "text_preview": X.preview(F.col("chunk_text"), 200)})


def chunk_rows(chunks: DataFrame, strategy: str) -> DataFrame:
    """Chunks of (file_name, regulation, doc_type, chunk_index, chunk_text, page) under the chunk schema. Names with folders keep them in the id."""
    name = F.col("file_name")
    in_folder = F.format_string("%s_%04d", F.regexp_replace(name, r"\.[^./]*$", ""), F.col("chunk_index").cast("int"))
    out = chunks.select(
        F.when(F.contains(name, F.lit("/")), in_folder).otherwise(X.chunk_id(name, F.col("chunk_index"))).alias("chunk_id"), F.col("file_name").alias("paper_id"), "regulation", "doc_type", "chunk_text", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("page").cast("int").alias("page"),
        F.lit("text").alias("extractor"), F.lit(strategy).alias("chunk_strategy"), F.lit("ok").alias("status"), F.lit("").alias("error"),
    )
    return out.na.fill("").na.fill(-1)


def _index_rows(chunks: DataFrame) -> DataFrame:
    good = chunks.where((F.col("status") == "ok") & (X.strip(F.col("chunk_text")) != ""))
    return good.withColumnRenamed("chunk_text", "content")


def upload(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Good, non-blank chunks as the index: partitioned by class and regulation, so that filters on them prune folders."""
    _index_rows(chunks).write.mode(mode).partitionBy("doc_type", "regulation").parquet(path)


def upsert(chunks: DataFrame, path: str, papers: DataFrame | None = None) -> None:
    """Chunks of documents into the index: what it has of these documents is replaced, so a batch may come twice.

    ``papers`` (paper_id) names the documents that were read, with those that gave no chunk: what
    the index has of them goes. Without it they are the documents of ``chunks``. Only folders that
    hold some of these documents are written again, from a copy that is complete before they are;
    batches of new documents are appended.
    """
    spark = chunks.sparkSession
    if not exists(spark, path):
        upload(chunks, path)
        return
    rows = _index_rows(chunks)
    read = lambda at: spark.read.schema(rows.schema).parquet(at)
    known, papers = read(path), (chunks if papers is None else papers).select("paper_id").distinct()
    folders = known.join(papers, "paper_id", "left_semi").select("doc_type", "regulation").distinct()
    if not folders.take(1):
        upload(chunks, path)
        return
    staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    upload(chunks, staged)
    touched = folders.unionByName(rows.select("doc_type", "regulation").distinct()).distinct()
    rest = known.join(touched, ["doc_type", "regulation"], "left_semi").join(papers, "paper_id", "left_anti")
    rest.select(rows.columns).write.mode("append").partitionBy("doc_type", "regulation").parquet(staged)
    emptied = folders.join(read(staged).select("doc_type", "regulation").distinct(), ["doc_type", "regulation"], "left_anti").collect()
    read(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_type", "regulation").parquet(path)
    for r in emptied:  # folders, as few as there are classes and regulations
        remove(spark, f"{path.rstrip('/')}/doc_type={r['doc_type']}/regulation={r['regulation']}")
    remove(spark, staged)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def log_ingestion(summary: DataFrame, path: str, seconds: float) -> None:
    """Appends the summary row of an ingestion run with its time, rate and status."""
    rate = F.col("processed") / F.greatest(F.lit(seconds), F.lit(1e-3))
    summary.withColumns({"run_id": F.expr("uuid()"), "finished": F.current_timestamp(), "seconds": F.lit(seconds), "files_per_second": rate}).write.mode("append").parquet(f"{path}/ingestion_runs")


def deliver(chunks: DataFrame, send: Callable[[list[dict]], None], size: int = 100) -> DataFrame:
    """Sends good, non-blank chunks to a service in batches from the executors; one row: batches, uploaded, errors.

    A batch that fails is counted with its chunks and the others go on. A task that is tried
    again sends its batches again, so the service should take chunks by id.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for at in range(0, len(frame), size):
                batch = frame.iloc[at : at + size].to_dict("records")
                try:
                    send(batch)
                    done.append((len(batch), 0))
                except Exception:  # noqa: BLE001  one bad batch must not end the job
                    done.append((0, len(batch)))
            yield pd.DataFrame(done, columns=["uploaded", "errors"])

    good = chunks.where((F.col("status") == "ok") & (X.strip(F.col("chunk_text")) != ""))
    sent = cut(good.mapInPandas(run, "uploaded long, errors long"))
    return sent.agg(F.count("*").alias("batches"), F.coalesce(F.sum("uploaded"), F.lit(0)).alias("uploaded"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index under its schema, without inference; vectors are null where chunks were stored without."""
    return spark.read.schema(INDEX).parquet(path)


def index_count(spark: SparkSession, path: str) -> int:
    return read_index(spark, path).count() if exists(spark, path) else 0


def with_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new chunks together, repeats and all; a column that only one side has is null in the other."""
    return existing.unionByName(new, allowMissingColumns=True)


def build_or_load(chunks: DataFrame, path: str, force: bool = False) -> DataFrame:
    """The index at ``path``; built only if it is not there, or anew if forced."""
    spark = chunks.sparkSession
    if force or not exists(spark, path):
        upload(chunks, path, "overwrite")
    return spark.read.parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Files that are done, by path and modification time; empty before the first run."""
    schema = "file_path string, modified timestamp"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.range(0).select(F.lit("").alias("file_path"), F.current_timestamp().alias("modified"))


def commit(done: DataFrame, path: str) -> None:
    """Appends finished files; called after the sink has committed."""
    done.select("file_path", "modified").distinct().write.mode("append").parquet(path)


def write_graph(tables: dict[str, DataFrame], path: str, clear: bool = True) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite" if clear else "append").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "mentions")}


def log_run(run: DataFrame, metrics: DataFrame, path: str, gaps: DataFrame | None = None, risk_scores: DataFrame | None = None) -> None:
    """Appends a run's parameters, its metrics in long form, its gaps and its risk scores, each to a table of its own."""
    for name, rows in (("audit_runs", run), ("audit_metrics", metrics), ("gaps", gaps), ("risk_scores", risk_scores)):
        if rows is not None:
            rows.write.mode("append").parquet(f"{path}/{name}")


def run_history(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """Newest runs first; empty where nothing was logged yet."""
    at = f"{path}/audit_runs"
    if not exists(spark, at):
        return spark.range(0).select(F.lit("").alias("run_id"), F.current_timestamp().alias("start_time"))
    return spark.read.parquet(at).orderBy(F.desc("start_time"), "run_id").limit(most)
