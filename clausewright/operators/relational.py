"""Windows, set operations, batches, upserts and summaries that several jobs share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def interleave(df: DataFrame, batch_col: str, pos_col: str, cap: int, by: Sequence[str] = ()) -> DataFrame:
    """Round robin over batches: the first of each, then the second of each, up to ``cap`` rows in all, or of each ``by``."""
    turn = df.withColumn("turn", F.row_number().over(W.partitionBy(*by, batch_col).orderBy(pos_col)))
    if by:
        return top_per_group(turn.where(F.col("turn") <= cap), by, ["turn", batch_col], cap).drop("rank")
    return turn.orderBy("turn", batch_col).limit(cap)


def grams(text: Column, width: int = 3) -> Column:
    """The distinct substrings of one to ``width`` characters."""
    of = lambda w: F.when(F.length(text) >= w, F.transform(F.sequence(F.lit(1), F.length(text) - w + 1), lambda i: F.substring(text, i, F.lit(w)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(w) for w in range(1, width + 1))))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str, width: int = 3) -> DataFrame:
    """Rows of ``texts`` joined with those of ``parts`` whose string they contain, case and all; empty parts are in nothing.

    An equality join of the first characters of each part with the substrings of each text finds
    the candidates, so no cross product is made, and only substrings that start a part are
    kept before the join. Columns of both go through; their names must differ.
    """
    keyed = parts.where(F.length(part) > 0).withColumn("__gram", F.substring(part, 1, width))
    cut_up = texts.withColumn("__gram", F.explode(grams(F.col(text), width)))
    known = cut_up.join(keyed.select("__gram").distinct(), "__gram", "left_semi")
    return known.join(keyed, "__gram").where(F.contains(F.col(text), F.col(part))).drop("__gram")


def batches(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], size: int) -> DataFrame:
    """Adds batch: rows of a group in runs of ``size``."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int"))


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def reusable(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``done`` whose key is wanted."""
    return done.join(wanted.select(*keys), list(keys), "left_semi")


def completed(processed: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return processed.select(*keys).distinct().join(failed.select(*keys), list(keys), "left_anti")


def merged_history(local: DataFrame, server: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, the local one where both have a key."""
    both = local.withColumn("__source", F.lit(0)).unionByName(server.withColumn("__source", F.lit(1)))
    return first_wins(both, keys, ["__source", *sorted(set(local.columns) - set(keys))]).drop("__source")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """MERGE: the first change of each key in ``order`` wins over the base, value by value where it has one; rows with a blank key are skipped.

    For the last change to win, order by its time or number descending.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & (F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "")
    values = [c for c in base.columns if c not in keys]
    last = first_wins(changes.where(whole), keys, order).select(*keys, *(F.col(v).alias(f"__{v}") for v in values))
    return base.join(last, list(keys), "full_outer").select(*keys, *(F.coalesce(f"__{v}", v).alias(v) for v in values))


def ingest_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, processed, skipped, chunks, uploaded, errors, success_rate and status."""
    per_file = chunks.groupBy("file_name").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("bad"))
    both = files.select("file_name").distinct().join(per_file, "file_name", "left")
    out = both.agg(
        F.count("*").alias("files"),
        F.count_if(F.coalesce("ok", F.lit(0)) > 0).alias("processed"),
        F.count_if(F.col("ok").isNull()).alias("skipped"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("errors"),
    )
    rate = F.col("chunks") / F.greatest(F.col("chunks") + F.col("errors"), F.lit(1))
    return out.withColumns({"success_rate": rate, "status": F.when(F.col("errors") == 0, "ok").otherwise("partial")})


def joined_text(df: DataFrame, group: Sequence[str], order: Sequence[str], text_col: str, separator: str) -> DataFrame:
    """The texts of each group in order as one; meant for groups of bounded size, such as the top chunks of a query."""
    return df.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("__text")))), lambda s: s["__text"]), separator).alias("context"))


def bounded_text(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], text_col: str, most: int = 16_000, separator: str = "\n\n") -> DataFrame:
    """The texts of each group in order until ``most`` characters are reached, cut there. Rows behind the bound are dropped before they are gathered."""
    w = W.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum(F.length(text_col) + len(separator)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = df.withColumns({"__before": before, "__pos": F.row_number().over(w)}).where(F.col("__before") < most)
    return joined_text(kept.withColumn("__cut", F.substring(text_col, 1, most)), group, ["__pos"], "__cut", separator).withColumn("context", F.substring("context", 1, most))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path that Spark can reach."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
