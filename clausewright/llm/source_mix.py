"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Sources, in code point order with null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share
the words of all documents by weight. A target stops at ``CEILING`` times its source's
words, and the excess is shared again by weight until none is above. A document's
expected copies are its source's target over its source's words, times its relative
weight where a weight column is given. Whole copies are certain. For the fraction p that
is left, documents are ranked by u / (1 - u) over p / (1 - p), u being a hash of the seed
and the id, and taken in that order while at least half of the document fits into the
words that the whole copies leave of the target; the rank of the last one taken is all
that a source's documents need to be told.

The ranking of a source is never brought together: ranks are dealt into buckets of about
``BUCKET`` rows, bucket sums are added up per source, and only rows within a bucket are
ordered.

Defined results: null text has size 0; null source is a source; sources without words
have target 0; a document of size 0 takes 0; repeated ids have the same rank and are
taken together; an empty table gives an empty table; the same seed gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spark_io import cut, written

WEIGHTS = (1, 2, 3)
CEILING = 3
BUCKET = 2048
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, weight, target) from (source, size); windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (CEILING * F.col("source_size")).cast("double"))
    # sources fill up in the order of cap over weight; the level is fixed by the first that does not
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumn("__at", F.row_number().over(fill))
    per = per.withColumn("__level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = F.when(F.col("cap") >= F.col("__level") * F.col("weight"), F.struct("__at", "__level"))
    per = per.withColumn("__level", F.min(free).over(every)["__level"])
    return per.select("source", "source_size", "n", "weight", F.coalesce(F.least(F.col("cap"), F.col("__level") * F.col("weight")), F.col("cap")).alias("target"))


def _ranked(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, weight_col: str | None, *rest: Column) -> DataFrame:
    """id, source, size, u, relative weight and ``rest``."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    relative = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), u.alias("u"), relative.alias("relative"), *rest)


def _placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Whole copies and rank, null where no fraction is left, of every row."""
    copies = F.least(F.lit(float(CEILING)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("relative") / F.when(F.col("mean") > 0, F.col("mean"))))
    p, q = F.col("part"), F.col("source_part")
    return (
        rows.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("expected", F.coalesce(copies, F.lit(0.0)))
        .withColumns({"whole": F.floor("expected"), "part": F.col("expected") - F.floor("expected"), "source_part": F.pmod(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(1.0))})
        .withColumn("odds", F.when((p > 0) & (q > 0), F.col("u") / (1 - F.col("u")) * (q / (1 - q)) / (p / (1 - p))))
        .withColumn("rank", F.col("odds") / (1 + F.col("odds")))
        .drop("t_source", "expected", "part", "source_part", "odds")
    )


def _planned(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> tuple[DataFrame, DataFrame]:
    """(id, source, size, target, whole, rank, bucket) of every row, and one row per source: (source, source_size, n, weight, target, mean, last)."""
    rows = cut(_ranked(docs, seed, id_col, text_col, source_col, weight_col))
    targets = source_targets(rows.select("source", "size"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    mean = rows.groupBy(F.col("source").alias("m_source")).agg(F.when(F.sum("size") > 0, F.sum(F.col("size") * F.col("relative")) / F.sum("size")).otherwise(1.0).alias("mean"))
    targets = written(targets.join(mean, same("source", "m_source")).drop("m_source"))
    ranked = cut(_placed(rows, targets).withColumn("bucket", F.floor(F.col("rank") * F.ceil(F.col("n") / BUCKET))).select("id", "source", "size", "target", "whole", "rank", "bucket"))
    sums = ranked.groupBy("source", "bucket").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("sum"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
    by = W.partitionBy("source")
    sums = sums.select(
        F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "sum", F.coalesce(F.sum("sum").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("certain").over(by).alias("certain")
    ).where(F.col("s_bucket").isNotNull())
    within = W.partitionBy("source", "bucket").orderBy("rank", "id", "size")
    room = F.col("target") - F.col("certain")
    fits = F.col("before") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2 <= room
    last = ranked.where("rank is not null").join(sums, same("source", "s_source") & (F.col("bucket") == F.col("s_bucket"))).withColumn("fits", fits).where("fits").groupBy(F.col("source").alias("l_source")).agg(F.max("rank").alias("last"))
    return ranked, written(targets.join(last, same("source", "l_source"), "left").drop("l_source"))


def plan(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """(source, source_size, n, weight, target, mean, last): one row per source; documents ranked up to ``last`` are taken once more."""
    return _planned(docs, seed, id_col, text_col, source_col, weight_col)[1]


def _copies() -> Column:
    return F.col("whole") + F.coalesce(F.col("rank") <= F.col("last"), F.lit(False)).cast("long")


def mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of ``docs``; texts are read once."""
    ranked, per = _planned(docs, seed, id_col, text_col, source_col, weight_col)
    both = ranked.drop("target").join(per.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).withColumn("copies", _copies())
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever their names.

    Texts are not shuffled: what is joined to them is one row per source.
    """
    every = _ranked(docs, seed, id_col, text_col, source_col, weight_col, F.struct("*").alias("row"))
    rows = _placed(every, plan(docs, seed, id_col, text_col, source_col, weight_col)).withColumn("copies", _copies())
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
