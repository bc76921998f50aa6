"""Quality rules with adaptive thresholds from mergeable quantile sketches.

``text_stats`` counts words, symbols, repeated lines and repeated word runs of whole
texts. Three rates are judged: symbols per character of words, repeated lines per line,
repeated words per word, each with ``NOISE`` standard deviations of a count taken off, so
that one event in a short text is not a habit. ``adaptive_thresholds`` builds a quantile
sketch of each rate for each language and source: counts in logarithmic buckets (relative
error at most ``ALPHA``), which merge by addition, so a hot source is combined before the
shuffle and no group is ever collected. A group's own limit is the quantile at the rate's
``LEVELS`` plus ``SPREAD`` times its distance from the median: what most texts of the group
stay under, and some room. Small groups lean on the sketch of their language, and small
languages on the sketch of all, as if these added ``WEIGHT`` texts. No limit is fixed: a
rate that one source has by habit is rejected in another. ``judge`` joins the thresholds
back to the documents on language and source (null matches null) and keeps the rows that
pass the fixed base rules and every threshold; a rate equal to its threshold passes.

Defined results: null text has no words and fails the base rules; texts of white space
likewise; null language or source is a group of its own; an empty table gives an empty
table; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spark_io import cut, written
from .textnum import release, slices, text_bytes, windows, word_hashes, word_spans

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
SMALLEST = 1e-4
NOISE = 0.5
SPREAD = 1.0
WEIGHT = 200
#: rate: the quantile that its group's texts stay under by habit. Symbols are a trait of whole texts, repeats are events in a few of them.
LEVELS = {"symbol_ratio": 0.85, "dup_line_ratio": 0.99, "repeat_ratio": 0.99}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of every whole text."""

    def count(text: pa.Array) -> list[np.ndarray]:
        data, at = text_bytes(text)
        n = len(at) - 1
        starts, ends, first = word_spans(data, at)
        words = word_hashes(data, starts, ends, lower=False)

        def per_text(marks: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            return total[at[1:]] - total[at[:-1]]

        solid = np.zeros(len(data) + 1, np.int64)
        np.add.at(solid, starts, 1)
        np.subtract.at(solid, ends, 1)
        chars = per_text((np.cumsum(solid[:-1]) > 0) & ((data & 0xC0) != 0x80))
        n_words = np.diff(first)
        dup, rep, n_lines = np.zeros(n, np.int64), np.zeros(n, np.int64), (n_words > 0).astype(np.int64)
        runs = windows(words, 3)
        line_ends = np.flatnonzero(data == 10)
        line_at = np.searchsorted(line_ends, at)
        raw = data.tobytes()
        for i in range(n):
            if n_words[i] >= 3:
                r = runs[first[i] : first[i + 1] - 2]
                order = np.argsort(r, kind="stable")
                s = r[order]
                same = s[1:] == s[:-1]
                if same.any():
                    twice = np.zeros(len(s), bool)
                    twice[1:] |= same
                    twice[:-1] |= same
                    hit = np.zeros(len(s) + 2, bool)
                    where = order[twice]
                    hit[where] = hit[where + 1] = hit[where + 2] = True
                    rep[i] = hit.sum()
            if line_at[i + 1] > line_at[i]:
                lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
                n_lines[i], dup[i] = len(lines), len(lines) - len(set(lines))
        return [n_words, chars, per_text(_SYMBOL[data]), dup, rep, n_lines]

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    own = text_col if text_col in keep else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, own):
                rest = [c for c in b.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(x, pa.int64()) for x in count(b.column(own)))], [*rest, *names])
        release()

    kept = list(dict.fromkeys((id_col, *keep)))
    rows = docs.select(*kept, *([F.col(text_col).alias("__text")] if own == "__text" else []))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, ", ".join([kinds, *(f"{x} long" for x in names)]))


def with_ratios(stats: DataFrame) -> DataFrame:
    def over(n: str, all_of: str) -> Column:
        events, size = F.col(n).cast("double"), F.col(all_of).cast("double")
        return F.when(size > 0, F.greatest(F.lit(0.0), events - NOISE * F.sqrt(events)) / size).otherwise(0.0)

    return stats.withColumns({"symbol_ratio": over("n_symbols", "word_chars"), "dup_line_ratio": over("n_dup_lines", "n_lines"), "repeat_ratio": over("n_repeat_words", "n_words")})


def bucket(x: Column) -> Column:
    """The sketch's bucket of a value: 0 up to SMALLEST, else by the logarithm to base GAMMA."""
    return F.when(x <= SMALLEST, F.lit(0)).otherwise(F.ceil(F.log(x / SMALLEST) / math.log(GAMMA))).cast("int")


def bucket_value(b: Column) -> Column:
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.lit(SMALLEST) * F.pow(F.lit(GAMMA), b - 1) * (2 * GAMMA / (1 + GAMMA)))


def sketch(rows: DataFrame, groups: list[str], ratios: list[str]) -> DataFrame:
    """(groups..., metric, bucket, n): a mergeable sketch, one row per bucket in use; sketches add up by bucket."""
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in ratios))).alias("x")
    return rows.select(*groups, parts).groupBy(*groups, "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    whole = sketches[0]
    for s in sketches[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*(c for c in whole.columns if c != "n")).agg(F.sum("n").alias("n"))


def quantiles(sketched: DataFrame, groups: list[str], at: dict[str, float | Column]) -> DataFrame:
    """(groups..., metric, n, one column per quantile). Windows run over buckets, whose number is bounded, not over rows."""
    by = W.partitionBy(*groups, "metric")
    run = sketched.withColumns({"__upto": F.sum("n").over(by.orderBy("bucket")), "__all": F.sum("n").over(by)})
    point = lambda q: bucket_value(F.min(F.when(F.col("__upto") >= F.col("__all") * q, F.col("bucket"))))
    return run.groupBy(*groups, "metric").agg(F.max("__all").alias("n"), *(point(q).alias(name) for name, q in at.items()))


def adaptive_thresholds(rows: DataFrame, groups: list[str], levels: dict[str, float] = LEVELS) -> DataFrame:
    """(groups..., one threshold column per ratio); each group leans on the one without its last column, up to all rows."""
    whole = cut(sketch(rows, groups, list(levels)))
    level = F.lit(None).cast("double")
    for m, q in levels.items():
        level = F.when(F.col("metric") == m, F.lit(q)).otherwise(level)
    out = None
    for depth in range(len(groups) + 1):
        own = groups[:depth]
        q = quantiles(merge(whole.select(*own, "metric", "bucket", "n")), own, {"upper": level, "middle": F.lit(0.5)})
        q = q.select(*own, "metric", "n", (F.col("upper") + SPREAD * (F.col("upper") - F.col("middle"))).alias("limit"))
        if out is not None:
            up = out.select(F.col("metric").alias("u_metric"), F.col("limit").alias("u_limit"), *(F.col(c).alias(f"u_{c}") for c in own[:-1]))
            same = F.col("metric") == F.col("u_metric")
            for c in own[:-1]:
                same = same & F.col(c).eqNullSafe(F.col(f"u_{c}"))
            q = q.join(up, same).select(*own, "metric", "n", ((F.col("limit") * F.col("n") + F.col("u_limit") * WEIGHT) / (F.col("n") + WEIGHT)).alias("limit"))
        out = q
    return out.groupBy(*groups).agg(*(F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"max_{m}") for m in levels))


def _named(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, all_columns: bool) -> DataFrame:
    """The columns that the rules read under fixed names, and all others as c0, c1 and so on."""
    read = {id_col: "id", text_col: "text", lang_col: "lang", source_col: "source"}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in read.items()), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if all_columns and c not in read))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _limits(rows: DataFrame) -> DataFrame:
    return adaptive_thresholds(rows.where(~base_failed()), ["lang", "source"]).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})


def _joined(rows: DataFrame, limits: DataFrame) -> DataFrame:
    fits = F.lit(True)
    for m in LEVELS:
        fits = fits & F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True))
    both = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fits)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The statistics of every row, its base_failed and its kept."""
    rows = cut(with_ratios(text_stats(_named(docs, id_col, text_col, lang_col, source_col, False), "id", "text", ("lang", "source"))))
    return _joined(rows, _limits(rows)).select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *LEVELS, *(f"max_{m}" for m in LEVELS))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are read twice, once for the thresholds and once to judge, and never shuffled;
    the thresholds are a written table, so that their size is known when they are joined.
    """
    few = _named(docs, id_col, text_col, lang_col, source_col, False)
    limits = written(_limits(with_ratios(text_stats(few, "id", "text", ("lang", "source")))))
    every = _named(docs, id_col, text_col, lang_col, source_col, True)
    judged = _joined(with_ratios(text_stats(every, "id", "text", tuple(every.columns))), limits)
    read = {id_col: "id", text_col: "text", lang_col: "lang", source_col: "source"}
    return judged.where("kept").select(*(F.col(read.get(c, f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
