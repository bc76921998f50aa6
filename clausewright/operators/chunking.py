"""Chunkers: one row per document or article in, one row per chunk out. No Python runs except a given embedder."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T


def words(c: Column, space: str = r"(?U)\s+") -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), space), lambda w: w != "")


def token_chunks(docs: DataFrame, text_col: str = "text", size: int = 512, overlap: int = 100, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """Windows of ``size`` tokens that overlap by ``overlap`` and end with the text: chunk_index and chunk_text are added.

    The tokenizer is a column function that gives an array; by default tokens are words.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.size("__t")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil((n - size) / step) * step)).cast("int"), F.lit(step)))
    cut = docs.withColumn("__t", tokens(F.col(text_col)))
    out = cut.select(*docs.columns, "__t", F.posexplode(starts).alias("chunk_index", "__at"))
    return out.withColumn("chunk_text", F.array_join(F.slice("__t", F.col("__at") + 1, F.lit(size)), " ")).drop("__t", "__at").withColumn("chunk_strategy", F.lit("token"))


def size_chunks(docs: DataFrame, text_col: str = "text", size: int = 2000) -> DataFrame:
    """Chunks of words that close once their characters, one more for each word, reach ``size``; ids are section_1, section_2 and so on.

    The count starts anew with each chunk, so this is a fold and not a running sum.
    """
    empty = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("chars"))

    def add(acc: Column, length: Column) -> Column:
        chars, at = acc["chars"] + length + 1, acc["at"] + 1
        full = chars >= size
        return F.struct(F.when(full, F.concat(acc["ends"], F.array(at))).otherwise(acc["ends"]).alias("ends"), at.alias("at"), F.when(full, 0).otherwise(chars).alias("chars"))

    cut = docs.withColumn("__w", words(F.col(text_col)))
    # the words behind the last full chunk are a chunk of their own
    cut = cut.withColumn("__ends", F.aggregate(F.transform("__w", F.length), empty, add, lambda acc: F.when(acc["chars"] > 0, F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"])))
    starts = F.transform("__ends", lambda e, i: F.when(i == 0, 0).otherwise(F.get("__ends", i - 1)))
    parts = F.zip_with(starts, "__ends", lambda a, b: F.slice("__w", a + 1, b - a))
    out = cut.select(*docs.columns, F.posexplode(parts).alias("chunk_index", "__p"))
    return out.withColumns({"chunk_text": F.array_join("__p", " "), "article_id": F.format_string("section_%d", F.col("chunk_index") + 1), "heading_level": F.lit(0)}).drop("__p")


def delimiter_sections(docs: DataFrame, text_col: str = "text", delimiter: str = "###", longer_than: int = 100) -> DataFrame:
    """Sections between delimiters with more than so many characters; section_id counts those that are kept."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), T.quoted(delimiter)), T.strip), lambda s: F.length(s) > longer_than)
    return docs.select(*docs.columns, F.posexplode(parts).alias("section_id", "chunk_text")).withColumn("chunk_strategy", F.lit("section"))


def skip_contents(text: Column, end: str) -> Column:
    """From the first match of ``end`` on; the whole text without one."""
    rest = F.regexp_extract(text, f"(?s)({end}.*)$", 1)
    return F.when(rest != "", rest).otherwise(text)


def article_split(docs: DataFrame, header: str, text_col: str = "text", clean_tables: bool = False, shortest: int = 50) -> DataFrame:
    """Articles from one header match to the next: article_id and chunk_text. What stands before the first header goes, and so do articles under ``shortest`` characters.

    A header directly behind another is found too, since the split looks ahead.
    """
    inline, body = ("(?m)", header[4:]) if header.startswith("(?m)") else ("", header)
    lead = r"\n" if body.startswith(r"\n") else ""
    # the line break before a header of that kind stays with the text before it
    look = f"{inline}(?<=\\n)(?={body[2:-2]}(?:\\n|\\z))" if lead else f"{inline}(?={body})"
    head = f"{inline}^({body[2:-2]})" if lead else f"{inline}^({body})"
    text = F.concat(F.lit("\n"), F.col(text_col)) if lead else F.col(text_col)
    parts = F.filter(F.split(text, look), lambda s: s.rlike(head.replace("(?m)", "")))
    rows = docs.select(*docs.columns, F.posexplode(parts).alias("__pos", "__part"))
    raw = F.regexp_extract("__part", head.replace("(?m)", ""), 1)
    inner = F.regexp_replace(F.regexp_replace(raw, r"^##\s*", ""), r"\*\*|\s*:\s*(?=\*\*)", "")
    content = T.strip(F.substring(F.col("__part"), F.length(raw) + 1, F.length("__part")))
    content = T.clean_table(content) if clean_tables else content
    out = rows.withColumns({"article_id": T.header_id(inner), "__body": content})
    out = out.withColumn("chunk_text", F.concat(F.col("article_id"), F.lit("\n\n"), F.col("__body")))
    return out.where(F.length("chunk_text") >= shortest).withColumn("heading_level", F.lit(2)).drop("__part", "__body").withColumnRenamed("__pos", "article_pos")


def split_articles(docs: DataFrame, regulation_col: str = "regulation", text_col: str = "text", headers: Mapping[str, str] = vocab.ARTICLE_HEADERS, contents: Mapping[str, str] = vocab.CONTENTS_END, tables: tuple[str, ...] = vocab.TABLE_REGULATIONS, least: int = 3, size: int = 2000, spellings: Mapping[str, str] = vocab.REGULATION_SPELLINGS) -> DataFrame:
    """Each document by its regulation's headers, also under a misspelt name; documents with no pattern, or fewer than ``least`` headers, by size."""
    text, reg = F.col(text_col), F.upper(regulation_col)
    for name, meant in spellings.items():
        reg = F.when(reg == name, meant).otherwise(reg)
    for name, end in contents.items():
        text = F.when(reg == name, skip_contents(F.col(text_col), end)).otherwise(text)
    trimmed = docs.withColumn(text_col, text)
    count = F.lit(0)
    for name, header in headers.items():
        count = F.when(reg == name, F.regexp_count(F.concat(F.lit("\n"), F.col(text_col)), F.lit(header.replace(r"\n", r"(?:^|\n)", 1) if header.startswith(r"\n") else header))).otherwise(count)
    counted = trimmed.withColumns({"__n": count, "__reg": reg})
    wanted = [*docs.columns, "article_id", "heading_level", "chunk_index", "chunk_text"]
    out = size_chunks(counted.where(F.coalesce(F.col("__n"), F.lit(0)) < least), text_col, size).select(wanted)
    for name, header in headers.items():
        own = counted.where((F.col("__reg") == name) & (F.col("__n") >= least)).drop("__reg")
        out = out.unionByName(article_split(own, header, text_col, name in tables).withColumnRenamed("article_pos", "chunk_index").select(wanted))
    return out


def semantic_chunks(docs: DataFrame, id_col: str, embed: Callable[[Column], Column], text_col: str = "text", percentile: float = 0.95, neighbours: int = 1) -> DataFrame:
    """Sentences grouped between the largest distances of neighbouring windows: (id, section_id, chunk_text).

    ``embed`` maps a text column to an array column. Windows are partitioned by document.
    """
    w = W.partitionBy(id_col).orderBy("pos")
    sentences = docs.select(id_col, F.posexplode(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=[.?!])\s+"), lambda s: s != "")).alias("pos", "sentence"))
    joined = sentences.withColumn("around", F.array_join(F.collect_list("sentence").over(w.rowsBetween(-neighbours, neighbours)), " ")).withColumn("v", embed(F.col("around")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    paired = joined.withColumn("next", F.lead("v").over(w))
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("next"), F.col("next")))
    apart = paired.withColumn("distance", F.when(F.col("next").isNotNull(), 1 - F.when(norm > 0, dot(F.col("v"), F.col("next")) / norm).otherwise(0.0))).select(id_col, "pos", "sentence", "distance")
    limit = apart.withColumn("limit", F.percentile("distance", F.lit(percentile)).over(W.partitionBy(id_col)))
    breaks = F.sum(F.when(F.col("distance") > F.col("limit"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    grouped = limit.withColumn("section_id", F.coalesce(breaks, F.lit(0)))
    return grouped.groupBy(id_col, "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), " ").alias("chunk_text")).withColumn("chunk_strategy", F.lit("semantic"))


def _semantic(docs: DataFrame, id_col: str, embed: Callable[[Column], Column], text_col: str = "text", **options) -> DataFrame:
    """Semantic chunks with the columns of their document; ``id_col`` tells documents apart."""
    return semantic_chunks(docs, id_col, embed, text_col, **options).join(docs.drop(text_col), id_col)


STRATEGIES = {"token": token_chunks, "size": size_chunks, "section": delimiter_sections, "article": split_articles, "semantic": _semantic}


def chunk(docs: DataFrame, strategy: str, **options) -> DataFrame:
    """By the name of a strategy, numbered in chunk_index; an unknown one is an error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](docs, **options).withColumnRenamed("section_id", "chunk_index")
