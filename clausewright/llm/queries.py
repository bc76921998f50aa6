"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, context_tree, embedding_dedup, hard_negatives, html_extract, jaccard_join, packing, quality_classifier, quality_rules, source_mix, token_counts, url_filter, whitening


def vocabulary(name: str):
    """A function that finds a public vocabulary file where it runs."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def _held(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classifier(spark: SparkSession, sf_dir: str):
    """Learns from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    return quality_classifier.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~_held("doc_id"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(_table(spark, sf_dir, "documents"), classifier(spark, sf_dir))
    return scored.select("doc_id", _held("doc_id").alias("held_out"), "score", "predicted")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("score")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.expand(talks)).drop("n_examples")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(_table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row asks; every seventh row is given the label after its own."""
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), number % 100 == 0, label, lambda x: F.floor(256 * x))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the texts whose crc32(doc_id) mod 5 is not 1."""
    return context_tree.score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filter": op3_url_filter,
    "op4_chat_format": op4_chat_format,
    "op5_html_extract": op5_html_extract,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_lm_score": op13_lm_score,
}
