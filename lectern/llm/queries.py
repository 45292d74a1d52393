"""One query per operator, with production parameters, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import BASE, find_pii

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(said(F.filter("pii", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; a parameter of every function that reads one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mpeg import audio_columns

    return audio_columns(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.ngram_join import ngram_jaccard

    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).drop("n_repeated")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), epochs=1.0, seed=17).select("doc_id", "source", "copy", "shuffle_key", "text")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.weak_labels import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).drop("via")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.hard_negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy), F.col("vec_id") % 50 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.conversations import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_mix_sources, op3_quality_classifier, op4_quality_rules, op5_pii, op6_licences, op7_bpe, op8_mpeg_audio, op9_suffix_array, op10_ngram_jaccard, op11_url_filter, op12_hard_negatives, op13_conversation_repair)
}
