"""From raw documents to tokens, in five stages; each reads what its predecessor kept, as a table.

Defined results: a null or empty text has no words, so the rules reject it; a stage that is given one keeps it (near
duplicates, personal data) or gives it no copies if its source has no characters at all (mix), and it has no tokens. Rows
without an id are judged like others, and none of them is dropped as a near duplicate. All rows of a component's smallest id stay, so
repeated rows of one id stay together. Texts of any length are read whole. Columns beyond those of documents, whatever their
names, pass through all stages but the last. An empty table gives an empty table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import round_trip_digests
from lectern.llm.common import table, written
from lectern.llm.mixing import mix_sources
from lectern.llm.ngram_join import ngram_jaccard
from lectern.llm.pii import find_pii, redact
from lectern.llm.quality_rules import quality_rules
from lectern.llm.queries import tokenizer_file

#: Seed and size of the mix, as a multiple of the characters that reach it.
SEED, EPOCHS = 17, 1.0


def whole(docs: DataFrame) -> DataFrame:
    """Each row as one column, so that no column of an operator meets one of its own; with the id and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("text"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and every quality rule accept."""
    # The verdict goes through a generator: a filter on it would be moved below the steps that compute the metrics and
    # compute them anew for every rule.
    return quality_rules(whole(docs)).withColumn("_keep", F.explode(F.array("kept"))).where("_keep").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near duplicates; documents without an id all stay."""
    others = ngram_jaccard(docs.select("doc_id", "text")).where("doc_id != component_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, docs["doc_id"] == others["_other"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with <KIND> for each span of personal data; n_chars follows the new text."""
    clean = redact(find_pii(whole(docs)))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same share of characters in expectation, shuffled."""
    return mix_sources(docs, epochs=EPOCHS, seed=SEED, copy="_mix_copy", shuffle_key="_mix_key").drop("_mix_copy", "_mix_key")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text decoded from them."""
    return round_trip_digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("ngram_jaccard", near_duplicates), ("pii", personal_data), ("mix_sources", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages stands a written table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs


#: SQL has no BPE merges; tests hold the stages against brute force.
ORACLE_SQL = None
