"""The queries op1 to op10: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import chat, decontaminate, html_extract, jaccard_join, language_id, line_dedup, lm_score, merkle, sentencepiece_bpe, toxicity
from tallyspark.llm.common import fold_of, partitions, table

CONTROL_TURN = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; other paths can be given to the operator itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], "conv_id long, turn long, role string, text string"
    )
    events = chat.events_of_turns(turns).unionByName(chat.events_of_turns(extra))
    return chat.digests(chat.render(chat.fold(events)), in_order=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_join.join(docs, n=4, per_cent=85).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "__toxicity.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "__lang.lang_pred", "__lang.score", "__lang.known")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepiece_bpe.digests(docs, tokenizer_path("piece_bpe_32k.model"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lm_score.score(docs, fold_of(F.col("doc_id"), 5) == 1)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(table(spark, sf_dir, "documents", "doc_id", "text"), partitions(spark))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = html_extract.extract_pages(pages).select("page_id", "url", "text")
    return found.withColumn("n_chars", F.length("text").cast("long"))
