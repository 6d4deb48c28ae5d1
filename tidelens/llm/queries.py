"""Queries opN_<name> and pipeline, over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelens.llm import bpe, chat, decontaminate, html, join, lm, rules, secrets, shard, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers keeps a file, on the driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.document_scores(_table(spark, sf_dir, "documents"))


def op3_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, _table(spark, sf_dir, "labels")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.document_shards(_table(spark, sf_dir, "documents"), 24)


def op8_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    import corpus_pipeline

    found = {f.__name__: f for f in (op1_chat_perspectives, op2_backoff_scores, op3_line_labels, op4_jaccard_join, op5_secret_scan, op6_kd_shards, op7_main_text, op8_bpe_word_table, op9_warc_round_trip, op10_benchmark_leaks)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_perspectives": chat.SQL, "op4_jaccard_join": join.SQL, "op5_secret_scan": secrets.SQL, "op9_warc_round_trip": warc.SQL, "op10_benchmark_leaks": decontaminate.SQL}
