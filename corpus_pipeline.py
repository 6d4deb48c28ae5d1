"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secret scan, token ids.

Each stage is a function of (spark, docs, sf_dir): docs is what the stage before kept, sf_dir the folder of the other
tables. All but the last return the columns of documents. run() writes what each stage returns as Parquet in the shared
folder and reads it again for the next, so a lost executor costs a stage's tasks and not the pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import bpe, decontaminate, join, rules, secrets
from tidelens.llm.common import written
from tidelens.llm.queries import tokenizer_path


ENCODE_BYTES = 2 << 20  # of text in a block of the last stage: its workers share the executor with what came before


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.keep(docs, rules.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id."""
    return join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and n_chars as the new text has."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return clean.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    return bpe.encode(docs, tokenizer_path(), output="ids", block_bytes=ENCODE_BYTES)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", token_ids),
]

#: No SQL: the field of the first stage is a trained model, and the last stage's ids are a tokenizer's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
