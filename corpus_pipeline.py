"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, tokens.

Every stage but the last takes and returns the columns of documents; each works on all that the one before it kept.
A stage's result is written as Parquet to the shared scratch folder and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, ngram_join, secrets, toxicity
from millrace.llm.common import crc_mod5, stored, table

#: Near duplicates: word n-grams and the similarity, in hundredths.
SHINGLE, SIMILARITY = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay. The model learns from the labelled documents of the table, as op4's does."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod5() != 0)
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the row with the smallest doc_id stays, and one row alone where an id repeats.
    Documents without words are in no group; rows that share an id, or have none, are judged by their texts."""
    return ngram_join.deduplicated(docs, SHINGLE, SIMILARITY, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, each row by its own text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of secrets are masked and n_chars follows."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of the ids and of what they decode to. Null texts are empty."""
    import public_tokenizers

    # the key travels with its document's other columns, so that rows with one id aren't joined with each other
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    out = bpe.encode_texts(keyed, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, key="key")
    return out.select("key.doc_id", "key.lang", "key.source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]

#: SQL can express neither the learnt models nor the tokens; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
