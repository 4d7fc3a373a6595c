"""Corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens. Each stage works on what the one before has kept."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import jaccard, mixing, pieces, pii, toxicity
from tessella.llm.common import cut


def _find_here(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on labelled rows of docs outside the held-out quarter. A null text
    scores as one without a toxic word and stays; without labels the public list decides."""
    _find_here(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by five-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays.
    Rows without text or without a doc_id stay."""
    _find_here(spark)
    return jaccard.one_of_each(docs, words=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become surrogates; n_chars follows. A null text stays null, an empty table empty; every row stays."""
    _find_here(spark)
    columns = docs.columns
    return _measured(pii.pseudonymise(docs)).select(columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each a whole text. Rows without a word are never drawn."""
    _find_here(spark)
    return _measured(mixing.mixed_documents(docs, whole=True)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, with parity and round trip. A null or empty text has none; an empty table gives an empty one."""
    _find_here(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "source", "lang"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: No stage but the third can be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
