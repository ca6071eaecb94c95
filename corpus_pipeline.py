"""Corpus pipeline: quality, near duplicates, personal data, mix, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result
to the shared folder and reads it back as the documents of the next stage.

Defined cases, for every stage: null ids, texts, sources and languages are kept as values of their
own; an empty table gives an empty result; columns beyond those of documents are kept as they are by
all stages but the last, whatever their names, which reads none of them; ties are decided as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import mixing, ngram_join, packing, pii, quality
from lodestar.llm.common import materialize, read


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Repeated rows score alike; an empty text is judged by its metadata; without labels of both classes all stay."""
    return quality.filter_good(docs, read(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Blank texts are near nothing; rows alike in id, text and source are one."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; ``n_chars`` follows the text (null for a null text). Texts without any stay as they are."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, twice at most. Texts without words take no part; rows that share an id and a source are taken together."""
    return mixing.repeat(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens. A null text is an empty one; each of repeated rows is packed."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", distinct_documents),
    ("pii", without_personal_data),
    ("mixing", mixed_documents),
    ("best_fit_packing", packed_sequences),
]

#: A trained classifier and tokenizer can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
