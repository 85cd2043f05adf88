"""Documents through the filters of a training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardwatch.llm import decontaminate, ngram_join, piece_codec, pii, toxicity
from cardwatch.llm.base import prepare, stash, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. The model learns from labelled documents outside its held-out third."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.fold(3, 1)))
    return toxicity.clean_rows(docs, model)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of similar documents."""
    prepare(spark)
    return ngram_join.one_of_each(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    prepare(spark)
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the token ids of their texts."""
    prepare(spark)
    return piece_codec.encode(docs, piece_codec.read_vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_per_group),
    ("decontamination", reject_contaminated),
    ("pii", redact_personal),
    ("sentencepiece", encode_pieces),
]

# Learned lexicons and Viterbi paths are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again by the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
