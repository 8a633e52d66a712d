"""A corpus pipeline of the llm operators: each stage reads what the one before it wrote.

Ids are taken to be unique: a stage that drops an id drops every row that has it; rows with a null id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.bpe import encode_bpe
from calibrant.llm.common import labelled_sample, stored, table, with_ids
from calibrant.llm.decontaminate import contamination
from calibrant.llm.exact_dedup import exact_dedup
from calibrant.llm.near_dedup import near_components
from calibrant.llm.queries import BYTE_BPE
from calibrant.llm.toxicity import TRAIN_ROWS, drop_toxic, fit_severity


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    return with_ids(docs, stored(dropped.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), f"pipeline-{name}"), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on a bounded sample of labels, doesn't call toxic."""
    return drop_toxic(docs, fit_severity(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", TRAIN_ROWS)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return _without(docs, exact_dedup(docs, keep="largest").where("NOT kept"), "copies")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (5-word shingles, similarity 0.8 or more), the one with the smallest id."""
    return _without(docs, near_components(docs, words=5, percent=80).where("NOT kept"), "near")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows of 13 words don't hit a twentieth of the words."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark"), length=13).where("contaminated"), "contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return encode_bpe(docs, BYTE_BPE, keys=("doc_id", "lang", "source"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontaminate), ("bpe", encode)]

#: No SQL expresses the fitted model and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
