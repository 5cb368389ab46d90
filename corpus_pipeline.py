"""A corpus made ready for training: toxic documents go, then all but one of each group of near duplicates, then those that hold
benchmark passages; secrets are masked in what is left, and it is packed into sequences.

Every stage works on all rows its predecessor kept; what it writes is Parquet in the shared folder. All but the last return
the columns of their input.

A null text counts as empty and stays null until it is packed as one end id. A null doc_id is a row as any other: it is judged by its
own text, and comes after all doc_ids where one of a group stays. Of rows that repeat in doc_id and text, and of all near duplicates,
one stays: that of least doc_id, then of least hash of the text. Other columns, of whatever name, are carried along. An empty table
gives an empty one. Without labels nothing is toxic; without benchmark items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlode.llm import decontamination, near_dedup, packing, secrets, toxicity
from textlode.llm.common import documents, materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Nearest neighbours, SimHash and tokenizers are beyond SQL.
ORACLE_SQL = None
