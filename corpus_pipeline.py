"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's documents. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontam, minhash, mixing, quality, secrets
from marlstone.llm.common import remove, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones selects.

    Null and empty texts weigh 0; rows of one doc_id and text, and ties at the cut, stay or go
    together; without labels of good documents all stay. Columns stay as they are.
    """
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates.

    Null and empty texts and rows without doc_id stay; of rows that repeat each other wholly one stays.
    """
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay, rows without doc_id are looked at by their text, repeated rows go or stay together."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts. Null and empty texts and repeated rows stay as they are."""
    return secrets.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that is taken, with its text and all columns, and the number of times.

    Documents without words are never taken; null sources are one source; of rows with one doc_id, source and size the
    first ones are taken; rows with one doc_id, source and text come out as one, with the copies of all.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]
#: SQL can express neither the models nor the similarity joins; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What lies between them is in the cluster's shared folder and removed when the next stage
    is written; the table before the mix stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{quote(name)}")
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
