"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``; further columns that ``docs`` may have are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegauge.llm import decontaminate, langid, mixing, neardup, pii
from sourcegauge.llm.common import NO_ID, free_names, table, text_of
from sourcegauge.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Posterior that a document's language must have.
MIN_SCORE = 0.5


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the key by which operators name documents, and the names of its columns, which ``docs`` does not have."""
    names = free_names(docs, "x_k1", "x_k2")
    return docs.withColumns(dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text_of()))))), names


def _keys(found: DataFrame, names: list[str]) -> DataFrame:
    return found.select(*[F.col(k).alias(name) for k, name in zip(("k1", "k2"), names)]).distinct()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is in doubt, go. Models are learned from ``docs`` itself."""
    named = langid.identify(docs, langid.train(docs))
    return named.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id; of rows equal in id and text, one."""
    rows, names = _keyed(docs)
    keep = _keys(neardup.near_duplicates(docs).where("kept"), names)
    return rows.join(keep, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    rows, names = _keyed(docs)
    found = _keys(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")), names)
    return rows.join(found, names, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind; n_chars follows."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes of a document, numbered from 1, with the mix's figures."""
    mixed = mixing.mix(docs).where("copies > 0")
    (name,) = free_names(mixed, "copy")
    return mixed.withColumn(name, F.explode(F.sequence(F.lit(1), F.col("copies"))))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_to_weights),
]

#: The language model of stage 1 and the sketches of stage 2 have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
