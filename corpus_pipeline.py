"""A training corpus from `documents` in five stages, each written as Parquet and read again by the next.

language        rows whose language is not known go
near_duplicates one document of each class of near duplicates stays
secrets         secrets in texts are masked; every row stays
mix             rows are taken as often as their source's target says
pack            token ids in sequences of 1,024, with the pieces' ids
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_before: list[str] = []


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """Frees the work tables of the stage before: its rows are written when the next one begins."""

    @wraps(make)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        from tracelens.llm import common

        common.delete(spark, _before)
        _before.clear()
        since = common.mark()
        out = make(spark, docs, sf_dir)
        _before.extend(common.taken(since))
        return out

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tracelens.llm.language import in_known_language

    return in_known_language(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tracelens.llm.near import one_of_each

    return one_of_each(docs)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tracelens.llm.secrets import without_secrets

    return without_secrets(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tracelens.llm.mixing import mixed

    return mixed(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tracelens.llm.packing import pack
    from tracelens.llm.queries import vocabulary

    return pack(docs, vocabulary("byte_bpe_50k.json"), "byte")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", packed)]

#: No stage's method can be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages over sf_dir's documents."""
    from tracelens.llm import common

    docs = common.documents(spark, sf_dir)
    folder = f"{common.scratch_root(spark)}/llm-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
