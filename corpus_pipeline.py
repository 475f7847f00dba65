"""From raw documents to token ids: five stages, each an operator of the library at work on what the one before kept.

Every stage but the last returns the columns of `documents`; its result is written as Parquet and read again
as the next one's input. The stages: documents that repeat themselves go; of each group of near-duplicates the one
with the least id stays; secrets are masked in the text; sources are mixed to their target weights (a document
comes as often as the mix takes it); texts become token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, mixing, neardup, repetition, secrets
from granary.llm.common import documents, scratch, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return repetition.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.deduplicate(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # the workers have served the stages before: a small cache leaves them room
    return bpe.encode(docs, columns=("doc_id", "lang", "source"), cache=120_000)


#: (name, stage); a stage takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("secret_scan", mask),
    ("source_mix", mix),
    ("bpe_encode", encode),
]

#: SQL expresses neither suffix arrays nor near-duplicates; tests/llm holds `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
