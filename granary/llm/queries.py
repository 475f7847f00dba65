"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from granary.llm import bpe, classifier, classlm, fingerprints, linkgraph, mixing, neardup, packed, repetition, secrets
from granary.llm.common import documents, ship, spread, table


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repetition_rules": lambda spark, sf_dir: repetition.quality(documents(spark, sf_dir)),
        "op2_prob_minhash": lambda spark, sf_dir: neardup.classes(documents(spark, sf_dir)),
        "op3_sainte_lague_mix": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir)),
        "op4_ftrl_quality": lambda spark, sf_dir: classifier.digest(documents(spark, sf_dir), table(spark, sf_dir, "labels")),
        "op5_packed_ids": lambda spark, sf_dir: packed.digest(documents(spark, sf_dir)),
        "op6_fingerprints": lambda spark, sf_dir: fingerprints.digest(documents(spark, sf_dir)),
        "op7_bpe_backtrack": lambda spark, sf_dir: bpe.digest(documents(spark, sf_dir)),
        "op8_class_lm": lambda spark, sf_dir: classlm.digest(documents(spark, sf_dir)),
        "op9_link_graph": lambda spark, sf_dir: linkgraph.judge(spread(table(spark, sf_dir, "pages")), linkgraph.CONTRACT),
        "op10_secret_scan": lambda spark, sf_dir: secrets.digest(documents(spark, sf_dir)),
        "pipeline": corpus_pipeline.run,
    }


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_sainte_lague_mix": mixing.ORACLE, "op9_link_graph": linkgraph.oracle()}
