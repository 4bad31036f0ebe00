"""Queries of the training-data operators, each over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import bpe, chosen_path, decision_list, exact_dedup, fair_mix, hilbert, licenses, periodic_runs, pii, prefix_forest, prefix_trie, token_count, toxicity
from casemill.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its ids and decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of equal rows."""
    return hilbert.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links at five words and 0.8."""
    return chosen_path.join(table(spark, sf_dir, "documents"))


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest others of every vector whose id is divisible by twenty."""
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, the base rule's verdict and the list's."""
    return decision_list.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix."""
    return fair_mix.report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return pii.report(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, and its text without their repetitions."""
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its exact copies."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_hilbert": op2_hilbert,
    "op3_toxicity": op3_toxicity,
    "op4_chosen_path": op4_chosen_path,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_decision_list": op6_decision_list,
    "op7_fair_mix": op7_fair_mix,
    "op8_licenses": op8_licenses,
    "op9_token_count": op9_token_count,
    "op10_pii": op10_pii,
    "op11_runs": op11_runs,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op7_fair_mix": fair_mix.ORACLE,
    "op8_licenses": licenses.oracle(),
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
