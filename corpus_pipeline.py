"""A training-data pipeline over documents: quality rules, near duplicates, personal data, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import bpe, chosen_path, decision_list, fair_mix, pii
from casemill.llm.common import materialize, table, temporaries

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the base rule nor a learned rule rejects; a null or empty text is rejected. Columns named like counts stay as they are."""
    rules = decision_list.train(docs, table(spark, sf_dir, "labels"))
    whole = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    kept = decision_list.statistics(whole).where(~decision_list.base_failed() & decision_list.expression(rules))
    return kept.select(*[c if c == "text" else f"row.{c}" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts linked by a similarity of 0.8 or more: that of the least doc_id."""
    return chosen_path.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind; n_chars follows the new text."""
    masked = pii.find(docs, spans="__pii", masked="text")
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to three times."""
    return fair_mix.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every row."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: Learned rules and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read back, and removed after the next one."""
    docs = table(spark, sf_dir, "documents")
    with temporaries(spark, STAGES[-2][0]):
        for name, stage in STAGES[:-1]:
            with temporaries(spark, name):
                docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
