"""A training corpus from documents: quality, near-duplicates, secrets, mixing, token ids.

Each stage takes all rows its predecessor kept; all but the last give rows with the columns of
documents. Between stages the rows are a table in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm import bpe, mixing, quality, secrets, simhash
from alertloom.llm.tables import documents
from alertloom.operators.durable import written_once

# Every leaf keeps its weight in the whole of what is left; small ones may be read twice.
TARGETS = mixing.Targets(
    domains={"d0": 1, "d1": 1, "d2": 1, "d3": 1}, langs={"en": 4, "de": 2, "fr": 2, "es": 1}, budget_percent=100, max_epochs=2, seed=7
)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    ledger = secrets.Ledger(spark)
    secrets.scan_new(docs, ledger)
    return secrets.without_secrets(docs, ledger)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their sources' weights, once for each epoch they are taken in."""
    return mixing.mixed(docs, TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens): the ids of each document's text."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("doc_id", "lang", "source"))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", good_quality),
    ("simhash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("bpe encoding", token_ids),
]

# SQL has no fingerprints and no merges; the stages are tested one by one against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
