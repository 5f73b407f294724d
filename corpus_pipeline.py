"""A training-corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; it is written as Parquet and read again as the next stage's docs.  All stages but the
last return the columns of ``documents``.

Cases with a defined result
    null, empty or very short text: rejected by the quality rules; very long text: read whole by every stage
    null id, repeated rows and ids: as each stage's module says; ties: by least id
    extra columns of any name: carried to the last stage, which returns its own
    empty tables: an empty result
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from shelfmark.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the check that they decode to its text, as digests."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing sources", mix),
    ("bpe", tokens),
]

#: Trained weights, fingerprints and drawn copies have no SQL form; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
