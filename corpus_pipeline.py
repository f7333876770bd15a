"""The training-data pipeline: filter, deduplicate, redact and pack a corpus.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the
last return the columns of documents, whatever these are called.

Defined results, for every stage: an empty table gives an empty result; null text counts as empty;
repeated rows are rows of their own, but copies for the near-duplicate stage, where all rows of the doc_id that
stays remain; ties go to the smallest doc_id there and to the largest in the line stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import materialize, scratch, table
from logweave.llm.line_dedup import line_dedup
from logweave.llm.near_dedup import keep_first
from logweave.llm.packing import best_fit_packing
from logweave.llm.pii import redact
from logweave.llm.quality import keep_good
from logweave.llm.queries import TOKENIZER


def _resized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs in the given columns, with n_chars following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    return _resized(line_dedup(docs, counts=False), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_first(docs, width=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _resized(redact(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces placed in sequences."""
    return best_fit_packing(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers are beyond SQL; tests hold the operators of the other stages
#: against brute force, and the whole for what its stages promise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written before the next one starts, and
    what it needed in between is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
