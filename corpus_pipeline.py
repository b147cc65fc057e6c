"""A training corpus from raw documents: five stages, each written and read again.

Every stage takes an empty table, null and shared doc_ids, and columns besides
those of documents, whatever their names; all but the last return the columns
they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegrain.llm.common import read_table, stage
from casegrain.llm.decontaminate import drop_leaks
from casegrain.llm.packing import pack
from casegrain.llm.quality import keep_good
from casegrain.llm.simhash import keep_one
from casegrain.llm.suffix_dedup import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them, repeated rows go or stay together."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, repeated rows included; rows that share a doc_id, or have none, aren't thereby duplicates."""
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier too go from the texts; every row stays, a null text null."""
    return drop_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go; null and empty texts hold none."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays is cut to the context, in tokens of the sentencepiece model, and dealt to batches; an empty text is one piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: The model, the fingerprints and the retrieval have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
