"""A training corpus from raw documents: language, exact and near copies, benchmark
passages, packed sequences. Every stage works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import stored, table
from rankloom.llm.decontaminate import decontaminate
from rankloom.llm.exact_dedup import deduplicate
from rankloom.llm.language_id import fitted, identify
from rankloom.llm.ngram_join import first_of_groups
from rankloom.llm.packing import pack
from rankloom.sources.files import temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model rejects: texts without a letter, and scores below
    its calibrated threshold."""
    return identify(docs, fitted(docs)).where("NOT rejected").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of equal texts, the one of the largest id."""
    return deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of the smallest id. Rows of
    one id are told apart by the size of their set and their text: each stays if its own
    text is the one that stands for its group, or is linked with none."""
    return first_of_groups(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of a benchmark item; other rows of the same id stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in their sequences, with their token ids."""
    return pack(docs)


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("ngram_join", near_copies), ("decontaminate", without_benchmark), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's documents are deleted when the next ones are
    written, and what an operator stored on its way goes with its stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name, instead_of=docs))
    return STAGES[-1][1](spark, docs, sf_dir)
