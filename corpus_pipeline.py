"""From raw documents to training sequences, in stages that each read what the one before kept.

All stages take null and empty texts, repeated rows, rows without an id, further columns and empty tables: such texts
hold no shingle, window or benchmark item, so only the classifier can reject them; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacatlas.llm.common import source, stored
from vacatlas.llm.decontaminate import remove_contaminated
from vacatlas.llm.neardup import keep_one
from vacatlas.llm.packing import pack
from vacatlas.llm.quality import keep_quality, train
from vacatlas.llm.queries import BYTE_BPE
from vacatlas.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least 0.3; it is fitted on labelled documents outside its held-out fold."""
    return keep_quality(docs, train(docs, source(spark, sf_dir, "labels", "doc_id", "quality")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles of similarity 0.8 or more."""
    return keep_one(docs, 5, (4, 5))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that stand anywhere else too; n_chars follows."""
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = remove_repeats(docs, carry=carried)
    if "n_chars" in carried:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    return remove_contaminated(docs, source(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return pack(docs, BYTE_BPE)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings),
    ("decontamination", decontamination), ("packing", packing),
]

#: A fitted network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole of ``documents``, each result written and read again."""
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
