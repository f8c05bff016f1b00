"""A training corpus in four stages, each over all that the stage before it kept.

Quality first, then one document of each group of near copies, then passages that earlier
documents have, then packed sequences of ids. Each stage's rows are written as Parquet into the
folder that all executors share and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelgrid.llm import jaccard, packing, quality, shared, substring


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of documents in the input.

    A null or empty text is scored like any other; rows without an id are scored, but not learned from; rows that share an id
    are judged each on its own; without labels all rows stay; an empty table stays empty. All columns stay as they are."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: shingles of five words, a Jaccard similarity of
    0.8 or more.

    Rows without words or without an id are linked with nothing and stay; of rows that share an id, one of each set of
    shingles stays, the least by its text and then by all columns; an empty table stays empty. All columns stay as they are."""
    return jaccard.representatives(docs, k=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words inside windows of 13 words that an earlier document has.

    A null text stays null; a text that loses nothing stays sign by sign, one that loses all becomes empty; rows without an
    id lose nothing, and rows that share an id nothing to each other; an empty table stays empty. Of the other columns
    only ``n_chars`` changes, where a text does."""
    return substring.shortened(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of at most 1024 ids.

    A null or empty text is one end id; rows that share an id or have none are packed each on its own; a text of any length
    is packed whole; an empty table gives no pieces. Only ``doc_id`` and ``text`` are read."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("substring", substring_stage), ("packing", packing_stage)]

#: Trees, hashes of all windows and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
        shared.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
