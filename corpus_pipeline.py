"""A corpus from raw documents to packed sequences, stage by stage.

Each stage works on all that the one before kept, is written as Parquet in the shared folder
and read again. Quality drops documents that the classifier rejects; exact dedup keeps the
largest id of equal texts; near dedup keeps the smallest id of each group of texts with a
five-word Jaccard similarity of 0.8 or more, linked directly or through others;
decontamination drops documents that hold a benchmark passage; packing returns the pieces of
what is left with their sequences.

A decision is taken for a row, not for an id. While every row has an id of its own, the id names
it; where ids are null or stand in several rows, a stage's rows are numbered in order of their
ids, nulls first, and rows with one id in order of their texts, and the number stands for the id.
So one row of each group of copies stays, whatever ids they have. Empty tables stay empty;
further columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, exact_dedup, jaccard, packing, quality
from lamina.llm.common import arrow_rows, table
from lamina.operators.numbering import ordered_ids
from lamina.session import Workspace

#: Words of an n-gram and least similarity, in hundredths, of near duplicates.
NEAR_WORDS, NEAR_SIMILARITY = 5, 80
#: Rows of an Arrow batch in every stage that takes them: both the JVM and Python hold a batch of texts.
BATCH_ROWS = 500
#: Words that a Python worker keeps for packing, a tenth of what packing alone would: workers live through all stages, beside
#: a JVM whose heap near dedup has filled.
PACK_WORDS = 50_000


def _without(docs: DataFrame, name: str, dropped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that ``dropped`` names by doc_id, of a table of doc_id and text with an id for each row."""
    work, key, gone = Workspace(docs.sparkSession, name), "doc_id", f"gone_{uuid.uuid4().hex}"
    columns = docs.columns
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        key = f"row_{uuid.uuid4().hex}"
        docs = work.keep(ordered_ids(docs.select("doc_id", "text", F.struct(*columns).alias("columns")), ["doc_id", "text"], key, work), "numbered").select(key, "columns.*")
    named = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        listed = work.keep(dropped(named).select(F.col("doc_id").alias(gone)).distinct(), "gone")  # written, so that its size is known and it is broadcast only if small
    return docs.join(listed, docs[key] == listed[gone], "left_anti").select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))  # lazy: a written copy of the texts would stay on disk through all stages


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, "copies", lambda d: exact_dedup.dedup_table(d).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, "near", lambda d: jaccard.jaccard_components(d, NEAR_WORDS, NEAR_SIMILARITY, 100).where("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, "contaminated", lambda d: decontaminate.find_overlaps(d, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with arrow_rows(spark, BATCH_ROWS):
        return packing.pack_documents(docs, words=PACK_WORDS)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: SQL can't train the classifier or run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next stage's is written."""
    work, docs, before = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        work.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
