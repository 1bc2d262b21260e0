"""What the text operators share: input columns, Arrow helpers and label samples."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: a null text counts as empty, other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def lowered(text: F.Column) -> F.Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only, in Python."""
    return text.encode().lower().decode()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc ids, texts) of at most SLICE_ROWS rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside take so many rows a batch, so that batches of texts, which both sides hold, stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(doc_id: F.Column, parts: int) -> F.Column:
    """crc32 of the id's text, modulo parts: how labelled rows are held out."""
    return F.crc32(doc_id.cast("string")) % F.lit(parts)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> list[tuple[str, int]]:
    """A bounded training sample: labelled rows of the training folds whose text docs holds, in
    order of a hash of their id, at most ``rows`` of them and ``most_bytes`` bytes of text in all.

    Labels are joined with docs before they are ordered and cut, so labels of other documents take
    no place. A text is passed over only where it no longer fits into the bytes left. Rows with a null id or
    label are left out; of several labels of one id the largest holds, of several texts the greatest.
    Without usable labels, or without documents, there is nothing to learn: the sample is empty, with a
    warning. Labels that fit none of the documents are an error.
    """
    labelled = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .where(fold(F.col("doc_id"), 5) != 0)
    )
    texts = id_and_text(docs)
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).where(F.col("size") <= most_bytes)
    first = sizes.join(labelled, "doc_id").groupBy("doc_id", "y").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    chosen, left = [], most_bytes
    for r in first:
        if r.size <= left:
            chosen.append((r.doc_id, r.y))
            left -= r.size
    if not chosen:
        if not labelled.isEmpty() and not docs.isEmpty():
            raise ValueError(f"none of the labels in {label} that may be learnt from belongs to a document of at most {most_bytes} bytes")
        warnings.warn(f"nothing to learn {label} from: all scores will be 0.5", stacklevel=2)
        return []
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int")
    picked = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))  # broadcast: at most ``rows`` rows
    return [(r.text, r.y) for r in picked.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
