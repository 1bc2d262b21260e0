"""Exact dedup by a minimal perfect hash over historical digests.

The digest of a text is SHA-256 of its UTF-8 bytes after lower-casing A-Z. The history's
distinct digests are spread over buckets of bounded expected size; each bucket holds a
minimal perfect hash (levels of bit arrays, in which a key settles where it is alone) and,
by slot, the full digest, the winner's doc_id and the number of copies. A new batch is first
grouped by digest, which collapses hot groups before any shuffle, then looks its distinct
digests up in their buckets: a slot counts only if its 32 bytes are equal. Digests that the
history lacks group among themselves.

Nulls and edge cases: a null text is the empty text; rows with a null doc_id belong to their
group and count, and win only if no row of the group has an id; repeated rows count each; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_and_text, lowered
from lamina.session import Workspace

#: Expected digests of a bucket; with 48 bytes each this bounds a task's memory.
BUCKET_KEYS = 20_000
#: Bits of a level for each key that is still unsettled.
GAMMA = 2.0
MAX_LEVELS = 32

INDEX_SCHEMA = "bucket long, sizes array<long>, bits binary, digests binary, winners array<long>, copies array<long>, rest binary, rest_winners array<long>, rest_copies array<long>"


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[:, 0] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)) * (words[:, 1] | np.uint64(1))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)


def build_hash(digests: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, the levels' bits, the slot of each digest, and which digests stay without one."""
    words, slots = _words(digests), np.full(len(digests), -1, dtype=np.int64)
    left, sizes, bits, base = np.arange(len(digests)), [], [], 0
    while len(left) and len(sizes) < MAX_LEVELS:
        size = max(8, int(GAMMA * len(left)) // 8 * 8 + 8)
        at = _place(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[settled]] = base + rank[at[settled]]
        base += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~settled]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slots, left


def find_slots(digests: list[bytes], sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The only slot that a digest can have; -1 if it has none."""
    words, slots = _words(digests), np.full(len(digests), -1, dtype=np.int64)
    rank, left, start = np.cumsum(bits) - 1, np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = start + _place(words[left], level, size)
        hit = bits[at]
        slots[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return slots


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("digest")
    digests = [bytes(x) for x in pdf["digest"]]
    sizes, bits, slots, rest = build_hash(digests)
    order = np.argsort(slots, kind="stable")[len(rest):]
    winners, copies = pdf["winner"].astype("Int64").tolist(), pdf["copies"].tolist()
    pick = lambda values, at: [None if values[i] is pd.NA else values[i] for i in at]
    return pd.DataFrame(
        [[pdf["bucket"].iloc[0], sizes, np.packbits(bits).tobytes(), b"".join(digests[i] for i in order), pick(winners, order), pick(copies, order), b"".join(digests[i] for i in rest), pick(winners, rest), pick(copies, rest)]],
        columns=["bucket", "sizes", "bits", "digests", "winners", "copies", "rest", "rest_winners", "rest_copies"],
    )


def _lookup(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = {"digest": keys["digest"], "winner": keys["winner"], "copies": keys["copies"], "old_winner": None, "old_copies": None}
    if len(keys) and len(index):
        row, digests = index.iloc[0], [bytes(x) for x in keys["digest"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        slots = find_slots(digests, list(row["sizes"]), bits)
        held, rest = row["digests"], {row["rest"][32 * i : 32 * i + 32]: i for i in range(len(row["rest"]) // 32)}
        winners, copies = [], []
        for digest, slot in zip(digests, slots):
            if slot >= 0 and held[32 * slot : 32 * slot + 32] == digest:  # byte by byte
                winners.append(row["winners"][slot])
                copies.append(row["copies"][slot])
            elif digest in rest:
                winners.append(row["rest_winners"][rest[digest]])
                copies.append(row["rest_copies"][rest[digest]])
            else:
                winners.append(None)
                copies.append(None)
        out |= {"old_winner": pd.array([None if x is None or x != x else int(x) for x in winners], dtype="Int64"), "old_copies": pd.array([None if x is None else int(x) for x in copies], dtype="Int64")}
    return pd.DataFrame(out, index=keys.index)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte digest of every row."""
    return id_and_text(docs).select("doc_id", F.unhex(F.sha2(lowered(F.col("text")), 256)).alias("digest"))


def digest_keys(rows: DataFrame) -> DataFrame:
    """One row for each digest: its largest doc_id and number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def build_index(keys: DataFrame, buckets: int) -> DataFrame:
    """The index: a row for each bucket of historical digests."""
    return keys.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """The batch's digests with old_winner and old_copies, null for those that the index lacks."""
    return (
        keys.withColumn("bucket", _bucket(buckets))
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(_lookup, "digest binary, winner long, copies long, old_winner long, old_copies long")
    )


def exact_dedup(history: DataFrame, batch: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Every row of history and batch with the row of its group that stays.

    Returns doc_id, digest (binary), keep_id, group_size and kept. The largest doc_id of a
    group of equal normalised texts stays, wherever it came from.
    """
    work = Workspace(history.sparkSession, "exact")
    rows = work.keep(digest_rows(history).withColumn("old", F.lit(True)).unionByName(digest_rows(batch).withColumn("old", F.lit(False))), "rows")
    old = work.keep(digest_keys(rows.where("old")), "keys")
    buckets = max(1, -(-old.count() // bucket_keys))
    found = work.keep(lookup(digest_keys(rows.where(~F.col("old"))), build_index(old, buckets), buckets), "found")
    groups = found.select("digest", F.greatest("winner", "old_winner").alias("keep_id"), (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("group_size")).unionByName(
        old.join(found.where("old_copies is not null").select("digest"), "digest", "left_anti").select("digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"))
    )
    return rows.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def split_history(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table that has no history of its own: half of its rows, by a hash of the id, stand for it."""
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs.where(old), docs.where(~old)


def dedup_table(docs: DataFrame) -> DataFrame:
    return exact_dedup(*split_history(docs))
