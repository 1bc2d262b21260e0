"""Benchmark decontamination by a broadcast hash set of n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is WINDOW
consecutive words of an item; an item of fewer words, but not none, is one window. Windows
of the benchmark form sorted arrays of 64-bit hashes and a table of their words; a document's
windows are hashed in one pass, and each hit is verified word by word.

The benchmark is broadcast only in blocks of at most BLOCK_WINDOWS windows, whatever its
size and that of its items; each block is a pass over the documents and the passes' spans are united. Null or empty
texts have no words and no hits; items without words never occur; items with equal ids are
one item, and those with a null id are one item without a name: it hits and is counted, as a null
among the items found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ascii_lower, id_and_text, slices
from lamina.session import Workspace

WINDOW = 10
#: Windows of a broadcast: some 600 bytes each in every Python worker, so 90 MB, and the words.
BLOCK_WINDOWS = 150_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(ascii_lower(text))


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` word hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(ids) - length + 1), np.uint64)
        for i in range(length):
            out = out * MULTIPLIER + ids[i : i + len(out)]
    return out


class WindowSet:
    """The windows of a block of items: by length, sorted hashes; by hash, words and items."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        windows: dict[tuple[str, ...], set] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1)) if words else ():
                windows[tuple(words[i : i + window])].add(item)
        self.word_ids = {w: np.uint64(xxhash.xxh3_64_intdigest(w) | 1) for run in windows for w in run}
        self.by_length: dict[int, np.ndarray] = {}
        self.at: dict[tuple[int, int], list] = defaultdict(list)
        for run, owners in windows.items():
            h = int(_hashes(np.array([self.word_ids[w] for w in run], np.uint64), len(run))[0])
            self.at[len(run), h].append((run, sorted(owners, key=str)))
        for length in {n for n, _ in self.at}:
            self.by_length[length] = np.array(sorted(h for n, h in self.at if n == length), np.uint64)

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words (start, end) covered by windows, united, and the items found."""
        zero = np.uint64(0)
        ids = np.fromiter((self.word_ids.get(w, zero) for w in words), np.uint64, len(words))
        runs, items = [], set()
        for length, known in self.by_length.items():
            hashes = _hashes(ids, length)
            if not len(hashes):
                continue
            found = np.searchsorted(known, hashes)
            found[found == len(known)] = 0
            for i in np.flatnonzero(known[found] == hashes).tolist():
                for run, owners in self.at[length, int(hashes[i])]:
                    if tuple(words[i : i + length]) == run:
                        runs.append((i, i + length))
                        items.update(owners)
        spans: list[tuple[int, int]] = []
        for a, b in sorted(runs):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return spans, items


def _scanner(block):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for ids, texts in slices(batches):
            counts, spans, items = [], [], []
            for text in texts:
                words = words_of(text)
                s, i = windows.scan(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(str(x) for x in i if x is not None) + [None] * (None in i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"],
            )

    return scan


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most block_windows windows; the driver holds one block at a time.

    A longer item is cut into parts that share window - 1 words, so that each window is in one part.
    """
    block, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        words = words_of(row.text)
        for at in range(0, max(1, len(words) - window + 1), block_windows):
            part = words[at : at + block_windows + window - 1]
            count = max(1, len(part) - window + 1)
            if block and size + count > block_windows:
                yield block
                block, size = [], 0
            block.append((row.item_id, " ".join(part)))
            size += count
    if block:
        yield block


def _unite(spans: F.Column) -> F.Column:
    """Spans that touch or overlap become one."""
    empty = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans of hit words and the items found, a row for each row of docs.

    With one block there is no shuffle. With more, rows are told apart by a number that is
    written with them, so repeated rows stay repeated.
    """
    spark, text = docs.sparkSession, id_and_text(docs)
    blocks = _blocks(benchmark, window, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return text.mapInArrow(_scanner(spark.sparkContext.broadcast(WindowSet(first, window))), SCHEMA)
    numbered = Workspace(spark, "decontaminate").keep(text.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("doc_id").alias("own_id")), "documents")

    def passes() -> Iterator[DataFrame]:
        yield numbered.select("doc_id", "text").mapInArrow(_scanner(spark.sparkContext.broadcast(WindowSet(first, window))), SCHEMA)
        block = second
        while block is not None:
            hits = numbered.select("doc_id", "text").mapInArrow(_scanner(spark.sparkContext.broadcast(WindowSet(block, window))), SCHEMA)
            yield hits.where(F.size("items") > 0)
            block = next(blocks, None)

    united = reduce(DataFrame.unionByName, passes()).groupBy("doc_id").agg(F.max("n_words").alias("n_words"), _unite(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.select("doc_id", "own_id").join(united, "doc_id").select(F.col("own_id").alias("doc_id"), "n_words", "spans", "items")


def n_hit(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
