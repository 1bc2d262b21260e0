"""Dedup of repeated byte strings by a logarithmic family of sampled anchors, in place of suffix arrays.

Any string of LENGTH bytes holds an anchor chosen by its content alone: the place of its least
hashed k-gram (K bytes, leftmost on ties). The windows, that is the starts of strings of
LENGTH bytes, with one anchor are consecutive and form a row: anchor key, and fingerprint of
all bytes from the first window's start to the last one's end. A batch's level is a table of
its anchors, ordered by these hashes and not by suffix, one entry for each distinct pair, with
the first document that has it. Batches come in order of doc_id. Each is
merge-scanned against the levels before it: a row that an earlier document has is removed
whole. Then its new entries become a level, and levels of equal size merge, so that n batches
leave log n levels.

What is left are matches that end within a row: anchor keys with several fingerprints. Their
first rows alone are compared, byte by byte: the windows of a key's rows meet in one task, in
order, and one that an earlier row has is removed. Keys with more than GROUP_ROWS such rows
are opened into the bytes of their windows instead, which are summed like the rows. So no frequent string
is gathered in one task, and no pairs of occurrences are ever formed. Places inside a document
are never shuffled, as its rows are cut again where they are needed. A suffix for every byte
instead would shuffle more than 16 bytes for each byte of text.

A null text is empty. Texts of fewer than LENGTH bytes keep all bytes. Rows with a null
doc_id have no place in the order and keep all bytes; rows with one doc_id count as one
document. Keys and fingerprints are 64-bit hashes, and two rows are equal if both are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_and_text
from lamina.llm.jaccard import mixed
from lamina.session import Workspace

LENGTH, K = 100, 40
BATCHES = 4
#: First rows of one key that are compared in one task, of some 200 bytes each.
GROUP_ROWS = 20_000
#: Bytes hashed at once; places in a block fit into PLACE_BITS.
BLOCK_BYTES, PLACE_BITS = 1 << 20, 24

_rng = np.random.default_rng(20)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 5


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as far as needed."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            make = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            cls.up, cls.down = make(BASE), make(pow(BASE, -1, 2**64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    Powers.reach(len(data) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * Powers.up[: len(data)])])


def run_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], wherever they stand."""
    with np.errstate(over="ignore"):
        return mixed((prefix[end] - prefix[start]) * Powers.down[start] + (end - start).astype(np.uint64))


def anchor_rows(data: np.ndarray, doc_end: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(key, fingerprint, first window, last window) of a block of documents side by side.

    doc_end: for every byte, where its document ends in the block.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none
    prefix, places, w = prefix_hashes(data), np.arange(len(data) - k + 1), length - k + 1
    grams = run_hashes(prefix, places, places + k)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, span = (grams & ~low) | places.astype(np.uint64), 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(places) - w + 1], least[w - span : w - span + len(places) - w + 1])
    windows = np.flatnonzero(np.arange(len(least)) + length <= doc_end[: len(least)])
    if not len(windows):
        return none.view(np.uint64), none.view(np.uint64), none, none
    anchors = (least[windows] & low).astype(np.int64)
    breaks = np.flatnonzero(np.diff(anchors)) + 1
    first, last = windows[np.concatenate([[0], breaks])], windows[np.concatenate([breaks - 1, [len(windows) - 1]])]
    return grams[anchors[np.concatenate([[0], breaks])]], run_hashes(prefix, first, last + length), first, last


def cut_rows(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document's number, key, fingerprint, first window, last window) of documents, in order.

    Documents stand side by side in blocks of about BLOCK_BYTES; a longer one is cut with an overlap.
    """
    numbers, parts, offsets, size = [], [], [], 0

    def block() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        key, fingerprint, lo, hi = anchor_rows(np.frombuffer(b"".join(parts), np.uint8), np.repeat(ends, lengths), length, k)
        part = np.searchsorted(ends, lo, "right")
        shift = np.array(offsets)[part] - (ends - lengths)[part]
        return np.array(numbers)[part], key, fingerprint, lo + shift, hi + shift

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), BLOCK_BYTES):
            part = text[at : at + BLOCK_BYTES + length - 1]
            if size and size + len(part) > 2 * BLOCK_BYTES:
                yield block()
                numbers, parts, offsets, size = [], [], [], 0
            if len(part) >= length:
                numbers.append(number)
                parts.append(part)
                offsets.append(at)
                size += len(part)
    if parts:
        yield block()


def joint(key: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(key * np.uint64(0x9E3779B97F4A7C15) + fingerprint)


def _by_slices(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    """256 documents at a time (doc_id, text, ...) with their texts and rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t.encode() for t in part.column(1).to_pylist()]
            cut = list(zip(*cut_rows(texts, length, k)))
            none = np.zeros(0, np.int64)
            yield part, texts, [np.concatenate(c) for c in cut] if cut else [none, none.view(np.uint64), none.view(np.uint64), none, none]


ENTRY = "key long, print long, doc_id long"


def _sampler(length: int, k: int):
    """The distinct (key, fingerprint) of every document."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, (doc, key, fingerprint, _, _) in _by_slices(batches, length, k):
            with np.errstate(over="ignore"):
                _, once = np.unique(mixed(joint(key, fingerprint) + doc.astype(np.uint64)), return_index=True)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), pa.array(fingerprint[once].view(np.int64)), pa.array(ids[doc[once]].astype(np.int64))], ["key", "print", "doc_id"])

    return sample


def _listed(lists: pa.Array, doc: np.ndarray, key: np.ndarray, fingerprint: np.ndarray, count: int) -> np.ndarray:
    """Which rows are in their document's list of (key, print)."""
    codes, out = joint(key, fingerprint), np.zeros(len(doc), bool)
    bounds = np.searchsorted(doc, np.arange(count + 1))
    for i in range(count):
        if bounds[i] < bounds[i + 1] and lists[i].is_valid:
            own = lists[i].values
            out[bounds[i] : bounds[i + 1]] = np.isin(codes[bounds[i] : bounds[i + 1]], joint(own.field(0).to_numpy().view(np.uint64), own.field(1).to_numpy().view(np.uint64)))
    return out


def _first_in_document(doc: np.ndarray, key: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        _, once = np.unique(mixed(joint(key, fingerprint) + doc.astype(np.uint64)), return_index=True)
    first = np.zeros(len(doc), bool)
    first[once] = True
    return first


def _opener(length: int, k: int):
    """(key, doc_id, lo, bytes) of the listed rows, at their first place in the document."""

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, (doc, key, fingerprint, lo, hi) in _by_slices(batches, length, k):
            wanted = np.flatnonzero(_listed(part.column(2), doc, key, fingerprint, len(texts)) & _first_in_document(doc, key, fingerprint))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            pieces = [texts[doc[i]][lo[i] : hi[i] + length] for i in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(key[wanted].view(np.int64)), pa.array(ids[doc[wanted]].astype(np.int64)), pa.array(lo[wanted]), pa.array(pieces, pa.binary())], ["key", "doc_id", "lo", "piece"])

    return open_rows


def _comparer(length: int):
    """(doc_id, start, end) of a key's windows that an earlier row of the key has; rows come in order of key, doc_id, lo."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        now = last = None
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for key, doc_id, lo, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != now:
                    now, last, seen = key, None, set()
                if last == (doc_id, lo):  # a repeated row of documents
                    continue
                last, end = (doc_id, lo), -1
                for p in range(len(piece) - length + 1):
                    window = piece[p : p + length]
                    if window not in seen:
                        seen.add(window)
                    elif p <= end - lo:
                        out[2][-1] = end = lo + p + length
                    else:
                        end = lo + p + length
                        for column, value in zip(out, (doc_id, lo + p, end)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "end"])

    return compare


def _windows(length: int):
    """(key, window, doc_id, start) of every window of rows that are too many for one task."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, lo, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                starts = np.arange(len(piece) - length + 1)
                windows = [piece[p : p + length] for p in range(len(starts))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), key)), pa.array(windows, pa.binary()), pa.array(np.full(len(starts), doc_id)), pa.array(lo + starts)], ["key", "window", "doc_id", "start"])

    return explode


def merged_spans(starts: np.ndarray, ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    order = np.lexsort((ends, starts))
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        a, b = min(a, size), min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _remover(length: int, k: int):
    """Cuts each document's rows again and removes the listed ones, those it repeats itself, and the runs."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, (doc, key, fingerprint, lo, hi) in _by_slices(batches, length, k):
            placed = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            gone = (_listed(part.column(2), doc, key, fingerprint, len(texts)) | ~_first_in_document(doc, key, fingerprint)) & placed[doc]
            doc, lo, hi = doc[gone], lo[gone], hi[gone]
            bounds, runs = np.searchsorted(doc, np.arange(len(texts) + 1)), part.column(3)
            out: list[list] = [[], [], [], [], []]
            for i, data in enumerate(texts):
                starts, ends = lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]] + length
                if runs[i].is_valid:
                    starts, ends = np.concatenate([starts, runs[i].values.field(0).to_numpy()]), np.concatenate([ends, runs[i].values.field(1).to_numpy()])
                spans = merged_spans(starts, ends, len(data))
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                for column, value in zip(out, (len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans])):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return remove


class AnchorIndex:
    """The levels: anchors of 1, 2, 4... batches, newest last."""

    def __init__(self, work: Workspace, length: int = LENGTH, k: int = K):
        self.work, self.length, self.k = work, length, k
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.batches = 0

    def entries(self) -> DataFrame | None:
        out = None
        for _, _, level in self.levels:
            out = level if out is None else out.unionByName(level)
        return out

    def add(self, docs: DataFrame, merge: bool = True) -> DataFrame:
        """Adds a batch, whose ids follow all before, and returns what its documents repeat (key, print, doc_id)."""
        name, self.batches = f"batch{self.batches}", self.batches + 1
        own, before = self.work.keep(docs.mapInArrow(_sampler(self.length, self.k), ENTRY), f"{name}_own"), self.entries()
        tagged = own.withColumn("new", F.lit(1))
        if before is not None:
            tagged = tagged.unionByName(before.withColumn("new", F.lit(0)))
        scanned = tagged.groupBy("key", "print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("new").alias("new"))
        scanned = self.work.keep(scanned.where("new = 1 or last > first").sortWithinPartitions("key", "print"), f"{name}_scanned")
        repeats = self.work.keep(own.join(scanned.where("last > first").select("key", "print", "first"), ["key", "print"]).where("doc_id > first").select("key", "print", "doc_id"), f"{name}_repeats")
        self.levels.append((0, f"{name}_level", self.work.keep(scanned.where("new = 1").select("key", "print", F.col("first").alias("doc_id")), f"{name}_level")))
        while merge and len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, newer, b), (_, older, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((size + 1, f"{older}{size + 1}", self.work.keep(a.unionByName(b).repartition("key").sortWithinPartitions("key", "print"), f"{older}{size + 1}")))
            self.work.drop(newer, older)
        self.work.drop(f"{name}_own", f"{name}_scanned")
        return repeats

    def partial(self, docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
        """Repeated windows (doc_id, start, end) within rows that are the first of their fingerprint."""
        entries, bounded = self.entries(), "doc_id long, start long, end long"
        contested = self.work.keep(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "contested")
        opened = entries.join(contested.select("key"), "key", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("key", "print")).alias("entries"))  # bounded by a document's length
        pieces = self.work.keep(docs.join(opened, "doc_id").select("doc_id", "text", "entries").mapInArrow(_opener(self.length, self.k), "key long, doc_id long, lo long, piece binary"), "pieces")
        crowded = contested.where(F.col("n") > group_rows).select("key")
        any_crowded = not crowded.isEmpty()
        few = pieces.join(crowded, "key", "left_anti") if any_crowded else pieces
        small = few.select("key", "doc_id", "lo", "piece").repartition("key").sortWithinPartitions("key", "doc_id", "lo").mapInArrow(_comparer(self.length), bounded)
        if not any_crowded:
            return small
        windows = self.work.keep(pieces.join(crowded, "key", "left_semi").select("key", "doc_id", "lo", "piece").mapInArrow(_windows(self.length), "key long, window binary, doc_id long, start long"), "windows")
        firsts = windows.groupBy("key", "window").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return small.unionByName(windows.join(firsts, ["key", "window"]).where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start", (F.col("start") + self.length).alias("end")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, batches: int = BATCHES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (bytes) of every row."""
    docs = id_and_text(docs)
    work = Workspace(docs.sparkSession, "suffix")
    index, placed = AnchorIndex(work, length, k), docs.where("doc_id is not null")
    cuts = sorted({int(c) for c in placed.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    repeats = None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        batch = placed if lo is None else placed.where(F.col("doc_id") >= lo)
        new = index.add(batch if hi is None else batch.where(F.col("doc_id") < hi), merge=hi is not None)
        repeats = new if repeats is None else repeats.unionByName(new)
        work.release()
    runs = work.keep(index.partial(placed, group_rows).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "runs")  # these lists, too, are bounded by a document's length
    work.release()
    lists = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("key", "print")).alias("entries"))
    found = work.keep(lists.join(runs, "doc_id", "full"), "found")
    return docs.join(found, "doc_id", "left").select("doc_id", "text", "entries", "runs").mapInArrow(_remover(length, k), RESULT)
