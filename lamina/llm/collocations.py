"""Phrase collocations: Misra-Gries summaries find the frequent n-grams, a second pass counts them.

Texts are lower-cased in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``; n-grams of one to four words lie within a piece. Languages are told apart
everywhere. With f the occurrences of a phrase, candidates are phrases of two to four words with
a = f >= MIN_COUNT; a cut after k words scores floor(SCALE a / (l + r)) with l and r the f of both parts, and
the lowest cut, of equal ones the first, is the candidate's score. Candidates inside a longer one
that holds SUBSUMED percent of their occurrences are dropped.

First pass. Reading tasks count the hashed n-grams of a block of text, so that a common one is one
entry a block, and write them in order of bucket, a range of hashes. A bucket's summary has more
counters than its mass divided by MIN_COUNT: each reduction takes one count from at least so many, so what all
reductions take from an n-gram is less than MIN_COUNT, and every frequent one keeps a counter.
Summaries merge by adding counters and reducing. Words and pairs are summed up first; longer n-grams are
read only where all of their pairs survived, which none that is frequent lacks.

Second pass. Survivors are told by bitmaps of at most MAP_BITS bits, whose false hits cost work
alone. Reading tasks count the words themselves of what survived, with no hash left in the key;
sums below MIN_COUNT go. So results are exact whatever hashes share.

A null text counts as empty, a null language as 'und'. Ties end by the phrase's bytes. Repeated
rows count each, ids and other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import arrow_rows
from lamina.session import Workspace

MIN_COUNT, LONGEST, SCALE, SUBSUMED, TOP = 30, 4, 2_000_000, 80, 2000
#: Text that a reading task counts at once, in bytes, and the most keys of a row it writes.
BLOCK_BYTES, ROW_KEYS = 4 << 20, 1024
#: Texts, or packed rows, of an Arrow batch.
BATCH_ROWS = 500
#: Text of a bucket, in bytes, and the least and most buckets, as powers of two.
BUCKET_BYTES, BUCKET_POWERS = 4 << 20, (8, 15)
#: Bits of the bitmap that is broadcast: 32 MB at most, for any corpus.
MAP_BITS = 1 << 28
#: Entries that wait at least before a summary is reduced.
WAITING = 1 << 18
#: Parts of the single words that many candidates share.
SALTS = 16
BREAK = b"\xff"  # not in UTF-8
BREAKS = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MIXER
        return x ^ (x >> np.uint64(29))


class Bitmap:
    """Which hashes survived; each bucket has a part of its own. Without bits all hashes pass."""

    def __init__(self, power: int, parts: dict[int, bytes], bits: int):
        self.power, self.part = np.uint64(64 - power), bits >> power
        self.bytes = np.zeros(bits >> 3, np.uint8)
        for bucket, data in parts.items():
            at = bucket * self.part >> 3
            self.bytes[at : at + len(data)] = np.frombuffer(data, np.uint8)

    @staticmethod
    def part_of(keys: np.ndarray, size: int) -> bytes:
        bits = np.zeros(size, np.uint8)
        bits[(keys & np.uint64(size - 1)).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.power) * np.uint64(self.part) + (keys & np.uint64(self.part - 1))
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class MisraGries:
    """At most ``capacity`` counters; a true count is at most the counter plus ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(self.capacity, WAITING):
            self.reduce()

    def merge(self, other: MisraGries) -> None:
        other.reduce()
        self.error += other.error
        self.add(other.keys, other.counts)

    def reduce(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.waiting))
        self.waiting, self.held = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            cut = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            stays = self.counts > cut
            self.keys, self.counts, self.error = self.keys[stays], self.counts[stays] - cut, self.error + int(cut)

    def survivors(self, least: int) -> np.ndarray:
        self.reduce()
        return self.keys[self.counts + self.error >= least]


class Words:
    """A block's texts as codes of its distinct words, by language; code 0 breaks pieces."""

    def __init__(self):
        self.code: defaultdict = defaultdict()
        self.code.default_factory = self.code.__len__
        self.code[BREAK]  # noqa: B018
        self.texts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        words = text.encode().lower().translate(BREAKS).replace(b"\n", b" \xff ").split()
        words.append(BREAK)
        self.texts.setdefault(lang, []).append(np.fromiter(map(self.code.__getitem__, words), np.int32, len(words)))
        self.size += len(text)

    def hashed(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(language, codes, hashes by place) of each language."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.code), np.uint64, len(self.code))
        for lang, texts in self.texts.items():
            codes = np.concatenate([*texts, np.zeros(LONGEST, np.int32)])
            yield lang, codes, hashes[codes]


def grams(lang: str, codes: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one to LONGEST words: the hash of the n-gram at each place, and whether one is there."""
    size = len(codes) - LONGEST
    at, there = np.full(size, np.uint64(xxhash.xxh3_64_intdigest(lang, seed=1))), np.ones(size, bool)
    for n in range(LONGEST):
        with np.errstate(over="ignore"):
            at = mixed(at * MULTIPLIER + hashes[n : n + size])
        there = there & (codes[n : n + size] != 0)
        yield at, there


def both(mask: np.ndarray) -> np.ndarray:
    """mask at a place and the next."""
    return mask & np.append(mask[1:], False)


def found_grams(lang: str, codes: np.ndarray, hashes: np.ndarray, pairs: Bitmap | None, longer: Bitmap | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, hashes, mask): without bitmaps words and pairs; with that of pairs what is longer; with both everything that survived."""
    wide = None
    for n, (at, there) in enumerate(grams(lang, codes, hashes), 1):
        if n <= 2:
            mask = there if pairs is None else there & pairs.has(at)
            if pairs is None or longer is not None:
                yield n, at, mask
            wide = mask
        elif pairs is None:
            return
        else:
            mask = there & both(wide)
            if longer is not None:
                mask[mask] = longer.has(at[mask])
            yield n, at, mask
            wide = mask


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Words]:
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for lang, text in zip(*(batch.slice(at, 256).column(i).to_pylist() for i in range(2))):
                words.add(lang, text)
                if words.size >= block_bytes:
                    yield words
                    words = Words()
    if words.texts:
        yield words


COUNTED = "bucket int, mass long, keys binary, counts binary"


def _count_hashes(power: int, block_bytes: int, pairs):
    """The block's distinct n-grams with their counts, a row for some of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _blocks(batches, block_bytes):
            keys = np.concatenate([at[mask] for parts in words.hashed() for _, at, mask in found_grams(*parts, pairs and pairs.value, None)])
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            counts = np.diff(first, append=len(keys))
            keys = keys[first]
            buckets = (keys >> np.uint64(64 - power)).astype(np.int32)
            starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(keys)])
            cuts = np.unique(np.concatenate([starts, np.arange(0, len(keys), ROW_KEYS)]))
            if not len(cuts):
                continue
            ends = np.append(cuts, len(keys))
            packed = lambda x: pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
            whole = pa.RecordBatch.from_arrays([pa.array(buckets[cuts]), pa.array(np.add.reduceat(counts, cuts)), packed(keys), packed(counts.astype(np.int32))], ["bucket", "mass", "keys", "counts"])  # a block's counts fit 32 bits
            yield from (whole.slice(i, 1000) for i in range(0, len(cuts), 1000))

    return run


def _summarise(masses, least: int):
    """Rows come in order of bucket; each bucket's survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, summary = None, None

        def out() -> Iterator[pa.RecordBatch]:
            keys = summary.survivors(least)
            rows = [keys[i : i + ROW_KEYS].tobytes() for i in range(0, len(keys), ROW_KEYS)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array([len(r) // 8 for r in rows], pa.int64()), pa.array(rows, pa.binary())], ["bucket", "n", "keys"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
            for a, b in zip(starts, np.append(starts[1:], len(of))):
                if of[a] != bucket:
                    if summary is not None:
                        yield from out()
                    bucket, summary = int(of[a]), MisraGries(masses.value[int(of[a])] // least + 1)
                part = batch.slice(a, b - a)
                keys, counts = (b"".join(part.column(i).to_pylist()) for i in (1, 2))
                summary.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64))
        if summary is not None:
            yield from out()

    return run


def _survivors(counted: DataFrame, power: int, least: int, work: Workspace, name: str):
    """The bitmap of the n-grams whose summaries leave at least ``least`` possible, as a broadcast."""
    spark = counted.sparkSession
    counted = work.keep(counted, f"{name}_counted")
    masses = {r.bucket: r.mass for r in counted.groupBy("bucket").agg(F.sum("mass").alias("mass")).collect()}  # at most 2^15 rows
    rows = counted.select("bucket", "keys", "counts").repartition(1 << power, "bucket").sortWithinPartitions("bucket")  # about a bucket a task, as Arrow holds thousands of rows at once
    kept = work.keep(rows.mapInArrow(_summarise(spark.sparkContext.broadcast(masses), least), "bucket int, n long, keys binary"), f"{name}_kept")
    work.drop(f"{name}_counted")
    work.release()
    n = kept.agg(F.sum("n")).first()[0] or 0
    bits = min(MAP_BITS, max(1 << (power + 6), 1 << (32 * n).bit_length()))

    def parts(key: tuple, table: pa.Table) -> pa.Table:
        data = Bitmap.part_of(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64), bits >> power)
        return pa.table([table.column("bucket").combine_chunks().slice(0, 1), pa.array([data], pa.binary())], ["bucket", "part"])

    found = kept.select("bucket", "keys").groupBy("bucket").applyInArrow(parts, "bucket int, part binary").collect()  # MAP_BITS / 8 bytes at most
    return spark.sparkContext.broadcast(Bitmap(power, {r.bucket: bytes(r.part) for r in found}, bits))


def _count_phrases(block_bytes: int, pairs, longer):
    """(lang, phrase, f) of a block's surviving n-grams; the empty phrase stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_bytes):
            words = list(block.code)
            for lang, codes, hashes in block.hashed():
                phrases, counts = [b""], [np.array([np.count_nonzero(codes)])]
                for n, at, mask in found_grams(lang, codes, hashes, pairs.value, longer.value):
                    places = np.flatnonzero(mask)
                    _, first, of, count = np.unique(at[places], return_index=True, return_inverse=True, return_counts=True)
                    apart = np.zeros(len(places), bool)  # has its hash but not its words from another n-gram
                    for i in range(n):
                        apart |= codes[places + i] != codes[places[first][of] + i]
                    if apart.any():
                        count = count - np.bincount(of[apart], minlength=len(count))
                    heads = np.concatenate([places[first], places[apart]])
                    columns = [map(words.__getitem__, codes[heads + i].tolist()) for i in range(n)]
                    phrases += columns[0] if n == 1 else map(b" ".join, zip(*columns))
                    counts += [count, np.ones(int(apart.sum()), np.int64)]
                whole = pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "phrase", "f"])
                yield from (whole.slice(i, 10_000) for i in range(0, whole.num_rows, 10_000))

    return run


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, words, f) of all n-grams with f >= least, and with words = 0 of the number of words."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _frequent(docs, least, block_bytes, Workspace(docs.sparkSession, "collocations"))


def _frequent(docs: DataFrame, least: int, block_bytes: int, work: Workspace) -> DataFrame:
    """All of it is written here, so that it runs with the session's setting of the moment."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    power = min(max(BUCKET_POWERS[0], (size // BUCKET_BYTES).bit_length()), BUCKET_POWERS[1])
    pairs = _survivors(rows.mapInArrow(_count_hashes(power, block_bytes, None), COUNTED), power, least, work, "pairs")
    longer = _survivors(rows.mapInArrow(_count_hashes(power, block_bytes, pairs), COUNTED), power, least, work, "longer")
    counted = rows.mapInArrow(_count_phrases(block_bytes, pairs, longer), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return work.keep(counted.select("lang", "phrase", words.alias("words"), "f").where(F.col("f") >= F.when(F.col("words") == 0, 1).otherwise(least)), "frequent")


def score_phrases(frequent: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one holds."""
    big = lambda c: c.cast("decimal(38,0)")
    candidates = frequent.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = candidates.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    parts = F.array(F.struct(F.lit("l").alias("side"), F.expr("substring_index(phrase, ' ', k)").alias("part")), F.struct(F.lit("r").alias("side"), F.expr("substring_index(phrase, ' ', k - words)").alias("part")))
    salt = F.when(F.instr("part", " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
    asked = cut.select("lang", "phrase", "a", "k", F.explode(parts).alias("p")).select("lang", "phrase", "a", "k", "p.*").withColumn("salt", salt)
    copies = F.when(F.col("words") == 1, F.expr(f"sequence(0, {SALTS - 1})")).otherwise(F.array(F.lit(0)))
    known = frequent.where(F.col("words").between(1, LONGEST - 1)).select("lang", F.col("phrase").alias("part"), "f", F.explode(copies).alias("salt"))
    cuts = range(1, LONGEST)
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}")
    both_sides = asked.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a").agg(*(side(k, s) for k in cuts for s in "lr"))
    score = lambda k: F.call_function("div", big(F.col("a")) * SCALE, big(F.col(f"l{k}") + F.col(f"r{k}")))
    lowest = F.array_min(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts)))
    scored = both_sides.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
    longer = candidates.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big(F.col("longer")) * 100 < big(F.col("a")) * subsumed)).drop("longer")


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first ``top`` phrases."""
    frequent = frequent_phrases(docs, **options)
    scored = score_phrases(frequent).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    first = scored.withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= top)  # so that no language is one task
    totals = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
    ranked = first.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
