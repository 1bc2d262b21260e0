"""Language-model scoring by a weighted backoff automaton.

Training counts every word (lower-cased A-Z, split at ASCII white space) and one end for each
training document, and every pair of neighbours with it. The automaton has a root, whose arcs
are all words with add-one probabilities, and a state for the start and for each training word,
with arcs for all pairs seen, smoothed by absolute discounting; where a state lacks an arc, its
failure arc leads to the root at the cost of its backoff weight. The weights of a state's arcs
and of its backoff sum to one over all words and the unknown word. Scoring follows a document
once from left to right, carries the state and adds up log10 probabilities.

Neither words nor pairs are ever gathered in one place. The reading tasks form blocks of at
most BLOCK_BYTES of text (or one longer text) and write each as one row. A block asks for the
counts of its distinct words and pairs, packed by bucket; the buckets grow in number with the
text. A bucket of pairs adds up its counts and how many arcs each state has there; a bucket of
words adds up both for its words; block and answers meet in one task. Start and end are the
empty word. Pairs are known by the 64-bit hashes of their words; should two words share a hash,
which the word buckets see, all is done again with another hash key.

A null text is empty: its only token is the end. A null doc_id is not held out, as its
remainder is not 2. Repeated rows count each. Without training rows N and V are 0 and every
token has probability 1.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fold, id_and_text
from lamina.session import Workspace

DISCOUNT = 0.5
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Blocks are large rows: a row group ends after a few, so that readers hold no more of them at once.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
#: The buckets of pairs take turns, as their hashes are most of what is shuffled; a turn's files go before the next.
TURNS = 2
FOLDS, HELD_OUT = 7, 2

BLOCK = "block long, doc_ids array<long>, training array<boolean>, lengths array<long>, codes binary, bounds binary, words binary"
ASKED = "bucket int, block long, keys binary, n binary"
ANSWER = "block long, bucket int, c binary, arcs binary, keys binary, total long, vocabulary long, collided boolean"


def tokens(text: str) -> list[bytes]:
    """Words as bytes; bytes.lower and bytes.split know ASCII alone."""
    return text.encode().lower().split()


def indexed() -> defaultdict:
    """Numbers its keys as they come."""
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


def hashes(words: list[bytes], key: int) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words
    return pd.util.hash_array(out, hash_key=f"{key:016d}", categorize=False)


def _blocks(buckets: int, key: int, block_bytes: int):
    """One row for each block; codes number its words by bucket."""

    def block_row(number: int, ids: list, training: list, code: dict, docs: list[np.ndarray]) -> pa.RecordBatch:
        words = list(code)
        bucket = hashes(words, key) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        columns = [[(TaskContext.get().partitionId() << 32) + number], [ids], [training], [[len(d) for d in docs]], [rank[np.concatenate(docs)].tobytes()], [bounds.astype(np.int32).tobytes()], [b" ".join(words[i] for i in order)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "doc_ids", "training", "lengths", "codes", "bounds", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        ids, training, code, docs = [], [], indexed(), []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc_id, text, held_out in zip(*(batch.slice(at, 256).column(i).to_pylist() for i in range(3))):
                    if docs and size + len(text) > block_bytes:
                        yield block_row(number, ids, training, code, docs)
                        number, size = number + 1, 0
                        ids, training, code, docs = [], [], indexed(), []
                    own = tokens(text)
                    own.append(b"")
                    ids.append(doc_id)
                    training.append(not held_out)
                    docs.append(np.fromiter(map(code.__getitem__, own), np.int32, len(own)))
                    size += len(text) + 16
        if docs:
            yield block_row(number, ids, training, code, docs)

    return run


class Block:
    """A block's tokens, each document closed by its end, and its distinct words and pairs."""

    def __init__(self, row: dict):
        self.ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
        self.training = np.repeat(np.array(row["training"], bool), self.lengths)
        self.symbols = np.frombuffer(row["codes"], np.int32).astype(np.int64)
        self.bounds = np.frombuffer(row["bounds"], np.int32)
        self.size, self.buckets = int(self.bounds[-1]), len(self.bounds) - 1
        self.states = np.concatenate([self.symbols[-1:], self.symbols[:-1]])  # all texts end in the same code, which is also the start
        coded = (self.states * self.size + self.symbols) * 2 + self.training
        coded.sort()
        first = np.flatnonzero(np.diff(coded >> 1, prepend=-1))
        self.pairs = coded[first] >> 1
        self.pair_counts = np.add.reduceat(coded & 1, first)
        self.word_counts = np.bincount(self.symbols[self.training], minlength=self.size)
        of = np.repeat(np.arange(self.buckets), np.diff(self.bounds))
        bucket = (of[self.pairs // self.size] + of[self.pairs % self.size]) % self.buckets
        self.order = np.argsort(bucket, kind="stable")
        self.pair_bounds = np.searchsorted(bucket[self.order], np.arange(self.buckets + 1))


def _asked(of: str, key: int, turn: int = 0, turns: int = 1):
    """The block's distinct words, or pairs, by bucket; the buckets of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                block, words = Block(row), row["words"].split(b" ")
                if of == "words":
                    bounds, n = block.bounds, block.word_counts
                    packed = lambda a, b: b" ".join(words[a:b])
                else:
                    h, pairs = hashes(words, key), block.pairs[block.order]
                    keys, bounds, n = np.stack([h[pairs // block.size], h[pairs % block.size]]), block.pair_bounds, block.pair_counts[block.order]
                    packed = lambda a, b: keys[:, a:b].tobytes()
                filled = [i for i in range(turn, block.buckets, turns) if bounds[i] < bounds[i + 1]]
                spans = [(bounds[i], bounds[i + 1]) for i in filled]
                columns = [pa.array(filled, pa.int32()), pa.array([row["block"]] * len(filled), pa.int64()), pa.array([packed(a, b) for a, b in spans], pa.binary()), pa.array([n[a:b].astype(np.int64).tobytes() for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "n"])

    return run


def _answers(blocks: list, bucket: list, c: list, arcs: list, keys: list, total: int = 0, vocabulary: int = 0, collided: bool = False) -> pa.Table:
    size = len(blocks)
    columns = [pa.array(blocks, pa.int64()), pa.array(bucket, pa.int32()), *(pa.array([None if x is None else x.tobytes() for x in part], pa.binary()) for part in (c, arcs, keys))]
    columns += [pa.array([total] + [0] * (size - 1), pa.int64())[:size], pa.array([vocabulary] + [0] * (size - 1), pa.int64())[:size], pa.array([collided] * size, pa.bool_())]
    return pa.table(columns, ["block", "bucket", "c", "arcs", "keys", "total", "vocabulary", "collided"])


def _ints(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def _add_pairs(buckets: int):
    """The counts of the pairs that each block asked for and, in rows without a block, the arcs of each state by bucket of words."""

    def run(asked: pa.Table) -> pa.Table:
        blocks, counts = asked.column("block").to_pylist(), _ints(asked.column("n"))
        a, b = np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in asked.column("keys").to_pylist()], axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        sums = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        c = np.empty(len(a), np.int64)
        c[order] = sums[np.cumsum(new) - 1]
        states, arcs = np.unique(a[new][sums > 0], return_counts=True)
        to = states % np.uint64(buckets)
        by = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[by], np.arange(buckets + 1, dtype=np.uint64))
        parts = [(i, by[ends[i] : ends[i + 1]]) for i in range(buckets) if ends[i] < ends[i + 1]]
        own, none = asked.column("bucket")[0].as_py(), [None] * len(blocks)
        return _answers(
            blocks + [None] * len(parts),
            [own] * len(blocks) + [i for i, _ in parts],
            np.split(c, np.cumsum([len(n) for n in counts])[:-1]) + [None] * len(parts),
            none + [arcs[p] for _, p in parts],
            none + [states[p] for _, p in parts],
        )

    return run


def _add_words(key: int):
    """The counts and arcs of the words that each block asked for."""

    def run(asked: pa.Table, arcs: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _answers([], [], [], [], [])
        blocks, counts, code = asked.column("block").to_pylist(), _ints(asked.column("n")), indexed()
        at = [np.fromiter(map(code.__getitem__, x.split(b" ")), np.int64, len(n)) for x, n in zip(asked.column("keys").to_pylist(), counts)]
        c = np.zeros(len(code), np.int64)
        for i, n in zip(at, counts):
            c[i] += n  # a block's words are distinct
        h = hashes(list(code), key)
        order = np.argsort(h)
        leaving = np.zeros(len(code), np.int64)
        for states, n in zip(arcs.column("keys").to_pylist(), _ints(arcs.column("arcs"))):
            leaving[order[np.searchsorted(h, np.frombuffer(states, np.uint64), sorter=order)]] += n
        collided = bool((np.diff(h[order]) == 0).any())
        bucket = asked.column("bucket")[0].as_py()
        return _answers(blocks, [bucket] * len(blocks), [c[i] for i in at], [leaving[i] for i in at], [None] * len(blocks), int(c.sum()), int((c > 0).sum()), collided)

    return run


class PairCoder:
    """Codes of words for the states: 0 the start or end, 1..n the states' words, -1 any other."""

    def __init__(self, words: list[bytes]):
        self.code = {w: i + 1 for i, w in enumerate(words)}
        self.size = len(words) + 1

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Codes from the start to the end of a document."""
        out = np.zeros(len(words) + 2, np.int64)
        get = self.code.get
        out[1:-1] = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        return out


class Arcs:
    """log10 probabilities by state and symbol, NaN where there is no arc."""

    def __init__(self, size: int, pairs: np.ndarray, values: np.ndarray):
        self.size, self.pairs, self.values = size, pairs, np.append(values, np.nan)

    def __getitem__(self, at: tuple) -> np.ndarray:
        pair = np.asarray(at[0]) * self.size + at[1]
        found = np.searchsorted(self.pairs, pair)
        hit = np.append(self.pairs, -1)[found] == pair
        return self.values[np.where(hit, found, len(self.pairs))]


class Automaton:
    """The arcs and backoff weights of some states; pairs, in order, are state * states + symbol."""

    def __init__(self, coder: PairCoder | None, state_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, root: np.ndarray, leaving: np.ndarray | None = None):
        """state_counts, root: by code, how often a state is left, and log10 probabilities at the root.
        leaving: how many arcs a state has, where pairs aren't all of them but only those asked for."""
        self.coder, n = coder, len(state_counts)
        seen = pair_counts > 0
        pairs, kept = pairs[seen], pair_counts[seen] - DISCOUNT
        states, symbols, own = pairs // n, pairs % n, np.maximum(state_counts, 1)
        if leaving is None:
            backoff = 1 - np.bincount(states, kept, n) / own
        else:
            backoff = np.where(state_counts > 0, DISCOUNT * leaving / own, 1.0)
        backoff = np.clip(backoff, 1e-12, 1.0)
        self.arcs = Arcs(n, pairs, np.log10(kept / own[states] + backoff[states] * 10 ** root[symbols]))
        self.backoff = np.log10(backoff)

    def scores(self, states: np.ndarray, symbols: np.ndarray, root: np.ndarray) -> np.ndarray:
        arc = self.arcs[states, symbols]
        return np.where(np.isnan(arc), root[symbols] + self.backoff[states], arc)


def _scorer(total: int, vocabulary: int):
    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows.to_pylist()[0])
        answers = answers.sort_by("bucket")
        words, pairs = (answers.filter(pa.array([x == pair for x in answers.column("pair").to_pylist()])) for pair in (False, True))
        c, leaving = np.concatenate(_ints(words.column("c"))), np.concatenate(_ints(words.column("arcs")))
        found = np.empty(len(block.pairs), np.int64)
        found[block.order] = np.concatenate(_ints(pairs.column("c")))
        root = np.log10((c + 1) / (total + vocabulary + 1))
        automaton = Automaton(None, c, block.pairs, found, root, leaving)
        starts = np.cumsum(block.lengths) - block.lengths
        by_doc = lambda x: np.add.reduceat(x, starts)
        columns = [block.lengths, by_doc((c[block.symbols] > 0).astype(np.int64)), by_doc(root[block.symbols]), by_doc(automaton.scores(block.states, block.symbols, root))]
        return pa.table([pa.array(block.ids, pa.int64()), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "lm")

    def keep(df: DataFrame, name: str, **options) -> str:
        df.write.options(compression="zstd", **options).parquet(work.path(name))
        work.release()
        return work.path(name)

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = id_and_text(docs).select("doc_id", "text", held_out.alias("held_out"))
    buckets = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes + 1
    key, collided = 0, True
    while collided:
        blocks = spark.read.schema(BLOCK).parquet(keep(rows.mapInArrow(_blocks(buckets, key, block_bytes), BLOCK), f"blocks{key}", **ROW_GROUPS))
        pairs = [keep(blocks.mapInArrow(_asked("pairs", key, turn, TURNS), ASKED).groupBy("bucket").applyInArrow(_add_pairs(buckets), ANSWER), f"pairs{key}-{turn}") for turn in range(TURNS)]
        pairs = spark.read.schema(ANSWER).parquet(*pairs)
        arcs = pairs.where("block is null").select("bucket", "keys", "arcs")
        words = keep(blocks.mapInArrow(_asked("words", key), ASKED).groupBy("bucket").cogroup(arcs.groupBy("bucket")).applyInArrow(_add_words(key), ANSWER), f"words{key}")
        words = spark.read.schema(ANSWER).parquet(words)
        known = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v"), F.max("collided").alias("collided")).first()
        key, collided = key + 1, known.collided
    answers = words.select("block", "bucket", "c", "arcs", F.lit(False).alias("pair")).unionByName(pairs.where("block is not null").select("block", "bucket", "c", "arcs", F.lit(True).alias("pair")))
    scored = blocks.drop("words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(known.n, known.v), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), "base_score", "score")
