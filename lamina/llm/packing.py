"""Hierarchical best-fit packing of tokenised documents into sequences.

A document is its token ids and then END_ID; one longer than the sequence length is cut into
pieces of that length, the last as long as what is left. In each round the items are dealt
over tasks of bounded size by a hash; every task packs its own by best fit, longest first.
Bins with no more than NEARLY_FULL free places are done; the others go on as items of the
next round, in fewer tasks, until one task holds them or packing no longer merges them.

Tokens of a text are those of its space-separated words in a row, as the tokenizer drops
white space and never joins across it; a word's ids are remembered. Latin-1 texts are lowered and
split as bytes, as the normaliser and the pre-tokenizer would, and the model gets each new
pre-token. Texts with other characters go by words, and words that hold such characters or
special strings through the tokenizer; texts with white space other than space, tab and line
ends take the tokenizer's own path as a whole.

Null and empty texts are one piece with END_ID alone; repeated rows are packed each; a row
with a null doc_id is packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_and_text, slices
from lamina.session import Workspace

SEQUENCE, END_ID = 4096, 1
NEARLY_FULL = 64
#: Items of one packing task.
TASK_ITEMS = 50_000
#: Words of Latin-1 whose ids a Python worker keeps, twice over (of others, a fifth of that), and the most characters of one that is kept.
KEPT_WORDS, KEPT_CHARACTERS = 500_000, 32
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
#: The same in Latin-1.
OTHER_SPACES = tuple(bytes([b]) for b in range(256) if OTHER_SPACE.match(chr(b)))
#: Lower case of Latin-1, whose letters have one in every version of Unicode; of spaces, a space.
LOWERED = bytes(32 if b in b" \t\n\r" else b + 32 if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" or (0xC0 <= b <= 0xDE and b != 0xD7) else b for b in range(256))
LETTERS = bytes(b for b in range(256) if chr(b).isalpha() and LOWERED[b] == b)
#: The pre-tokenizer's pattern for words of lowered Latin-1: a fixed value of the tokenizer file's format.
PRETOKEN = re.compile(b"[%b]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)|[^%b0-9\xb2\xb3\xb9\xbc-\xbe]+" % (LETTERS, LETTERS))
PUNCTUATION = b".,;:!?"


def default_tokenizer() -> str:
    """The public tokenizer's file; its place is a parameter of every function here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


BYTE_LETTERS = _byte_letters()


#: Layouts of the ids of short words.
LAYOUTS = [struct.Struct(f"<{n}I") for n in range(KEPT_CHARACTERS)]


def pack(ids: list[int]) -> bytes:
    return LAYOUTS[len(ids)].pack(*ids) if len(ids) < KEPT_CHARACTERS else struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Token ids of words as little-endian 32-bit bytes, found when they are first asked for.

    Once ``most`` are held they become the old ones, of which those asked for again are taken over.
    """

    def __init__(self, find: Callable[[str | bytes], bytes], most: int):
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, word: str | bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.find(word)
        if len(word) <= KEPT_CHARACTERS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ChunkTokenizer:
    """Token ids of texts as little-endian 32-bit bytes; ids of words and of their pre-tokens are remembered."""

    def __init__(self, path: str, words: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.raw_specials = tuple(t.encode() for t in self.specials)
        self.latin, self.other = Words(self._latin_word, words), Words(self._other_word, -(-words // 5))

    def ids(self, text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            if OTHER_SPACE.search(text):
                return self._encode(text)
            return b"".join(map(self.other.__getitem__, text.split()))
        for space in OTHER_SPACES:
            if space in raw:
                return self._encode(text)
        for special in self.raw_specials:
            if special in raw:
                return b"".join(map(self.other.__getitem__, text.split()))
        return b"".join(map(self.latin.__getitem__, raw.translate(LOWERED).split()))

    def _encode(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, pretoken: str) -> bytes:
        """Ids of a normalised pre-token."""
        return pack([t.id for t in self.tokenize(pretoken.encode().decode("latin-1").translate(BYTE_LETTERS))])

    def _latin_word(self, word: bytes) -> bytes:
        """Of a word of lowered Latin-1, without specials; each pre-token stands alone."""
        if word.isalpha():
            return pack([t.id for t in self.tokenize(word.decode())])
        stem = word.rstrip(PUNCTUATION)
        if stem and len(stem) < len(word) and stem[-1] in LETTERS:
            return self.latin[stem] + self.latin[word[len(stem) :]]
        parts = PRETOKEN.findall(word)
        return self._model(word.decode("latin-1")) if len(parts) == 1 else b"".join(map(self.latin.__getitem__, parts))

    def _other_word(self, word: str) -> bytes:
        """Of a word of a text that isn't Latin-1 or has specials."""
        if any(special in word for special in self.specials):
            return self._encode(word)
        try:
            return self.latin[word.encode("latin-1").translate(LOWERED)]
        except UnicodeEncodeError:
            pass
        # letters end a token, so what follows stands alone; a lowered letter may end in a mark, which doesn't
        stem = word.rstrip(PUNCTUATION.decode())
        if len(stem) < len(word) and stem and stem[-1].lower().isalpha():
            return self.other[stem] + self.other[word[len(stem) :]]
        return self._model(word) if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word) else self._encode(word)


@lru_cache(maxsize=1)
def worker_tokenizer(path: str, words: int = KEPT_WORDS) -> ChunkTokenizer:
    """One for all tasks of a Python worker, so that its words are found once.

    It stays while the worker lives, through the stages of other operators too: ``words`` bounds what they carry.
    """
    return ChunkTokenizer(path, words)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, sequence: int, words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = worker_tokenizer(path, words), pack([END_ID])
        for ids, texts in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(ids, texts):
                data = memoryview(tokenizer.ids(text) + end)
                for piece, at in enumerate(range(0, len(data), 4 * sequence)):
                    part = data[at : at + 4 * sequence]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, words: int = KEPT_WORDS) -> DataFrame:
    """The pieces of every document; no shuffle."""
    return id_and_text(docs).mapInArrow(_cutter(tokenizer or default_tokenizer(), sequence, words), PIECE)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    free = 0  # bit r is set if a bin with r free places exists
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            at = by_room[r].pop()
            if not by_room[r]:
                free ^= 1 << r
            bins[at].append(i)
            r -= size
        else:
            at, r = len(bins), room - size
            bins.append([i])
        by_room[r].append(at)
        free |= 1 << r
    return bins


ITEM = f"sequence_id long, size long, pieces array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in PIECE.split(', '))}>>"


def _packer(level: int, sequence: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if items is None or not items.num_rows:
            return
        items = items.sort_by("deal")
        pieces, start = items.column("pieces").combine_chunks(), (level << 52) + (TaskContext.get().partitionId() << 28)
        bins = best_fit(items.column("size").to_pylist(), sequence)
        lists, kind = pieces.to_pylist(), pieces.type
        for at in range(0, len(bins), 2000):
            part = bins[at : at + 2000]
            merged = [[p for i in b for p in lists[i]] for b in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(start + at, start + at + len(part)), pa.int64()), pa.array([sum(p["length"] for p in m) for m in merged], pa.int64()), pa.array(merged, kind)],
                ["sequence_id", "size", "pieces"],
            )

    return pack


def pack_pieces(pieces: DataFrame, work: Workspace, sequence: int = SEQUENCE, nearly_full: int = NEARLY_FULL, task_items: int = TASK_ITEMS) -> DataFrame:
    """Bins: sequence_id, size and pieces in order."""
    # items are dealt by a number of their own that is written with them, so that ids that are null or repeat don't gather
    pieces = work.keep(pieces.withColumn("deal", F.monotonically_increasing_id()), "pieces")
    items = pieces.select("deal", F.col("length").alias("size"), F.array(F.struct(*(c for c in pieces.columns if c != "deal"))).alias("pieces"))
    count, level, done = pieces.count(), 0, []
    while count:
        tasks = -(-count // task_items)
        bins = work.keep(items.repartition(tasks, "deal").mapInArrow(_packer(level, sequence), ITEM), f"bins{level}")
        left = bins.where(F.col("size") < sequence - nearly_full)
        before, count = count, left.count()
        if tasks == 1 or count > 0.9 * before:
            done.append(bins)
            break
        done.append(bins.where(F.col("size") >= sequence - nearly_full))
        items, level = left.select(F.col("sequence_id").alias("deal"), "size", "pieces"), level + 1
    if not done:
        return work.spark.createDataFrame([], ITEM)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, words: int = KEPT_WORDS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset; ``words`` bounds a worker's memory, not the result."""
    work = Workspace(docs.sparkSession, "packing")
    bins = pack_pieces(cut_pieces(docs, tokenizer, sequence, words), work, sequence)
    offsets = F.transform("pieces", lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0).cast("long"), lambda acc, q: acc + q["length"]).alias("offset")))
    return bins.select("sequence_id", F.explode(offsets).alias("at")).select("at.p.*", "sequence_id", "at.offset")
