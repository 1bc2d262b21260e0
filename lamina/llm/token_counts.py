"""Token counts of whole texts by rank-synchronous array merging.

A text is split at the special strings of the vocabulary file, each of which is one token, and
then into pre-tokens. The pre-tokens of a batch that aren't remembered are held as one ragged
array of byte symbols. In each round every pre-token's lowest-rank pair is found and all of its
occurrences are merged at once, from left to right where they overlap; ranks change only next to
a merge. A pre-token without a pair left has as many tokens as symbols.

All occurrences may be merged at once because a pair's rank is higher than those of the merges
that make its two parts, which is checked when the file is read. Pre-tokens follow the byte-level
pattern; where a text holds characters whose class depends on the version of Unicode, the
library's own pre-tokenizer splits it.

A null text counts as empty: no bytes and no tokens. Rows are independent, so repeated rows, null
ids and ties need no rule; an empty table gives an empty result; other columns aren't read. Long
texts go through in runs of RUN_PRETOKENS pre-tokens.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_and_text, slices
from lamina.llm.packing import BYTE_LETTERS

LIMIT = 1024
#: Pre-tokens whose counts a Python worker keeps, and the most bytes of one that is kept.
CACHE_WORDS, CACHE_BYTES = 600_000, 64
#: Pre-tokens of one text that are held at once.
RUN_PRETOKENS = 200_000
#: The byte-level pre-tokenizer's pattern: a fixed value of the vocabulary file's format.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A character outside the scripts whose letters and digits all versions of Unicode agree on.
UNSETTLED = regex.compile(r"[^\x00-԰‐- ぀-ゖ一-龥가-힣\U0001F300-\U0001F64F]")
NO_PAIR = np.int32(2**31 - 1)


def default_tokenizer() -> str:
    """The public tokenizer's file; its place is a parameter of every function here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PairMerger:
    """Ranks of symbol pairs, and the number of symbols that merging leaves of byte strings."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        code = {t: i for i, t in enumerate(vocabulary)}
        parts = [(code[a], code[b], code[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        left, right, made = (np.array(c, np.int64) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        rank_of = np.full(len(code), -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before the merges that make its parts, or makes what another makes")
        self.size = len(code)
        key = left * self.size + right
        self.ranks = np.argsort(key).astype(np.int32)
        self.keys = key[self.ranks]
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made.astype(np.int32)
        self.byte_symbols = np.array([code.get(BYTE_LETTERS[b], -1) for b in range(256)], np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR) if len(self.keys) else np.full(len(a), NO_PAIR)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The symbols left of each nonempty byte string."""
        out, lengths = np.zeros(len(words), np.int64), np.fromiter(map(len, words), np.int64, len(words))
        owner = np.arange(len(words))
        symbols = self.byte_symbols[np.frombuffer(b"".join(words), np.uint8)]
        last = np.cumsum(lengths) - 1
        rank = np.full(len(symbols), NO_PAIR)  # of the pair of a symbol and the next one of its string
        rank[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
        rank[last] = NO_PAIR
        while len(owner):
            first = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == NO_PAIR
            if done.any():
                out[owner[done]] = lengths[done]
                going = np.repeat(~done, lengths)
                symbols, rank = symbols[going], rank[going]
                owner, lengths, lowest = owner[~done], lengths[~done], lowest[~done]
                if not len(owner):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, lengths))
            own = rank[at]
            twins = self.left[own] == self.right[own]
            if twins.any():  # of a run of overlapping occurrences every second one is merged
                starts = np.append(True, (np.diff(at) != 1) | (np.diff(own) != 0))
                place = np.arange(len(at))
                at = at[~twins | ((place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0)]
            symbols[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # no pair where the second symbol was the string's last
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            ends = np.zeros(len(symbols), bool)
            ends[np.cumsum(lengths) - 1] = True
            merged = at - np.arange(len(at))  # places after the second symbols are gone
            ends[at] |= ends[at + 1]
            symbols, rank, ends = symbols[stays], rank[stays], ends[stays]
            lengths = np.diff(np.flatnonzero(ends), prepend=-1)
            near = np.concatenate([merged[~ends[merged]], merged[merged > 0] - 1])
            near = near[~ends[near]]
            rank[near] = self.pair_ranks(symbols[near], symbols[near + 1])
        return out


class TokenCounter:
    """Numbers of tokens of texts, with the counts of pre-tokens remembered."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.merger = PairMerger(parts["model"]["vocab"], parts["model"]["merges"])
        specials = sorted((t["content"] for t in parts["added_tokens"]), key=lambda t: (-len(t), t))
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.path, self.library, self.cache = path, None, {}

    def _split(self, text: str) -> Iterator[str]:
        if not UNSETTLED.search(text):
            return (m[0] for m in PRETOKEN.finditer(text)) if len(text) > RUN_PRETOKENS else iter(PRETOKEN.findall(text))
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return (text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text))

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts of the words; those that aren't kept in the cache are returned."""
        new = list(words)
        raw = [w.encode() for w in new]
        counts = dict(zip(new, self.merger.counts(raw).tolist())) if new else {}
        long = {w for w, r in zip(new, raw) if len(r) > CACHE_BYTES}
        self.cache.update((w, n) for w, n in counts.items() if w not in long)
        return {w: counts[w] for w in long}

    def _runs(self, texts: list[str]) -> Iterator[tuple[int, list[str], int]]:
        """(number of the text, some of its pre-tokens, special strings among the rest)."""
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special else [text]
            yield i, [], len(pieces) - 1
            for piece in pieces:
                split = self._split(piece)
                while run := list(islice(split, RUN_PRETOKENS)):
                    yield i, run, 0

    def counts(self, texts: list[str]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0

        def flush() -> None:
            missing = set().union(*(run for _, run in held)).difference(self.cache)
            if len(self.cache) + len(missing) > CACHE_WORDS:
                self.cache.clear()
                missing = set().union(*(run for _, run in held))
            long = self._learn(missing)
            for i, run in held:
                out[i] += sum(map(self.cache.__getitem__, run)) if not long else sum(long[w] if w in long else self.cache[w] for w in run)
            held.clear()

        for i, run, special in self._runs(texts):
            out[i] += special
            held.append((i, run))
            size += len(run)
            if size >= RUN_PRETOKENS:
                flush()
                size = 0
        flush()
        return out


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for ids, texts in slices(batches):
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(counter.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row; no shuffle."""
    counted = id_and_text(docs).mapInArrow(_counter(tokenizer or default_tokenizer()), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
