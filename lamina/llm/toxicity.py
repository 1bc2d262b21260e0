"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, their stems, word pairs and pairs
with one word between them, lower-cased. Training follows McMahan et al. (2013): a learning rate for each
coordinate and L1 sparsity, over a bounded sample of labelled rows (at most SAMPLE_ROWS rows
and SAMPLE_BYTES bytes); the nonzero weights, at most 2^HASH_BITS, are broadcast.
Every text is scored whole, without a shuffle. Empty and null texts get the bias's score;
repeated rows get equal scores and a null id passes through.
Without labels or documents all scores are 0.5, with a warning; labels that fit no document are an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lamina.llm.common import id_and_text, label_sample, slices

HASH_BITS = 20
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 96 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
THRESHOLD = 0.5
#: Words whose hashes a Python worker keeps.
CACHE_WORDS = 300_000
#: Stems are words cut to so many letters; they stand for word forms that training didn't show.
STEMS = (4, 5)
WORD = re.compile(r"\w+")
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHasher:
    """64-bit hashes of words and of their stems, remembered by word."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((CACHE_WORDS, 1 + len(STEMS)), np.uint64)

    def hashes(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        if len(rows) + len(words) > len(self.table):
            rows.clear()
            if len(words) > len(self.table):
                self.table = np.zeros((len(words), self.table.shape[1]), np.uint64)
        for word in set(words).difference(rows):
            self.table[len(rows)] = [xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(f"{n}:{word[:n]}") for n in STEMS)]
            rows[word] = len(rows)
        return self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]


def hashed(text: str, hasher: WordHasher, bits: int = HASH_BITS) -> np.ndarray:
    """Hashed features of a whole text, with repeats: words, stems, pairs and pairs with a gap."""
    table = hasher.hashes(WORD.findall(text.lower()))
    with np.errstate(over="ignore"):
        h = table[:, 0]
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        skips = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        x = np.concatenate([table.ravel(), pairs, skips]) * MIX
    return (x >> np.uint64(64 - bits)).astype(np.int32)


def features(text: str, hasher: WordHasher) -> np.ndarray:
    return np.unique(hashed(text, hasher))


def score_text(text: str, hasher: WordHasher, weights: np.ndarray) -> float:
    """Each distinct feature counts once; those without weight are left out before they are sorted."""
    at = hashed(text, hasher)
    return sigmoid(float(weights[np.unique(at[weights[at] != 0])].sum() + weights[-1]))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, without L1."""

    def __init__(self, bits: int = HASH_BITS):
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - y
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g


def train(sample: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the nonzero weights; the bias is the last one."""
    hasher, model = WordHasher(), Ftrl()
    rows = [(features(t, hasher), y) for t, y in sample]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    w = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32)


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(2**HASH_BITS + 1, np.float32)
        at, values = model.value
        weights[at] = values
        hasher = WordHasher()
        for ids, texts in slices(batches):
            scores = [score_text(t, hasher, weights) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and score, a row for each row of docs."""
    model = train(label_sample(docs, labels, "toxic", sample_rows, SAMPLE_BYTES))
    return id_and_text(docs).mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
