"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of CHUNK bytes, each starting STRIDE after the last, so
that chunks overlap and cover the whole text. FILTERS learned filters of WIDTH bytes run over
each chunk; a chunk keeps each filter's maximum (at least 0), and the mean and the maximum of
that over all chunks go into one logistic unit. Training is Adam on a bounded sample of
labelled rows (at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes). Scoring takes whole
texts in blocks of BLOCK chunks, so memory doesn't grow with a text. An empty or null text is
one chunk of padding and gets a score. Repeated rows and ties get equal scores; a null id passes through. Without labels or
documents every score is 0.5, with a warning; labels that fit no document are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_and_text, label_sample, slices

FILTERS, WIDTH = 12, 4
CHUNK, STRIDE, BLOCK = 512, 480, 256
PAD = 256
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 48 << 20
EPOCHS, BATCH_ROWS, RATE, DECAY = 6, 32, 0.01, 1e-4
THRESHOLD = 0.3


class Network:
    """tables[j, byte, f] is what a byte at place j adds to filter f; padding adds nothing."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        self.tables[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.concatenate([rng.normal(0, 0.3, 2 * FILTERS), [0.0]]).astype(np.float32)

    def filters(self, codes: np.ndarray) -> np.ndarray:
        """Activations (chunk, place, filter)."""
        places = codes.shape[1] - WIDTH + 1
        acts = self.tables[0][codes[:, :places]]
        for j in range(1, WIDTH):
            acts += self.tables[j][codes[:, j : j + places]]
        return acts

    def pooled(self, text: bytes) -> np.ndarray:
        """Mean and maximum over all chunks."""
        total, most, n = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
        for codes in chunks(text):
            p = np.maximum(self.filters(codes).max(axis=1) + self.bias, 0)
            total += p.sum(axis=0)
            most = np.maximum(most, p.max(axis=0))
            n += len(p)
        return np.concatenate([total / n, most])

    def score(self, text: bytes) -> float:
        x = float(self.pooled(text) @ self.out[:-1] + self.out[-1])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def chunks(text: bytes) -> Iterator[np.ndarray]:
    """The text's chunks, in blocks of at most BLOCK rows."""
    count = max(1, -(-(len(text) - (CHUNK - STRIDE)) // STRIDE))
    data = np.frombuffer(text, np.uint8)
    for first in range(0, count, BLOCK):
        rows = min(BLOCK, count - first)
        part = data[first * STRIDE : first * STRIDE + (rows - 1) * STRIDE + CHUNK]
        width = CHUNK if count > 1 else max(WIDTH, len(part))
        codes = np.full((rows - 1) * STRIDE + width, PAD, np.int16)
        codes[: len(part)] = part
        yield np.lib.stride_tricks.sliding_window_view(codes, width)[::STRIDE]


def _adam(rate: float):
    moments: dict[int, tuple] = {}

    def step(i: int, value: np.ndarray, grad: np.ndarray, t: int) -> None:
        m, v = moments.get(i, (np.zeros_like(value), np.zeros_like(value)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        moments[i] = m, v
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    return step


def train(sample: list[tuple[str, int]], seed: int = 5) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    rows = [(list(chunks(t.encode())), y) for t, y in sample]
    if not rows:
        net.out[:] = 0
        return net
    positive = sum(y for _, y in rows) / len(rows)
    net.out[-1] = np.log((positive + 0.01) / (1.01 - positive))
    step, t = _adam(RATE), 0
    f = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH_ROWS):
            t += 1
            g_tables, g_bias, g_out = np.zeros_like(net.tables), np.zeros_like(net.bias), np.zeros_like(net.out)
            batch = [rows[i] for i in order[at : at + BATCH_ROWS]]
            for blocks, y in batch:
                acts = [net.filters(c) for c in blocks]
                best = [a.argmax(axis=1) for a in acts]
                p = np.concatenate([np.take_along_axis(a, b[:, None], 1)[:, 0] for a, b in zip(acts, best)]) + net.bias
                h, n = np.maximum(p, 0), len(p)
                top = h.argmax(axis=0)
                x = np.concatenate([h.mean(axis=0), h[top, f]])
                err = 1 / (1 + np.exp(-np.clip(x @ net.out[:-1] + net.out[-1], -30, 30))) - y
                g_out[:-1] += err * x
                g_out[-1] += err
                g = np.repeat(net.out[None, :FILTERS] * (err / n), n, axis=0)
                g[top, f] += err * net.out[FILTERS:-1]
                g *= p > 0
                g_bias += g.sum(axis=0)
                start = 0
                for c, b in zip(blocks, best):
                    part = g[start : start + len(c)]
                    for j in range(WIDTH):
                        np.add.at(g_tables[j], (c[np.arange(len(c))[:, None], b + j], f[None, :]), part)
                    start += len(c)
            g_tables[:, PAD] = 0
            rate = 1 - 0.8 * epoch / EPOCHS
            for i, (value, grad) in enumerate(((net.tables, g_tables), (net.bias, g_bias), (net.out, g_out))):
                step(i, value, rate * (grad / len(batch) + DECAY * value), t)
    return net


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([net.score(t.encode()) for t in texts], pa.float64())], ["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and score, a row for each row of docs; no shuffle of texts."""
    net = train(label_sample(docs, labels, "quality", sample_rows, SAMPLE_BYTES))
    return id_and_text(docs).mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(net)), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; lazy, and nothing is written.

    The function takes no Arrow batches, whose size is the session's when the job runs: Spark hands it 100 texts at a time.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(label_sample(docs, labels, "quality", SAMPLE_ROWS, SAMPLE_BYTES)))
    good = F.udf(lambda text: net.value.score((text or "").encode()) >= threshold, "boolean", useArrow=False)
    return docs.where(good("text"))
