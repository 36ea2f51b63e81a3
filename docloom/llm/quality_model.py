"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are read in overlapping chunks that cover all of it. Each of ``FILTERS`` learned filters of
``WIDTH`` bytes (a weight for each byte value at each place) slides over a chunk; the rectified maximum of each filter
is the chunk's vector. A document's vector is the largest and the mean of its chunk vectors, and one logistic unit
turns it into a probability. Chunks are streamed, so memory is bounded whatever the length of a text.

The network is fitted on the driver from at most ``PER_CLASS`` labelled texts of each class of at most ``MAX_BYTES``
bytes (documented bound; see samples.py), with Adam and the gradient of the pooled positions only.

Edge cases: null and empty texts are scored as one chunk of padding; without labels of both classes every score is
the share of label 1 (0.5 without any); repeated rows are scored alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table
from docloom.llm.samples import labelled_texts

FILTERS = 12
WIDTH = 5
CELL = 64
CHUNK = 16  # cells of a chunk
STEP = 15  # cells from one chunk to the next
BLOCK = 128  # chunks whose responses are held at a time
PER_CLASS = 600
MAX_BYTES = 16_000
EPOCHS = 14
RATE = 0.02
THRESHOLD = 0.7


class ByteNet:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = 0.0
        self.constant: float | None = None

    def responses(self, data: np.ndarray) -> np.ndarray:
        """A row for each position at which a whole filter fits."""
        n = len(data) - WIDTH + 1
        r = self.w[0].take(data[:n], axis=0)
        for j in range(1, WIDTH):
            r += self.w[j].take(data[j : n + j], axis=0)
        return r

    def chunk_maxima(self, data: bytes) -> Iterator[np.ndarray]:
        """Filter maxima of all chunks, in blocks."""
        raw = np.frombuffer(data, np.uint8)
        span = BLOCK * STEP * CELL
        for at in range(0, max(1, len(raw)), span):
            if at and len(raw) - at <= (CHUNK - STEP) * CELL:
                break  # what is left lies in the last chunk already
            part = raw[at : at + span + (CHUNK - STEP) * CELL + WIDTH - 1]
            if len(part) < WIDTH:
                part = np.pad(part, (0, WIDTH - len(part)))
            r = self.responses(part)
            if at + span + (CHUNK - STEP) * CELL < len(raw):
                r = r[: span + (CHUNK - STEP) * CELL]
            whole = len(r) // CELL
            cells = r[: whole * CELL].reshape(whole, CELL, FILTERS).max(axis=1)
            if whole * CELL < len(r):
                cells = np.concatenate([cells, r[whole * CELL :].max(axis=0, keepdims=True)])
            starts = range(0, max(1, min(len(cells) - (CHUNK - STEP), BLOCK * STEP)), STEP)
            yield np.maximum(np.stack([cells[s : s + CHUNK].max(axis=0) for s in starts]) + self.b, 0)

    def score(self, data: bytes) -> float:
        if self.constant is not None:
            return self.constant
        top, total, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0
        for m in self.chunk_maxima(data):
            top = np.maximum(top, m.max(axis=0))
            total += m.sum(axis=0)
            n += len(m)
        z = float(self.out[:FILTERS] @ top + self.out[FILTERS:] @ (total / n)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, texts: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
        y = np.array([label for _, label in texts], np.float32)
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, _ in texts]
        data = [d if len(d) >= WIDTH else np.pad(d, (0, WIDTH - len(d))) for d in data]
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        rng = np.random.default_rng(seed)
        params = {"w": self.w, "b": self.b, "out": self.out, "bias": np.zeros(1, np.float32)}
        mean = {k: np.zeros_like(v) for k, v in params.items()}
        square = {k: np.zeros_like(v) for k, v in params.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            rate = RATE * (0.1 + 0.9 * (1 - epoch / epochs))
            for lo in range(0, len(order), 32):
                g = {k: np.zeros_like(v) for k, v in params.items()}
                batch = order[lo : lo + 32]
                for i in batch:
                    self._gradient(data[i], y[i], weight[i] / len(batch), params, g)
                step += 1
                for k, v in params.items():
                    g[k] += 1e-4 * v
                    mean[k] += 0.1 * (g[k] - mean[k])
                    square[k] += 0.01 * (g[k] * g[k] - square[k])
                    v -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        self.bias = float(params["bias"][0])
        return self

    def _gradient(self, d: np.ndarray, y: float, weight: float, params: dict, g: dict) -> None:
        r = self.responses(d)
        starts = np.arange(0, max(1, len(r) - (CHUNK - STEP) * CELL), STEP * CELL)
        at = np.stack([s + r[s : s + CHUNK * CELL].argmax(axis=0) for s in starts])  # chunk, filter
        ks = np.arange(FILTERS)
        m = np.maximum(r[at, ks] + self.b, 0)
        first = m.argmax(axis=0)
        top, avg = m[first, ks], m.mean(axis=0)
        z = float(self.out[:FILTERS] @ top + self.out[FILTERS:] @ avg) + float(params["bias"][0])
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g["out"][:FILTERS] += e * top
        g["out"][FILTERS:] += e * avg
        g["bias"] += e
        back = np.tile(e * self.out[FILTERS:] / len(starts), (len(starts), 1))
        back[first, ks] += e * self.out[:FILTERS]
        back = np.where(m > 0, back, 0)
        g["b"] += back.sum(axis=0)
        kk = np.broadcast_to(ks, at.shape)
        for j in range(WIDTH):
            np.add.at(g["w"][j], (d[at + j], kk), back)


def score_documents(documents: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id and score of each document."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([net.score(t.encode("utf-8", "replace")) for t in texts], dtype="float64")

    return documents.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    net = ByteNet().fit(labelled_texts(documents, labels, "quality", remainder != 2, PER_CLASS, MAX_BYTES))
    return score_documents(documents, net).select(
        "doc_id",
        F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
