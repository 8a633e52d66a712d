"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, in hashed places, pairs of neighbouring character
classes, and a few bins of how words repeat, all counted over the whole text. A
bounded sample of labelled rows gives the term weights, the latent axes
(singular vectors) and the labelled vectors, which are broadcast: their size is
SAMPLE_ROWS * AXES floats. Every document is compared with all of them, in blocks
of exact cosine products. Of equally near vectors those of the smaller ids count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import arrow_map, labelled_sample, learning_rows

SAMPLE_ROWS = 6_000
AXES = 48
NEIGHBOURS = 25
BLOCK = 512
#: Similarities count by this power.
SHARPNESS = 4.0
PREDICT_AT = 0.7

CLASSES = 64
BINS = 8
WORDS = 2048
BINNED = CLASSES * CLASSES
WORDED = BINNED + 3 * BINS
TERMS = WORDED + WORDS


def _classes() -> np.ndarray:
    """Byte to class: a-z by letter, A-Z one class, digits one, bytes over 127 three by kind, each other sign its own."""
    table = np.zeros(256, np.int64)
    signs = [b for b in range(128) if not chr(b).isalnum() and b >= 32] + [9, 10]
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            table[b] = 1 + b - 97
        elif "A" <= c <= "Z":
            table[b] = 27
        elif "0" <= c <= "9":
            table[b] = 28
        elif b >= 128:
            table[b] = 29 if b < 0xC0 else 30 if b < 0xE0 else 31
        elif b in signs:
            table[b] = 32 + signs.index(b) % 32
    return table


TABLE = _classes()


def counts(text: str) -> np.ndarray:
    """Term counts of the whole text."""
    out = np.zeros(TERMS, np.float32)
    data = text.encode()
    kinds = TABLE[np.frombuffer(data, np.uint8)]
    if len(kinds) > 1:
        out[: CLASSES * CLASSES] = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    ws = data.split()
    if ws:
        n = len(ws)
        again = sum(map(bytes.__eq__, ws[1:], ws[:-1])) / n
        new = len({*ws}) / n
        for k, x in enumerate((again, new, min(1.0, np.log2(n + 1) / 14))):
            out[BINNED + k * BINS + min(BINS - 1, int(x * BINS))] = 0.25 * len(kinds)
        out[WORDED:] = np.bincount(np.fromiter(map(crc32, data.lower().split()), np.int64, n) & (WORDS - 1), minlength=WORDS)
    return out


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of damped, weighted counts, in place; an empty text stays 0."""
    np.sqrt(rows, out=rows)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return rows


@dataclass
class Neighbours:
    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors on the axes; rows (counts) are used up."""
        empty = ~rows.any(axis=1)
        z = (weighted(rows, self.idf) - self.mean) @ self.axes
        z[empty] = 0
        return unit(z)

    def vote(self, z: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, by similarity; without any similar one, the base rate.
        Of the vectors as near as the last one that counts, those that come first do."""
        if not len(self.labels):
            return np.full(len(z), self.base)
        sims = z @ self.vectors.T
        k = min(neighbours, sims.shape[1])
        last = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
        near = sims >= last
        for i in np.flatnonzero(near.sum(axis=1) > k):
            ties = np.flatnonzero(sims[i] == last[i])
            near[i, ties[k - (sims[i] > last[i]).sum() :]] = False
        at = np.nonzero(near)[1].reshape(len(z), k)
        w = np.maximum(np.take_along_axis(sims, at, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = w.sum(axis=1)
        return np.where(total > 1e-9, (w * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-9), self.base)


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def fit_neighbours(rows: np.ndarray, labels: np.ndarray, axes: int = AXES, seed: int = 7) -> Neighbours:
    """Latent axes by a randomised singular value decomposition of the sample's weighted counts, which are used up."""
    if not len(rows):
        return Neighbours(np.ones(TERMS, np.float32), np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    empty = ~rows.any(axis=1)
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = weighted(rows, idf)
    mean = x.mean(axis=0)
    x -= mean
    q = x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(axes + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ (x.T @ np.linalg.qr(q)[0]))
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    basis = np.ascontiguousarray(vt[:axes].T)
    z = x @ basis
    z[empty] = 0
    return Neighbours(idf, mean, basis, unit(z), labels.astype(np.float64), float(labels.mean()))


def sample_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Term counts, by row, and labels of a labelled sample, in order of ids. Texts are counted on the executors; a row
    that comes to the driver has TERMS entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t.as_py()) for t in batch.column("text")]
            at = [np.flatnonzero(r).astype(np.int32) for r in rows]
            made = [pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(rows, at)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *made], names=["id", "label", "at", "n"])

    kind = sample.schema["id"].dataType.simpleString()
    got = arrow_map(sample, run, f"id {kind}, label int, at array<int>, n array<float>").toArrow().sort_by("id")
    out = np.zeros((got.num_rows, TERMS), np.float32)
    for i, (at, n) in enumerate(zip(got.column("at"), got.column("n"))):
        out[i, at.values.to_numpy()] = n.values.to_numpy()
    return out, got.column("label").to_numpy()


def score_quality(docs: DataFrame, model: Neighbours, predict_at: float = PREDICT_AT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher: label 1 likelier), predicted (score >= predict_at).

    Texts are read whole. Null, empty and one-byte texts have no terms and get the sample's base rate. Ids may be
    null or repeat; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                score = m.vote(m.project(np.stack([counts(t.as_py() or "") for t in part.column("text")])))
                score = np.clip(score, 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= predict_at).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(docs[id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return arrow_map(rows, run, "doc_id bigint, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality", where: Column | None = None) -> DataFrame:
    """Fit on at most so many labelled rows (by default of those that may be learned from) and score all of docs."""
    where = learning_rows() if where is None else where
    return score_quality(docs, fit_neighbours(*sample_counts(labelled_sample(docs, labels, label, rows, where=where))))
