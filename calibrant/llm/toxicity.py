"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold_k - weights . x): one weight vector for all
grades, and ordered thresholds. Features are the words of a text and their
beginnings, present or not. The model is fitted on a bounded sample of labelled
rows; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import arrow_map, give_back, labelled_sample

TRAIN_ROWS = 12_000
FEATURES = 8_192
MIN_ROWS = 3
#: Features are hashed into so many places.
SPACE = 1 << 22
PREFIXES = (5, 7)
GRADES = 4
PENALTY = 2e-3
STEPS = 300
#: A text is called toxic where P(grade >= 1) reaches this: the penalty draws probabilities of few-word cases down.
REJECT_AT = 0.35
#: ASCII letters stay, other ASCII characters part words, and bytes of other characters stay.
TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(TABLE).split()


def features(ws: list[bytes]) -> set[int]:
    """Hashes of the words, and of the beginnings of longer words, which are marked by a leading dash."""
    own = {*ws}
    return {crc32(f) & (SPACE - 1) for f in own | {b"-" + w[:n] for w in own for n in PREFIXES if len(w) > n}}


@dataclass
class Severity:
    """A fitted model: weights by feature, thresholds in ascending order."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1 on."""
        get = self.weights.get
        eta = sum(get(f, 0.0) for f in features(words(text)))
        return 1 / (1 + np.exp(np.clip(self.thresholds - eta, -60, 60)))


@dataclass
class Row:
    """A labelled text: hashes of its features, and, if it is toxic, of its words with their counts; else none."""

    toxic: int
    features: np.ndarray
    words: np.ndarray
    counts: np.ndarray


def association(rows: list[np.ndarray], toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell toxic rows from others most, and their z scores. Memory is SPACE counts, whatever the rows."""
    inside, outside = np.zeros(SPACE, np.float32), np.zeros(SPACE, np.float32)
    for fs, t in zip(rows, toxic.tolist()):
        (inside if t else outside)[fs] += 1  # a row's features are distinct
    n1, n0 = max(1, int(toxic.sum())), max(1, len(rows) - int(toxic.sum()))
    seen = np.flatnonzero(inside + outside >= MIN_ROWS)
    a, b = inside[seen].astype(float), outside[seen].astype(float)
    p = (a + b + 0.5) / (n1 + n0 + 1)
    z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    best = np.lexsort((seen, -np.abs(z)))[:size]
    return seen[best], z[best]


def severity_grades(rows: list[Row], size: int = FEATURES, grades: int = GRADES) -> np.ndarray:
    """Labels say toxic or not; toxic rows are graded 1 on by quantiles of the share of words that go with toxicity. Which
    words do is learned from the other half of the sample, so that no row grades itself."""
    toxic = np.array([r.toxic for r in rows], int)
    share = np.zeros(len(rows))
    for half in (0, 1):
        others = [r for i, r in enumerate(rows) if i % 2 != half]
        vocabulary, z = association([r.features for r in others], np.array([r.toxic for r in others], int), size)
        lexicon = vocabulary[z > 4]
        for i, r in enumerate(rows):
            if i % 2 == half and r.toxic and r.counts.sum():
                share[i] = r.counts[np.isin(r.words, lexicon)].sum() / r.counts.sum()
    out = np.zeros(len(rows), int)
    if toxic.any():
        cuts = np.quantile(share[toxic == 1], [k / (grades - 1) for k in range(1, grades - 1)])
        out[toxic == 1] = 1 + np.searchsorted(cuts, share[toxic == 1], side="right")
    return out


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, vocabulary: np.ndarray, n_grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS) -> Severity:
    """Penalised maximum likelihood by gradient steps with per-parameter rates (Adam). Thresholds are the first one
    and positive gaps, so they stay in order. Deterministic."""
    place = np.full(SPACE, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    kept = [(p := place[fs])[p >= 0] for fs in rows]
    r = np.repeat(np.arange(len(rows)), [len(k) for k in kept])
    c = np.concatenate([*kept, np.zeros(0, np.int32)]).astype(np.int64)
    n, m, k = len(rows), len(vocabulary), n_grades - 1
    share = np.array([max((grades >= j).mean(), 1e-3) for j in range(1, n_grades)]) if n else np.full(k, 0.01)
    start = np.log((1 - np.minimum(share, 0.999)) / np.minimum(share, 0.999))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    p = np.concatenate([np.zeros(m), start[:1], gaps])
    if not n:
        return Severity({}, start)
    mean, square = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        w, th = p[:m], p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])
        eta = np.bincount(r, w[c], n)
        upper = np.where(grades < k, sigmoid(np.append(th, 0)[grades] - eta), 1.0)
        lower = np.where(grades > 0, sigmoid(np.insert(th, 0, 0)[grades] - eta), 0.0)
        like = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / like, lower * (1 - lower) / like
        g_eta = du - dl  # of the negative log likelihood
        g_th = np.array([dl[grades == j + 1].sum() - du[grades == j].sum() for j in range(k)]) / n
        g_gap = np.array([g_th[j + 1 :].sum() for j in range(k - 1)]) * np.exp(p[m + 1 :])
        grad = np.concatenate([np.bincount(c, g_eta[r], m) / n + penalty * w / max(1, np.sqrt(m) / 16), [g_th.sum()], g_gap])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        p = p - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = {int(f): float(x) for f, x in zip(vocabulary, p) if abs(x) > 1e-4}
    return Severity(weights, p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))]))


def sample_features(sample: DataFrame) -> list[Row]:
    """Features and word counts of a labelled sample, in order of ids. Texts are read on the executors; what comes to the
    driver is hashes, SPACE a row at most. Words and counts come of toxic rows alone: grades need no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            made: list[list[np.ndarray]] = [[], [], []]
            for t, toxic in zip(batch.column("text"), batch.column("label").to_pylist()):
                ws = words(t.as_py())
                own = ws if toxic else []
                at, n = np.unique(np.fromiter(map(crc32, own), np.int64, len(own)) & (SPACE - 1), return_counts=True)
                for out, x in zip(made, (np.fromiter(features(ws), np.int32), at, n)):
                    out.append(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array(m, ints) for m in made)], names=["id", "label", "features", "words", "counts"])

    kind = sample.schema["id"].dataType.simpleString()
    got = arrow_map(sample, run, f"id {kind}, label int, features array<int>, words array<int>, counts array<int>").toArrow().sort_by("id")
    cols = [got.column(c) for c in ("label", "features", "words", "counts")]
    return [Row(y.as_py(), *(x.values.to_numpy() for x in xs)) for y, *xs in zip(*cols)]


def fit_severity(sample: DataFrame, size: int = FEATURES, n_grades: int = GRADES) -> Severity:
    """Fit on a labelled sample (id, text, label: toxic 0 or 1). Without toxic rows every score is near 0. The driver gives
    back what the sample took of its memory: later stages shouldn't carry it."""

    def fit(rows: list[Row]) -> Severity:
        found = [r.features for r in rows]
        vocabulary, _ = association(found, np.array([r.toxic for r in rows], int), size)
        return fit_ordinal(found, severity_grades(rows, size, n_grades), vocabulary, n_grades)

    model = fit(sample_features(sample))
    give_back()
    return model


def score_severity(docs: DataFrame, model: Severity, reject_at: float = REJECT_AT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, expected_severity (0 to the highest grade), grade (the largest that is as
    likely reached as not), p_toxic, toxic (p_toxic >= reject_at).

    Texts are read whole; null and empty ones have no features, so the model's base rate. Ids may be null or
    repeat; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = np.array([m.at_least(t.as_py() or "") for t in batch.column("text")]).reshape(batch.num_rows, -1)
            made = [pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= reject_at)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(docs[id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return arrow_map(rows, run, "doc_id bigint, expected_severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Severity, reject_at: float = REJECT_AT, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts aren't toxic (p_toxic < reject_at)."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.at_least(t.as_py() or "")[0] < reject_at for t in batch.column(place)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, where: Column | None = None, label: str = "toxic") -> DataFrame:
    """Fit on at most so many labelled rows (those that where admits) and score all of docs."""
    return score_severity(docs, fit_severity(labelled_sample(docs, labels, label, rows, where=where)))
