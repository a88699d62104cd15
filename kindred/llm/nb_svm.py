"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes.

A text is cut into runs of letters and digits, and runs of symbols, as they stand (case and punctuation tell junk from
prose).  Its features are the distinct n-grams of these runs (``NGRAMS``), hashed into ``BUCKETS`` buckets.  Each bucket is scaled by its
log-count ratio ``log((a + p) / |a + p|) - log((a + q) / |a + q|)``, with ``p`` and ``q`` the training rows of either label that hold it; the
scaled vector has length 1.  A linear model with hinge loss is fitted by dual coordinate descent: one multiplier in [0, C] for each row, set to its
best value given all others, in seeded random order, until no multiplier moves (Hsieh et al. 2008; Wang and Manning 2012).  A sigmoid, fitted on
margins of rows that the model hasn't seen (``FOLDS`` folds), turns margins into scores.

Training takes at most ``SAMPLE`` labelled rows, those with the smallest hashes of their doc_id, and of these as many as have ``ENTRIES``
features together: a bounded sample, whatever the corpus.  Scoring reads every whole text.  Labels, language, source and doc_id are no
inputs of a score.

Defined cases: a null text is scored as an empty one; a text without features has the margin of the bias alone.  Labels that are null,
neither 0 nor 1, or without doc_id are ignored; a doc_id labelled twice counts once, as 0 if any says so; of documents that repeat a labelled doc_id
the one with the smallest text is trained on.  Without training rows of both labels every score is the share of label 1, half a row of each added.
A row without doc_id isn't held out.  Repeated rows get equal scores; an empty table gives an empty result.  :func:`scored` carries other columns
along and replaces one whose name is that of the score in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kindred.llm.words import blocks, mix, windows
from kindred.llm.workspace import Workspace, ship

BUCKETS, NGRAMS = 1 << 18, (1, 2, 3)
SAMPLE, ENTRIES = 12_000, 8_000_000
#: Smoothing of counts, bound of multipliers, most rounds, least movement, folds of the calibration.
ALPHA, C, ROUNDS, STILL, FOLDS = 1.0, 4.0, 40, 0.01, 3
THRESHOLD = 0.7

_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: letters and digits (any byte beyond ASCII), 2: symbols
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of a block of rows, and where each row's begin."""
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    edge = np.flatnonzero(new)
    start, end = edge[:-1], edge[1:]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    hashes = np.zeros(len(start), np.uint64)
    left = end - start
    # Byte by byte of all runs at once; what is long shrinks to few runs quickly.
    at, k = np.arange(len(start)), 0
    while len(at):
        hashes[at] = mix(hashes[at] ^ _BYTE[data[start[at] + k]]) + _ODD
        k += 1
        at = at[left[at] > k]
        if k >= 64 and len(at):  # a very long run: the rest by a sum of products, which needs no loop
            for i in at.tolist():
                rest = _BYTE[data[start[i] + k : end[i]]] ^ np.arange(end[i] - start[i] - k, dtype=np.uint64)
                hashes[i] ^= np.bitwise_xor.reduce(mix(rest * _ODD))
            break
    return hashes, np.searchsorted(start, offsets)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row the distinct buckets of its n-grams, ascending."""
    for _, _, data, offsets in blocks(column):
        hashes, first = _runs(data, offsets)
        grams = [mix(windows(hashes, n)) % np.uint64(BUCKETS) for n in NGRAMS]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = [g[a : max(a, b - n + 1)] for n, g in zip(NGRAMS, grams)]
            yield np.unique(np.concatenate(own)).astype(np.int32)


class Model(NamedTuple):
    """Weights of the buckets (ratios included), before division by the length of the scaled vector; sigmoid of the margin."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, held: np.ndarray) -> float:
        r = self.ratios[held].astype(np.float64)
        length = float(np.sqrt(r @ r)) or 1.0
        margin = float(r @ self.weights[held]) / length + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each bucket, how much more of the rows of label 1 than of label 0 hold it."""
    sums = []
    for label in (1, 0):
        held = [r for r, y in zip(rows, labels) if y == label]
        count = np.bincount(np.concatenate(held), minlength=BUCKETS) if held else np.zeros(BUCKETS)
        sums.append(np.log(ALPHA + count) - np.log((ALPHA + count).sum()))
    return (sums[0] - sums[1]).astype(np.float32)


def coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, costs: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise ``|w|^2 / 2 + sum of cost * hinge``; ``rows`` are (buckets, values), the bias is a feature of value 1."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1 for _, v in rows])
    order, rnd = np.arange(len(rows)), np.random.default_rng(13)
    for _ in range(rounds):
        rnd.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            at, v = rows[i]
            slope = signs[i] * (float(v @ w[at]) + bias) - 1
            now = min(max(alpha[i] - slope / squares[i], 0.0), costs[i])
            step = (now - alpha[i]) * signs[i]
            if step:
                moved = max(moved, abs(step))
                alpha[i] = now
                w[at] += step * v
                bias += step
        if moved < STILL:
            break
    return w, bias


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, on targets that are kept off 0 and 1 (Platt 1999)."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        bend = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, x @ (target - p))
        theta += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from the buckets and labels of rows; both labels weigh the same together."""

    def trained(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        held, own = [rows[i] for i in chosen], labels[chosen]
        ratios = log_count_ratios(held, own)
        scaled = []
        for r in held:
            v = ratios[r].astype(np.float64)
            scaled.append((r, v / (np.sqrt(v @ v) or 1.0)))
        share = np.where(own == 1, own.mean(), 1 - own.mean())
        return ratios, *coordinate_descent(scaled, np.where(own == 1, 1.0, -1.0), C * 0.5 / share, BUCKETS)

    up = float(labels.sum())
    if up in (0, len(labels)):
        odds = (up + 0.5) / (len(labels) - up + 0.5)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(odds)))
    margins, seen = np.zeros(len(rows)), np.zeros(len(rows), bool)
    fold = np.zeros(len(rows), int)
    for label in (0, 1):  # folds have both labels in equal shares
        at = np.flatnonzero(labels == label)
        fold[at] = np.arange(len(at)) % FOLDS
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        if 0 < labels[rest].sum() < len(rest):
            ratios, w, bias = trained(rest)
            part = Model(ratios, w, bias, 1.0, 0.0)
            for i in np.flatnonzero(fold == k):
                s = part.score(rows[i])
                margins[i], seen[i] = np.log(s / (1 - s)), True
    ratios, w, bias = trained(np.arange(len(rows)))
    slope, offset = _sigmoid(margins[seen], labels[seen]) if 0 < labels[seen].sum() < seen.sum() else (1.0, 0.0)
    return Model(ratios, w, bias, slope, offset)


def fold(doc_id: str) -> F.Column:
    """0 to 3: ``crc32`` of the doc_id as text, modulo 4; 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = list(features(batch.column("text")))
        yield pa.record_batch([batch.column("key"), batch.column("label"), pa.array([len(x) for x in held], pa.int64()), pa.array([x.tobytes() for x in held], pa.binary())], names=["key", "label", "n", "held"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """A model from the labelled rows of ``docs(doc_id, text)`` that aren't held out."""
    ws = Workspace(docs.sparkSession, "nb-svm")
    seen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold("doc_id") != 2))
    seen = seen.groupBy("doc_id").agg(F.min(target).cast("int").alias("label")).withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id")  # at most ``sample`` narrow rows
    first = chosen.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label", "key")).alias("r")).select("r.*")
    cut = ws.save(first.mapInArrow(_cut, "key long, label int, n long, held binary"), "sample")
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a bounded number of rows
    kept = cut.select("key", F.sum("n").over(before).alias("total")).where(F.col("total") <= entries).agg(F.max("key").alias("last"))
    last = kept.first()["last"]
    got = sorted(cut.where(F.col("key") <= (last if last is not None else 0)).select("key", "label", "held").collect()) if last is not None else []
    ws.drop("")
    return fit([np.frombuffer(r.held, np.int32) for r in got], np.array([r.label for r in got], dtype=float))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``."""
    ship(docs.sparkSession)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name.lower() != name.lower()], T.StructField(name, T.DoubleType())])
    own = [f.name for f in schema.fields[:-1]]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.score(held) for held in features(batch.column(text))]
            yield pa.record_batch([*[batch.column(c) for c in own], pa.array(found, pa.float64())], names=[*own, name])

    return docs.select(*[f"`{c}`" for c in own]).mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    held_out = F.coalesce(fold("doc_id") == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
