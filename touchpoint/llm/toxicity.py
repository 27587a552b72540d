"""Toxicity scores (op8): FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features of a text are the presence of its words, of pairs of neighbouring words and of
pairs with one word between, hashed to ``2**BITS`` coordinates. FTRL-proximal keeps two
numbers per coordinate: an adaptive learning rate falls where gradients were large, and
the L1 term leaves every coordinate at exactly zero whose evidence stays small. What is
broadcast is the list of non-zero weights: a few thousand pairs, at most 2**BITS.

Training takes a bounded sample: of either label at most ``TRAIN_ROWS`` rows, those with
the smallest hashes of their id among rows of at most ``TRAIN_BYTES`` bytes of text, whole.
Where the bound cuts a label's rows, the rest count for those left out (importance
weights). The boundary (score 0.5) is placed on a fifth of the sample kept aside from a
first fit; the final fit uses the whole sample. Coordinates seen in fewer than ``MIN_ROWS`` rows of the sample get no weight.
Scoring reads whole texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.batches import mix64, prefix_hashes, span_hashes, text_blocks
from touchpoint.llm.stages import bounded_sample, small_batches

BITS = 20
TRAIN_ROWS, TRAIN_BYTES = 4000, 1 << 15
MIN_ROWS = 4
EPOCHS, SEED = 6, 11
#: FTRL-proximal: rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
#: One row in so many is kept aside to place the boundary, where a wrong alarm costs as
#: much as so many misses (both as shares of their label).
ASIDE_ONE_IN, ALARM_COST = 5, 6.0

U = np.uint64


def word_table() -> np.ndarray:
    """Bytes of words: letters, digits and all non-ASCII bytes."""
    own = np.zeros(256, bool)
    own[48:58] = own[65:91] = own[97:123] = own[128:] = True
    return own


IS_WORD = word_table()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, coordinate) of every feature occurrence in a block of lower-cased texts."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where documents do
    opens = word & (edge[:-1] | ~np.concatenate(([False], word[:-1])))
    closes = word & (edge[1:] | ~np.concatenate((word[1:], [False])))
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    h = span_hashes(prefix_hashes(data), starts, ends)
    docs, codes = [doc], [h]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            codes.append(mix64(h[:-gap][same] * U(3) + h[gap:][same] * U(5) + U(gap)))
    return np.concatenate(docs), (np.concatenate(codes) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    at: np.ndarray  # coordinates with a weight, ascending
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def row_features(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return np.unique(features(data, np.array([0, len(data)]))[1]).astype(np.int32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """(weights, bias) after ``EPOCHS`` passes, one row at a time; ``counts``: what each row counts."""
    seen = np.zeros(1 << BITS, np.int32)
    for at in rows:
        seen[at] += 1
    rows = [at[seen[at] >= MIN_ROWS] for at in rows]
    # the last place of z and n is the bias, which every row has; L1 does not hold it
    bias_at = np.array([1 << BITS])
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at) -> np.ndarray:
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at = np.concatenate((rows[i], bias_at))
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]) * counts[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    return w[:-1], float(w[-1])


def boundary(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the labels best; 0 where a label is missing."""
    low, high = np.sort(logits[labels == 0]), np.sort(logits[labels == 1])
    if not len(low) or not len(high):
        return 0.0
    at = np.unique(logits)
    cuts = np.concatenate((at[:1] - 1, (at[1:] + at[:-1]) / 2, at[-1:] + 1))
    alarms = 1 - np.searchsorted(low, cuts) / len(low)
    misses = np.searchsorted(high, cuts) / len(high)
    cost = misses + ALARM_COST * alarms
    best = cuts[cost <= cost.min() + 1e-9]
    return float((best[0] + best[-1]) / 2)


def fit(texts: list[str], labels: list[int], weights_of: tuple[float, float] = (1.0, 1.0), seed: int = SEED) -> Model:
    """``weights_of``: what a row of label 0 and of label 1 counts. Without any toxic row
    there is nothing to learn, and every text scores near 0."""
    if not any(labels):
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), -8.0)
    rows = [row_features(t) for t in texts]
    y = np.array(labels, np.int64)
    counts = np.array(weights_of)[y] if len(y) else np.empty(0)
    aside = np.zeros(len(rows), bool)
    for k in (0, 1):
        aside[np.flatnonzero(y == k)[::ASIDE_ONE_IN]] = True
    shift = 0.0
    if len(rows) >= 50:
        first, bias = ftrl([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], counts[~aside], seed)
        shift = boundary(np.array([first[rows[i]].sum() + bias for i in np.flatnonzero(aside)]), y[aside])
    w, bias = ftrl(rows, y, counts, seed)
    at = np.flatnonzero(w)
    return Model(at, w[at].astype(np.float32), bias - shift)


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns ``toxic`` from the labelled rows that are not held out. Rows without id,
    text or label are left out; an id with several labels gives several rows."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.when(F.col("toxic").cast("int") != 0, 1).otherwise(0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    # at most 2 * rows ids, however often one is repeated; the same holds for their texts
    chosen = bounded_sample(marked, ["doc_id"], rows, per="toxic")
    found = bounded_sample(texts.join(F.broadcast(chosen), "doc_id"), ["doc_id", "text"], rows, per="toxic")
    picked: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(tuple(r) for r in found.select("doc_id", "toxic", "text").collect()):
        picked[r[1]].append(r[2])
    weights_of = tuple(max(1.0, sizes.get(k, 0) / rows) for k in (0, 1))
    return fit(picked[0] + picked[1], [0] * len(picked[0]) + [1] * len(picked[1]), weights_of)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in 0..1 and predicted (1 from 0.5 on), one row per row.

    Only the text decides. A null or empty text has no features, so its score is the
    model's base rate. Columns other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cut = docs.select("doc_id", F.lower(F.col("text").cast("string")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        dense = own.dense()
        for batch in batches:
            total = np.full(batch.num_rows, own.bias)
            for at, end, data, offsets in text_blocks(batch, "text"):
                doc, code = features(data, offsets)
                has = dense[code] != 0
                once = np.unique((doc[has] << BITS) | code[has])  # presence, not counts
                total[at:end] += np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], end - at)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return cut.mapInArrow(run, f"doc_id {dict(cut.dtypes)['doc_id']}, score double, predicted int")
