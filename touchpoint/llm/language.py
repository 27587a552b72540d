"""Language identification (op7): averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy, with calibrated rejection.

A text is lower-cased; its features are the 2-, 3- and 4-byte pieces of its words (with
word boundaries), hashed to ``BUCKETS`` rows of an embedding table. A text is the mean
of its pieces' rows; a linear layer and a softmax give the languages. As both are linear,
the trained table and layer collapse into one table of per-piece scores, which is what
is broadcast (BUCKETS x languages floats: fixed size) and what scoring averages.

Training takes a bounded sample of whole texts: of each language the same number of rows,
``TRAIN_ROWS`` shared out but ``LANGUAGE_ROWS`` at least, those with the smallest hashes of
id and text; texts of over ``TRAIN_BYTES`` bytes only where a language has no others. So a
rare language is learned like a common one. A tenth of the sample is kept aside to
calibrate: a temperature makes the scores probabilities, and the rejection threshold is the
score that all but one in ``REJECT_ONE_IN`` correctly labelled rows reach. Without labels
there is nothing to tell apart: only texts without letters are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpoint.llm.batches import mix64
from touchpoint.llm.stages import bounded_sample, free_name, small_batches

BUCKETS, DIMENSIONS, ORDERS = 1 << 15, 16, (2, 3, 4)
TRAIN_ROWS, LANGUAGE_ROWS, TRAIN_BYTES = 2000, 100, 1 << 15
EPOCHS, RATE, SEED = 4, 0.5, 7
REJECT_ONE_IN = 1000
UNKNOWN = "und"
ADDED = ("lang_pred", "lang_score", "lang_rejected")
#: Texts per pass of the scorer stay below so many bytes.
PIECE_BYTES = 1 << 18


def pieces(data: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of all pieces of lower-cased UTF-8 bytes. Runs of anything but
    letters become one blank, so digits, signs and layout say nothing."""
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    data = np.where(letter, data, 32)[keep].astype(np.uint64)
    data = np.concatenate([np.array([32], np.uint64), data, np.array([32], np.uint64)])
    out = []
    for n in ORDERS:
        if len(data) >= n:
            code = np.full(len(data) - n + 1, n, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | data[k : k + len(code)]
            out.append(mix64(code) & np.uint64(buckets - 1))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, float32: embedding times layer, over temperature
    bias: np.ndarray
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.lower().encode(), np.uint8)
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(1, len(data)), PIECE_BYTES):  # bounded temporaries for very long texts
            found = pieces(data[at : at + PIECE_BYTES])
            total += np.bincount(found, minlength=BUCKETS).astype(np.float64) @ self.scores if len(found) > BUCKETS else self.scores[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); und with 0 for texts without a letter."""
        if not text or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text))
        best = int(p.argmax())
        return self.languages[best], min(1.0, float(p[best]))

    def rejects(self, lang: str, score: float) -> bool:
        if lang == UNKNOWN:  # without labels, that is the only answer
            return score == 0.0 or self.languages != [UNKNOWN]
        return score < self.threshold


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    """Stochastic gradient descent, one text at a time, on nine tenths of the rows."""
    names = sorted(set(langs))
    if not names:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 0.0)
    target = np.array([names.index(x) for x in langs])
    rows = []
    for t in texts:
        at, count = np.unique(pieces(np.frombuffer(t.lower().encode(), np.uint8)), return_counts=True)
        rows.append((at.astype(np.int32), (count / count.sum()).astype(np.float32)))
    aside = np.arange(len(rows)) % 10 == 0 if len(rows) >= 100 else np.zeros(len(rows), bool)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    train = np.flatnonzero(~aside)
    # rows of a language that has few are seen more often
    train = np.repeat(train, np.maximum(1, LANGUAGE_ROWS // np.maximum(1, np.bincount(target[train], minlength=len(names))))[target[train]])
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share = rows[i]
            mean = share @ table[at]
            error = softmax(mean @ layer + bias)
            error[target[i]] -= 1
            down = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            table[at] -= rate * len(at) * share[:, None] * down
    held = np.flatnonzero(aside) if aside.any() else train
    raw = np.array([rows[i][1] @ table[rows[i][0]] @ layer + bias for i in held]).reshape(len(held), len(names))
    cold = 1 / temperature(raw, target[held])
    p = softmax(raw * cold)
    right = np.sort(p.max(1)[p.argmax(1) == target[held]])
    threshold = float(right[len(right) // REJECT_ONE_IN]) * 0.9 if len(right) else 0.0
    return Model(names, (table @ layer * cold).astype(np.float32), bias * cold, min(threshold, 0.5))


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on the rows kept aside."""
    grid = np.geomspace(0.25, 16, 49)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from text and non-null lang of the rows not held out."""
    cut = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = cut.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    languages = usable.agg(F.approx_count_distinct("lang").alias("n")).first()["n"]
    each = max(LANGUAGE_ROWS, -(-rows // max(1, languages)))
    chosen = bounded_sample(usable, ["id", "text"], each, per="lang", last=f"octet_length(text) > {TRAIN_BYTES}")
    sample = sorted((r["id"], r["lang"], r["text"]) for r in chosen.collect())
    return fit([r[2] for r in sample], [r[1] for r in sample])


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) plus lang_pred, lang_score and
    lang_rejected; one row per row.

    Only the text decides. A null, empty or letterless text is ``und`` with score 0 and
    rejected; so is any text whose score is below the model's threshold, which keeps its
    predicted language. A model of no labels calls every other text ``und`` with score 1
    and does not reject it. ``names`` are those of the added columns; input columns of these
    names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_column = free_name(docs, "__text")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in names]
    cut = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias(text_column))
    schema = T.StructType([*cut.drop(text_column).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(text_column)]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([own.rejects(*x) for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*kept, *names])

    return cut.mapInArrow(run, schema)
