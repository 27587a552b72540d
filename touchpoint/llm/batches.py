"""Helpers for Arrow batches inside Spark tasks: bounded blocks of texts, word spans
and 64-bit hashes computed with numpy over the raw UTF-8 bytes.

A block holds a few hundred KB of text (or one document, if that is longer), so the
temporaries of a task do not depend on the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

U = np.uint64
_MIX1, _MIX2, _BASE = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A fixed random-looking 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=U) * U(_BASE))


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(b^i, b^-i) modulo 2^64 for i < n at least; kept between calls."""
    if len(_POWERS[0]) < n:
        n = max(n, BLOCK_BYTES + 2)
        b = _BASE | 1
        for k, base in enumerate((b, pow(b, -1, 1 << 64))):
            step = np.full(n, U(base))
            step[0] = U(1)
            _POWERS[k] = np.cumprod(step, dtype=U)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums; ``span_hashes`` turns them into hashes of any span."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(byte_values()[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per span [start, end): equal bytes give equal hashes."""
    inverse = powers(len(prefix))[1]
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * U(_BASE))


def fold_table() -> np.ndarray:
    """Maps A-Z to a-z and every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


FOLD = fold_table()
IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words are runs without blanks inside one document;
    document d has the words first[d] to first[d + 1] - 1."""
    word = ~IS_BLANK[buf]
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(buf)]
    opens[cuts] = word[cuts]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    last = cuts[cuts > 0] - 1
    closes[last] = word[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows with at most ``limit``
    bytes of text, or one row. A null text has no bytes."""
    texts = batch.column(column)
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null(b"")
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
