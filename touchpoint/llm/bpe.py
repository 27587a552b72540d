"""Byte-level BPE encoding and decoding (op4).

A rank file lists byte strings; BPE would merge, inside each match of the split
pattern, the adjacent pair of lowest rank until none is left. The same ids come out
of a left-to-right search without any merging: at each byte take the longest token
that starts there, and keep it if it is *compatible* with the token before it (the
two, put side by side, would not have merged otherwise). If no shorter token fits
either, step back one token. A byte position that failed once is never tried again,
so the work is linear in the text.

Longest tokens come from a pyahocorasick automaton over the token bytes, mapped to
Latin-1 strings one character per byte. Compatibility of two tokens depends on those
two alone, so it is memoised; so are the ids of a whole match.

The ranks are read once on the driver (a vocabulary file: a fixed size that does not
depend on the corpus) and broadcast with the two halves each token was merged from.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from touchpoint.llm.stages import small_batches

#: Matches kept with their ids, and token pairs kept with their compatibility, per worker.
MEMO_ENTRIES = 300_000
PAIR_ENTRIES = 300_000
#: Bytes of output in one Arrow batch.
OUT_BYTES = 2 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id. The ids must be 0 .. n-1."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks of a vocabulary must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def merge_halves(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the ids of the two tokens whose merge made it; itself twice for a
    single byte. Found by merging the token's bytes with lower ranks only."""
    ids = {t: i for i, t in enumerate(tokens)}
    left, right = np.arange(len(tokens)), np.arange(len(tokens))
    for own, token in enumerate(tokens):
        parts = [ids[token[k : k + 1]] for k in range(len(token))]
        while len(parts) > 2:
            pairs = [(r, k) for k in range(len(parts) - 1) if (r := ids.get(tokens[parts[k]] + tokens[parts[k + 1]], own)) < own]
            if not pairs:
                raise ValueError(f"token {own} cannot be built by merges of lower rank")
            rank, k = min(pairs)
            parts[k : k + 2] = [rank]
        left[own], right[own] = parts[0], parts[-1]
    return left, right


class Encoder:
    """Encodes and decodes with one vocabulary; built once per Python worker."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray, pattern: str):
        self.tokens, self.count = tokens, len(tokens)
        self.left, self.right = left.tolist(), right.tolist()
        self.merged: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            if a != i:
                self.merged[a, b] = i
        self.ids = ids = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.automaton.make_automaton()
        # longest proper prefix that is a token, -1 for none
        self.shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in tokens]
        self.lengths = [len(t) for t in tokens]
        self.sizes = np.array(self.lengths, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.pairs: dict[int, bool] = {}  # by a * tokens + b
        self.memo = _Memo(self)
        self.split = splitter(pattern)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b side by side as they are."""
        key = a * self.count + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of both sides from the latest to the first, and see whether the
        # two parts that touch would have merged before one of them was taken up.
        bound = len(self.tokens)
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < bound:
                return False
            whole = [t for t in (a, b) if self.left[t] != t]
            if not whole:
                return True
            if self.left[a] != a and (self.left[b] == b or a > b):
                bound, a = a, self.right[a]
            else:
                # of equal ranks the left one merges first, so b's own rank still loses to it
                bound, b = b + 1, self.left[b]

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one match."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, (before_end, token) in self.automaton.iter(data.decode("latin-1")):
            longest[end - before_end] = token  # a later end is a longer token
        lengths, shorter, pairs, count = self.lengths, self.shorter, self.pairs, self.count
        dead: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, longest[0] if n else -1
        while at < n:
            while token >= 0:
                if at + lengths[token] not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(last * count + token)
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                last = token
                token = longest[at] if at < n else -1
            elif out:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
                token = shorter[token]
            else:
                raise ValueError("the vocabulary cannot spell these bytes")
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes the ids stand for."""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[tokens] - (ends - sizes), sizes) + np.arange(total)].tobytes()


class _Memo(dict):
    """Match -> ids; forgets everything when full."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, match: str) -> bytes:
        ids = pack("<%dI" % len(out := self.encoder.encode_bytes(match.encode())), *out)
        if len(match) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[match] = ids
        return ids


#: The pattern whose plain form is known (fixed value).
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """The function that lists the matches of ``pattern`` in a text. Texts made only of
    ASCII and of U+00C0 to U+024F (letters, but for the signs of multiplication and
    division) go to the standard module with the classes spelt out, which is faster
    and gives the same matches."""
    general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    if pattern != KNOWN_PATTERN:
        return general
    letters = "A-Za-zÀ-ÖØ-öø-ɏ"
    plain = re.compile(rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r {letters}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
    other = re.compile("[^\x00-\x7fÀ-ɏ]").search
    return lambda text: general(text) if other(text) else plain(text)


_BUILT: dict[tuple, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; built at its first use."""
    tokens, left, right, pattern = shared.value
    key = (len(tokens), hash(b"\0".join(tokens[-1000:])), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(tokens, left, right, pattern)
    return _BUILT[key]


def share_vocabulary(spark, path: str, pattern: str):
    small_batches(spark)
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast((tokens, *merge_halves(tokens), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded`` (binary, the bytes the ids stand for).

    A null or empty text has no ids. Rows are independent: repeated rows give repeated
    results, other columns of the input are ignored whatever their names, an empty table
    gives an empty one. A text of any length is encoded whole.
    """
    shared = share_vocabulary(docs.sparkSession, ranks_path, pattern)
    cut = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = dict(cut.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            texts = batch.column("text")
            at, rows, held = 0, [], 0
            for k in range(len(texts)):
                ids = encoder.encode(texts[k].as_py() or "")
                rows.append((ids, encoder.decode(ids)))
                held += 2 * len(ids)
                if held >= OUT_BYTES or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "ids", "decoded"])
                    at, rows, held = k + 1, [], 0

    out = cut.mapInArrow(run, f"id {kind}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_column)
