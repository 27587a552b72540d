"""Suffix-array dedup of long passages (op2): a run-length index.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in
the corpus. Equal strings must meet in one task, and an index must stay small, so:

1. Every LENGTH-byte window has an anchor, the piece of ``PIECE`` bytes in it with the
   least hash. Equal windows have equal anchors. Runs of windows with one anchor
   occurrence form a stretch; a text becomes about one stretch per 175 bytes, of which
   only hashes are shuffled.
2. Stretches are counted by anchor and content. A stretch found twice is repeated as a
   whole. A stretch whose anchor occurs nowhere else is unique.
3. What is left are anchors with several different stretches (passages in changed
   surroundings, near copies). One copy of each such stretch is cut out of its document,
   and the stretches of an anchor meet in one task. It concatenates them in batches of
   ``BATCH_BYTES`` and builds a run-length index: the Burrows-Wheeler transform in runs,
   with the suffix array and the length of the common prefix sampled at run ends. Inside
   a run the match of the next position is the last one's less its first byte, so the
   matching statistics stream from the samples alone; matches of LENGTH bytes are marked.
4. An anchor with more than ``HOT_BYTES`` of different stretches (the edge of a passage
   that a third of the corpus shares) does not fit one task. Equal windows have equal
   distances from their anchor, so its stretches are cut into parts of ``STEP`` distances;
   equal windows of a part share the core of LENGTH - STEP + 1 bytes that all its windows
   cover. Parts whose core occurs once are dropped, the others meet by their core and are
   indexed as in 3. If those of one core are still too many, they are cut into finer parts,
   down to single windows, which are equal where their core is.
5. Marks go back to all copies of their stretches and are joined into spans per document.

Hashes are 64 bits and only compared under one anchor of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.batches import U, prefix_hashes, span_hashes, text_blocks
from touchpoint.llm.stages import small_batches, text_or_empty, written

LENGTH = 400
PIECE = 48
BATCH_BYTES = 1 << 20
HOT_BYTES = 4 << 20
#: Windows of a part of a hot anchor's stretch, and by how much finer parts are cut.
STEP, FINER = 32, 8
#: Bytes of a document worked on at a time; longer ones are cut with LENGTH - 1 bytes of overlap.
CHUNK = 1 << 19
#: Documents up to which their keys are broadcast to pick texts; beyond, texts are shuffled.
BROADCAST_IDS = 300_000
ROWS_OUT = 20_000

_PLACE = U((1 << 22) - 1)  # places of a chunk fit into 22 bits
KEY = ["doc_id", "text_hash"]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: the running minima of blocks from both sides."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, U)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor hash, content hash, anchor place) of each
    stretch of a block of texts; places count from the start of the text."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - piece + 1)
    pieces = span_hashes(prefix, at, at + piece)
    # ties go to the left, which depends on the window's content alone
    least = window_minima((pieces & ~_PLACE) | at.astype(U), length - piece + 1)
    anchor = (least & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[1:][text]
    place = np.flatnonzero(inside)
    if not len(place):
        return none, none, none, none, none, none
    own, whose = anchor[place], text[place]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (whose[1:] != whose[:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    start = place[first]
    content = span_hashes(prefix, start, start + count + length - 1)
    base = offsets[:-1][whose[first]]
    return whose[first], start - base, count, pieces[own[first]].astype(np.int64), content.astype(np.int64), own[first] - base


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (rows with a null or repeated doc_id differ by it, or are equal), text."""
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().cast("binary").alias("text"))


def stretch_rows(rows: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """doc_id, text_hash, start, n, anchor, content, place: every stretch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch, "text", CHUNK):
                for low in range(0, max(1, len(data) - length + 1), CHUNK):
                    if end - at == 1:
                        part = data[low : low + CHUNK + length - 1]
                        whose, start, n, anchor, content, place = stretches(part, np.array([0, len(part)]), length, piece)
                        start, place = start + low, place + low
                    elif low:
                        break
                    else:
                        whose, start, n, anchor, content, place = stretches(data, offsets, length, piece)
                    if len(whose):
                        of = pa.array(whose + at)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("text_hash").take(of), pa.array(start), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content), pa.array(place - start)], ["doc_id", "text_hash", "start", "n", "anchor", "content", "place"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, start long, n int, anchor long, content long, place long")


def pick(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` joined with ``wanted``, which has one row per key; equal rows count once."""
    ids = wanted.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_semi").dropDuplicates(KEY)
    w = wanted.withColumnsRenamed({"doc_id": "w_id", "text_hash": "w_hash"})
    return chosen.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).drop("w_id", "w_hash")


def cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, content, place, bytes) of the stretches ``wanted``."""
    by_doc = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "content", "place", "start", "n")).alias("parts"))
    found = pick(rows, written(by_doc, "wanted"))
    cut = F.transform(
        "parts",
        lambda p: F.struct(
            p["anchor"].alias("anchor"),
            p["content"].alias("content"),
            p["place"].alias("place"),
            F.substr(F.col("text"), (p["start"] + 1).cast("int"), p["n"] + F.lit(length - 1)).alias("bytes"),
        ),
    )
    return found.select(F.explode(cut).alias("s")).select("s.*")


@dataclass
class RunIndex:
    """A Burrows-Wheeler transform in runs, sampled at the runs' ends."""

    symbols: np.ndarray  # of each run
    heads: np.ndarray  # rank of the first suffix of each run
    first: np.ndarray  # suffix array at run starts
    last: np.ndarray  # suffix array at run ends
    common: np.ndarray  # common prefix of a run's first suffix with the suffix before it
    size: int


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of joined strings; ``text`` has 1 to 256 in strings and 0 at the ends.
    Each string's end is smaller than any symbol and ends are ordered by place."""
    n = len(text)
    packed = np.zeros(n, np.int64)
    padded = np.concatenate((text, np.zeros(8, text.dtype))).astype(np.int64)
    alive = np.ones(n, bool)  # no end so far
    for k in range(7):
        symbol = np.where(alive, padded[k : k + n], 0)
        packed = (packed << 9) | symbol
        alive &= symbol > 0
    order = np.argsort(packed)
    ended = ~alive[order]  # suffixes that end within the key; of equal ones the first in place is the smaller
    few = order[ended]
    order[ended] = few[np.lexsort((few, packed[few]))]
    key = packed[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | ended[1:]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 7
    while True:
        # only suffixes in groups of several are sorted further
        todo = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(todo):
            return order
        own = order[todo]
        both = (rank[own] << 31) | (rank[np.minimum(own + step, n)] + 1)
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[todo] = own
        starts = np.concatenate(([True], both[1:] != both[:-1]))
        rank[own] = todo[np.maximum.accumulate(np.where(starts, np.arange(len(todo)), 0))]
        new[todo[starts]] = True
        step *= 2


def run_index(strings: list[bytes]) -> tuple[RunIndex, np.ndarray]:
    """The index of the strings, and where each begins in the joined text."""
    sizes = np.array([len(s) for s in strings])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = begins + sizes
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text = data.astype(np.int16) + 1
    text[ends] = 0
    order = suffix_array(text)
    # the symbol before a string's first is the end before it, unlike any other
    before = text[order - 1].astype(np.int64)
    lone = np.flatnonzero(before == 0)
    before[lone] = -1 - lone
    head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    ranks_before = np.maximum(head - 1, 0)
    common = common_prefixes(data, ends, order[ranks_before], order[head])
    common[0] = 0
    tail = np.append(head[1:], len(order)) - 1
    return RunIndex(before[head], head, order[head], order[tail], common, len(text)), begins


def common_prefixes(data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, up to the end of their strings;
    found by halving on hashes."""
    prefix = prefix_hashes(data)
    limit = np.minimum(*(ends[np.searchsorted(ends, x)] - x for x in (a, b)))
    low, high = np.zeros(len(a), np.int64), limit
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        same = span_hashes(prefix, a, a + mid) == span_hashes(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def matching_statistics(index: RunIndex) -> np.ndarray:
    """For each place of the text, the longest match with another place. It streams from
    the samples: from a run's end on, each place's match is the last one's less a byte."""
    before, after = np.zeros(index.size, np.int64), np.zeros(index.size, np.int64)
    before[index.first] = index.first + index.common
    # the suffix before a run's first is the last of the run before it
    after[index.last[:-1]] = index.last[:-1] + index.common[1:]
    reach = np.maximum.accumulate(np.maximum(before, after))
    return np.maximum(reach - np.arange(index.size), 0)


def marked_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


MARKS = "anchor long, content long, first long, end long"


def indexed_marks(parts: DataFrame, length: int) -> DataFrame:
    """(anchor, content, first, end): runs of repeated windows, by index. ``parts``: grp,
    anchor, content, base, bytes; only strings of one group can have windows in common, and
    ``base`` is the window of the stretch that the string begins with."""

    def marks(keys: list[tuple[int, int, int]], strings: list[bytes]) -> list[tuple[int, int, int, int]]:
        index, begins = run_index(strings)
        flags = matching_statistics(index) >= length
        out = []
        for (anchor, content, base), b, s in zip(keys, begins, strings, strict=True):
            out += [(anchor, content, base + int(x), base + int(y)) for x, y in zip(*marked_runs(flags[b : b + len(s)]), strict=True)]
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["anchor", "content", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, strings, held, last = [], [], 0, None
        for batch in batches:
            for group, anchor, content, base, data in zip(*(batch.column(c).to_pylist() for c in ("grp", "anchor", "content", "base", "bytes")), strict=True):
                if held >= BATCH_BYTES and group != last:
                    if found := marks(keys, strings):
                        yield batch_of(found)
                    keys, strings, held = [], [], 0
                keys.append((anchor, content, base))
                strings.append(data)
                held += len(data)
                last = group
        if keys and (found := marks(keys, strings)):
            yield batch_of(found)

    dealt = parts.select("grp", "anchor", "content", "base", "bytes").repartition("grp").sortWithinPartitions("grp", "anchor", "content", "base")
    return dealt.mapInArrow(run, MARKS)


def cores(parts: DataFrame, length: int, step: int) -> DataFrame:
    """(anchor, content, base, part, code): the hash of the core of every part of the strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            for anchor, content, place, base, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "place", "base", "bytes")), strict=True):
                data = np.frombuffer(data, np.uint8)
                own = place - base  # the anchor's place in the string
                part = np.unique((own - np.arange(len(data) - length + 1)) // step)
                begin = own - part * step
                code = span_hashes(prefix_hashes(data), np.maximum(begin, 0), np.minimum(begin + length - step + 1, len(data)))
                k = len(part)
                rows.append(np.stack([np.full(k, anchor), np.full(k, content), np.full(k, base), part, code.astype(np.int64)]))
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows, 1)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows, 1)], names)

    names = ["anchor", "content", "base", "part", "code"]
    return parts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def hot_marks(parts: DataFrame, length: int) -> DataFrame:
    """The same for anchors whose stretches do not fit one task; ``parts`` has place besides."""
    step, marks = min(STEP, length), []
    while True:
        found = written(cores(parts, length, step), "cores")
        twice = found.groupBy("anchor", "part", "code").agg(F.count("*").alias("c")).where(F.col("c") > 1).drop("c")
        shared = found.join(twice, ["anchor", "part", "code"])
        own = F.col("place") - F.col("base")
        # the windows of a part: from its farthest distance to its nearest, inside the string
        low = F.greatest(own - (F.col("part") + 1) * step + 1, F.lit(0))
        high = F.least(own - F.col("part") * step, F.octet_length("bytes") - length)
        cut = parts.join(shared, ["anchor", "content", "base"]).select(
            F.xxhash64("anchor", "part", "code").alias("grp"),
            "anchor",
            "content",
            "place",
            (F.col("base") + low).alias("base"),
            F.substr(F.col("bytes"), (low + 1).cast("int"), (high - low + length).cast("int")).alias("bytes"),
        )
        if step == 1:  # a core is the window: equal cores are repeated windows
            marks.append(cut.select("anchor", "content", F.col("base").alias("first"), (F.col("base") + 1).alias("end")))
            break
        cut = written(cut, "parts")
        large = written(cut.groupBy("grp").agg(F.sum(F.octet_length("bytes")).alias("b")).where(F.col("b") > HOT_BYTES).select("grp"), "large-groups")
        if not large.limit(1).count():
            marks.append(indexed_marks(cut, length))
            break
        marks.append(indexed_marks(cut.join(large, "grp", "left_anti"), length))
        parts, step = written(cut.join(large, "grp", "left_semi").drop("grp"), "hot-parts"), max(1, step // FINER)
    return reduce(DataFrame.unionByName, marks)


def repeated_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(doc_id, text_hash, spans): byte spans (start, end) covered by repeated strings, for
    the documents that have any; spans neither touch nor overlap and ascend."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    found = written(stretch_rows(rows, length, piece), "stretches")
    kinds = found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash", "start", "n", "place")).alias("one"))
    kinds = written(kinds, "kinds")
    anchors = kinds.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count("*").alias("kinds"), F.sum(F.col("one.n") + length - 1).alias("bytes")).where(F.col("all") > 1)
    shared = kinds.join(anchors.select("anchor", "kinds", "bytes"), "anchor")
    whole = kinds.where(F.col("copies") > 1).select("anchor", "content", F.lit(0).cast("long").alias("first"), F.col("one.n").cast("long").alias("end"))
    mixed = written(shared.where(F.col("kinds") > 1).select("anchor", "content", "one.*", (F.col("bytes") > HOT_BYTES).alias("hot")), "mixed")
    parts = written(cut_out(rows, mixed.drop("hot"), length).join(mixed.select("anchor", "content", "hot"), ["anchor", "content"]), "parts")
    parts = parts.withColumns({"base": F.lit(0).cast("long"), "grp": F.col("anchor")})
    marks = whole.unionByName(indexed_marks(parts.where(~F.col("hot")), length))
    if parts.where("hot").limit(1).count():
        marks = marks.unionByName(hot_marks(parts.where("hot").drop("hot", "grp"), length))
    # a written table beside a scan: a stretch with many copies is a join that Spark can split
    by_stretch = written(marks.groupBy("anchor", "content").agg(F.collect_set(F.struct("first", "end")).alias("runs")), "marks")
    hits = found.join(by_stretch, ["anchor", "content"]).select(*KEY, F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("start"), (F.col("start") + r["end"] + length - 1).alias("end"))).alias("spans"))
    by_doc = hits.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            offs, flat = lists.offsets.to_numpy(), lists.values
            starts, ends = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            joined = [join_spans(starts[a:b], ends[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            sizes = np.concatenate(([0], np.cumsum([len(s) for s, _ in joined]))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate([j[k] for j in joined])) for k in (0, 1)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.ListArray.from_arrays(pa.array(sizes), spans)], ["doc_id", "text_hash", "spans"])

    return by_doc.mapInArrow(run, f"doc_id {dict(by_doc.dtypes)['doc_id']}, text_hash long, spans array<struct<start:long,end:long>>")


def join_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins spans that touch or overlap."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(spans, kept): ``repeated_spans``, and (doc_id, text_hash, kept) with the remaining
    bytes of the documents that lose any."""
    spans = written(repeated_spans(docs, length, piece), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, runs in zip(batch.column("text"), batch.column("spans"), strict=True):
                data, at, rest = data.as_py(), 0, []
                for s in runs.as_py():
                    rest.append(data[at : s["start"]])
                    at = s["end"]
                out.append(b"".join([*rest, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(out, pa.binary())], ["doc_id", "text_hash", "kept"])

    found = pick(keyed(docs), spans).select("doc_id", "text_hash", "text", "spans")
    return spans, found.mapInArrow(run, f"doc_id {dict(spans.dtypes)['doc_id']}, text_hash long, kept binary")


def dedup(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty; texts shorter than ``length`` lose nothing. Each row is a
    document of its own: a row that repeats another loses all its bytes if the text has
    ``length`` of them, whatever its doc_id, which may be null. Matches never cross
    documents; overlapping matches of one document with itself count. Other columns are
    ignored.
    """
    spans, kept = remove_repeats(docs, length, piece)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    s = spans.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"))
    k = kept.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), F.sha2("kept", 256).alias("kept_sha"))
    rows = keyed(docs).select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = rows.join(s, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left")
    out = out.join(k, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def oracle_sql(length: int = LENGTH) -> str:
    """``dedup`` in DuckDB SQL: every window of every text, as digests of its bytes in hex."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
window_at AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, {2 * length})) AS m
  FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - {length - 1}, 0))) AS i FROM d)
),
twice AS (SELECT m FROM window_at GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, i FROM window_at SEMI JOIN twice USING (m)),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER w + {length}, true)::INTEGER AS opens FROM hit WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
span AS (SELECT r, k, min(i) AS a, max(i) + {length} AS b FROM numbered GROUP BY r, k),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM span),
left_over AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gap JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""
