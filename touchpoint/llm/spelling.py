"""Spelling variant grouping (op12): dense prefix-suffix tiling.

Two words are near if one edit (a code point inserted, deleted or replaced) turns one into
the other: with L the longer length, common prefix plus common suffix reach L - 1.

1. The vocabulary (words and counts) is one aggregation over all texts.
2. The place of the edit, the length of the common prefix, falls into one of the segments
   of at most two code points that L positions are cut into, and what lies before and after
   that segment is equal. So a word gets a key per segment, for L its own length and one
   more, and near words meet in exactly one group. A group holds at most 90 * 90 + 90
   words, whatever the corpus, as the alphabet has 90 letters. For words beyond ``LONG``
   letters segments are wider, so that a long word has ``LONG / 2`` keys at most; groups of
   over ``GROUP_BYTES`` among those are cut again, down to segments of one code point
   (groups of 91 words at most).
3. A task takes whole groups and cuts them into blocks. Padded code-point matrices of two
   blocks, one flush left and one flush right, are compared at once, which gives the common
   prefixes and suffixes of all pairs of the tile.
4. Each task keeps one row per word and batch (number of near words, the best of them), and
   Spark adds those up. Roots are found by doubling: chains are short, as counts grow five
   times with each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.sql_rules import CRC_TABLE, crc32
from touchpoint.llm.stages import text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"a-zÀ-ÿ"
MIN_LETTERS, MIN_COUNT, FORM_TIMES = 6, 5, 5
#: One in this many (document, run) pairs loses a letter.
DAMAGE_STEP = 199
#: Letters up to which segments have two code points.
LONG, GROUP_BYTES = 64, 1 << 18
#: Words of a block, rows and bytes of a chunk, and cells of a slab of tiles.
BLOCK, CHUNK_ROWS, CHUNK_BYTES, SLAB = 32, 1 << 15, 1 << 22, 1 << 22

NEAR = "word string, n long, n_near long, best_n long, best string"


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the digest of document and run says so."""
    digest = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(digest, F.char_length(run)).cast("int")
    return F.when(F.pmod(digest, F.lit(DAMAGE_STEP)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of six letters or more that occur five times or more."""
    text = F.translate(text_or_empty(), UPPER, LOWER)
    # shorter runs cannot give words: a match of this length is still a maximal run
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0))).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def with_key(rows: DataFrame) -> DataFrame:
    """Adds the digest of what lies outside the segment [low, high) of ``size`` positions."""
    outside = F.xxhash64(F.substr("word", F.lit(1), F.col("low")), F.right("word", F.col("size") - F.col("high")))
    return rows.withColumn("outside", outside)


def keyed(words: DataFrame) -> DataFrame:
    """A row per word, size (its length, and one more) and segment of that many positions."""
    sized = words.select("*", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("size"))
    count = F.ceil(F.least(F.col("size"), F.lit(LONG)) / 2).cast("int")
    cut = sized.withColumn("count", count).select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    border = lambda i: F.floor(i.cast("long") * F.col("size") / F.col("count")).cast("int")
    return with_key(cut.select("word", "n", "size", border(F.col("i")).alias("low"), border(F.col("i") + 1).alias("high")))


def cut_large(rows: DataFrame) -> DataFrame:
    """Halves the segments of groups of over ``GROUP_BYTES`` until none is left that can be."""
    group = ["size", "low", "high", "outside"]
    done = []
    while True:
        large = rows.where(F.col("high") - F.col("low") > 1).groupBy(*group).agg(F.sum(F.char_length("word")).alias("letters")).where(F.col("letters") > GROUP_BYTES)
        large = written(large.select(*group), "large-groups")
        if not large.limit(1).count():
            return rows if not done else done[0].unionByName(rows) if len(done) == 1 else _union(done + [rows])
        done.append(rows.join(large, group, "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
        again = rows.join(large, group, "left_semi").select("word", "n", "size", F.explode(halves).alias("half"))
        rows = written(with_key(again.select("word", "n", "size", F.col("half.low").alias("low"), F.col("half.high").alias("high"))), "cut-groups")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def blocks_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row a, rows a, first row b, rows b) of all block pairs, a <= b, of each group."""
    one = sizes <= BLOCK
    pairs = [(starts[one], sizes[one], starts[one], sizes[one])]
    for s, n in zip(starts[~one], sizes[~one]):
        first = np.arange(s, s + n, BLOCK)
        a, b = np.triu_indices(len(first))
        rows = np.minimum(BLOCK, s + n - first)
        pairs.append((first[a], rows[a], first[b], rows[b]))
    return tuple(np.concatenate(p) for p in zip(*pairs))


class Chunk:
    """Whole groups of words, sorted by group; compared tile by tile."""

    def __init__(self, table: pa.Table):
        self.words = table["word"].combine_chunks()
        self.n, self.size, self.low, self.high = (table[c].to_numpy() for c in ("n", "size", "low", "high"))
        outside = table["outside"].to_numpy()
        # all letters are below U+0100, so the code points are the bytes of Latin-1
        texts = [w.encode("latin-1") for w in self.words.to_pylist()]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.length)
        self.codes = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        new = np.ones(len(texts), bool)
        if len(texts) > 1:
            new[1:] = (outside[1:] != outside[:-1]) | (self.size[1:] != self.size[:-1]) | (self.low[1:] != self.low[:-1]) | (self.high[1:] != self.high[:-1])
        self.first = np.flatnonzero(new)
        self.rows = np.diff(np.append(self.first, len(texts)))

    def matrix(self, rows: np.ndarray, width: int, flush_right: bool) -> np.ndarray:
        """Code points of ``rows`` (-1: none), padded with zeros on the other side."""
        length = np.where(rows >= 0, self.length[rows], 0)
        end = self.end[rows]
        k = np.arange(width)
        if flush_right:
            at, inside = end[..., None] - 1 - k, k < length[..., None]
        else:
            at, inside = (end - self.length[rows])[..., None] + k, k < length[..., None]
        return np.where(inside, self.codes[np.where(inside, at, 0)], 0).astype(np.uint8)

    def common(self, a: np.ndarray, b: np.ndarray, width: int, flush_right: bool) -> np.ndarray:
        """Length of the common prefix (suffix) of every row of block a and of block b."""
        same = self.matrix(a, width, flush_right)[:, :, None, :] == self.matrix(b, width, flush_right)[:, None, :, :]
        return np.where(same.all(-1), width, same.argmin(-1))

    def near_in(self, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, row) of the near pairs that belong to the tiles of the blocks a and b."""
        la, lb = np.where(a >= 0, self.length[a], 0)[:, :, None], np.where(b >= 0, self.length[b], 0)[:, None, :]
        size = self.size[a[:, 0]][:, None, None]
        longer, shorter = np.maximum(la, lb), np.minimum(la, lb)
        prefix = np.minimum(self.common(a, b, width, False), shorter)
        suffix = np.minimum(self.common(a, b, width, True), shorter)
        place = np.minimum(prefix, size - 1)
        low, high = self.low[a[:, 0]][:, None, None], self.high[a[:, 0]][:, None, None]
        hit = (a[:, :, None] < b[:, None, :]) & (a >= 0)[:, :, None] & (longer == size) & (prefix + suffix >= size - 1) & (low <= place) & (place < high)
        t, i, j = np.nonzero(hit)
        return a[t, i], b[t, j]

    def near_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        many = self.rows > 1
        a, na, b, nb = blocks_of(self.first[many], self.rows[many])
        if not len(a):
            return a, b
        # tiles of like shape are compared together
        side = 1 << np.ceil(np.log2(np.maximum(np.maximum(na, nb), 2))).astype(int)
        width = -(-self.size[a] // 8) * 8
        found = []
        for p, w in np.unique(np.stack([side, width], 1), axis=0):
            of = np.flatnonzero((side == p) & (width == w))
            k = np.arange(p)
            step = max(1, SLAB // int(p * p * w))
            for s in range(0, len(of), step):
                o = of[s : s + step]
                rows_a = np.where(k < na[o][:, None], a[o][:, None] + k, -1)
                rows_b = np.where(k < nb[o][:, None], b[o][:, None] + k, -1)
                found.append(self.near_in(rows_a, rows_b, int(w)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def summary(self) -> pa.RecordBatch | None:
        """One row per word with near words: their number, and the best of them."""
        a, b = self.near_pairs()
        if not len(a):
            return None
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        rank = pc.rank(self.words, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((rank[y], -self.n[y], rank[x]))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, rank[x][1:] != rank[x][:-1]))
        count = np.diff(np.append(first, len(x)))
        word, best = self.words.take(pa.array(x[first])), self.words.take(pa.array(y[first]))
        return pa.RecordBatch.from_arrays([word, pa.array(self.n[x[first]]), pa.array(count.astype(np.int64)), pa.array(self.n[y[first]]), best], ["word", "n", "n_near", "best_n", "best"])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, several at a time, from batches sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) < CHUNK_ROWS and sum(h.nbytes for h in held) < CHUNK_BYTES:
            continue
        table = pa.Table.from_batches(held)
        outside = table["outside"].to_numpy()
        differs = np.flatnonzero(outside != outside[-1])
        if len(differs):  # the last group may go on in the next batch
            end = int(differs[-1]) + 1
            yield table.slice(0, end)
            held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches):
        if table.num_rows:
            out = Chunk(table).summary()
            if out is not None:
                yield out


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best_n, best for every row of ``words`` (word, n; distinct words)."""
    rows = keyed(words)
    longest = words.agg(F.coalesce(F.max(F.char_length("word")), F.lit(0)).alias("l")).first()["l"]
    if longest >= LONG:
        short = rows.where(F.col("size") <= LONG)
        rows = short.unionByName(cut_large(written(rows.where(F.col("size") > LONG), "long-words")))
    group = ["outside", "size", "low", "high"]
    found = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare_groups, NEAR)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best"))))
    added = found.unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return added.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain that starts at each word of ``forms`` (word, form).
    Every round doubles the steps already taken."""
    steps = written(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "steps")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        steps = moved.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no runs; a null doc_id counts as an empty text in the digest
    that decides which runs lose a letter; repeated rows count each; columns besides doc_id
    and text are ignored; an empty table gives an empty result. Words of any length are
    compared whole.
    """
    words = written(vocabulary(docs), "vocabulary")
    near = near_words(words)
    has_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    formed = written(near.select("word", F.when(has_form, F.col("best")).alias("form"), "n", "n_near", F.when(has_form, F.col("best_n")).alias("form_n")), "forms")
    roots = last_forms(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The query in DuckDB SQL: near words share a text with one letter blanked out, or one
    is the other without a letter."""
    letters = "a-zÀ-ÿ"
    return f"""
WITH RECURSIVE crc AS {CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[{letters}]+')) AS run
  FROM documents
),
per_doc AS (SELECT d, run, count(*) AS c FROM runs WHERE length(run) >= {MIN_LETTERS} GROUP BY d, run),
h AS (SELECT run, c, {crc32("(d || ':' || run)")} AS h FROM per_doc, crc),
made AS (SELECT CASE WHEN h % {DAMAGE_STEP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
blank AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM place),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM blank x JOIN blank y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM blank x JOIN v y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM blank x JOIN v y ON y.word = x.a || x.b
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FORM_TIMES} * v.n THEN other END AS form, CASE WHEN m >= {FORM_TIMES} * v.n THEN m END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
),
chain(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.tip AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.tip AND e.form IS NULL
"""
