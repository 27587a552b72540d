"""Benchmark decontamination (op10): a distributed positional inverted index.

1. Test items are cut into windows of ten words (a shorter item is one window). The terms
   of a window for phrases are its pairs of neighbouring words (of a one-word item, the
   word); for proximity, its words.
2. Every training text is split once, into an array of word hashes in the shared folder;
   all passes below read that. One pass counts the windows' terms. A window with a pair of
   frequency zero cannot occur as a phrase and is dropped; for proximity, words of frequency
   zero are left out.
3. Postings (document, position) are stored for the *rarest* terms of each window only:
   the lists of frequent terms, which hold most positions, are never built.
4. A posting at position p of the pair at offset o puts the window's start at p - o. A
   start named by the lists of all rarest pairs of the window is a candidate, and is
   confirmed word by word against the document: exact phrase matches.
5. The rarest ``NEAR_TERMS`` words of a window within ``NEAR_SPAN`` words of each other, in
   any order, are a proximity match: the postings of the rarest one are extended by those
   of the next ones in the same or a neighbouring stretch of the text.

Only DataFrame functions are used. What is broadcast (the windows' terms) comes from the
test items alone; their size is measured first, and beyond ``BROADCAST_BYTES`` the joins
shuffle instead. So do the ids of documents with candidates beyond ``BROADCAST_IDS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchpoint.llm.stages import free_name, text_or_empty, written

WINDOW_WORDS = 10
#: Lists intersected per window before confirmation.
RAREST = 2
#: Rarest words, and the span in words they must share, of a proximity match.
NEAR_TERMS, NEAR_SPAN = 3, 20
#: Bytes of test items up to which tables derived from them are broadcast.
BROADCAST_BYTES = 4 << 20
#: Documents with candidates up to which their keys (16 bytes each) are broadcast.
BROADCAST_IDS = 300_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text") -> Column:
    """Lower-case A-Z; words are runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(text_or_empty(text), UPPER, LOWER), SEPARATORS), "")


def item_windows(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, window): distinct windows of each item as arrays of words."""
    cut = items.select(F.col("item_id"), words_of().alias("words"))
    windows = F.when(F.size("words") > size, F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).when(F.size("words") > 0, F.array("words"))
    return cut.select("item_id", F.explode(windows).alias("window")).distinct()


def bounded(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def terms_of(rows: DataFrame, keys: list[str], pairs: bool) -> DataFrame:
    """(keys, pos, term) of ``hashes``: a row per pair of neighbours, or per word."""
    if not pairs:
        return rows.select(*keys, F.posexplode("hashes").alias("pos", "term"))
    some = rows.where(F.size("hashes") > 1)
    zipped = F.arrays_zip(F.col("hashes").alias("a"), F.slice("hashes", 2, F.size("hashes")).alias("b"))
    each = some.select(*keys, F.posexplode(zipped).alias("pos", "p"))
    return each.where(F.col("p.b").isNotNull()).select(*keys, "pos", F.xxhash64("p.a", "p.b").alias("term"))


KEY = ["doc_id", "text_hash"]


class TestIndex:
    """The windows of a test set, matched against one corpus."""

    __test__ = False

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, rarest: int = RAREST, near_terms: int = NEAR_TERMS):
        self.rarest, self.near_terms = rarest, near_terms
        size_of = items.agg(F.coalesce(F.sum(F.octet_length(text_or_empty())), F.lit(0)).alias("b")).first()["b"]
        self.small = size_of <= BROADCAST_BYTES
        # a null or repeated doc_id is no key: the text's hash tells rows apart, and equal rows have equal results
        self.docs = docs.select(F.col("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("text_hash"))
        self.split = written(self.docs.select(*KEY, hashed(words_of()).alias("hashes")).select("*", F.size("hashes").cast("long").alias("n_words")), "split-texts")
        self.item_windows = written(item_windows(items, size).withColumn("w", F.xxhash64("window")), "item-windows")
        self.windows = written(self.item_windows.select("w", "window").dropDuplicates(["w"]), "windows")
        one, cut = F.size("window") == 1, hashed(F.col("window")).alias("hashes")
        self.has_one_word = bool(self.windows.where(one).limit(1).count())
        terms = terms_of(self.windows.where(~one).select("w", cut), ["w"], True)
        if self.has_one_word:
            terms = terms.unionByName(terms_of(self.windows.where(one).select("w", cut), ["w"], False))
        self.terms = written(terms.withColumnRenamed("pos", "offset"), "terms")
        self.anchors = written(self._anchors(), "anchors")
        self.starts = written(self._starts(), "postings")

    def _pairs(self, keys: list[str]) -> DataFrame:
        found = terms_of(self.split, keys, True)
        return found.unionByName(terms_of(self.split, keys, False)) if self.has_one_word else found

    def _counted(self, found: DataFrame, terms: DataFrame) -> DataFrame:
        """(term, n) for those of ``terms`` that occur."""
        wanted = bounded(terms.select("term").distinct(), self.small)
        return bounded(found.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), self.small)

    def _anchors(self) -> DataFrame:
        """(w, terms, term, offset, rank): the rarest pairs of each window that can occur."""
        each = Window.partitionBy("w")
        ranked = self.terms.withColumn("terms", F.count("*").over(each)).join(self._counted(self._pairs([]), self.terms), "term")
        ranked = ranked.withColumn("rank", F.row_number().over(each.orderBy("n", "offset"))).withColumn("known", F.count("*").over(each))
        return ranked.where((F.col("known") == F.col("terms")) & (F.col("rank") <= self.rarest)).select("w", "terms", "term", "offset", "rank")

    def _starts(self) -> DataFrame:
        """The index for phrases: postings of the rarest pairs, with the window starts they
        stand for."""
        postings = self._pairs(KEY)
        return postings.join(bounded(self.anchors, self.small), "term").select(*KEY, "w", "terms", "rank", (F.col("pos") - F.col("offset")).alias("start"))

    def candidates(self) -> DataFrame:
        """(doc_id, text_hash, w, start): starts on which the lists of all rarest terms agree."""
        lists = self.starts.where(F.col("start") >= 0)
        agreed = lists.groupBy("doc_id", "text_hash", "w", "start").agg(F.count("*").alias("n"), F.first("terms").alias("terms"))
        return agreed.where(F.col("n") >= F.least(F.col("terms"), F.lit(self.rarest))).select("doc_id", "text_hash", "w", "start")

    def phrase_matches(self) -> DataFrame:
        """(doc_id, text_hash, found): confirmed matches of the rows that have any, as an
        array of (start, size, w)."""
        named = written(self.candidates().join(bounded(self.windows, self.small), "w"), "candidates")
        by_doc = named.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "window", "w")).alias("maybe"))
        ids = named.select("doc_id", "text_hash").distinct()
        few = ids.count() <= BROADCAST_IDS
        chosen = self.docs.join(bounded(ids.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")), few), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_semi")
        c = by_doc.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "maybe")
        joined = chosen.dropDuplicates(["doc_id", "text_hash"]).join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")))
        # written, so that a text is split once and not anew for each of its candidates
        split = written(joined.select("doc_id", "text_hash", words_of().alias("words"), "maybe"), "candidate-texts")
        confirmed = F.filter("maybe", lambda m: F.slice("words", m["start"] + 1, F.size(m["window"])) == m["window"])
        return split.select("doc_id", "text_hash", F.transform(confirmed, lambda m: F.struct(m["start"].alias("start"), F.size(m["window"]).alias("size"), m["w"].alias("w"))).alias("found"))

    def near_sets(self) -> DataFrame:
        """(w, set): hashes of the rarest words of each window, the rarest first. A window
        of which fewer words than that occur anywhere has none."""
        words = self.windows.select("w", F.explode(F.array_distinct("window")).alias("word")).withColumn("term", F.xxhash64("word"))
        each = Window.partitionBy("w")
        needed = F.least(F.lit(self.near_terms), F.count("*").over(each))
        words = written(words.withColumn("needed", needed), "near-words")
        ranked = words.join(self._counted(terms_of(self.split, [], False), words), "term")
        ranked = ranked.withColumn("rank", F.row_number().over(each.orderBy("n", "word")))
        rarest = ranked.where(F.col("rank") <= F.col("needed")).groupBy("w").agg(F.max("needed").alias("needed"), F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
        return rarest.where(F.size("t") == F.col("needed")).select("w", F.transform("t", lambda t: t["term"]).alias("set"))

    def proximity_matches(self, span: int = NEAR_SPAN) -> DataFrame:
        """(doc_id, text_hash, item_id): the rarest words of one of the item's windows lie
        within ``span`` words of each other, in any order."""
        by_window = written(self.near_sets(), "near-sets")
        sets = by_window.select("set").distinct()
        terms = sets.select(F.explode("set").alias("term")).distinct()
        places = written(terms_of(self.split, KEY, False).join(bounded(terms, self.small), "term", "left_semi"), "word-postings")
        step = places.join(bounded(sets, self.small), F.col("term") == F.get("set", F.lit(0))).select(*KEY, "set", F.col("pos").alias("low"), F.col("pos").alias("high"))
        found = []
        for rank in range(1, self.near_terms):
            found.append(step.where(F.size("set") == rank).select(*KEY, "set"))
            # the next word stands in a stretch of ``span`` words that the match can reach
            cells = F.sequence(F.floor((F.col("high") - (span - 1)) / span), F.floor((F.col("low") + (span - 1)) / span))
            ahead = step.where(F.size("set") > rank).select("*", F.get("set", F.lit(rank)).alias("next"), F.explode(cells).alias("cell"))
            of_rank = sets.select(F.get("set", F.lit(rank)).alias("term")).where("term IS NOT NULL").distinct()
            there = places.join(bounded(of_rank, self.small), "term", "left_semi")
            there = there.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "term", "pos", F.floor(F.col("pos") / span).alias("p_cell"))
            met = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")) & (F.col("next") == F.col("term")) & (F.col("cell") == F.col("p_cell"))
            joined = ahead.join(there, met).select(*KEY, "set", F.least("low", "pos").alias("low"), F.greatest("high", "pos").alias("high"))
            step = written(joined.where(F.col("high") - F.col("low") < span).distinct(), "near")
        found.append(step.select(*KEY, "set"))
        hit = reduce(DataFrame.unionByName, found).distinct().join(bounded(by_window, self.small), "set").select(*KEY, "w").distinct()
        return self.with_items(hit)

    def with_items(self, hit: DataFrame) -> DataFrame:
        return hit.join(bounded(self.item_windows.select("item_id", "w"), self.small), "w").select("doc_id", "text_hash", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """One row per document row: n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256, contaminated, n_near_items (items with a proximity match).

    Null and empty texts have no words: such documents are clean, such items match
    nothing. Items with equal texts all count. Rows with a null or repeated doc_id are
    judged by their own text; columns besides doc_id, item_id and text are ignored. An
    empty table of items leaves every document clean.
    """
    index = TestIndex(docs, items, size)
    key = ["doc_id", "text_hash"]
    matches = written(index.phrase_matches().where(F.size("found") > 0), "matches")
    positions = F.flatten(F.transform("found", lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1)))
    hits = matches.select(*key, F.size(F.array_distinct(positions)).cast("long").alias("n_hit"))
    exact = index.with_items(matches.select(*key, F.explode("found.w").alias("w")).distinct())
    listed = exact.withColumn("near", F.lit(False)).unionByName(index.proximity_matches().withColumn("near", F.lit(True)))
    found = listed.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(~F.col("near"), F.coalesce(F.col("item_id").cast("string"), F.lit(""))))).alias("items"),
        F.count(F.when(F.col("near"), 1)).alias("near"),
    )
    per_doc = found.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "items", "near")
    per_hit = hits.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "n_hit")
    rows = index.split.select("doc_id", "text_hash", "n_words")
    out = rows.join(per_hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    out = out.join(per_doc, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near_items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of an item."""
    matches = TestIndex(docs, items, size, near_terms=0).phrase_matches().where(F.size("found") > 0)
    i, h = free_name(docs, "hit_id"), free_name(docs, "hit_hash")
    hit = written(matches.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)), "hit")
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64(text_or_empty()) == F.col(h))
    return docs.join(bounded(hit, hit.count() <= BROADCAST_IDS), same, "left_anti")


def oracle_sql(size: int = WINDOW_WORDS, near_terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> str:
    """The result of ``contamination`` in DuckDB SQL: every run of words of the corpus is
    compared with every window of that length, every stretch of ``span`` words with the
    rarest words of every window, and no index is used."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    words = words.replace("\\\\", "\\")
    return f"""
WITH iw AS (SELECT item_id, {words} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(ws, k, k + {size} - 1) AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {size} + 1, least(len(ws), 1)) + 1)) AS k FROM iw)
),
p AS (SELECT win, len(win) AS size, sha256(array_to_string(win, ' ')) AS digest FROM (SELECT DISTINCT win FROM win)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
one AS (SELECT digest, size, unnest(win) AS word, generate_subscripts(win, 1) AS o FROM p),
seen AS (SELECT r, k, word FROM w WHERE word IN (SELECT word FROM one)),
df AS (SELECT word, count(*) AS n FROM seen GROUP BY word),
need AS (SELECT digest, least({near_terms}, count(DISTINCT word)) AS needed FROM one GROUP BY digest),
rare AS (
  SELECT digest, needed, word, row_number() OVER (PARTITION BY digest ORDER BY n, word) AS rk, count(*) OVER (PARTITION BY digest) AS known
  FROM (SELECT DISTINCT digest, word FROM one) JOIN df USING (word) JOIN need USING (digest)
),
hit AS (
  SELECT r, f.k, p.digest, p.size
  FROM p JOIN w f ON f.word = p.win[1] JOIN d USING (r)
  WHERE list_slice(d.ws, f.k, f.k + p.size - 1) = p.win
),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS x FROM hit) GROUP BY r),
owner AS (SELECT item_id, sha256(array_to_string(win, ' ')) AS digest FROM win),
found AS (SELECT DISTINCT r, item_id FROM hit JOIN owner USING (digest)),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM found GROUP BY r),
spot AS (
  SELECT r, digest, needed, count(DISTINCT word) OVER (PARTITION BY r, digest ORDER BY k RANGE BETWEEN CURRENT ROW AND {span - 1} FOLLOWING) AS seen
  FROM rare JOIN seen USING (word) WHERE known >= needed AND rk <= needed
),
near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM spot JOIN owner USING (digest) WHERE seen = needed GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""
