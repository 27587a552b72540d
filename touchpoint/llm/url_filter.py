"""URL filter (op11): a Bloom filter cascade.

A block list names domains (with their subdomains) and single addresses. Which addresses
of the corpus it covers is found once, over the *key universe*: every distinct host + path
of the pages. Level 1 of the cascade is a Bloom filter of the covered keys; level 2 holds
the uncovered keys that level 1 lets through, level 3 the covered keys that level 2 lets
through, and so on until nothing is let through. The first level that refuses a key tells
whether it is covered: exactly, for every key of the universe, and without a join.

Levels are arrays of 64-bit words made by grouped ``bit_or`` and written to the shared
folder; pages read them through scalar subqueries. A cascade of more than ``FILTER_BYTES``
is cut into parts by the key's hash, and each part judges its own pages.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.stages import written

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts alike.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bytes of all levels of one part, which is what a task holds.
FILTER_BYTES = 8 << 20
#: Share of foreign keys that levels after the first let through.
LATER_PASS = 1 / 16
MAX_LEVELS = 60
#: Block-list entries up to which they are broadcast, and the longest name that DNS knows.
BROADCAST_ENTRIES, NAME_CHARS = 100_000, 253

#: Parts of host labels, between hyphens, that put a domain on the query's own list, and
#: the addresses on it: those whose MD5 starts below this, about one in fifty.
LISTED_LABELS = "ads|adult|bets|casino|pills|spam"
LISTED_BELOW = "05"

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOMAIN = rf"(?s)(?:^|\.)((?:[^.]*-)?(?:{LISTED_LABELS})(?:-[^.]*)?(?:\..*)?)$"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """After the first ``://``; both empty for null and for texts without it."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, ADDRESS, 1), UPPER, LOWER), F.regexp_extract(text, ADDRESS, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of equally long ones the
    least by text."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    words: Column  # a scalar subquery
    bits: int
    hashes: int
    number: int

    def places(self, key: Column) -> list[Column]:
        # the level goes first, so that two keys cannot collide on all levels at once
        first = F.pmod(F.xxhash64(F.lit(self.number), key), F.lit(self.bits))
        step = F.pmod(F.xxhash64(F.lit(-self.number), key), F.lit(self.bits - 1)) + 1
        return [F.pmod(first + F.lit(i) * step, F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        one = [F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self.places(key)]
        return reduce(lambda a, b: a & b, one)


def bits_per_key(let_through: float) -> float:
    return math.log2(1 / let_through) / math.log(2)


def make_level(keys: DataFrame, count: int, number: int, let_through: float) -> Level:
    """A Bloom filter of ``keys`` (column key)."""
    words = max(1, math.ceil(count * bits_per_key(let_through) / 64))
    level = Level(F.lit(None), words * 64, max(1, round(math.log2(1 / let_through))), number)
    marks = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    set_bits = marks.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
    blank = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = set_bits.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = written(full.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.transform("w", lambda w: w["bits"]).alias("words")), "bloom")
    level.words = row.scalar()
    return level


def make_levels(keys: DataFrame) -> list[Level]:
    """``keys``: key (distinct) and listed; levels until no key is judged wrongly."""
    inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    n, others = inside.count(), outside.count()
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"{n} keys are still judged wrongly after {MAX_LEVELS} levels")
        # the first level pays for few survivors among the many others
        through = LATER_PASS if levels else min(0.5, max(2.0**-20, math.sqrt(0.5) * n / max(1, others)))
        levels.append(make_level(inside, n, len(levels) + 1, through))
        wrong = written(outside.where(levels[-1].passes(F.col("key"))), "let-through")
        inside, outside, n = wrong, inside, wrong.count()
    return levels


class Cascade:
    """Exact membership of the universe's keys in the list."""

    def __init__(self, keys: DataFrame, filter_bytes: int = FILTER_BYTES):
        """``keys``: key (distinct, not null) and listed, for the whole universe."""
        counted = keys.agg(F.count(F.when(F.col("listed"), 1)).alias("n"), F.count("*").alias("all")).first()
        n, others = counted["n"], counted["all"] - counted["n"]
        first = bits_per_key(min(0.5, max(2.0**-20, n / max(1, others))))
        self.parts = max(1, math.ceil(n * (first + 2 * bits_per_key(LATER_PASS)) / 8 / filter_bytes))
        self.levels = [make_levels(keys.where(self.part(F.col("key")) == i)) for i in range(self.parts)]

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(self.parts))

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with a boolean column ``name``: is the key listed?"""
        marked = []
        for i, levels in enumerate(self.levels):
            answer = F.lit(len(levels) % 2 == 1)
            for level in reversed(levels):
                answer = F.when(level.passes(key), answer).otherwise(F.lit(level.number % 2 == 0))
            marked.append((rows.where(self.part(key) == i) if self.parts > 1 else rows).withColumn(name, answer))
        return reduce(DataFrame.unionByName, marked)


def listed_keys(universe: DataFrame, entries: DataFrame) -> DataFrame:
    """host, key, listed: ``universe`` has distinct (host, key); ``entries`` (column entry)
    are names, which cover their host and its subdomains, or whole keys with a path."""
    few = entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    wanted = entries.where(F.col("entry").isNotNull() & (F.col("entry") != "")).distinct()
    labels = F.split(F.right(F.col("host"), F.lit(NAME_CHARS + 1)), r"\.")
    # the first label may be cut off there, but then the name is too long
    names = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    names = F.filter(names, lambda name: F.char_length(name) <= NAME_CHARS)
    each = universe.withColumn("labels", labels).select("key", F.explode(F.array_distinct(F.concat(names, F.array("host", "key")))).alias("entry"))
    hit = each.join(F.broadcast(wanted) if few else wanted, "entry", "left_semi").select("key").distinct()
    return universe.join(hit.withColumn("hit", F.lit(True)), "key", "left").select("host", "key", F.coalesce("hit", F.lit(False)).alias("listed"))


def own_list(universe: DataFrame) -> DataFrame:
    """The list of the query, drawn from the pages themselves, as the tables hold none:
    domains with a listed label, and addresses by their digest."""
    domains = universe.select(F.regexp_extract("host", DOMAIN, 1).alias("entry")).where("entry != ''").distinct()
    chosen = (F.substring(F.md5(F.col("key").cast("binary")), 1, 2) < LISTED_BELOW) & (F.col("key") != F.col("host"))
    return domains.unionByName(universe.where(chosen).select(F.col("key").alias("entry")))


def judge(pages: DataFrame, entries: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    ``entries`` (column entry): names of at most 253 characters, and addresses as host +
    path; without it the list is ``own_list``. The longest rule that fits decides, else
    the list. Null urls and urls without ``://`` have an empty host and path, which no
    entry covers. Repeated rows are judged each; other columns are ignored; an empty
    table gives an empty result, an empty list blocks nothing.
    """
    host, path = host_and_path()
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    # hot addresses shrink to one row a task before they are shuffled
    universe = written(cut.select("host", F.concat("host", "path").alias("key")).distinct(), "key-universe")
    keys = written(listed_keys(universe, own_list(universe) if entries is None else entries), "keys")
    marked = Cascade(keys.select("key", "listed"), filter_bytes).mark(cut, F.concat("host", "path"), "listed")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")


def oracle_sql() -> str:
    """The query in DuckDB SQL, with plain set membership."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
p AS (
  SELECT r, page_id, translate(regexp_extract(url, '{ADDRESS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '{ADDRESS}', 2) AS path FROM u
),
dom AS (SELECT DISTINCT regexp_extract(host, '{DOMAIN}', 1) AS name FROM p),
bad AS (
  SELECT DISTINCT host FROM (SELECT DISTINCT host FROM p) h JOIN dom ON name <> '' AND (host = name OR ends_with(host, '.' || name))
),
rule(v, h, s) AS (VALUES {rules}),
fit AS (
  SELECT r, arg_max(h || s, len(h || s)) AS rule, arg_max(v, len(h || s)) AS v
  FROM p JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY r
),
seen AS (
  SELECT p.*, coalesce(bad.host IS NOT NULL OR (path <> '' AND substr(md5(p.host || path), 1, 2) < '{LISTED_BELOW}'), false) AS listed
  FROM p LEFT JOIN bad ON bad.host = p.host
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM seen LEFT JOIN fit USING (r)
"""
