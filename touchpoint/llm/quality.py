"""Quality rules (op6): a threshold table compiled into one Spark projection.

Each rule bounds a count by a share of another count, in thousandths, so the verdict is
exact integer arithmetic. All measures of a document are array expressions over its own
words and lines: no user function, no shuffle, a plan of projections over the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.stages import text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is for with was on are this be as by "
    "der die das und ist ein eine den von mit für auf sich des im nicht "
    "le la les de des et du un une est que pour dans en sur pas "
    "el los las y del una por con no se su lo como al"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """at_least <= 1000 * part / whole <= at_most (either bound may be missing).
    A whole of zero passes."""

    name: str
    part: str
    whole: str
    at_least: int | None = None
    at_most: int | None = None

    def passes(self) -> Column:
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        ok = F.lit(True)
        if self.at_least is not None:
            ok = ok & (part >= whole * self.at_least)
        if self.at_most is not None:
            ok = ok & (part <= whole * self.at_most)
        return ok

    def sql(self) -> str:
        both = [f"1000 * {self.part} >= {self.at_least} * {self.whole}"] * (self.at_least is not None)
        both += [f"1000 * {self.part} <= {self.at_most} * {self.whole}"] * (self.at_most is not None)
        return " AND ".join(both)


#: The production table.
RULES = (
    Rule("word length", "word_chars", "n_words", at_least=2000, at_most=14000),
    Rule("symbols", "n_symbols", "n_words", at_most=300),
    Rule("stop words", "n_stop_words", "n_words", at_least=10),
    Rule("repeated lines", "n_dup_lines", "n_lines", at_most=400),
    Rule("bullet lines", "n_bullet_lines", "n_lines", at_most=900),
    Rule("cut-off lines", "n_cut_lines", "n_lines", at_most=400),
)


def measures(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Counts of each document's words, symbols and lines.

    Words are runs without blanks. ``n_repeat_words`` counts the words that lie in a
    window of three words found at least twice in the text. ``n_dup_lines`` counts lines
    with a word that equal an earlier line; ``n_lines`` all lines with a word. A null or
    empty text counts zero everywhere; repeated rows give repeated results; input columns
    other than the id and the text are dropped, whatever their names.
    """
    words = F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    first = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text).alias("t"))
    split = first.select("doc_id", "t", words.alias("words"), lines.alias("lines"))
    grams = F.when(
        F.size("words") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("at")),
            )
        ),
    )
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•] "))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_cut_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        grams.alias("grams"),
    )
    # sorted by hash, equal windows are neighbours
    again = F.transform(
        F.filter("grams", lambda g, i: (g["h"].eqNullSafe(F.get("grams", i - 1)["h"])) | (g["h"].eqNullSafe(F.get("grams", i + 1)["h"]))),
        lambda g: g["at"],
    )
    marked = counted.withColumn("again", F.coalesce(again, F.array().cast("array<int>"))).drop("grams")
    covered = F.flatten(F.transform("again", lambda a: F.array(a, a + 1, a + 2)))
    repeats = F.size(F.array_distinct(covered)).cast("long")
    return marked.withColumn("n_repeat_words", repeats).drop("again")


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed`` and ``kept``: the whole table as one projection."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passes()
    return measured.withColumns({"base_failed": base, "kept": ~base & verdict})


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: measures, ``base_failed`` and ``kept``."""
    return apply_rules(measures(docs), rules)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in DuckDB SQL: words and lines as rows instead of arrays."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdict = " AND ".join(f"({r.sql()})" for r in rules)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
),
wc AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words
  FROM w GROUP BY r
),
g AS (
  SELECT r, k, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS gram
  FROM w WINDOW p AS (PARTITION BY r ORDER BY k)
),
rep AS (
  SELECT r, count(DISTINCT k + o) AS n_repeat_words
  FROM (SELECT r, k, count(*) OVER (PARTITION BY r, gram) AS c FROM g WHERE gram IS NOT NULL), (VALUES (0), (1), (2)) AS x(o)
  WHERE c >= 2 GROUP BY r
),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^ *[-*•] ')) AS n_bullet_lines,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|…) *$')) AS n_cut_lines
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_cut_lines, 0) AS n_cut_lines,
         coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN wc USING (r) LEFT JOIN rep USING (r) LEFT JOIN lc USING (r)
),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {verdict} AS kept,
       n_lines, n_bullet_lines, n_cut_lines, n_stop_words
FROM b
"""
