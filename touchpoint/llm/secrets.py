"""Secret scan (op3): a random forest that removes false positives.

Candidates are found by four patterns, none of which asks for a length or a digit where the
context or the format speaks for itself: any value after a key word and ``=`` or ``:``, the
password of a URL's ``user:password@``, the formats of issued keys, and, anywhere, runs of
ten or more key characters with a digit. Each candidate gets features of its length, its
character transitions, the share of it that dictionary words cover, whether it is part of a
path, and the words next to it. A random forest decides which candidates are secrets.

The forest learns from labelled findings: candidates of the corpus whose format or
neighbours settle the label (``label_of``; undecided ones are left out), at most
``TRAIN_ROWS``, those with the smallest hashes, and ``SEEDED`` rows of usual formats of
secrets and of harmless identifiers that Spark derives from row numbers, so that both
labels are there whatever the corpus holds.

Everything runs as DataFrame expressions and MLlib; there is no Python code on the rows.
What is written between the steps holds places, features and digests, never a value.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchpoint.llm.stages import bounded_sample, free_name, text_or_empty, written

#: Words next to secrets, words next to harmless identifiers, and words inside the latter.
KEY_WORDS = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth|credential|credentials|private|bearer|passwort|contraseña|clave|mot de passe"
PLAIN_WORDS = "sha|md5|commit|checksum|digest|revision|uuid|guid|version|isbn|phone|tel|card|order|invoice|serial|number|build|file|path"
DICTIONARY = "user|name|test|example|sample|image|file|index|version|python|java|lib|usr|home|data|local|share|site|page|http|www|html|json|the|and|for|tion|ing|ent|ist|ung|cion|ment|able|order|item|date|time|year|month|build|release|model|table|column|value|north|south|east|west"

#: Formats of issued keys: cloud access keys, code hosts, chat, payment, mail, signed tokens.
ISSUED = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|SG\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)?"
EDGE = r"(?<![A-Za-z0-9+/_\-])"
#: What stands between a key word and its value; the short test comes first, as it fails fast.
ASSIGNED = r"""(?<=[=:]>?\s{0,2}["'`]{0,1})(?<=(?i:KEY)["'`]{0,1}\s{0,2}(?:=>|:=|[=:])\s{0,2}["'`]{0,1})""".replace("KEY", KEY_WORDS)
VALUE = r"""[^\s"'`]*[^\s"'`.,;:)\]}>]"""
IN_URL = r"(?<=:)(?=[^\s/@:]{1,256}@)(?<=://[^\s/:@]{0,256}:)[^\s/@:]+"
RUN = EDGE + r"(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{10,}={0,2}"
CANDIDATE = f"{IN_URL}|{ASSIGNED}{VALUE}|{EDGE}(?:{ISSUED})|{RUN}"
#: Values that stand for a secret to be filled in.
PLACEHOLDER = r"(?i)^(null|none|nil|true|false|yes|no|required|optional|string|str|text|hidden|changeme|your.*|x{3,}|[*]+|[.]+|[<$%{(\[].*)$"
#: Characters of context on either side.
CONTEXT = 40
TRAIN_ROWS, SEEDED = 4000, 3200
TREES, DEPTH, SEED = 20, 8, 5
SECRET_FROM = 0.5
MASK = "[SECRET]"

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE = "^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"

FEATURES = ["length", "runs", "turns", "digits", "uppers", "symbols", "distinct", "hex", "coverage", "path", "key_near", "assigned", "spaced", "quoted", "in_url", "issued", "placeholder", "plain_near"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end (characters, from 0, end excluded), value, before, after."""
    text = text_or_empty()
    row = docs.select(F.col("doc_id"), text.alias("t")).withColumn("row", F.monotonically_increasing_id())
    # pieces between candidates and candidates alternate, so lengths add up to places
    cut = row.select("doc_id", "row", F.xxhash64("t").alias("text_hash"), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split("t", CANDIDATE, -1).alias("gaps"))
    some = cut.where(F.size("values") > 0).select(
        "doc_id",
        "row",
        "text_hash",
        F.posexplode(
            F.transform(
                "values",
                lambda v, k: F.struct(
                    v.alias("value"),
                    (F.char_length(F.get("gaps", k)) + F.char_length(v)).alias("width"),
                    F.right(F.get("gaps", k), F.lit(CONTEXT)).alias("before"),
                    F.left(F.coalesce(F.get("gaps", k + 1), F.lit("")), F.lit(CONTEXT)).alias("after"),
                ),
            )
        ).alias("k", "c"),
    )
    upto = Window.partitionBy("row").orderBy("k")
    placed = some.withColumn("end", F.sum("c.width").over(upto).cast("long"))
    value = F.col("c.value")
    return placed.select("doc_id", "text_hash", (F.col("end") - F.char_length(value)).alias("start"), "end", value.alias("value"), F.col("c.before").alias("before"), F.col("c.after").alias("after"))


def _share(value: Column, pattern: str) -> Column:
    return (F.char_length(value) - F.char_length(F.regexp_replace(value, pattern, ""))) / F.char_length(value)


def with_features(found: DataFrame) -> DataFrame:
    """Adds the feature columns to value, before and after."""
    v, before = F.col("value"), F.lower("before")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    turns = F.regexp_replace(F.regexp_replace(F.lower(v), "[aeiou]+", "\u0001"), "[b-df-hj-np-tv-z]+", "\u0002")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return found.withColumns(
        {
            "length": F.char_length(v).cast("double"),
            "runs": F.char_length(runs) / F.char_length(v),  # changes between lower case, upper case and digits
            "turns": F.char_length(turns) / F.char_length(v),  # changes between vowels, consonants and the rest
            "digits": _share(v, "[0-9]"),
            "uppers": _share(v, "[A-Z]"),
            "symbols": _share(v, "[^A-Za-z0-9]"),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.char_length(v),
            "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
            "coverage": _share(F.lower(v), DICTIONARY),
            "path": flag(v.contains("/") | before.rlike("[/.][a-z0-9_.-]*$") | before.contains("://")),
            "key_near": flag(before.rlike(rf"({KEY_WORDS})[^a-z0-9]{{0,5}}$")),
            "assigned": flag(before.rlike(r"[=:]>?\s*[\"'`]?$")),
            "spaced": flag(before.rlike(r"[=:]>?\s+[\"'`]?$")),
            "quoted": flag(before.rlike("[\"'`]$")),
            "in_url": flag(before.rlike("://[^/@:]*:$") & F.col("after").startswith("@")),
            "issued": flag(v.rlike(f"^(?:{ISSUED})$")),
            "placeholder": flag(v.rlike(PLACEHOLDER)),
            "plain_near": flag(before.rlike(rf"(^|[^a-z])({PLAIN_WORDS})[^a-z0-9]{{0,5}}$")),
        }
    )


def label_of() -> Column:
    """1 and 0 where the finding's format or neighbours settle it, else null."""
    v = F.col("value")
    plain = v.rlike("^[0-9+/_=-]+$") | v.rlike(UUID) | v.rlike(DATE) | (F.col("plain_near") == 1) | (F.col("coverage") >= 0.5)
    given = (F.col("key_near") == 1) & (F.col("assigned") == 1)
    # a word after "key: " may be prose; after "key=" or in quotes it is a value
    prose = given & v.rlike(r"^\p{L}{1,15}$") & (F.col("spaced") == 1) & (F.col("quoted") == 0)
    secret = (F.col("issued") == 1) | (F.col("in_url") == 1) | (given & (F.char_length(v) >= 4))
    return F.when(F.col("placeholder") == 1, 0.0).when(prose, 0.0).when(secret, 1.0).when(plain, 0.0)


def seeded_findings(spark: SparkSession, rows: int = SEEDED) -> DataFrame:
    """value, before, after and label of usual formats, derived from row numbers."""
    n = F.col("id")
    digest = lambda salt: F.sha2(F.concat(n.cast("string"), F.lit(salt)), 256)
    part = lambda text, k: F.substr(text, F.lit(1), k if isinstance(k, Column) else F.lit(k))
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    mixed = F.translate(F.base64(F.unhex(digest("m"))), "+/=", "Aa0")
    letters = F.regexp_replace(F.base64(F.unhex(digest("l"))), "[^A-Za-z]", "")
    size, few = ((F.pmod(F.xxhash64(n, F.lit(k)), F.lit(24)) + least).cast("int") for k, least in ((5, 12), (6, 5)))
    tight, loose = ["password=", "secret='", 'auth_token="', "pwd=", "api-key="], ["token = \"", "api_key: ", "password: ", "Token: '", "passwd = "]
    any_key = F.when(n % 4 < 2, pick(3, tight)).otherwise(pick(4, loose))
    words = F.concat(pick(10, ["correct", "summer", "dragon", "river"]), pick(11, ["horse", "winter", "monkey", "stone"]), pick(12, ["", "battery", "staple", "love"]))
    prose = pick(13, ["is", "the", "required", "must", "it", "expired", "wurde", "est", "your", "and", "reset", "incorrect", "see", "de", "theaor", "mention"])
    marks = pick(14, ["!", "@", "#", "$x", "?1", "%"])
    word = pick(2, ["image_file", "usr/lib/python", "sample-data", "index_page", "build_version"])
    number = F.conv(part(digest("d"), 15), 16, 10)
    cut = lambda a, k: F.substr(digest("u"), F.lit(a), F.lit(k))
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    lit = F.lit
    rows_of = [  # value, before, after, label
        (part(digest("h"), size), any_key, " ", 1.0),
        (part(mixed, size), any_key, '"', 1.0),
        (part(F.concat(lit("AKIA"), F.upper(mixed)), 20), pick(7, ["key ", "and ", "", "= "]), " ", 1.0),
        (part(mixed, size + 8), lit("with "), " ", 1.0),
        (F.upper(part(digest("h"), size)), F.upper(any_key), " ", 1.0),
        (words, pick(3, tight), " ", 1.0),
        (F.concat(words, F.pmod(n, F.lit(977)).cast("string")), any_key, " ", 1.0),
        (F.concat(part(mixed, few), marks, part(number, 4)), any_key, " ", 1.0),
        (F.concat(part(letters, few), marks), F.concat(pick(8, ["postgres://", "https://", "amqp://"]), pick(9, ["user:", "root:", "svc:"])), "@", 1.0),
        (F.concat(lit("ghp_"), part(F.concat(letters, letters, mixed), 36)), pick(7, ["key ", "and ", "", "= "]), " ", 1.0),
        (F.concat(lit("eyJ"), part(mixed, size), lit("."), part(digest("j"), size), lit("."), part(letters, few)), pick(7, ["jwt ", "Bearer ", "", "= "]), " ", 1.0),
        (F.concat(lit("SG."), part(mixed, size), lit("."), part(letters, size)), pick(7, ["key ", "and ", "", "= "]), " ", 1.0),
        (part(F.concat(number, number), F.lit(10) + F.pmod(size, F.lit(7))), pick(15, ["and ", "card ", "nr ", ""]), " ", 0.0),
        (uuid, lit("uuid "), " ", 0.0),
        (F.concat(word, lit("_"), part(number, 4)), lit("see "), " ", 0.0),
        (part(digest("c"), 40), lit("commit "), " ", 0.0),
        (F.concat(lit("2021-0"), part(number, 1), lit("-1"), F.substr(number, lit(2), lit(1))), lit("of "), " ", 0.0),
        (prose, pick(16, ["password: ", "the token: ", "Secret: ", "auth: ", "clave: "]), " ", 0.0),
        (pick(17, ["${TOKEN}", "<your-token>", "null", "None", "true", "xxxxxx", "******", "$PASSWORD"]), any_key, " ", 0.0),
        (F.concat(pick(19, ["8080/path", "en/", "docs/page", "443/v"]), part(number, size)), pick(20, ["http://host:", "https://www.example.com/", "see http://a.b/"]), " ", 0.0),
        (F.concat(lit("v"), part(number, 2), lit("-"), word), pick(18, ["version: ", "file = ", "path="]), " ", 0.0),
    ]
    kind = F.pmod(n, F.lit(len(rows_of)))
    value, before, after, label = F.lit(""), F.lit(""), F.lit(""), F.lit(0.0)
    for k, (v, b, a, y) in enumerate(rows_of):
        value, before, after, label = (F.when(kind == k, x).otherwise(old) for x, old in ((v, value), (b, before), (F.lit(a), after), (F.lit(y), label)))
    return spark.range(0, rows, 1, 1).select("id", value.alias("value"), before.alias("before"), after.alias("after"), label.alias("label")).where("value != ''")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def train(found: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel:
    """``found``: findings with features, label and digest."""
    labelled = [bounded_sample(found.where(F.col("label") == y), ["digest"], rows // 2).select("label", *FEATURES) for y in (0.0, 1.0)]
    seeds = with_features(seeded_findings(found.sparkSession)).select("label", *FEATURES)
    sample = seeds.unionByName(labelled[0]).unionByName(labelled[1])
    # in one order, so that the same rows give the same forest
    sample = sample.coalesce(1).sortWithinPartitions("label", *FEATURES)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return forest.fit(assembler().transform(sample).select("label", "features"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, text_hash, start, end (characters, end excluded),
    value_sha256, score (0 to 1) and is_secret.

    Null and empty texts have no candidates. Equal rows have equal findings each; doc_id
    may be null or repeated, as places are counted per row and findings carry the hash of
    their text. Columns other than doc_id and text are ignored. Candidates do not
    overlap; the user name of a URL may have up to 256 characters. A table without
    candidates gives an empty result.
    """
    seen = with_features(candidates(docs)).withColumns({"label": label_of(), "value_sha256": F.sha2("value", 256), "digest": F.xxhash64("value", "before")})
    found = written(seen.drop("value", "before", "after"), "candidates")
    scored = train(found).transform(assembler().transform(found))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "text_hash", "start", "end", "value_sha256", score.alias("score"), (score >= SECRET_FROM).alias("is_secret"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``MASK``; columns, their order and
    the number of rows stay. Rows without a secret are unchanged, null texts too."""
    spans = scan(docs).where("is_secret").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    own, i, h, cuts = (free_name(docs, n) for n in ("own_hash", "span_id", "span_hash", "spans"))
    s = spans.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("spans").alias(cuts))
    joined = docs.withColumn(own, F.xxhash64(text_or_empty())).join(s, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left")
    end_before = lambda k: F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda k: F.substr(F.col("text"), (end_before(k) + 1).cast("int"), (F.coalesce(F.get(cuts, k)["start"], F.char_length("text")) - end_before(k)).cast("int")),
    )
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(pieces, MASK))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
