"""From raw documents to token ids in five stages, each of which reads what the stage
before it wrote.

1. language ID: documents without letters, or whose language is not clear, go
2. near-dedup: one document of each group of near-duplicates stays (five-word shingles)
3. decontamination: documents with a passage of a benchmark item go
4. secrets: secrets are masked in the text
5. byte-level BPE: the ids of every remaining document, as digests

Stages 1 to 4 return the columns of ``documents``. Null doc_ids, null and empty texts,
repeated rows and extra columns are handled as the operators say; an empty table passes
through. Shingles are of five words here, not of four as in the op1 query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpoint.llm import bpe, decontaminate, language, near_dedup, queries, secrets
from touchpoint.llm.stages import free_name, shared_folder

SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(free_name(docs, n) for n in language.ADDED)
    named = language.identify(docs, language.train(docs), names=names)
    return named.where(~F.col(names[2])).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = dict(docs.dtypes)["n_chars"]
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(kind))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.tokenizer_pattern()
    return queries.bpe_digests(bpe.encode_documents(docs, path, pattern))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]

#: No stage but decontamination can be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared
    folder and read again."""
    out = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, out, sf_dir)
        path = f"{folder}/{k}-{name}"
        made.write.parquet(path)
        out = spark.read.schema(made.schema).parquet(path)
    return out
