"""Intermediate tables in the shared folder that the cluster names in
``spark.checkpoint.dir``; they survive the loss of executors and cut the lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchpoint.session import shared_folder  # noqa: F401 - the operators' and the pipeline's


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder of the shared place, and read again. All
    such tables of an application lie in one folder that bears its id, to be removed when
    the application has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch; Spark's own default suits short rows, not documents.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch, unless it was set: a batch of documents
    is held several times over, in the JVM and in Python."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


#: Rows kept for each row wanted, as the distinct keys are only estimated first.
SAMPLE_SPARE = 1.5
#: Groups up to which their sizes are broadcast.
SAMPLE_GROUPS = 10_000


def bounded_sample(df: DataFrame, keys: list[str], rows: int, per: str | None = None, last: str | None = None) -> DataFrame:
    """At most ``rows`` rows of ``df`` (of each value of ``per``, if given), one for each
    distinct value of ``keys``: those whose keys hash lowest, rows that meet the condition
    ``last`` only where others do not suffice. Which ones does not depend on partitions.

    A key that fills a third of the table counts once, so neither it nor anything else
    exceeds the bound. The distinct keys are estimated first, and rows above the hash that
    the estimate gives never leave their tasks."""
    steps, group = 1 << 40, F.lit(0) if per is None else F.col(per)
    marked = df.withColumns({"_group": group, "_order": F.xxhash64(*keys, F.lit("sample")), "_last": F.expr(last) if last else F.lit(False)})
    sizes = written(marked.groupBy("_group", "_last").agg(F.approx_count_distinct("_order", 0.02).alias("n")), "group-sizes")
    few = sizes.limit(SAMPLE_GROUPS + 1).count() <= SAMPLE_GROUPS
    share = sizes.select(F.col("_group").alias("_g"), F.col("_last").alias("_l"), (F.lit(rows * SAMPLE_SPARE + 50) / F.col("n")).alias("_share"))
    # a row per group: beside it the rows stay where they are
    low = marked.join(F.broadcast(share) if few else share, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_last") == F.col("_l"))).where(F.pmod("_order", F.lit(steps)) / steps < F.col("_share"))
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_last", F.pmod("_order", F.lit(steps)), "_order"))
    one = low.dropDuplicates(["_group", "_order"]).withColumn("_place", place).where(F.col("_place") <= rows)
    return one.select(*df.columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | None = None):
    return F.coalesce(F.col(column or "text").cast("string"), F.lit(""))
