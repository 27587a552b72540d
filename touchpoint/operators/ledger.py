"""Exactly-once loading of attributed leads: stage, then publish.

Layout below one folder on shared storage:

* ``rows/batch_id=.../attempt=.../created_date=.../*.parquet``: staged rows. A load writes to
  a new attempt each time it runs, so it never meets the files of a run that died.
* ``ledger/*.parquet``: one row per published batch (batch id, attempt, window, rows, days,
  newest lead, files). Appending that single row is the commit: it appears whole or not at all.

Readers see the rows of published attempts only, so a load that dies between write and
publish leaves no row. A batch id names the load (method and window), so a load that is run
again after its publish writes nothing; if two runs of a batch publish at the same time, the
first record counts. Retried or speculative tasks are settled by Spark's own committer.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpoint.functions.timeutil import ntz_lit
from touchpoint.operators import attribution as A
from touchpoint.operators.incremental import PARTITION_COL, SINK_SCHEMA, sink_rows

STAGED = T.StructType([*SINK_SCHEMA.fields, T.StructField("batch_id", T.StringType()), T.StructField("attempt", T.StringType())])
FILE = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_rows", T.LongType())])
LEDGER = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("window_from", T.TimestampNTZType()),
        T.StructField("window_to", T.TimestampNTZType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("first_day", T.DateType()),
        T.StructField("last_day", T.DateType()),
        T.StructField("newest", T.TimestampNTZType()),
        T.StructField("files", T.ArrayType(FILE)),
        T.StructField("published_at", T.TimestampType()),
    ]
)
#: Batches up to which their attempts become a partition filter; beyond it they are joined.
LISTED_BATCHES = 10_000


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def batch_id(window: A.LoadWindow, method: str) -> str:
    """The name of a load: the same leads are asked for under the same name."""
    low, high = (d.strftime("%Y%m%dT%H%M%S%f") if d else "none" for d in (window.lower, window.upper))
    return f"{method}-{low}-{high}"


def stage(df: DataFrame, root: str, batch: str, files_per_day: int = 8) -> str:
    """Write the sink rows of ``df`` as a new attempt of ``batch``, unseen by readers.
    Returns the attempt. Each day is spread over ``files_per_day`` writers."""
    attempt = uuid.uuid4().hex
    rows = sink_rows(df)
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(files_per_day))
    rows.repartition(PARTITION_COL, bucket).write.partitionBy(PARTITION_COL).parquet(f"{root}/rows/batch_id={batch}/attempt={attempt}")
    return attempt


def publish(spark: SparkSession, root: str, batch: str, attempt: str, window: A.LoadWindow | None = None) -> None:
    """Make a staged attempt visible by one ledger row, counted from its files."""
    staged = spark.read.schema(SINK_SCHEMA).parquet(f"{root}/rows/batch_id={batch}/attempt={attempt}")
    per_file = staged.groupBy(F.input_file_name().alias("file")).agg(
        F.count("*").alias("n"), F.min(PARTITION_COL).alias("first"), F.max(PARTITION_COL).alias("last"), F.max("created_at").alias("newest")
    )
    record = per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.min("first").alias("first_day"),
        F.max("last").alias("last_day"),
        F.max("newest").alias("newest"),
        F.array_sort(F.collect_list(F.struct("file", F.col("n").alias("n_rows")))).alias("files"),
    )
    lower, upper = (ntz_lit(d) if d else F.lit(None).cast("timestamp_ntz") for d in ((window.lower, window.upper) if window else (None, None)))
    named = record.withColumns(
        {"batch_id": F.lit(batch), "attempt": F.lit(attempt), "window_from": lower, "window_to": upper, "published_at": F.current_timestamp()}
    )
    named.select([f.name for f in LEDGER.fields]).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per published batch: its first record."""
    records = _read(spark, f"{root}/ledger", LEDGER)
    rest = [f.name for f in LEDGER.fields if f.name not in ("batch_id", "published_at", "attempt")]
    first = records.groupBy("batch_id").agg(F.min(F.struct("published_at", "attempt", *rest)).alias("r"))
    return first.select("batch_id", *[F.col(f"r.{f.name}").alias(f.name) for f in LEDGER.fields[1:]])


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The sink: rows of published batches (columns of ``SINK_SCHEMA``). Staged rows of dead
    or running loads are not even listed as files to read."""
    staged = _read(spark, f"{root}/rows", STAGED)
    attempts = read_ledger(spark, root).select("attempt")
    some = [r["attempt"] for r in attempts.limit(LISTED_BATCHES + 1).collect()]
    if len(some) <= LISTED_BATCHES:
        seen = staged.where(F.col("attempt").isin(some)) if some else staged.where(F.lit(False))
    else:
        seen = staged.join(attempts, "attempt", "left_semi")
    return seen.select([f.name for f in SINK_SCHEMA.fields])


def unpublished(spark: SparkSession, root: str) -> DataFrame:
    """batch_id, attempt, n_rows of staged attempts that no reader sees (dead or running
    loads, or the later of two): what a cleanup may remove once no load is running."""
    staged = _read(spark, f"{root}/rows", STAGED).groupBy("batch_id", "attempt").agg(F.count("*").alias("n_rows"))
    return staged.join(read_ledger(spark, root).select("attempt"), "attempt", "left_anti").select("batch_id", "attempt", "n_rows")


def watermark(spark: SparkSession, root: str) -> DataFrame:
    """newest: the newest ``created_at`` of the sink, from the ledger's rows alone (one per
    batch); no row of the sink is read."""
    return read_ledger(spark, root).agg(F.max("newest").alias("newest"))


def is_published(spark: SparkSession, root: str, batch: str) -> bool:
    return bool(_read(spark, f"{root}/ledger", LEDGER).where(F.col("batch_id") == batch).limit(1).count())


def append_once(df: DataFrame, root: str, batch: str, window: A.LoadWindow | None = None, files_per_day: int = 8) -> bool:
    """Append ``df`` to the sink as ``batch``; does nothing if that batch is published."""
    spark = df.sparkSession
    if is_published(spark, root, batch):
        return False
    publish(spark, root, batch, stage(df, root, batch, files_per_day), window)
    return True


def load_once(
    spark: SparkSession,
    inputs: A.AttributionInputs,
    root: str,
    as_of: dt.date,
    lookback_days: int | None = 18,
    bootstrap: dt.datetime | None = None,
    method: str = "first_paid_touch",
    null_safe: bool = False,
) -> tuple[A.LoadWindow, bool]:
    """Attribute the leads of the window that the published sink does not hold and append
    them, once. ``lookback_days=None`` starts at the ledger's watermark (``bootstrap`` if there
    is none). Returns the window and whether anything was written. Leads with a NULL
    identifying column are "new" to every load, but a load that is replayed adds none."""
    sink = read_published(spark, root)
    if lookback_days is None:
        newest = watermark(spark, root).first()["newest"]
        window = A.LoadWindow(newest or bootstrap, dt.datetime.combine(as_of, dt.time(0)))
    else:
        window = A.lookback_window(as_of, lookback_days)
    batch = batch_id(window, method)
    if is_published(spark, root, batch):
        return window, False
    inp = A.AttributionInputs(inputs.leads, inputs.events, inputs.phone_map, sink)
    return window, append_once(A.attribute(inp, window, method, null_safe=null_safe), root, batch, window)
