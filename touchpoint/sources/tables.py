"""Readers and writers for the logical tables in production layouts.

* events: Parquet partitioned by ``event_date`` (``yyyyMMdd``), the shard suffix of
  the export. Day ranges become ``PartitionFilters`` (only the needed folders are
  listed and read).
* leads / sink / dimension tables: Parquet with the schemas of
  ``touchpoint.sources.schemas`` (never inferred).

``flatten_events`` writes a "silver" copy of the events with the parameters the
operators need as flat columns: a higher-order filter over ``event_params`` cannot
be column-pruned at the scan, so extracting them once saves reading the whole
nested list in every query.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpoint.functions.params import RAW_LEAVES, all_values, event_param
from touchpoint.sources import schemas as S

SILVER_PARAMS = [("page_location", "string"), ("ga_session_id", "int"), ("medium", "string")]


def _days(df: DataFrame, day_from, day_to) -> DataFrame:
    def text(d):
        return d.strftime("%Y%m%d") if isinstance(d, dt.date) else d

    if day_from is not None:
        df = df.where(F.col("event_date") >= text(day_from))
    if day_to is not None:
        df = df.where(F.col("event_date") <= text(day_to))
    return df


def read_events(
    spark: SparkSession,
    path: str,
    day_from: dt.date | str | None = None,
    day_to: dt.date | str | None = None,
) -> DataFrame:
    """Events partitioned by ``event_date``; optional inclusive day range."""
    return _days(spark.read.schema(S.EVENTS).parquet(path), day_from, day_to)


def read_flat_events(
    spark: SparkSession,
    path: str,
    day_from: dt.date | str | None = None,
    day_to: dt.date | str | None = None,
) -> DataFrame:
    """The flat layout; every event operator and report takes it in place of the raw one."""
    return _days(spark.read.schema(S.FLAT_EVENTS).parquet(path), day_from, day_to)


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, snapshot_date: dt.date
) -> DataFrame:
    """One day of a table partitioned by ``snapshot_date`` (only its folder is read)."""
    dated = T.StructType([*schema.fields, T.StructField("snapshot_date", T.DateType())])
    df = spark.read.schema(dated).parquet(path)
    return df.where(F.col("snapshot_date") == F.lit(snapshot_date)).drop("snapshot_date")


def read_snapshot_as_of(
    spark: SparkSession, path: str, schema: T.StructType, day: dt.date
) -> DataFrame:
    """The newest day not after ``day`` of a table partitioned by ``snapshot_date``, with that
    date as a column; empty if there is none. The date is looked up among the partition
    values, and only its folder is read."""
    dated = T.StructType([*schema.fields, T.StructField("snapshot_date", T.DateType())])
    df = spark.read.schema(dated).parquet(path)
    newest = df.where(F.col("snapshot_date") <= F.lit(day)).select(F.max("snapshot_date"))
    return df.where(F.col("snapshot_date") == newest.scalar())


def write_snapshot(df: DataFrame, path: str, snapshot_date: dt.date) -> None:
    """Write one day of a dated table; a day that is there already is replaced."""
    dated = df.withColumn("snapshot_date", F.lit(snapshot_date))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as table ``name``, bucketed by ``key``: joins of tables with equal buckets need
    no exchange. One task writes a bucket, as one file; choose ``buckets`` so that a bucket
    of the larger table fits a task. A key that holds a large share of the rows stays one
    bucket: leave such tables to the salted joins."""
    spread = df.repartition(buckets, key)
    spread.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_events(df: DataFrame, path: str, mode: str = "append",
                 files_per_day: int = 64) -> None:
    """Write events partitioned by day. Each day is spread over ``files_per_day``
    writer tasks by a hash of (user, timestamp); choose it so that a day's rows divided
    by it fit one writer. A day holding a large share of the
    events is not written by one task, and the hash is deterministic, so a retried
    task writes the same rows."""
    bucket = F.pmod(F.xxhash64("user_pseudo_id", "event_timestamp"), F.lit(files_per_day))
    (
        df.repartition("event_date", bucket)
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )


def write_silver_events(events: DataFrame, path: str, mode: str = "append",
                        files_per_day: int = 64) -> None:
    """Write the flattened copy of the events (see ``flatten_events``)."""
    write_events(flatten_events(events), path, mode, files_per_day)


def flatten_events(events: DataFrame) -> DataFrame:
    """Raw events in the flat layout (``schemas.FLAT_EVENTS``): later scans read the used
    columns only, and never the nested list."""
    return events.select(
        "event_date",
        "event_timestamp",
        "event_name",
        "user_pseudo_id",
        *[event_param(k, kind).alias(k) for k, kind in SILVER_PARAMS],
        all_values("page_location").alias("page_locations"),
        *[F.col(leaf).alias(name) for name, leaf in RAW_LEAVES.items()],
    )
