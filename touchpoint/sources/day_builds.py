"""Tables kept by day and built in attempts.

A build writes the tables of some days below ``<root>/<table>/attempt=.../event_date=...``
and is published by one append of a row per day to ``<root>/days``. The last published
attempt of a day counts: a build that dies changes nothing, one that is run again replaces
its days, and readers filter on the folders of the counted attempts only.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpoint.functions.timeutil import day_text

FOLDERS = [T.StructField("attempt", T.StringType()), T.StructField("event_date", T.StringType())]
DAYS = T.StructType([T.StructField("event_date", T.StringType()), T.StructField("attempt", T.StringType()), T.StructField("published_at", T.TimestampType())])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def days_between(day_from: str, day_to: str) -> list[str]:
    first, last = (dt.datetime.strptime(d, "%Y%m%d").date() for d in (day_from, day_to))
    return [day_text(first + dt.timedelta(days=k)) for k in range((last - first).days + 1)]


def new_attempt() -> str:
    return uuid.uuid4().hex


def store(df: DataFrame, root: str, table: str, attempt: str, by: list[str], spread: list[str], files_per_day: int) -> None:
    """Write ``df`` by event_date and the columns ``by``; a day is spread over
    ``files_per_day`` writers by a hash of the columns ``spread``."""
    bucket = F.pmod(F.xxhash64(*spread), F.lit(files_per_day))
    df.repartition("event_date", bucket).write.partitionBy("event_date", *by).parquet(f"{root}/{table}/attempt={attempt}")


def publish(spark: SparkSession, root: str, attempt: str, days: list[str]) -> None:
    record = spark.createDataFrame([(d, attempt) for d in days], "event_date string, attempt string")
    record.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/days")


def published_days(spark: SparkSession, root: str) -> DataFrame:
    """event_date, attempt: the last published build of each day."""
    last = read_or_empty(spark, f"{root}/days", DAYS).groupBy("event_date").agg(F.max(F.struct("published_at", "attempt")).alias("r"))
    return last.select("event_date", F.col("r.attempt").alias("attempt"))


def folders(spark: SparkSession, root: str, day_from: str, day_to: str) -> Column:
    """The filter on attempt and event_date that reads the days' counted builds (a row per
    day is listed, whatever the data); ``ValueError`` if a day was never built."""
    known = {r["event_date"]: r["attempt"] for r in published_days(spark, root).where(F.col("event_date").between(day_from, day_to)).collect()}
    missing = [d for d in days_between(day_from, day_to) if d not in known]
    if missing:
        raise ValueError(f"days without a build: {missing[:5]}{' ...' if len(missing) > 5 else ''}")
    of_attempt: dict[str, list[str]] = {}
    for day, attempt in known.items():
        of_attempt.setdefault(attempt, []).append(day)
    wanted = F.lit(False)
    for attempt, days in sorted(of_attempt.items()):
        wanted = wanted | (_stretches(sorted(days)) & (F.col("attempt") == attempt))
    return wanted


def _stretches(days: list[str]) -> Column:
    """``event_date`` lies in ``days`` (sorted): two bounds for each stretch of days, one
    comparison for a single day."""
    cond, start = F.lit(False), days[0]
    for day, after in zip(days, [*days[1:], None]):
        if after is None or after not in days_between(day, after)[:2]:
            cond = cond | (F.col("event_date") == day if start == day else F.col("event_date").between(start, day))
            start = after
    return cond
