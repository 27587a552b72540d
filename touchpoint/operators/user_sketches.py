"""Stored distinct-user sketches: HyperLogLog states per day that add up to any period.

Distinct counts of a month or a channel cannot be added from those of days, so an exact
report reads every event of the period again. A state here is one HLL sketch per day,
local month, event name and traffic medium: a few rows a day whatever the number of users.
Reports merge sketches (``hll_union_agg``) and never read events; a daily run sketches one
day. The exact reports of ``reports`` stay the default; estimates of merged sketches have a
relative standard error of 1.04 / sqrt(2 ** LG_K).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpoint.functions.params import leaf_column
from touchpoint.functions.timeutil import LEAD_TZ, micros_to_ntz, to_local
from touchpoint.operators.reports import channel_sums
from touchpoint.sources import day_builds as DB

LG_K = 14
KEYS = ["event_date", "month_year", "event_name", "medium"]
SKETCHES = T.StructType([T.StructField(c, T.StringType()) for c in KEYS[1:]] + [T.StructField("users", T.BinaryType()), *DB.FOLDERS])


def error_bound(lg_k: int = LG_K, errors: float = 4.0) -> float:
    """The relative error that ``errors`` standard errors allow."""
    return errors * 1.04 / math.sqrt(2**lg_k)


def day_sketches(events: DataFrame, day_from: str, day_to: str, tz: str = LEAD_TZ, lg_k: int = LG_K) -> DataFrame:
    """One row per day, local month, event name and medium. The sketches combine map-side,
    so a day with a third of all events is not one task."""
    month = F.date_format(to_local(micros_to_ntz("event_timestamp"), tz), "yyyy-MM")
    rows = events.where(F.col("event_date").between(day_from, day_to))
    keyed = rows.select("event_date", month.alias("month_year"), "event_name", leaf_column(events, "traffic_medium").alias("medium"), "user_pseudo_id")
    return keyed.groupBy(*KEYS).agg(F.hll_sketch_agg("user_pseudo_id", F.lit(lg_k)).alias("users"))


def update(events: DataFrame, root: str, day_from: str, day_to: str | None = None, files_per_day: int = 1) -> None:
    """Sketch the events of a day (or a range: a backfill); replaces what is stored of them."""
    day_to = day_to or day_from
    attempt = DB.new_attempt()
    DB.store(day_sketches(events, day_from, day_to), root, "users", attempt, [], KEYS[1:], files_per_day)
    DB.publish(events.sparkSession, root, attempt, DB.days_between(day_from, day_to))


def read_sketches(spark: SparkSession, root: str, day_from: str, day_to: str) -> DataFrame:
    return DB.read_or_empty(spark, f"{root}/users", SKETCHES).where(DB.folders(spark, root, day_from, day_to)).drop("attempt")


def _users(sketches: DataFrame, *keys: str) -> DataFrame:
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("users").alias("merged"))
    return merged.select(*keys, F.hll_sketch_estimate("merged").alias("users"))


def monthly_users(sketches: DataFrame) -> DataFrame:
    """``reports.monthly_users`` estimated from the days' sketches."""
    return _users(sketches, "month_year").withColumnRenamed("users", "total_users").orderBy(F.desc("month_year"))


def channel_users(sketches: DataFrame) -> DataFrame:
    """``reports.channel_users`` estimated from the days' sketches."""
    return channel_sums(_users(sketches, "event_date", "event_name", "medium"))


def within_bound(exact: DataFrame, estimated: DataFrame, keys: list[str], lg_k: int = LG_K) -> DataFrame:
    """The exact report with a column that says whether the estimate is as near as it must be."""
    other = estimated.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("total_users").alias("_users"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    near = F.abs(F.col("_users") - F.col("total_users")) <= F.col("total_users") * error_bound(lg_k) + 1
    return exact.join(other, same, "left").select(*keys, "total_users", F.coalesce(near, F.lit(False)).alias("within_bound"))
