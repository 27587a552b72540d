"""Data-freshness check on a lead table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpoint.functions.timeutil import ntz_lit

NO_DATA = "There is no data"  # fixed value: text of the sentinel row

CHECK_COLS = [
    ("description", "description"),
    ("car_name", "car_name"),
    ("created_at", "created_at"),
    ("fullname", "customer.fullname"),
    ("phone", "customer.phone"),
    ("email", "customer.email"),
    ("city", "customer.city"),
    ("estimated_buying_time", "customer.estimated_buying_time"),
    ("referer", "customer.referer"),
]


def freshness_check(leads: DataFrame, as_of: dt.date, days: int = 3) -> DataFrame:
    """Leads created since ``as_of - days`` (00:00), each with the total count as
    text, newest first; when there is none, one row of NULLs with ``total_row = 'There is no
    data'``. The count is a scalar subquery (no single-partition window) and the
    sentinel row is driven by the same scalar."""
    since = ntz_lit(dt.datetime.combine(as_of - dt.timedelta(days=days), dt.time(0)))
    recent = leads.where(F.col("created_at") >= since)
    n = recent.select(F.count(F.lit(1))).scalar()
    rows = recent.select(
        *[F.col(src).alias(name) for name, src in CHECK_COLS],
        F.when(n > 0, n.cast("string")).alias("total_row"),
    )
    schema = {f.name: f.dataType for f in rows.schema.fields}
    spark = leads.sparkSession
    sentinel = spark.range(1).where(n == 0).select(
        *[F.lit(None).cast(schema[name]).alias(name) for name, _ in CHECK_COLS],
        F.lit(NO_DATA).alias("total_row"),
    )
    return rows.unionByName(sentinel).orderBy(F.desc_nulls_last("created_at"))


def freshness_assertion(check: DataFrame) -> DataFrame:
    """Lazy assertion: evaluating it fails the job when the sentinel row is
    present (``raise_error`` only fires on a matching row, unlike a folded ``1/0``)."""
    return check.where(F.col("total_row") == NO_DATA).select(
        F.raise_error(F.lit("stale lead table: no recent rows")).alias("failed")
    )


def freshness_status(check: DataFrame) -> DataFrame:
    """One row: whether the table is fresh, and its number of recent rows."""
    stale = F.max(F.when(F.col("total_row") == NO_DATA, 1).otherwise(0))
    return check.agg(
        (F.coalesce(stale, F.lit(0)) == 0).alias("fresh"),
        F.count(F.when(F.col("total_row") != NO_DATA, 1)).alias("recent_rows"),
    )


def assert_fresh(check: DataFrame) -> None:
    """Run the assertion; raises when the table is stale."""
    freshness_assertion(check).collect()
