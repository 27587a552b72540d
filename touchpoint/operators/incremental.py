"""Incremental, idempotent loading of attributed leads into the sink table.

``load_new_leads`` re-reads an overlapping window (lookback) or everything after the
sink's newest lead (watermark), attributes it, drops what the sink already holds and
appends the rest. Re-running with the same input appends nothing for leads whose
identifying columns are all non-NULL (NULL keys never match, as in SQL).

The sink is a Parquet table partitioned by ``created_date`` on shared storage; the
append is the job's only write, so a lost executor just re-runs tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpoint.operators import attribution as A
from touchpoint.sources.schemas import MATCHED_LEADS

PARTITION_COL = "created_date"
SINK_SCHEMA = T.StructType(MATCHED_LEADS.fields + [T.StructField(PARTITION_COL, T.DateType())])


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """The sink (empty with the right schema when it does not exist yet)."""
    try:
        # created_date is the partition column: day filters on it prune folders
        return spark.read.schema(SINK_SCHEMA).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], SINK_SCHEMA)


def sink_rows(df: DataFrame) -> DataFrame:
    """The rows to append: the sink's columns (missing ones NULL) and the local day."""
    out = df
    for f in MATCHED_LEADS.fields:
        if f.name not in df.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.select(*[f.name for f in MATCHED_LEADS.fields]).withColumn(
        PARTITION_COL, F.to_date("created_at")
    )


def append_matched(df: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Append attributed leads, partitioned by local creation date; each day is spread
    over ``files_per_day`` writers by a deterministic hash. Raise it for a backfill, so
    that a day's rows divided by it fit one writer."""
    cols = [f.name for f in MATCHED_LEADS.fields]
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(files_per_day))
    (
        sink_rows(df)
        .repartition(PARTITION_COL, bucket)
        .write.mode("append")
        .partitionBy(PARTITION_COL)
        .parquet(path)
    )


def load_new_leads(
    spark: SparkSession,
    inputs: A.AttributionInputs,
    sink_path: str,
    as_of: dt.date,
    lookback_days: int | None = 18,
    bootstrap: dt.datetime | None = None,
    method: str = "first_paid_touch",
    null_safe: bool = False,
) -> A.LoadWindow:
    """Attribute the leads of the window and append the ones not loaded yet.

    ``lookback_days=None`` uses the sink's high watermark (``bootstrap`` when the sink
    is empty). ``null_safe``: leads with a NULL identifying column are loaded once
    instead of on every run. Returns the window that was loaded.
    """
    sink = read_sink(spark, sink_path)
    inp = A.AttributionInputs(inputs.leads, inputs.events, inputs.phone_map, sink)
    if lookback_days is None:
        window = A.watermark_bounds(sink, as_of, bootstrap)
    else:
        window = A.lookback_window(as_of, lookback_days)
    append_matched(A.attribute(inp, window, method, null_safe=null_safe), sink_path)
    return window
