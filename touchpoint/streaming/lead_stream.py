"""Incremental lead attribution as a Structured Streaming job that loses no lead.

Lead files arriving in a folder are attributed micro-batch by micro-batch. The file
source hands out each file once, so a batch may not drop a lead for its date:

* leads of a day that has not ended at the batch's date wait in a table of pending leads,
  which the next batch adds to its own leads;
* leads of the lookback window are attributed as a daily batch load of that date does;
* leads older than the window (late files) are attributed in runs of days that lie close
  to each other, each over the events of its own days, so that one very old lead does not
  stretch the events of all others;
* leads without a time can never be attributed: each batch sets its own aside in a table
  of their own, and no later batch reads them again.

The date is asked for anew in every batch. Leads already in the sink are excluded, NULL
columns compared as equal, and each batch writes its pending leads to a folder of its own
number, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchpoint.functions.timeutil import LEAD_TZ, local_to_utc, ntz_lit, to_local
from touchpoint.operators import attribution as A
from touchpoint.operators.incremental import append_matched, read_sink
from touchpoint.session import checkpoint_dir
from touchpoint.sources.schemas import LEADS


def today(tz: str = LEAD_TZ) -> dt.date:
    return dt.datetime.now(ZoneInfo(tz)).date()


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Leads held back by a batch; none if the folder does not exist."""
    try:
        return spark.read.schema(LEADS).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], LEADS)


def split_by_day(leads: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leads of ended days, leads that wait for the end of their day, leads without a time)."""
    end = ntz_lit(local_to_utc(dt.datetime.combine(as_of, dt.time(0)), LEAD_TZ))
    created = F.col("created_at")
    return leads.where(created < end), leads.where(created >= end), leads.where(created.isNull())


def late_runs(days: list[dt.date], gap: int) -> list[tuple[dt.date, dt.date]]:
    """First and last day of each run of ``days`` in which neighbours are at most ``gap``
    days apart."""
    runs: list[tuple[dt.date, dt.date]] = []
    for day in sorted(set(days)):
        if runs and (day - runs[-1][1]).days <= gap:
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs


def ready_windows(
    leads: DataFrame, as_of: dt.date, lookback_days: int
) -> list[tuple[A.LoadWindow, A.LoadWindow]]:
    """(window of the leads, window of their events) of the daily load and of each run of
    late days. The events of a run reach from ``lookback_days`` before its first day to its
    last day, as in the daily load that would have taken it. Runs are as far apart as their
    events reach back, so no event day is read for two of them. Only distinct days come to
    the driver."""
    window = A.lookback_window(as_of, lookback_days)
    late = leads.where(F.col("created_at") <= ntz_lit(local_to_utc(window.lower, LEAD_TZ)))
    days = [r[0] for r in late.select(F.to_date(to_local("created_at", LEAD_TZ))).distinct().collect()]
    tick = dt.timedelta(microseconds=1)
    out = [(window, window)]
    for first, last in late_runs(days, lookback_days):
        begin = dt.datetime.combine(first, dt.time(0))
        end = dt.datetime.combine(last + dt.timedelta(days=1), dt.time(0))
        out.append((A.LoadWindow(begin - tick, min(end, window.lower + tick)),
                    A.LoadWindow(begin - dt.timedelta(days=lookback_days), end)))
    return out


def append_ready(
    spark: SparkSession,
    leads: DataFrame,
    events: DataFrame,
    phone_map: DataFrame,
    sink_path: str,
    as_of: dt.date,
    lookback_days: int = 18,
) -> None:
    """Append the attribution of all ``leads`` (of ended days) that the sink does not hold,
    one window after the other: a plan holds one window, however many days are late, and a
    repeated call finds the windows that were loaded in the sink."""
    for window, event_window in ready_windows(leads, as_of, lookback_days):
        inp = A.AttributionInputs(leads, events, phone_map, read_sink(spark, sink_path))
        append_matched(A.attribute(inp, window, event_window=event_window, null_safe=True), sink_path)


def load_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    events: DataFrame,
    phone_map: DataFrame,
    sink_path: str,
    pending_path: str,
    as_of: dt.date,
    lookback_days: int = 18,
) -> None:
    """One micro-batch: pending leads of the batch before plus its own. Leads without a
    time go to ``<pending_path>-untimed/batch=<number>``."""
    cols = [f.name for f in LEADS.fields]
    leads = read_pending(spark, f"{pending_path}/{batch_id - 1}").unionByName(batch.select(*cols))
    ready, waiting, untimed = split_by_day(leads, as_of)
    append_ready(spark, ready, events, phone_map, sink_path, as_of, lookback_days)
    untimed.write.mode("overwrite").parquet(f"{pending_path}-untimed/batch={batch_id}")
    waiting.write.mode("overwrite").parquet(f"{pending_path}/{batch_id}")


def release_pending(
    spark: SparkSession,
    batch_id: int,
    events: DataFrame,
    phone_map: DataFrame,
    sink_path: str,
    pending_path: str,
    as_of: dt.date,
    lookback_days: int = 18,
) -> None:
    """Load what has waited since batch ``batch_id`` when no new file comes to start a
    batch. The next batch finds these leads in the sink and skips them."""
    ready = split_by_day(read_pending(spark, f"{pending_path}/{batch_id}"), as_of)[0]
    append_ready(spark, ready, events, phone_map, sink_path, as_of, lookback_days)


def start_lead_stream(
    spark: SparkSession,
    leads_path: str,
    events: DataFrame,
    phone_map: DataFrame,
    sink_path: str,
    as_of: dt.date | Callable[[], dt.date] = today,
    lookback_days: int = 18,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream (``availableNow`` processes what is there and stops). ``as_of``: a
    date, or a function that gives the date of each batch. Pending leads live beside the
    checkpoint, in ``<checkpoint>-pending``."""
    shared = checkpoint_dir(spark)
    if checkpoint is None and shared is None:
        raise ValueError("no checkpoint location: set spark.checkpoint.dir or pass one")
    location = checkpoint or f"{shared}/lead_stream"
    stream = spark.readStream.schema(LEADS).parquet(leads_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        day = as_of() if callable(as_of) else as_of
        load_batch(spark, batch, batch_id, events, phone_map, sink_path, f"{location}-pending",
                   day, lookback_days)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute"
    )
    return writer.start()
