"""Touch state: what a day's events leave for attribution, kept day by day.

A window of 18 (or 1000) days is attributed anew every day, but only its last day is new.
So each day is reduced once to the rows that any later choice can need:

* ``touches``: per user, session and day the rows in first place, once by the first-paid
  order and once by the last-source order (``kind``), all ties included. The best of a
  window is the best of its days' bests, so these rows may stand for the events;
* ``conversions``: the sessions with a conversion event, per user and day.

Users are kept, not phones: a user who leaves a phone later is found in earlier days too,
and a change of the phone map needs no rebuild. Rows of a user's session are few, so the
state grows with sessions, not with events, and a daily run reads one day of events.

A build dies without a trace or is published whole, and one that is run again (late events,
a replay) replaces its days (``sources.day_builds``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchpoint.functions.params import param_column
from touchpoint.functions.timeutil import LEAD_TZ, micros_to_ntz, to_local
from touchpoint.functions.utm import extract_utm, is_non_paid
from touchpoint.operators import attribution as A
from touchpoint.sources import day_builds as DB

FIRST, LAST = "first_paid", "last_source"
CONVERSIONS = (A.TEST_DRIVE_CONVERSION, A.BROCHURE_CONVERSION)
KEYS = ["event_date", "user_pseudo_id", "ga_session_id"]


_ID = [T.StructField("user_pseudo_id", T.StringType()), T.StructField("ga_session_id", T.LongType())]
_FIELDS = [T.StructField("log_time", T.TimestampNTZType()), *[T.StructField(c, T.StringType()) for c in A.UTM_COLS]]
TOUCHES = T.StructType([*_ID, *_FIELDS, *DB.FOLDERS, T.StructField("kind", T.StringType())])
CONVERTING = T.StructType([*_ID, T.StructField("event_name", T.StringType()), *DB.FOLDERS])


def _of_days(events: DataFrame, day_from: str, day_to: str) -> DataFrame:
    """The columns of the state, of rows that can belong to a session of a known user."""
    ev = events.where(F.col("event_date").between(day_from, day_to)).select(
        "event_date",
        "user_pseudo_id",
        "event_timestamp",
        "event_name",
        param_column(events, "page_location").alias("page_location"),
        param_column(events, "ga_session_id", "int").cast("long").alias("ga_session_id"),
    )
    return ev.where(F.col("user_pseudo_id").isNotNull() & F.col("ga_session_id").isNotNull())


def day_touches(events: DataFrame, day_from: str, day_to: str, kinds: Sequence[str] = (FIRST, LAST), tz: str = LEAD_TZ) -> DataFrame:
    """Per day, user and session the rows in first place of each kind of choice. A page
    whose campaign fields cannot be cut out has NULL fields here."""
    rows = _of_days(events, day_from, day_to).select(
        *KEYS, to_local(micros_to_ntz("event_timestamp"), tz).alias("log_time"), *extract_utm("page_location", strict=False)
    )
    orders = {FIRST: [is_non_paid("utm_source"), F.col("log_time"), F.col("utm_source")], LAST: [F.desc_nulls_last("utm_source")]}
    # the last source needs no time, so a session's repeated rows shrink to one
    given = {FIRST: rows.distinct(), LAST: rows.withColumn("log_time", F.lit(None).cast("timestamp_ntz")).distinct()}
    best = [A._best_rows(given[k], KEYS, orders[k]).withColumn("kind", F.lit(k)) for k in kinds]
    return best[0] if len(best) == 1 else best[0].unionByName(best[1])


def day_conversions(events: DataFrame, day_from: str, day_to: str, names: Sequence[str] = CONVERSIONS) -> DataFrame:
    return _of_days(events, day_from, day_to).where(F.col("event_name").isin(*names)).select(*KEYS, "event_name").distinct()


def stage(events: DataFrame, root: str, day_from: str, day_to: str, kinds: Sequence[str] = (FIRST, LAST), files_per_day: int = 8) -> str:
    """Build the days into a new attempt that no reader sees yet."""
    attempt, spread = DB.new_attempt(), ["user_pseudo_id", "ga_session_id"]
    DB.store(day_touches(events, day_from, day_to, kinds), root, "touches", attempt, ["kind"], spread, files_per_day)
    DB.store(day_conversions(events, day_from, day_to), root, "conversions", attempt, [], spread, files_per_day)
    return attempt


def update(events: DataFrame, root: str, day_from: str, day_to: str | None = None, kinds: Sequence[str] = (FIRST, LAST), files_per_day: int = 8) -> None:
    """Reduce the events of a day (or a range: a backfill) into the state; replaces what the
    state holds of these days."""
    day_to = day_to or day_from
    attempt = stage(events, root, day_from, day_to, kinds, files_per_day)
    DB.publish(events.sparkSession, root, attempt, DB.days_between(day_from, day_to))


def read_state(spark: SparkSession, root: str, day_from: str, day_to: str, kind: str = FIRST) -> tuple[DataFrame, DataFrame]:
    """(touches, conversions) of the days; raises ``ValueError`` if one was never built."""
    wanted = DB.folders(spark, root, day_from, day_to)
    touches = DB.read_or_empty(spark, f"{root}/touches", TOUCHES).where(wanted & (F.col("kind") == kind))
    return touches.drop("attempt", "kind"), DB.read_or_empty(spark, f"{root}/conversions", CONVERTING).where(wanted).drop("attempt")


def compact(spark: SparkSession, root: str, day_from: str, day_to: str, files_per_day: int = 1) -> None:
    """Write the days again as one build with fewer files, once they no longer change."""
    attempt, spread = DB.new_attempt(), ["user_pseudo_id", "ga_session_id"]
    both = [read_state(spark, root, day_from, day_to, k)[0].withColumn("kind", F.lit(k)) for k in (FIRST, LAST)]
    DB.store(both[0].unionByName(both[1]), root, "touches", attempt, ["kind"], spread, files_per_day)
    DB.store(read_state(spark, root, day_from, day_to)[1], root, "conversions", attempt, [], spread, files_per_day)
    DB.publish(spark, root, attempt, DB.days_between(day_from, day_to))


def touches_from_state(
    spark: SparkSession,
    root: str,
    phone_map: DataFrame,
    window: A.LoadWindow,
    kind: str = FIRST,
    conversion_event: str = A.TEST_DRIVE_CONVERSION,
    leads: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(touches, converting sessions of registered users) of the window's days, as the
    choices of ``attribution`` take them. ``leads`` cuts the phone map to their phones."""
    days = window.event_days()
    if days is None:
        raise ValueError("window has no lower bound")
    rows, conversions = read_state(spark, root, *days, kind)
    mapped = A.mapped_phones(phone_map, leads)
    touches = rows.join(mapped, "user_pseudo_id").select("user_pseudo_id", "phone_no", "log_time", "ga_session_id", *A.UTM_COLS)
    of_event = conversions.where(F.col("event_name") == conversion_event)
    conv = of_event.join(phone_map.select("user_pseudo_id"), "user_pseudo_id", "left_semi").select("ga_session_id").distinct()
    return touches, conv


def attribute_from_state(inp: A.AttributionInputs, root: str, window: A.LoadWindow, method: str = "first_paid_touch", exclude: bool = True) -> DataFrame:
    """``attribution.attribute`` for the methods 'first_paid_touch' and 'best_per_session',
    with the state in place of the events."""
    spark = inp.leads.sparkSession
    leads = A.load_leads(inp.leads, window)
    if exclude and inp.sink is not None:
        leads = A.exclude_loaded(leads, inp.sink, window)
    if method == "first_paid_touch":
        chosen = A.first_paid_touch(*touches_from_state(spark, root, inp.phone_map, window, FIRST, leads=leads))
    elif method == "best_per_session":
        chosen = A.best_source_per_session(*_swap(touches_from_state(spark, root, inp.phone_map, window, LAST, leads=leads)))
    else:
        raise ValueError(f"method {method!r} has no state")
    return A.attribute_leads(leads, chosen)


def _swap(pair: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, bool, DataFrame]:
    return pair[0], True, pair[1]


def last_touch_from_state(leads: DataFrame, phone_map: DataFrame, root: str, window: A.LoadWindow, conversion_event: str = A.BROCHURE_CONVERSION) -> DataFrame:
    """Per lead the latest of its first paid touches (``attribution.last_touch_per_lead``)."""
    touches, conv = touches_from_state(leads.sparkSession, root, phone_map, window, FIRST, conversion_event, leads)
    columns = [c for c in A.LEAD_COLS if c in leads.columns and c != "dealer_name"]
    latest = A.latest_touch_per_phone(A.first_paid_touch_converted(touches, conv))
    mapped = A.attribute_leads(leads, latest, columns, extra_cols=["log_time"])
    return A.last_touch_per_lead(mapped)
