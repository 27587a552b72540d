"""Lead -> campaign attribution.

Flow (each step is a function; the ``attribute_*`` functions compose them):

1. ``lookback_window`` / ``watermark_window``: which leads to (re)load;
2. ``load_leads``: flatten the lead form, local time, phone cleanup, de-duplicate;
3. ``registered_events``: web events of users with a known phone, partition-pruned
   to the window, with page URL, session id and a conversion flag per event;
4. ``flag_conversion_sessions`` (or ``conversion_sessions_join``) + ``extract_utm``
   -> ``ga_utm`` rows;
5. one of ``best_source_per_phone``, ``best_source_per_session``,
   ``first_paid_touch``, ``first_paid_touch_converted`` -> phone -> UTM rows;
6. ``attribute_leads``: leads LEFT JOIN phone UTM rows (``last_touch_per_lead``
   for the brochure flow);
7. ``exclude_loaded``: drop leads already in the sink. The test reads lead columns
   only, so ``attribute`` applies it right after step 2, before the joins.

Scale notes: the events scan is pruned by ``event_date`` and projected to five
columns; top-1 choices are map-side-combined aggregates, re-joins use the full
composite key (hot sessions/phones spread over many tasks), NULL join keys bypass
shuffles, and the phone->UTM side is de-duplicated before it meets the leads.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchpoint.functions.params import param_column
from touchpoint.functions.phone import normalize_mapped_phone, normalize_phone
from touchpoint.functions.timeutil import (
    LEAD_TZ,
    day_text,
    local_to_utc,
    micros_to_ntz,
    ntz_lit,
    to_local,
)
from touchpoint.functions.utm import display_source, extract_utm, is_non_paid
from touchpoint.operators.relational import (
    exclude_existing,
    frequent_values,
    left_join_split_nulls,
    top1_per_group,
)

# Names of the conversion events of the two lead types.
TEST_DRIVE_CONVERSION = "dax_testdrive_beforedealer_conversion"
BROCHURE_CONVERSION = "dax_downloadbrochure_conversion"
CONV, NO_CONV = "conv", "null"  # the flag is text; 'null' is not NULL
SESSION_KEYS = ("ga_session_id",)

LEAD_COLS = [
    "fullname", "city", "phone", "email", "estimated_buying_time",
    "created_at", "car_name", "dealer_name",
]
UTM_COLS = ["utm_source", "utm_medium", "utm_campaign", "utm_content"]
# keys of one submission (raw values, before cleanup)
TEST_DRIVE_DEDUPE_KEYS = [
    "dealer_name", "car_name", "fullname", "phone_raw", "email", "city",
    "estimated_buying_time", "created_raw",
]
BROCHURE_DEDUPE_KEYS = [k for k in TEST_DRIVE_DEDUPE_KEYS if k != "dealer_name"]
# columns that identify an already-loaded lead
LOADED_KEYS = ["fullname", "city", "phone", "email", "created_at", "car_name"]
LAST_TOUCH_KEYS = [
    "fullname", "city", "phone", "email", "estimated_buying_time", "created_at", "car_name",
]


# ------------------------------------------------------------------ windows
@dataclass(frozen=True)
class LoadWindow:
    """Leads with ``lower < created_local < upper`` (local wall clock, exclusive)."""

    lower: dt.datetime | None
    upper: dt.datetime

    def event_days(self) -> tuple[str, str] | None:
        """Event shard range: the lower bound's day .. the day before ``upper``."""
        if self.lower is None:
            return None
        first = (self.lower + dt.timedelta(microseconds=1)).date()
        last = (self.upper - dt.timedelta(microseconds=1)).date()
        return day_text(first), day_text(last)


def lookback_window(as_of: dt.date, days: int) -> LoadWindow:
    """(as_of - days) 00:00:00 (exclusive, i.e. from .000001) .. as_of 00:00 (exclusive)."""
    start = dt.datetime.combine(as_of - dt.timedelta(days=days), dt.time(0))
    return LoadWindow(lower=start, upper=dt.datetime.combine(as_of, dt.time(0)))


def window_summary(leads: DataFrame, window: LoadWindow, tz: str = LEAD_TZ) -> DataFrame:
    """One row: the window's bounds (local), its event-day range and how many lead
    submissions (before de-duplication) it selects."""
    days = window.event_days() or (None, None)
    n = filter_window(leads, window, tz).agg(F.count(F.lit(1)).alias("leads_in_window"))
    return n.select(
        F.timestamp_add("MICROSECOND", F.lit(1), ntz_lit(window.lower)).alias("lower_bound"),
        ntz_lit(window.upper).alias("upper_bound"),
        F.lit(days[0]).alias("event_day_from"),
        F.lit(days[1]).alias("event_day_to"),
        "leads_in_window",
    )


def watermark_bounds(sink: DataFrame, as_of: dt.date,
                     bootstrap: dt.datetime | None = None,
                     horizon_days: int = 31) -> LoadWindow:
    """Lower bound = newest ``created_at`` already in the sink (exclusive).

    Runs one tiny aggregate job and returns literals, so the bound is pushed to
    the lead scan. When the sink is partitioned by ``created_date`` the newest row
    is looked for in the last ``horizon_days`` day folders first (pruned scan) and
    in the whole sink only if those are empty, which gives the same maximum.
    Empty sink: ``bootstrap`` (None loads nothing, like the reference's NULL bound).
    """
    latest = None
    if "created_date" in sink.columns:
        recent = sink.where(F.col("created_date") >= F.lit(as_of - dt.timedelta(days=horizon_days)))
        latest = recent.agg(F.max("created_at")).first()[0]
    if latest is None:
        latest = sink.agg(F.max("created_at")).first()[0]
    return LoadWindow(lower=latest or bootstrap, upper=dt.datetime.combine(as_of, dt.time(0)))


def watermark_window(sink: DataFrame, as_of: dt.date, tz: str = LEAD_TZ) -> DataFrame:
    """The watermark window as a one-row DataFrame (lazy; for reporting)."""
    m = sink.agg(F.max("created_at").alias("m"))
    return m.select(
        F.timestamp_add("MICROSECOND", F.lit(1), F.col("m")).alias("lower_bound"),
        ntz_lit(as_of).alias("upper_bound"),
    )


# -------------------------------------------------------------------- leads
RAW_LEAD_COLS = [
    "fullname", "city", "phone_raw", "email", "estimated_buying_time", "created_raw",
    "car_name", "dealer_name",
]


def raw_leads(leads: DataFrame) -> DataFrame:
    """Lead struct -> flat raw columns (nested-pruned to the used leaves)."""
    return leads.select(
        F.col("customer.fullname").alias("fullname"),
        F.col("customer.city").alias("city"),
        F.col("customer.phone").alias("phone_raw"),
        F.col("customer.email").alias("email"),
        F.col("customer.estimated_buying_time").alias("estimated_buying_time"),
        F.col("created_at").alias("created_raw"),
        F.col("car_name"),
        F.col("dealer_name"),
    )


def clean_leads(raw: DataFrame, tz: str = LEAD_TZ, phone_mode: str = "reference") -> DataFrame:
    """Raw lead columns -> cleaned ``phone`` and local ``created_at`` (raw kept)."""
    return raw.select(
        "*",
        normalize_phone("phone_raw", phone_mode).alias("phone"),
        to_local("created_raw", tz).alias("created_at"),
    )


def flatten_leads(leads: DataFrame, tz: str = LEAD_TZ, phone_mode: str = "reference") -> DataFrame:
    """Lead struct -> flat columns; local ``created_at``; cleaned ``phone``.
    Keeps the raw phone and raw time for de-duplication."""
    return clean_leads(raw_leads(leads), tz, phone_mode)


def filter_window(leads: DataFrame, window: LoadWindow, tz: str = LEAD_TZ,
                  col: str = "created_at") -> DataFrame:
    """Window filter on the raw UTC column with UTC literals (pushed to the scan)."""
    if window.lower is None:
        return leads.where(F.lit(False))
    lo = local_to_utc(window.lower, tz)
    hi = local_to_utc(window.upper, tz)
    out = leads.where((F.col(col) > ntz_lit(lo)) & (F.col(col) < ntz_lit(hi)))
    if "created_date" in leads.columns:  # lead table partitioned by UTC day
        out = out.where(F.col("created_date").between(F.lit(lo.date()), F.lit(hi.date())))
    return out


def load_leads(
    leads: DataFrame,
    window: LoadWindow,
    dedupe_keys: Sequence[str] = TEST_DRIVE_DEDUPE_KEYS,
    tz: str = LEAD_TZ,
    phone_mode: str = "reference",
    out_cols: Sequence[str] = LEAD_COLS,
) -> DataFrame:
    """Leads created in the window, flattened, phone-cleaned, one row per submission.

    The de-duplication is a plain DISTINCT on the raw key columns (hash aggregate
    with map-side combine); phone cleanup and the zone shift run afterwards, once
    per distinct submission. Every output column must be a function of the keys; others
    raise ``ValueError``."""
    source = {"phone": "phone_raw", "created_at": "created_raw"}
    unknown = [c for c in out_cols if source.get(c, c) not in dedupe_keys]
    if unknown:
        raise ValueError(f"columns {unknown} are not settled by the keys {list(dedupe_keys)}")
    raw = raw_leads(filter_window(leads, window, tz))
    distinct = raw.select(*dedupe_keys).distinct()
    for c in ("phone_raw", "created_raw"):
        if c not in dedupe_keys:
            distinct = distinct.withColumn(c, F.lit(None).cast(raw.schema[c].dataType))
    return clean_leads(distinct, tz, phone_mode).select(*out_cols)


# ------------------------------------------------------------------- events
def registered_events(
    events: DataFrame,
    phone_map: DataFrame,
    day_from: str,
    day_to: str,
    conversion_event: str = TEST_DRIVE_CONVERSION,
    tz: str = LEAD_TZ,
) -> DataFrame:
    """Events (shards ``day_from..day_to``) of users present in the phone map.

    Columns: user_pseudo_id, phone_no, log_time (local), page_location,
    ga_session_id, conv_flag ('conv' when the event is the conversion).
    """
    ev = events.where(F.col("event_date").between(day_from, day_to)).select(
        "user_pseudo_id",
        "event_timestamp",
        "event_name",
        param_column(events, "page_location").alias("page_location"),
        param_column(events, "ga_session_id", "int").alias("ga_session_id"),
    )
    pm = phone_map.select("user_pseudo_id", "phone_no")
    return ev.join(pm, "user_pseudo_id", "inner").select(
        "user_pseudo_id",
        normalize_mapped_phone("phone_no").alias("phone_no"),
        to_local(micros_to_ntz("event_timestamp"), tz).alias("log_time"),
        "page_location",
        "ga_session_id",
        F.when(F.col("event_name") == conversion_event, F.lit(CONV))
        .otherwise(F.lit(NO_CONV))
        .alias("conv_flag"),
    )


def conversion_sessions(registered: DataFrame, session_keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Distinct non-NULL sessions holding a conversion event. ``session_keys``: the
    session id alone, or with ``user_pseudo_id``, so that users who share an id do not
    share the conversion."""
    return _present(registered.where(F.col("conv_flag") == CONV), session_keys).distinct()


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).dropna()


def flag_conversion_sessions(registered: DataFrame, strict_utm: bool = True,
                             session_keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """``ga_utm``: every registered event with its *session's* conversion flag
    ('conv' if any event of the session converts, else 'null') and its UTM fields."""
    conv = conversion_sessions(registered, session_keys)
    right = [f"_s_{k}" for k in session_keys]
    joined = left_join_split_nulls(
        registered.drop("conv_flag"),
        conv.select(*[F.col(k).alias(r) for k, r in zip(session_keys, right)], F.lit(True).alias("_conv")),
        list(session_keys), right,
    )
    return joined.select(
        "user_pseudo_id",
        "phone_no",
        "log_time",
        "ga_session_id",
        F.when(F.col("_conv"), F.lit(CONV)).otherwise(F.lit(NO_CONV)).alias("conv_flag"),
        *extract_utm("page_location", strict=strict_utm),
    )


def conversion_sessions_join(
    events: DataFrame,
    registered: DataFrame,
    day_from: str,
    day_to: str,
    conversion_event: str = TEST_DRIVE_CONVERSION,
) -> DataFrame:
    """Registered events right-joined to one ('conv') row per conversion event of
    *any* user in the shard range: a session with k conversions repeats each of
    its events k times; events of other sessions get a NULL flag.

    Conversions are counted per session first (map-side), and the repetition is
    rebuilt with ``array_repeat``, so only one row per session is shuffled. The result
    has conversions x events rows per session, as specified; the end-to-end flows
    need the session only once and do not call this.
    """
    counts = (
        events.where(F.col("event_date").between(day_from, day_to))
        .where(F.col("event_name") == conversion_event)
        .select(param_column(events, "ga_session_id", "int").alias("_sid"))
        .where(F.col("_sid").isNotNull())
        .groupBy("_sid")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    joined = left_join_split_nulls(
        registered.drop("conv_flag"), counts, ["ga_session_id"], ["_sid"]
    )
    return joined.select(
        "user_pseudo_id", "phone_no", "log_time", "ga_session_id", "page_location",
        F.explode_outer(F.array_repeat(F.lit(CONV), F.col("_n").cast("int"))).alias(
            "conv_flag"
        ),
    )


# ------------------------------------------------------- phone -> UTM choice
def _converting(touches: DataFrame, conv: DataFrame | None,
                session_keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """The touches of converting sessions (given, or read off ``conv_flag``). The ranking
    groups contain the session, so cutting before ranking gives the same choice and
    ranks only these sessions. The list of converting sessions is not repeated. A hash of
    the session is a further join key: rows dealt by it are dealt anew for the ranking (by
    session and phone), which lets Spark's adaptive skew join split a hot session."""
    sessions = conversion_sessions(touches, session_keys) if conv is None else _present(conv, session_keys).distinct()
    mixed = F.xxhash64(*session_keys)
    return touches.withColumn("_mix", mixed).join(sessions.withColumn("_mix", mixed), [*session_keys, "_mix"], "left_semi").drop("_mix")


def _best_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows that tie for the first place in their group. ``rank() = 1`` is cut to the
    best rows of each input partition before the shuffle, so a hot group is not moved
    whole."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def best_source_per_phone(touches: DataFrame) -> DataFrame:
    """Per phone the alphabetically last source ('!Non-Paid' loses to any paid
    source), left-joined to every distinct (medium, campaign, content) seen with
    that phone and source."""
    best = touches.groupBy("phone_no").agg(F.max("utm_source").alias("utm_source"))
    rows = (
        touches.where(F.col("phone_no").isNotNull() & F.col("utm_source").isNotNull())
        .select("phone_no", *UTM_COLS)
        .distinct()
    )
    keys = ["phone_no", "utm_source"]
    return left_join_split_nulls(best, rows, keys).select("phone_no", *UTM_COLS)


def best_source_per_session(
    touches: DataFrame, require_conversion: bool = True, conv: DataFrame | None = None,
    session_keys: Sequence[str] = SESSION_KEYS,
) -> DataFrame:
    """Per (session, phone) the alphabetically last source with the distinct UTM rows of
    that session, phone and source; with ``require_conversion`` only converting sessions
    are kept, and one shuffle of their distinct rows serves the choice and its UTM rows.
    Otherwise sessions and phones without an id appear too, with no UTM row of their own."""
    keys = ["ga_session_id", "phone_no"]
    if require_conversion:
        rows = _converting(touches, conv, session_keys).where(F.col("phone_no").isNotNull())
        last = _best_rows(rows.select(*keys, *UTM_COLS).distinct(), keys, [F.desc_nulls_last("utm_source")])
        return last.where(F.col("utm_source").isNotNull()).select("phone_no", *UTM_COLS)
    best = touches.groupBy(*keys).agg(F.max("utm_source").alias("utm_source"))
    rows = (
        touches.where(
            F.col("ga_session_id").isNotNull()
            & F.col("phone_no").isNotNull()
            & F.col("utm_source").isNotNull()
        )
        .select(*keys, *UTM_COLS)
        .distinct()
    )
    return left_join_split_nulls(best, rows, keys + ["utm_source"]).select("phone_no", *UTM_COLS)


def first_paid_touch(touches: DataFrame, conv: DataFrame | None = None,
                     session_keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Per converting (session, phone): the earliest paid event, else the earliest event
    (ties: lowest source), with every distinct (medium, campaign, content) of the same
    session, phone, source and log_time.

    One shuffle of the converting sessions' distinct rows serves the ranking and the UTM
    rows: all rows that tie on (paid, log_time, source) are returned."""
    keys = ["ga_session_id", "phone_no"]
    rows = _converting(touches, conv, session_keys).where(
        F.col("ga_session_id").isNotNull() & F.col("phone_no").isNotNull()
    )
    rows = rows.select(*keys, "log_time", *UTM_COLS).distinct()
    best = _best_rows(rows, keys, [is_non_paid("utm_source"), F.col("log_time"), F.col("utm_source")])
    return best.where(F.col("log_time").isNotNull() & F.col("utm_source").isNotNull()).select("phone_no", *UTM_COLS)


def first_paid_touch_converted(touches: DataFrame, conv: DataFrame | None = None,
                               session_keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Converting sessions first, then per (session, phone) the earliest paid
    event (else earliest; ties broken by the UTM fields). Medium, campaign and
    content are kept only when session, phone, log_time and all four UTM fields
    are non-NULL (the reference re-joins on all of them with ``=``).
    Columns: phone_no, utm_*, log_time."""
    keys = ["ga_session_id", "phone_no"]
    converting = _converting(touches, conv, session_keys)
    best = top1_per_group(
        converting.withColumn("_np", is_non_paid("utm_source")),
        keys,
        order=["_np", "log_time", *UTM_COLS],
    )
    complete = F.col("ga_session_id").isNotNull() & F.col("phone_no").isNotNull() & F.col(
        "log_time"
    ).isNotNull()
    for c in UTM_COLS:
        complete = complete & F.col(c).isNotNull()
    keep = lambda c: F.when(complete, F.col(c)).alias(c)
    return best.select(
        "phone_no", "utm_source", keep("utm_medium"), keep("utm_campaign"),
        keep("utm_content"), "log_time",
    )


# ------------------------------------------------------------ leads x UTM
def attribute_leads(
    leads: DataFrame,
    phone_utm: DataFrame,
    lead_cols: Sequence[str] = LEAD_COLS,
    extra_cols: Sequence[str] = (),
    distinct: bool = True,
) -> DataFrame:
    """Leads LEFT JOIN phone->UTM rows on the cleaned phone; '!Non-Paid' is shown
    as 'Non-Paid'. With ``distinct`` both sides are de-duplicated before the join, as
    shown, so the joined rows are distinct without being gathered again. Leads with a NULL
    phone, or with a phone that holds over 1 % of the leads (the cleanup shortens every
    number that starts 620 to one), are spread over many tasks."""
    right = phone_utm.select(
        "phone_no", display_source("utm_source").alias("utm_source"), *UTM_COLS[1:], *extra_cols
    )
    left = leads.select(*lead_cols)
    hot = frequent_values(leads, "phone")
    if distinct:
        left = left.distinct()
        right = right.where(F.col("phone_no").isNotNull()).distinct()
    joined = left_join_split_nulls(left, right, ["phone"], ["phone_no"], hot)
    return joined.select(*lead_cols, *UTM_COLS, *extra_cols)


def exclude_loaded(
    new: DataFrame,
    sink: DataFrame,
    window: LoadWindow | None = None,
    keys: Sequence[str] = LOADED_KEYS,
    null_safe: bool = False,
) -> DataFrame:
    """Drop leads already present in the sink (all ``keys`` equal, plain ``=``:
    a lead with a NULL key is never "loaded", so it is appended again on every run
    whose window holds it; ``null_safe`` lets NULL equal NULL). The sink's ``created_at`` is local
    time; only the window's slice of the sink is read."""
    loaded = sink
    if window is not None and window.lower is not None:
        loaded = sink.where(
            (F.col("created_at") > ntz_lit(window.lower))
            & (F.col("created_at") < ntz_lit(window.upper))
        )
        if "created_date" in sink.columns:  # sink partitioned by local day: prune folders
            loaded = loaded.where(
                F.col("created_date").between(F.lit(window.lower.date()), F.lit(window.upper.date()))
            )
    return exclude_existing(new, loaded, keys, null_safe)


def latest_touch_per_phone(phone_utm: DataFrame) -> DataFrame:
    """Per phone the touch that ``last_touch_per_lead`` would choose among all its touches.
    A lead meets the touches of its phone only, so this one stands for them: a phone with
    many leads and many touches (shortened numbers) makes no product of both."""
    shown = phone_utm.where(F.col("phone_no").isNotNull()).select(
        "phone_no", "log_time", display_source("utm_source").alias("utm_source"), *UTM_COLS[1:]
    )
    return top1_per_group(shown, ["phone_no"], order=["log_time", *UTM_COLS], descending=True)


def last_touch_per_lead(mapped: DataFrame, keys: Sequence[str] = LAST_TOUCH_KEYS) -> DataFrame:
    """Per lead the row with the latest ``log_time`` (NULL last; ties: highest
    UTM values). Drops ``log_time``."""
    top = top1_per_group(mapped, list(keys), order=["log_time", *UTM_COLS], descending=True)
    return top.select(*keys, *UTM_COLS)


# ------------------------------------------------------------ end to end
@dataclass(frozen=True)
class AttributionInputs:
    leads: DataFrame
    events: DataFrame
    phone_map: DataFrame
    sink: DataFrame | None = None


def touches_of(registered: DataFrame, strict_utm: bool = True) -> DataFrame:
    """Registered events reduced to what touch selection needs, with UTM fields."""
    return registered.select(
        "user_pseudo_id", "phone_no", "log_time", "ga_session_id",
        *extract_utm("page_location", strict=strict_utm),
    )


def all_conversion_sessions(events: DataFrame, day_from: str, day_to: str, conversion_event: str,
                            session_keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Sessions with a conversion event of *any* user in the shard range."""
    conv = (
        events.where(F.col("event_date").between(day_from, day_to))
        .where(F.col("event_name") == conversion_event)
        .select("user_pseudo_id",
                param_column(events, "ga_session_id", "int").alias("ga_session_id"))
    )
    return _present(conv, session_keys).distinct()


def registered_conversion_sessions(events: DataFrame, phone_map: DataFrame, day_from: str,
                                   day_to: str, conversion_event: str,
                                   session_keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Distinct sessions holding a conversion event of a registered user (one
    in the phone map). The event-name filter runs at the scan, so this pass reads
    only the conversion events."""
    conv = (
        events.where(F.col("event_date").between(day_from, day_to))
        .where(F.col("event_name") == conversion_event)
        .select("user_pseudo_id",
                param_column(events, "ga_session_id", "int").alias("ga_session_id"))
        .where(F.col("ga_session_id").isNotNull())
    )
    users = phone_map.select("user_pseudo_id")
    return _present(conv.join(users, "user_pseudo_id", "left_semi"), session_keys).distinct()


def phones_of_leads(phone_map: DataFrame, leads: DataFrame | None) -> DataFrame:
    """The phone map, cut to the phones of ``leads`` if given (through a small, usually
    broadcast, phone list)."""
    if leads is None:
        return phone_map
    wanted = leads.select(F.col("phone").alias("_lead_phone")).where(
        F.col("_lead_phone").isNotNull()
    ).distinct()
    return (
        phone_map.withColumn("_mapped", normalize_mapped_phone("phone_no"))
        .join(wanted, F.col("_mapped") == F.col("_lead_phone"), "left_semi")
        .drop("_mapped")
    )


def mapped_phones(phone_map: DataFrame, leads: DataFrame | None = None) -> DataFrame:
    """user_pseudo_id and the cleaned phone_no, of the leads' phones if given."""
    cut = phones_of_leads(phone_map, leads)
    return cut.select("user_pseudo_id", normalize_mapped_phone("phone_no").alias("phone_no"))


def _touches(inp: AttributionInputs, window: LoadWindow, conversion_event: str,
             strict_utm: bool, conversions: str = "in",
             leads: DataFrame | None = None,
             session_keys: Sequence[str] = SESSION_KEYS) -> tuple[DataFrame, DataFrame]:
    """(touches, converting sessions) of the window's event shards.

    With ``leads``, the phone map is first cut to the phones of those leads: touch
    choices are per (session, phone) and only lead phones reach the result, so the
    events of every other user are dropped right after the scan (a semi-join
    filter through a small, usually broadcast, phone list). The conversion test
    still sees every registered user. The 'join' mode's fan-out repeats rows only,
    which no touch choice depends on."""
    days = window.event_days()
    if days is None:
        raise ValueError("window has no lower bound")
    reg = registered_events(inp.events, phones_of_leads(inp.phone_map, leads), *days, conversion_event=conversion_event)
    if conversions == "in":
        conv = registered_conversion_sessions(inp.events, inp.phone_map, *days, conversion_event,
                                              session_keys)
    elif conversions == "join":
        conv = all_conversion_sessions(inp.events, *days, conversion_event, session_keys)
    else:
        raise ValueError(f"unknown conversions mode {conversions!r}")
    return touches_of(reg, strict_utm), conv


def attribute(
    inp: AttributionInputs,
    window: LoadWindow,
    method: str = "first_paid_touch",
    conversions: str = "in",
    conversion_event: str = TEST_DRIVE_CONVERSION,
    exclude: bool = True,
    session_keys: Sequence[str] = SESSION_KEYS,
    event_window: LoadWindow | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Test-drive leads of ``window`` with their campaign.

    ``method``: 'first_paid_touch' (first paid click of a converting session),
    'best_per_session' (alphabetically last source of a converting session),
    'best_per_session_all' (same, any session) or 'best_per_phone' (alphabetically
    last source of the phone; no DISTINCT and no sink check).
    ``conversions``: 'in' flags every event of a session holding a conversion;
    'join' right-joins one row per conversion event of any user (fan-out).
    ``exclude``: drop leads already in ``inp.sink`` (``null_safe``: see
    ``exclude_loaded``). ``session_keys``: what names a session when conversions are
    looked up. ``event_window``: the days whose events count, if not the leads' own.
    """
    if window.lower is None:
        return load_leads(inp.leads, window).select(*LEAD_COLS, *[
            F.lit(None).cast("string").alias(c) for c in UTM_COLS
        ])
    leads = load_leads(inp.leads, window)
    if exclude and inp.sink is not None and method != "best_per_phone":
        # The "already loaded" test reads lead columns only and the UTM join keeps
        # every lead, so excluding first gives the same rows; in a daily run with
        # a long lookback most of the window is already loaded, so the join and
        # the DISTINCT only see the new leads.
        leads = exclude_loaded(leads, inp.sink, window, null_safe=null_safe)
    touches, conv = _touches(inp, event_window or window, conversion_event, True, conversions,
                             leads, session_keys)
    if method == "first_paid_touch":
        phone_utm = first_paid_touch(touches, conv, session_keys)
    elif method == "best_per_session":
        phone_utm = best_source_per_session(touches, True, conv, session_keys)
    elif method == "best_per_session_all":
        phone_utm = best_source_per_session(touches, False, conv)
    elif method == "best_per_phone":
        return attribute_leads(leads, best_source_per_phone(touches), distinct=False)
    else:
        raise ValueError(f"unknown method {method!r}")
    return attribute_leads(leads, phone_utm)


def attribute_test_drive(
    inp: AttributionInputs,
    as_of: dt.date,
    lookback_days: int = 18,
    method: str = "first_paid_touch",
    conversion_event: str = TEST_DRIVE_CONVERSION,
    exclude: bool = True,
    conversions: str = "in",
) -> DataFrame:
    """``attribute`` over the lookback window ending at ``as_of``."""
    return attribute(inp, lookback_window(as_of, lookback_days), method, conversions,
                     conversion_event, exclude)


def attribute_brochure(
    inp: AttributionInputs,
    as_of: dt.date,
    lookback_days: int = 1000,
    conversion_event: str = BROCHURE_CONVERSION,
    exclude: bool = True,
) -> DataFrame:
    """Brochure leads: first paid touch of converting sessions (safe UTM cut),
    latest such touch per lead, minus already-loaded leads."""
    window = lookback_window(as_of, lookback_days)
    lead_cols = [c for c in LEAD_COLS if c != "dealer_name"]
    leads = load_leads(inp.leads, window, BROCHURE_DEDUPE_KEYS, out_cols=lead_cols)
    if exclude and inp.sink is not None:
        # lead-column test; commutes with the UTM join and the per-lead last touch
        leads = exclude_loaded(leads, inp.sink, window)
    touches, conv = _touches(inp, window, conversion_event, False, "in", leads)
    phone_utm = first_paid_touch_converted(touches, conv)
    mapped = attribute_leads(leads, latest_touch_per_phone(phone_utm), lead_cols, extra_cols=["log_time"])
    return last_touch_per_lead(mapped)
