"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through ``touchpoint.sources.fixtures``) in
full; time ranges and campaign names below are operator parameters, not samples.
The matching DuckDB SQL lives in ``touchpoint.plans.oracle`` under the same key.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpoint.functions import (
    channel_grouping,
    classify_click_url,
    event_param,
    extract_utm,
    normalize_mapped_phone,
)
from touchpoint.operators import attribution as A
from touchpoint.operators import audience as AU
from touchpoint.operators import incremental as I
from touchpoint.operators import ledger as LD
from touchpoint.operators import quality as Q
from touchpoint.operators import relational as R
from touchpoint.operators import reports as RP
from touchpoint.operators import touch_state as TS
from touchpoint.operators import user_sketches as US
from touchpoint.session import shared_folder
from touchpoint.sources import fixtures as FX
from touchpoint.sources import registry as RG
from touchpoint.sources import schemas as S
from touchpoint.sources import tables as TB

# ---- operator parameters used by the registered queries
AS_OF = dt.date(2024, 1, 31)
LOOKBACK_DAYS = 18
SHORT_LOOKBACK_DAYS = 17
BROCHURE_LOOKBACK_DAYS = 1000
JOURNEY_STORY = FX.MAIN_STORY
JOURNEY_START = dt.datetime(2024, 1, 10)
JOURNEY_AS_OF = dt.datetime(2024, 1, 11, 9, 30)
AUD_START, AUD_END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12)
ANY_START, ANY_END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 8)
INACTIVE_START, INACTIVE_END = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 9)
ACTIVITY_DAY = dt.date(2024, 1, 22)
EVENT_LOG_RANGES = [("2024", "20240101"), ("2023", "20230301")]
FIRST_USER_PREFIXES = ["202401", "202312"]
PAGE_CLASS_PREFIX = "202401"
STATION_BOUND = 1000.05
ADS_START, ADS_END = dt.date(1996, 8, 1), dt.date(1996, 8, 7)
LEAD_CAMPAIGN = "camp_1"
LEAD_START, LEAD_END = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
FRESH_AS_OF = dt.date(2001, 8, 2)
STALE_AS_OF = dt.date(2030, 1, 1)
FRESH_DAYS = 3
SAMPLE_N = 100
JOIN_BUCKETS = 16
SNAPSHOT_DAYS = [dt.date(2023, 11, 27), dt.date(2023, 11, 29), dt.date(2023, 12, 2)]
SNAPSHOT_AS_OF = dt.date(2023, 11, 30)

Query = Callable[[SparkSession, str], DataFrame]


def _inputs(spark, d, leads=None) -> A.AttributionInputs:
    lead_df = leads if leads is not None else FX.test_drive_leads(spark, d)
    return A.AttributionInputs(
        leads=lead_df,
        events=FX.ga_events(spark, d),
        phone_map=FX.phone_map(spark, d),
        sink=FX.matched_sink(spark, d),
    )


BROCHURE_LEAD_COLS = [c for c in A.LEAD_COLS if c != "dealer_name"]


def _window():
    return A.lookback_window(AS_OF, LOOKBACK_DAYS)


def _registered(spark, d, conversion=A.TEST_DRIVE_CONVERSION):
    days = _window().event_days()
    return A.registered_events(
        FX.ga_events(spark, d), FX.phone_map(spark, d), *days, conversion_event=conversion
    )


def _ga_utm(spark, d, strict=True, conversion=A.TEST_DRIVE_CONVERSION):
    return A.flag_conversion_sessions(_registered(spark, d, conversion), strict_utm=strict)


def _touches(spark, d, days=LOOKBACK_DAYS, conversion=A.TEST_DRIVE_CONVERSION, strict=True):
    inp = A.AttributionInputs(None, FX.ga_events(spark, d), FX.phone_map(spark, d))
    return A._touches(inp, A.lookback_window(AS_OF, days), conversion, strict)


def _brochure_touches(spark, d, leads=None):
    inp = A.AttributionInputs(None, FX.ga_events(spark, d), FX.phone_map(spark, d))
    return A._touches(inp, A.lookback_window(AS_OF, BROCHURE_LOOKBACK_DAYS), A.BROCHURE_CONVERSION,
                      False, leads=leads)


def _journey(spark, d):
    return AU.journey_clicks_linked(FX.clicks(spark, d), FX.user_links(spark, d),
                                    FX.sign_ins(spark, d), JOURNEY_STORY, JOURNEY_START,
                                    JOURNEY_AS_OF)


# ------------------------------------------------------------ column functions
def q_normalize_phone(spark, d):
    f = A.flatten_leads(FX.test_drive_leads(spark, d))
    return f.select("fullname", "phone_raw", "phone")


def q_normalize_mapped_phone(spark, d):
    return FX.phone_map(spark, d).select(
        "user_pseudo_id", "phone_no", normalize_mapped_phone("phone_no").alias("phone_clean")
    )


def q_extract_utm_pages(spark, d):
    p = FX.read(spark, d, "pages")
    return p.select("page_id", *extract_utm("url", strict=False))


def q_extract_utm_events(spark, d):
    e = FX.ga_events(spark, d)
    url = event_param("page_location")
    return e.select("user_pseudo_id", "event_timestamp", *extract_utm(url, strict=True))


def q_event_params(spark, d):
    e = FX.ga_events(spark, d)
    return e.select(
        "user_pseudo_id", "event_timestamp",
        event_param("page_location").alias("page_location"),
        event_param("ga_session_id", "int").alias("ga_session_id"),
        event_param("medium").alias("medium_param"),
    )


def q_classify_click_url(spark, d):
    c = FX.clicks(spark, d)
    return c.select("event_id", "click_url", classify_click_url("click_url").alias("tracking_type"))


def q_channel_grouping(spark, d):
    e = FX.ga_events(spark, d)
    m = e.select(F.col("traffic_source.medium").alias("medium")).distinct()
    return m.select("medium", channel_grouping("medium").alias("default_channel_grouping"))


# ----------------------------------------------------------- relational helpers
def q_load_leads(spark, d):
    return A.load_leads(FX.test_drive_leads(spark, d), _window())


def q_dedupe_leads(spark, d):
    """One row per brochure submission, with the raw phone beside the cleaned one."""
    cols = [*BROCHURE_LEAD_COLS, "phone_raw"]
    return A.load_leads(FX.brochure_leads(spark, d), _window(), A.BROCHURE_DEDUPE_KEYS, out_cols=cols)


def q_with_total_count(spark, d):
    o = FX.offer_leads(spark, d)
    return R.with_total_count(
        o.select("description", "car_name", "created_at",
                 F.col("customer.fullname").alias("fullname")),
        "data",
    )


def q_exclude_loaded(spark, d):
    leads = A.load_leads(FX.test_drive_leads(spark, d), _window())
    return A.exclude_loaded(leads, FX.matched_sink(spark, d), _window())


def q_last_touch_per_lead(spark, d):
    w = A.lookback_window(AS_OF, BROCHURE_LOOKBACK_DAYS)
    cols = [c for c in A.LEAD_COLS if c != "dealer_name"]
    leads = A.load_leads(FX.brochure_leads(spark, d), w, A.BROCHURE_DEDUPE_KEYS, out_cols=cols)
    # only the phones of these leads reach the result
    touches = A.first_paid_touch_converted(*_brochure_touches(spark, d, leads))
    mapped = A.attribute_leads(leads, A.latest_touch_per_phone(touches), cols, extra_cols=["log_time"])
    return A.last_touch_per_lead(mapped)


# ------------------------------------------------------------------ attribution
def q_lookback_window(spark, d):
    return A.window_summary(FX.test_drive_leads(spark, d), _window())


def q_watermark_window(spark, d):
    return A.watermark_window(FX.matched_sink(spark, d), AS_OF)


def q_registered_events(spark, d):
    return _registered(spark, d)


def q_registered_events_bucketed(spark, d):
    """Events and phone map bucketed by user: the join of every later day needs no exchange."""
    run = uuid.uuid4().hex
    root = f"{shared_folder(spark)}/bucketed-{run}"
    events = TB.save_bucketed(TB.flatten_events(FX.ga_events(spark, d)), f"web_events_{run}", f"{root}/events", "user_pseudo_id", JOIN_BUCKETS)
    phones = TB.save_bucketed(FX.phone_map(spark, d), f"phone_map_{run}", f"{root}/phones", "user_pseudo_id", JOIN_BUCKETS)
    return A.registered_events(events, phones, *_window().event_days())


def q_conversion_sessions_join(spark, d):
    days = _window().event_days()
    return A.conversion_sessions_join(FX.ga_events(spark, d), _registered(spark, d), *days)


def q_flag_conversion_sessions(spark, d):
    return _ga_utm(spark, d)


def q_best_source_per_phone(spark, d):
    return A.best_source_per_phone(_touches(spark, d)[0])


def q_best_source_per_session(spark, d):
    touches, conv = _touches(spark, d)
    return A.best_source_per_session(touches, True, conv)


def q_best_source_per_session_all(spark, d):
    touches, conv = _touches(spark, d)
    return A.best_source_per_session(touches, False, conv)


def q_first_paid_touch(spark, d):
    return A.first_paid_touch(*_touches(spark, d))


def q_first_paid_touch_converted(spark, d):
    return A.first_paid_touch_converted(*_brochure_touches(spark, d))


def q_frequent_phones(spark, d):
    """The phones that are spread over tasks when leads meet their campaigns."""
    leads = A.load_leads(FX.test_drive_leads(spark, d), A.lookback_window(AS_OF, BROCHURE_LOOKBACK_DAYS))
    hot = R.frequent_values(leads, "phone")
    return leads.where(F.array_contains(hot, F.col("phone"))).groupBy("phone").agg(F.count(F.lit(1)).alias("leads"))


def q_attribute_leads(spark, d):
    leads = A.load_leads(FX.test_drive_leads(spark, d), _window())
    return A.attribute_leads(leads, A.first_paid_touch(*_touches(spark, d)))


def q_attribute_test_drive(spark, d):
    return A.attribute_test_drive(_inputs(spark, d), AS_OF, LOOKBACK_DAYS, "first_paid_touch")


def q_attribute_by_session(spark, d):
    return A.attribute_test_drive(_inputs(spark, d), AS_OF, LOOKBACK_DAYS, "best_per_session")


def q_attribute_by_phone(spark, d):
    inp = _inputs(spark, d)
    window = A.watermark_bounds(inp.sink, AS_OF)
    return A.attribute(inp, window, "best_per_phone", exclude=False)


def q_attribute_since_watermark(spark, d):
    inp = _inputs(spark, d)
    window = A.watermark_bounds(inp.sink, AS_OF)
    return A.attribute(inp, window, "best_per_session_all", conversions="join", exclude=False)


def q_attribute_own_sessions(spark, d):
    """Sessions named by user and id: users who share an id do not share a conversion."""
    window = A.lookback_window(AS_OF, SHORT_LOOKBACK_DAYS)
    return A.attribute(_inputs(spark, d), window, "best_per_session", exclude=False,
                       session_keys=("user_pseudo_id", "ga_session_id"))


def q_sink_after_load(spark, d):
    """The sink with the rows that a load appends to it."""
    rows = A.attribute_test_drive(_inputs(spark, d), AS_OF, LOOKBACK_DAYS)
    return I.sink_rows(FX.matched_sink(spark, d)).unionByName(I.sink_rows(rows))


def _loads(spark, d) -> str:
    """A sink folder after: its first rows, a load, the same load again, a load that died
    before its publish."""
    root = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    held = FX.matched_sink(spark, d)
    LD.append_once(held, root, "start")
    inp = _inputs(spark, d)
    for _ in range(2):
        LD.load_once(spark, inp, root, AS_OF, LOOKBACK_DAYS)
    LD.stage(held, root, "died")
    return root


def q_sink_published(spark, d):
    return LD.read_published(spark, _loads(spark, d))


def q_load_ledger(spark, d):
    seen = LD.read_ledger(spark, _loads(spark, d))
    return seen.select("batch_id", "window_from", "window_to", "n_rows", "first_day", "last_day",
                       F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f["n_rows"]).alias("rows_in_files"))


def q_ledger_watermark(spark, d):
    """The newest lead of the sink, by its ledger."""
    return LD.watermark(spark, _loads(spark, d))


def q_attribute_by_names(spark, d):
    """The flagship run from table names alone, each checked against its declared columns."""
    names = RG.Registry()
    for name, df in [("leads", FX.test_drive_leads(spark, d)), ("web_events", FX.ga_events(spark, d)),
                     ("phone_map", FX.phone_map(spark, d)), ("matched_leads", FX.matched_sink(spark, d))]:
        names.bind(name, df)
    inp = A.AttributionInputs(*(names[n] for n in ("leads", "web_events", "phone_map", "matched_leads")))
    return A.attribute_test_drive(inp, AS_OF, LOOKBACK_DAYS)


def q_attribute_by_session_unchecked(spark, d):
    return A.attribute_test_drive(_inputs(spark, d), AS_OF, SHORT_LOOKBACK_DAYS,
                                  "best_per_session", exclude=False)


def q_attribute_joined_conversions(spark, d):
    return A.attribute_test_drive(_inputs(spark, d), AS_OF, SHORT_LOOKBACK_DAYS,
                                  "best_per_session", exclude=False, conversions="join")


def q_attribute_brochure(spark, d):
    inp = _inputs(spark, d, FX.brochure_leads(spark, d))
    inp = A.AttributionInputs(inp.leads, inp.events, inp.phone_map,
                              FX.matched_sink(spark, d, "brochure"))
    return A.attribute_brochure(inp, AS_OF, BROCHURE_LOOKBACK_DAYS)


def _touch_state(spark, d, window, kind) -> str:
    """A state of the window's days: all but the last in one build, then the last day alone."""
    root = f"{shared_folder(spark)}/touch-state-{uuid.uuid4().hex}"
    events, (first, last) = FX.ga_events(spark, d), window.event_days()
    before = A.lookback_window(window.upper.date() - dt.timedelta(days=1), 1).event_days()[1]
    TS.update(events, root, first, before, [kind])
    TS.update(events, root, last, kinds=[kind])
    return root


def q_touch_state_first_paid(spark, d):
    root = _touch_state(spark, d, _window(), TS.FIRST)
    return A.first_paid_touch(*TS.touches_from_state(spark, root, FX.phone_map(spark, d), _window()))


def q_touch_state_by_session(spark, d):
    root = _touch_state(spark, d, _window(), TS.LAST)
    return TS.attribute_from_state(_inputs(spark, d), root, _window(), "best_per_session")


def q_touch_state_last_touch(spark, d):
    w = A.lookback_window(AS_OF, BROCHURE_LOOKBACK_DAYS)
    leads = A.load_leads(FX.brochure_leads(spark, d), w, A.BROCHURE_DEDUPE_KEYS, out_cols=BROCHURE_LEAD_COLS)
    return TS.last_touch_from_state(leads, FX.phone_map(spark, d), _touch_state(spark, d, w, TS.FIRST), w)


# --------------------------------------------------------------------- audience
def q_identity_bridge(spark, d):
    return AU.identity_bridge(FX.user_links(spark, d), FX.sign_ins(spark, d))


def q_journey_clicks(spark, d):
    return _journey(spark, d)


def q_single_touch_users(spark, d):
    known = _journey(spark, d).where(F.col("customer_id").isNotNull())
    return AU.single_touch_users(known, FX.active_customers(spark, d))


def q_single_touch_users_unknown(spark, d):
    """With clicks of unknown customers, which empty every segment but that of their type."""
    return AU.single_touch_users(_journey(spark, d), FX.active_customers(spark, d))


def q_snapshot_as_of(spark, d):
    """The customers of the newest snapshot not after a day; each day lacks other customers."""
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    for k, day in enumerate(SNAPSHOT_DAYS):
        TB.write_snapshot(FX.customers(spark, d).where(F.col("customer_id").cast("long") % 5 != k), path, day)
    return TB.read_snapshot_as_of(spark, path, S.CUSTOMERS, SNAPSHOT_AS_OF)


def _activity_keys(spark, d, kind):
    return FX.activity(spark, d, kind).select("customer_id").distinct()


def q_not_in_subquery(spark, d):
    """Customers without a sign-up, by ``NOT IN``."""
    known = _activity_keys(spark, d, "signup").where(F.col("customer_id").isNotNull())
    return R.not_in(FX.customers(spark, d), "customer_id", known, "customer_id").select("customer_id")


def q_not_in_with_null(spark, d):
    """No row: the subquery holds a NULL."""
    null = spark.createDataFrame([(None,)], "customer_id string")
    return R.not_in(FX.customers(spark, d), "customer_id", _activity_keys(spark, d, "signup").unionByName(null), "customer_id").select("customer_id")


def q_not_in_empty(spark, d):
    """Every row, NULL keys too: the subquery is empty."""
    outer = FX.customers(spark, d).select(F.when(F.col("customer_id").cast("long") % 4 > 0, F.col("customer_id")).alias("customer_id"))
    none = _activity_keys(spark, d, "signup").where(F.col("customer_id") == "no such customer")
    return R.not_in(outer, "customer_id", none, "customer_id")


def q_multi_touch_users(spark, d):
    return AU.multi_touch_users(_journey(spark, d), FX.active_customers(spark, d))


def q_segment_counts(spark, d):
    return AU.segment_counts(_journey(spark, d), FX.active_customers(spark, d))


def q_source_audience(spark, d):
    return AU.source_audience(FX.activity(spark, d, "signup"), AUD_START, AUD_END, "[]")


def q_activity_on_day(spark, d):
    return AU.activity_on_day(FX.activity(spark, d, "signup"), ACTIVITY_DAY)


def q_signed_in_emails(spark, d):
    return AU.signed_in_emails(FX.activity(spark, d, "signup"), FX.activity(spark, d, "view"),
                               FX.customers(spark, d), AUD_START, AUD_END)


def q_emails_of_active(spark, d):
    return AU.emails_of_active(FX.customers(spark, d), FX.activity(spark, d, "signup"),
                               AUD_START, AUD_END)


def _three(spark, d):
    return [FX.activity(spark, d, "signup"), FX.activity(spark, d, "view"),
            FX.activity(spark, d, "click")]


def q_active_any_left_key(spark, d):
    si, pv, ce = _three(spark, d)
    return AU.active_any_left_key(pv, si, ce, FX.customers(spark, d), ANY_START, ANY_END)


def q_active_any(spark, d):
    return AU.active_any(_three(spark, d), FX.customers(spark, d), ANY_START, ANY_END)


def q_inactive_emails(spark, d):
    return AU.inactive_emails(_three(spark, d), FX.customers(spark, d), INACTIVE_START,
                              INACTIVE_END)


# ---------------------------------------------------------------------- reports
def q_page_users_by_instant(spark, d):
    return RP.page_users_by_instant(FX.ga_events(spark, d))


def q_page_users_by_day(spark, d):
    return RP.page_users_by_day(FX.ga_events(spark, d))


def q_monthly_users(spark, d):
    return RP.monthly_users(FX.ga_events_by_month(spark, d))


def q_channel_users(spark, d):
    return RP.channel_users(FX.ga_events(spark, d))


def _user_sketches(spark, events) -> DataFrame:
    """Sketches of all days of ``events``, stored by two builds and read back."""
    root = f"{shared_folder(spark)}/user-sketches-{uuid.uuid4().hex}"
    days = events.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last")).first()
    if days["first"] is None:
        return US.day_sketches(events, "0", "0")
    US.update(events, root, days["first"], days["last"])
    US.update(events, root, days["last"])  # the newest day once more, as a daily run does
    return US.read_sketches(spark, root, days["first"], days["last"])


def q_monthly_users_sketched(spark, d):
    events = FX.ga_events_by_month(spark, d)
    return US.within_bound(RP.monthly_users(events), US.monthly_users(_user_sketches(spark, events)), ["month_year"])


def q_channel_users_sketched(spark, d):
    events = FX.ga_events(spark, d)
    keys = ["event_date", "event_name", "default_channel_grouping"]
    return US.within_bound(RP.channel_users(events), US.channel_users(_user_sketches(spark, events)), keys)


def q_event_log_between(spark, d):
    return RP.event_log_between(FX.ga_events(spark, d), EVENT_LOG_RANGES)


def q_traffic_sources(spark, d):
    return RP.traffic_sources(FX.ga_events(spark, d))


def q_ad_date_parts(spark, d):
    return RP.ad_date_parts(FX.ads(spark, d), FX.daily_frequency(spark, d))


def q_city_orders(spark, d):
    return RP.city_orders(FX.shop_customers(spark, d), FX.shop_orders(spark, d))


def q_first_user_per_page(spark, d):
    return RP.first_user_per_page(FX.ga_events(spark, d), FIRST_USER_PREFIXES)


def q_daily_page_class(spark, d):
    return RP.daily_page_class(FX.ga_events(spark, d), PAGE_CLASS_PREFIX)


def q_value_at_max_key_below(spark, d):
    return RP.value_at_max_key_below(FX.stations(spark, d), "LAT_N", "LONG_W", STATION_BOUND)


def q_campaign_totals_on_rows(spark, d):
    return RP.campaign_totals_on_rows(FX.ads(spark, d), ADS_START, ADS_END)


def q_lead_counts(spark, d):
    tables = [(name, FX.matched_by_type(spark, d, et)) for name, et in FX.LEAD_TYPE_EVENTS]
    return RP.lead_counts(tables, LEAD_CAMPAIGN, LEAD_START, LEAD_END)


def q_find_customers(spark, d):
    return RP.find_customers(FX.customers(spark, d), "%%")


def q_campaign_list(spark, d):
    return RP.campaign_list(FX.campaigns(spark, d))


def q_pageview_users(spark, d):
    return RP.pageview_users(FX.pageviews(spark, d))


def q_sample_users(spark, d):
    return RP.sample_users(FX.customers(spark, d), SAMPLE_N)


# ---------------------------------------------------------------------- quality
def q_freshness_check(spark, d):
    return Q.freshness_check(FX.offer_leads(spark, d), FRESH_AS_OF, FRESH_DAYS)


def q_freshness_check_stale(spark, d):
    return Q.freshness_check(FX.offer_leads(spark, d), STALE_AS_OF, FRESH_DAYS)


def q_freshness_status(spark, d):
    return Q.freshness_status(q_freshness_check(spark, d))


def q_freshness_assertion(spark, d):
    """No rows, as the table is fresh; on a stale table the query fails."""
    return Q.freshness_assertion(q_freshness_check(spark, d)).select(
        F.col("failed").cast("string").alias("failed")
    )


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}

# operators whose results are exercised most in bench.py
HEADLINE = [
    "attribute_test_drive",
    "attribute_brochure",
    "attribute_by_session",
    "channel_users",
    "segment_counts",
    "page_users_by_day",
    "traffic_sources",
    "event_log_between",
    "active_any",
    "freshness_check",
]
