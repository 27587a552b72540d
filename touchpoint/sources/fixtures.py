"""Logical tables derived from the driver's test tables.

The test data is a TPC-H-like star schema plus an ``events`` table; the operators
need web-analytics events, lead forms, a phone mapping, journey clicks and ad
tables. Each adapter below is a projection (or a small aggregation) of one driver
table, so every query's work grows with the driver tables. The same derivations
are written in DuckDB SQL in ``touchpoint.plans.oracle`` (keep both in sync).

Variety needed by the operators (non-paid pages, partial UTM strings, every phone
shape, duplicated leads, NULL cities/phones, ...) is spread over the rows by
modular rules on the ids; no row is dropped.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpoint.functions.timeutil import ntz_lit, ntz_to_micros

# Fixture rule lists (our own test-data design, shared with the DuckDB views).
TRAFFIC_MEDIUMS = [
    "(none)", "organic", "referral", "cpc", "ppc", "cpm",
    "email", "social", "video", None, "xyz", "cpc email",
]
CARS = ["serena", "terra", "magnite", "kicks", "livina"]
UTM_SOURCES = ["google", "facebook", "tiktok", "Instagram"]
UTM_MEDIUMS = ["cpc", "social", "email"]
EVENT_NAMES = {
    "purchase": "dax_testdrive_beforedealer_conversion",
    "click": "dax_downloadbrochure_conversion",
    "signup": "Registration Success",
    "view": "page_view",
}
PHONE_PREFIXES = [  # by c_custkey % 8, put before the 7-digit key
    "0812", "62812", "+62812", "812", "0812-", "0812 ", "+620812", "O812",
]
CLICK_URLS = {
    "click": "https://www.example.com/sg-en?next=/account/forget-password",
    "view": "https://www.example.com/sg-en",
    "purchase": "https://www.example.com/sg-en/contactus/contact-us",
    "signup": "https://www.example.com/sg-en/account/sign-in",
}
SOCIAL_URL = "https://social.example.com/p/"
MAIN_STORY = "7000001"
OTHER_STORY = "9000001"
LEAD_EPOCH = dt.datetime(2024, 1, 1)
LEAD_SPREAD_MIN = 30 * 24 * 60
LEAD_TYPE_EVENTS = [  # matched-lead tables for lead counts, by event_type
    ("test drive", "purchase"),
    ("download brochure", "click"),
    ("offer", "signup"),
    ("quote", "view"),
]


def _pick(idx: Column, values: list) -> Column:
    """``values[idx]`` (idx in range): one array-literal lookup."""
    return F.element_at(F.lit(list(values)).cast("array<string>"), (idx + 1).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


_CACHES: list[dict] = []


def forget_plans() -> None:
    """Drop the kept plans and file listings (before a timed run, or after a folder changed)."""
    for cache in _CACHES:
        cache.clear()


def _memo(fn):
    """Adapters are immutable lazy plans: build each once per (session, folder, args)
    instead of re-listing files and re-analysing the projection on every call."""
    cache: dict = {}
    _CACHES.append(cache)

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args):
        key = (id(spark), sf_dir, args)
        hit = cache.get(key)
        if hit is None or hit[0] is not spark:
            hit = cache[key] = (spark, fn(spark, sf_dir, *args))
        return hit[1]

    return wrapper


@_memo
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------- events
def page_url(event_id: Column, user_id: Column, event_type: Column) -> Column:
    """Page URL: no UTM for errors and every 7th event, else source only (id % 5 = 0),
    source + medium (id % 5 = 1) or all four fields plus a click id."""
    base = F.concat(
        F.lit("https://www.example.com/"), _pick(user_id % 5, CARS), F.lit("/"), event_type
    )
    med = F.concat(F.lit("&utm_medium="), _pick(user_id % 3, UTM_MEDIUMS))
    tail = (
        F.when(event_id % 5 == 0, F.lit(""))
        .when(event_id % 5 == 1, med)
        .otherwise(
            F.concat(
                med, F.lit("&utm_campaign=camp_"), _s(user_id % 6),
                F.lit("&utm_content=ad"), _s(event_id % 3), F.lit("&gclid="), _s(event_id),
            )
        )
    )
    query = (
        F.when(event_type == "error", F.lit(""))
        .when(event_id % 7 == 0, F.lit("?ref=home"))
        .otherwise(F.concat(F.lit("?utm_source="), _pick(event_id % 4, UTM_SOURCES), tail))
    )
    return F.concat(base, query)


def visitor_id(event_id: Column, user_id: Column) -> Column:
    """Web user id; every 23rd event comes from a visitor who never left a phone."""
    return F.when(event_id % 23 == 0, F.concat(F.lit("anon-"), _s(user_id))).otherwise(_s(user_id))


@_memo
def ga_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-analytics export shape (``touchpoint.sources.schemas.EVENTS``)."""
    e = read(spark, sf_dir, "events")
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    name = None
    for raw, ga in EVENT_NAMES.items():
        name = F.when(et == raw, ga) if name is None else name.when(et == raw, ga)
    name = name.otherwise(et)
    med = _pick(uid % 3, UTM_MEDIUMS)
    # user 8k + 1 shares the sessions of user 8k; every 19th event has no session
    owner = F.when(uid % 8 == 1, uid - 1).otherwise(uid)
    session = F.when(eid % 19 != 0, owner * 100000 + F.unix_date(F.to_date("ts")))
    none_s = F.lit(None).cast("string")
    none_l = F.lit(None).cast("bigint")

    def param(key: str, s: Column, i: Column) -> Column:
        return F.struct(
            F.lit(key).alias("key"),
            F.struct(s.alias("string_value"), i.alias("int_value")).alias("value"),
        )

    return e.select(
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
        ntz_to_micros("ts").alias("event_timestamp"),
        name.alias("event_name"),
        visitor_id(eid, uid).alias("user_pseudo_id"),
        F.array(
            param("page_location", page_url(eid, uid, et), none_l),
            param("ga_session_id", none_s, session.cast("bigint")),
            param("medium", F.when(eid % 3 == 0, none_s).otherwise(med), none_l),
        ).alias("event_params"),
        F.struct(
            F.struct(
                F.when(uid % 2 == 0, F.lit("www.example.com"))
                .otherwise(F.lit("m.example.com"))
                .alias("hostname")
            ).alias("web_info")
        ).alias("device"),
        F.struct(_pick(eid % 12, TRAFFIC_MEDIUMS).alias("medium")).alias("traffic_source"),
        F.struct(
            F.when(eid % 4 == 0, med).alias("manual_medium"),
            F.when(eid % 5 >= 2, F.concat(F.lit("g"), _s(eid))).alias("gclid"),
            F.when(eid % 10 == 3, F.concat(F.lit("d"), _s(uid))).alias("dclid"),
            none_s.alias("srsltid"),
        ).alias("collected_traffic_source"),
    )


@_memo
def ga_events_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their instants spread over six months by user id."""
    month = F.lit(30 * 24 * 3600 * 1_000_000).cast("bigint")
    shift = (F.regexp_extract("user_pseudo_id", r"\d+", 0).cast("bigint") % 6) * month
    return ga_events(spark, sf_dir).withColumn("event_timestamp", F.col("event_timestamp") + shift)


@_memo
def phone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user -> phone mapping table of the registered customers (the web user id of
    customer k is k); keys ``% 10 == 7`` have no known phone, keys ``% 9 == 0`` carry the
    country code twice, keys ``% 31 == 4`` were cut to the bare country code, and keys
    ``% 7 == 2`` have a second phone."""
    uid = F.col("c_custkey")
    digits = F.lpad(_s(uid), 7, "0")
    phone = (
        F.when(uid % 10 == 7, F.lit(None).cast("string"))
        .when(uid % 31 == 4, F.lit("62"))
        .when(uid % 9 == 0, F.concat(F.lit("6262812"), digits))
        .otherwise(F.concat(F.lit("62812"), digits))
    )
    second = F.concat(F.lit("62813"), digits)
    phones = F.when(uid % 7 == 2, F.array(phone, second)).otherwise(F.array(phone))
    return read(spark, sf_dir, "customer").select(
        _s(uid).alias("user_pseudo_id"), F.explode(phones).alias("phone_no")
    )


# ---------------------------------------------------------------------- leads
def _lead_phone(key: Column) -> Column:
    digits = F.lpad(_s(key), 7, "0")
    shaped = F.concat(_pick(key % 8, PHONE_PREFIXES), digits)
    return F.when(key % 29 == 28, F.lit(None).cast("string")).otherwise(shaped)


def _lead_customer(key: Column, name: Column, nation: Column, segment: Column,
                   referer: Column | None = None) -> Column:
    return F.struct(
        name.alias("fullname"),
        F.when(key % 13 == 5, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("City "), _s(nation)))
        .alias("city"),
        _lead_phone(key).alias("phone"),
        F.concat(F.lower(F.regexp_replace(name, "#", ".")), F.lit("@mail.example.com")).alias(
            "email"
        ),
        segment.alias("estimated_buying_time"),
        (referer if referer is not None else F.lit(None).cast("string")).alias("referer"),
    )


def _lead_time(key: Column, mult: int) -> Column:
    return F.timestamp_add("MINUTE", (key * mult) % LEAD_SPREAD_MIN, ntz_lit(LEAD_EPOCH))


@_memo
def test_drive_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead forms: every customer submits twice; the second copy names another
    dealer for ``c_custkey % 3 == 0`` and is an exact duplicate otherwise."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")

    def copy(second: bool) -> DataFrame:
        dealer = F.concat(F.lit("Dealer "), _s(F.col("c_nationkey") % 5))
        if second:
            dealer = F.when(k % 3 == 0, F.lit("Dealer X")).otherwise(dealer)
        return c.select(
            _lead_customer(k, F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias(
                "customer"
            ),
            _lead_time(k, 7919).alias("created_at"),
            _pick(k % 4, ["Serena", "Terra", "Magnite", "Kicks"]).alias("car_name"),
            dealer.alias("dealer_name"),
            F.lit(None).cast("string").alias("description"),
        )

    return copy(False).unionByName(copy(True))


@_memo
def brochure_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brochure downloads: every customer twice (exact duplicates), no dealer."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    one = c.select(
        _lead_customer(k, F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias(
            "customer"
        ),
        _lead_time(k, 104729).alias("created_at"),
        _pick(k % 4, ["Serena", "Terra", "Magnite", "Kicks"]).alias("car_name"),
        F.lit(None).cast("string").alias("dealer_name"),
        F.lit(None).cast("string").alias("description"),
    )
    return one.unionByName(one)


@_memo
def offer_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offer requests, one per order."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    name = F.concat(F.lit("Customer#"), F.lpad(_s(k), 9, "0"))
    return o.select(
        _lead_customer(
            k, name, k % 25, F.col("o_orderpriority"),
            _pick(F.col("o_orderkey") % 3, ["google", "facebook", None]),
        ).alias("customer"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        _pick(F.col("o_orderkey") % 4, ["Serena", "Terra", "Magnite", "Kicks"]).alias("car_name"),
        F.lit(None).cast("string").alias("dealer_name"),
        F.concat(F.col("o_orderstatus"), F.lit("-"), F.col("o_orderpriority")).alias(
            "description"
        ),
    )


LOADED_CUTOFF_LOCAL = dt.datetime(2024, 1, 20)


@_memo
def matched_sink(spark: SparkSession, sf_dir: str, kind: str = "test_drive") -> DataFrame:
    """Already-loaded attributed leads (the sink): the normalized leads of ``kind``
    ('test_drive' or 'brochure') created before the cutoff (local time),
    attributed 'Non-Paid'."""
    from touchpoint.operators.attribution import flatten_leads

    src = test_drive_leads(spark, sf_dir) if kind == "test_drive" else brochure_leads(spark, sf_dir)
    flat = flatten_leads(src)
    return (
        flat.where(F.col("created_at") < ntz_lit(LOADED_CUTOFF_LOCAL))
        .select(
            "fullname", "city", "phone", "email", "estimated_buying_time",
            "created_at", "car_name", "dealer_name",
            F.lit("Non-Paid").alias("utm_source"),
            F.lit(None).cast("string").alias("utm_medium"),
            F.lit(None).cast("string").alias("utm_campaign"),
            F.lit(None).cast("string").alias("utm_content"),
        )
        .distinct()
    )


@_memo
def matched_by_type(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """A matched-lead table per lead type (for lead counts), from one event type."""
    e = read(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    return e.select(
        _s(F.col("user_id")).alias("fullname"),
        F.concat(F.lit("camp_"), _s(F.col("user_id") % 6)).alias("utm_campaign"),
        F.col("ts").alias("created_at"),
    )


# ------------------------------------------------------------ journey / audience
@_memo
def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    url = F.concat(F.lit(SOCIAL_URL), _s(eid))
    for raw, u in CLICK_URLS.items():
        url = F.when(et == raw, F.lit(u)).otherwise(url)
    # users whose link has no customer open the home page only
    url = F.when(F.col("user_id") % 12 == 5, F.lit(CLICK_URLS["view"])).otherwise(url)
    return e.select(
        _s(F.col("user_id")).alias("user_id"),
        _s(eid).alias("event_id"),
        F.when(eid % 10 == 0, F.lit(OTHER_STORY)).otherwise(F.lit(MAIN_STORY)).alias("story_id"),
        url.alias("click_url"),
        F.col("ts").alias("tracked_time"),
    )


@_memo
def user_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge table user -> customer; ``c_custkey % 5 == 0`` has no user id, and
    ``c_custkey % 12 == 5`` no customer id."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(_s(k)).alias("user_id"),
        F.when(k % 12 == 5, F.lit(None).cast("string")).otherwise(_s(k)).alias("customer_id"),
    )


@_memo
def sign_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    u = F.col("user_id")
    return e.select(_s(u).alias("user_id"), F.when(u % 12 != 5, _s(u)).alias("customer_id"))


@_memo
def active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, story) of customers with an open order; story = order priority."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O")
    return o.select(
        _s(F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderpriority").alias("story_id"),
    )


@_memo
def activity(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Customer activity source (sign-in / product view / click) from events."""
    e = read(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    return e.select(
        _s(F.col("user_id")).alias("customer_id"), F.col("ts").alias("tracked_time")
    )


@_memo
def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        _s(k).alias("customer_id"),
        F.when(k % 11 == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), _s(k), F.lit("@mail.example.com")))
        .alias("email"),
        F.col("c_name").alias("name"),
    )


# ------------------------------------------------------------------- ad tables
@_memo
def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("campaign_name"),
        (F.col("o_orderkey") % 50).alias("impressions"),
        (F.col("o_custkey") % 7).alias("clicks_all"),
    )


@_memo
def daily_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("frequency")
    )


@_memo
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_retailprice").alias("LAT_N"),
        (F.col("p_retailprice") / 7.0).alias("LONG_W"),
    )


@_memo
def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("destination_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("label_ids"),
        F.col("o_custkey").alias("c_user_id"),
        F.concat(F.lit("channel_"), _s(F.col("o_orderkey") % 3)).alias("channel_name"),
        F.to_date("o_orderdate").alias("end_date"),
        F.col("o_orderdate").alias("ctime"),
    )


@_memo
def shop_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit("City "), _s(F.col("c_nationkey"))).alias("city"),
    )


@_memo
def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("order_id"),
        F.floor("o_totalprice").cast("bigint").alias("order"),
    )


@_memo
def pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return e.select(_s(F.col("user_id")).alias("user_id"))

