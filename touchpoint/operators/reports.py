"""Insight reports over web events, ad tables and small dimension tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpoint.functions.classify import channel_grouping, page_class
from touchpoint.functions.params import leaf_column, param_column, values_column
from touchpoint.functions.timeutil import LEAD_TZ, micros_to_ntz, ntz_lit, to_local
from touchpoint.operators.relational import HOT_SPREAD, union_all

PAGE_KEY = "page_location"


def _distinct_users(approx_rsd: float | None):
    """Exact distinct users (two-phase aggregation), or a HyperLogLog++ estimate
    with relative standard deviation ``approx_rsd`` (one phase, fixed-size state)."""
    if approx_rsd is None:
        return F.count_distinct("user_pseudo_id")
    return F.approx_count_distinct("user_pseudo_id", rsd=approx_rsd)


def _page_views(events: DataFrame, *extra) -> DataFrame:
    """One row per page_location entry of an event (an event may have several)."""
    return events.select(
        *extra,
        F.col("user_pseudo_id"),
        leaf_column(events, "hostname").alias("hostname"),
        F.explode(values_column(events, PAGE_KEY)).alias(PAGE_KEY),
    )


def page_users_by_instant(events: DataFrame) -> DataFrame:
    """Distinct users per (event instant, host, page) *and user* (so 1 per row,
    0 for a NULL user)."""
    rows = _page_views(events, micros_to_ntz("event_timestamp").alias("timestamp_date"))
    # COUNT(DISTINCT user) grouped by user is 1 for a non-NULL user, else 0: no
    # distinct aggregation (and no extra shuffle) is needed.
    return rows.groupBy("timestamp_date", "user_pseudo_id", "hostname", PAGE_KEY).agg(
        F.max(F.col("user_pseudo_id").isNotNull().cast("long")).alias("total_users")
    ).select("timestamp_date", "hostname", PAGE_KEY, "total_users")


def page_users_by_day(events: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Distinct users per (day as dd-MM-yyyy, host, page)."""
    day = F.date_format(F.to_date("event_date", "yyyyMMdd"), "dd-MM-yyyy")
    rows = _page_views(events, day.alias("timestamp_date"))
    return rows.groupBy("timestamp_date", "hostname", PAGE_KEY).agg(
        _distinct_users(approx_rsd).alias("total_users")
    )


def monthly_users(events: DataFrame, tz: str = LEAD_TZ,
                  approx_rsd: float | None = None) -> DataFrame:
    """Distinct users per local month (yyyy-MM), newest first."""
    month = F.date_format(to_local(micros_to_ntz("event_timestamp"), tz), "yyyy-MM")
    return (
        events.groupBy(month.alias("month_year"))
        .agg(_distinct_users(approx_rsd).alias("total_users"))
        .orderBy(F.desc("month_year"))
    )


def channel_users(events: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Per day, event and default channel: users, paid / non-paid users and the
    same for registrations. Users are counted distinct per traffic medium and then
    summed per channel (a user seen with two media of one channel counts twice)."""
    per_medium = events.groupBy(
        "event_date", "event_name", leaf_column(events, "traffic_medium").alias("medium")
    ).agg(_distinct_users(approx_rsd).alias("users"))
    return channel_sums(per_medium)


def channel_sums(per_medium: DataFrame) -> DataFrame:
    """The sums of ``channel_users`` from event_date, event_name, medium and users."""
    ch = per_medium.select(
        "event_date", "event_name",
        channel_grouping("medium").alias("default_channel_grouping"), "users",
    )
    g = F.col("default_channel_grouping")
    paid = g.like("%Paid%")
    non_paid = ~g.like("%Paid Search/Display%")
    reg = F.col("event_name").like("%Registration Success%")
    u = F.col("users")

    def s(cond):
        return F.sum(F.when(cond, u).otherwise(F.lit(0)))

    return ch.groupBy("event_date", "event_name", "default_channel_grouping").agg(
        F.sum(u).alias("total_users"),
        s(paid).alias("paid_users"),
        s(non_paid).alias("non_paid_users"),
        s(paid & reg).alias("membership_paid_users"),
        s(non_paid & reg).alias("membership_non_paid_users"),
    )


def event_log_between(events: DataFrame, ranges: Sequence[tuple[str, str]],
                      sort: bool = True, sort_by: str = "text") -> DataFrame:
    """(day dd-MM-yyyy, user, event) of every event in the shard ``prefix`` with
    ``event_date >= lower``, for each (prefix, lower); one scan with a disjunctive
    partition filter instead of one scan per year. The filter reads the raw
    ``event_date`` before it is re-formatted under the same name. ``sort_by='text'``
    orders by the day-first text (as specified), ``'date'`` by the calendar day."""
    cond = None
    for prefix, lower in ranges:
        c = F.col("event_date").startswith(prefix) & (F.col("event_date") >= lower)
        cond = c if cond is None else (cond | c)
    day = F.to_date("event_date", "yyyyMMdd")
    out = events.where(cond).select(
        F.date_format(day, "dd-MM-yyyy").alias("event_date"),
        "user_pseudo_id",
        "event_name",
        day.alias("_day"),
    )
    if sort:
        # trailing keys only refine the order; they let the range partitioner split
        # a day that holds a large share of the events over several tasks
        first = "_day" if sort_by == "date" else "event_date"
        out = out.orderBy(first, "user_pseudo_id", "event_name")
    return out.drop("_day")


def traffic_sources(events: DataFrame) -> DataFrame:
    return events.select(
        leaf_column(events, "traffic_medium").alias("traffic_source_medium"),
        param_column(events, "medium").alias("medium_param"),
        leaf_column(events, "manual_medium").alias("manual_medium"),
        *[leaf_column(events, k).alias(f"source_{k}") for k in ("gclid", "dclid", "srsltid")],
    ).distinct()


def ad_date_parts(ads: DataFrame, frequency: DataFrame, min_impressions: int = 20) -> DataFrame:
    """Date parts of every (date, campaign, frequency). The result depends on the distinct
    campaigns and frequencies of a day alone, so both sides are reduced to these before
    they meet; a day's rows are never multiplied."""
    days = ads.where(F.col("impressions") >= min_impressions).select("date", "campaign_name").distinct()
    return days.join(frequency.select("date", "frequency").distinct(), "date").select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        "campaign_name",
        "frequency",
        F.col("date").alias("min_date"),
    )


def city_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Total ordered quantity and first (lowest) order id per city. Orders are
    reduced to one row per customer before the join (sum and min compose)."""
    per_customer = orders.groupBy("customer_id").agg(
        F.sum("order").alias("_total"), F.min("order_id").alias("_first")
    )
    j = customers.select("customer_id", "city").join(per_customer, "customer_id", "inner")
    return j.groupBy("city").agg(
        F.sum("_total").alias("total_order"), F.min("_first").alias("first_order")
    )


def first_user_per_page(events: DataFrame, prefixes: Sequence[str], sort: bool = True) -> DataFrame:
    """Smallest user id per (day yyyy-MM-dd, event, page) for each shard prefix,
    concatenated. Disjoint prefixes share one scan and one aggregation."""

    def agg(df: DataFrame) -> DataFrame:
        return df.groupBy(
            F.date_format(F.to_date("event_date", "yyyyMMdd"), "yyyy-MM-dd").alias("event_date"),
            "event_name",
            param_column(df, PAGE_KEY).alias(PAGE_KEY),
        ).agg(F.min("user_pseudo_id").alias("user_id"))

    disjoint = all(
        not (a != b and b.startswith(a)) for a in prefixes for b in prefixes
    ) and len(set(prefixes)) == len(prefixes)
    if disjoint:
        cond = None
        for p in prefixes:
            c = F.col("event_date").startswith(p)
            cond = c if cond is None else (cond | c)
        out = agg(events.where(cond))
    else:
        out = union_all([agg(events.where(F.col("event_date").startswith(p))) for p in prefixes])
    # secondary keys split a hot user id over several range partitions
    return out.orderBy("user_id", "event_date", "event_name", PAGE_KEY) if sort else out


def daily_page_class(events: DataFrame, prefix: str) -> DataFrame:
    """Per day the highest car-type class (text order) among the pages seen."""
    pages = events.where(F.col("event_date").startswith(prefix)).select(
        F.date_format(F.to_date("event_date", "yyyyMMdd"), "yyyy-MM-dd").alias("event_date"),
        param_column(events, PAGE_KEY).alias(PAGE_KEY),
    )
    return (
        pages.groupBy("event_date")
        .agg(F.max(page_class(PAGE_KEY)).alias("type_of_car"))
        .orderBy("event_date")
    )


def value_at_max_key_below(df: DataFrame, key: str, value: str, bound: float,
                           digits: int = 4, name: str | None = None) -> DataFrame:
    """``ROUND(value, digits)`` of every row whose key is the largest key below
    ``bound`` (a scalar subquery, no self-join)."""
    top = df.where(F.col(key) < bound).select(F.max(key)).scalar()
    return df.where(F.col(key) == top).select(
        F.round(value, digits).alias(name or value.lower())
    )


def campaign_totals_on_rows(ads: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Daily ad rows of the range with the campaign's range totals attached
    (sum and non-NULL count of impressions), sorted by date and campaign.

    There are few campaigns and any of them may hold most rows, so the rows are salted
    and the totals (one row per campaign) repeated over the salts."""
    rows = ads.where(F.col("date").between(F.lit(start), F.lit(end)))
    totals = rows.groupBy("campaign_name").agg(
        F.sum("impressions").alias("sum_impressions"),
        F.count("impressions").alias("count_impressions"),
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(HOT_SPREAD - 1)))
    salt = F.pmod(F.xxhash64("date", "impressions", "clicks_all"), F.lit(HOT_SPREAD)).cast("int")
    return (
        rows.select("date", "campaign_name", "impressions", "clicks_all", salt.alias("_salt"))
        .join(totals.withColumn("_salt", salts), ["campaign_name", "_salt"], "inner")
        .select("date", "campaign_name", "impressions", "clicks_all",
                "sum_impressions", "count_impressions")
        .orderBy("date", "campaign_name", "impressions", "clicks_all")
    )


def lead_counts(tables: Sequence[tuple[str, DataFrame]], campaign: str, start: dt.date,
                end: dt.date) -> DataFrame:
    """Leads of one campaign per lead type, ``created_at BETWEEN start AND end``
    (midnight of ``end``: later times that day are out); types with no lead give 0."""
    lo = ntz_lit(dt.datetime.combine(start, dt.time(0)))
    hi = ntz_lit(dt.datetime.combine(end, dt.time(0)))
    parts = [
        t.where((F.col("utm_campaign") == campaign) & F.col("created_at").between(lo, hi))
        .agg(F.count(F.lit(1)).alias("lead_count"))
        .select(F.lit(name).alias("lead_type"), "lead_count")
        for name, t in tables
    ]
    return union_all(parts)


def find_customers(customers: DataFrame, email_pattern: str = "%%") -> DataFrame:
    return customers.where(F.col("email").like(email_pattern)).select("email", "name")


CAMPAIGN_COLS = ["destination_id", "status", "label_ids", "c_user_id", "channel_name",
                 "end_date", "ctime"]


def campaign_list(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(*CAMPAIGN_COLS)


def pageview_users(pageviews: DataFrame) -> DataFrame:
    return pageviews.select("user_id")


def sample_users(users: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` user names in name order (an order makes the sample stable)."""
    return users.select("name").orderBy("name").limit(n)
