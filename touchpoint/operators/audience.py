"""Customer identity, journey clicks, touch segments and activity audiences."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpoint.functions.classify import CLICK_TYPES, classify_click_url
from touchpoint.functions.timeutil import day_range, ntz_lit
from touchpoint.operators.relational import any_of, full_outer_coalesce, left_join_split_nulls

MULTIPLE = "Multiple Visit"  # fixed value: label of multi-touch customers


# ----------------------------------------------------------------- identity
def identity_bridge(links: DataFrame, sign_ins: DataFrame) -> DataFrame:
    """user_id -> customer_id: the link table, completed by distinct sign-ins
    (full outer join on user_id, link table values first)."""
    signed = sign_ins.select("user_id", "customer_id").distinct()
    return full_outer_coalesce(
        links.select("user_id", "customer_id"), signed, "user_id", ["user_id", "customer_id"]
    )


# ------------------------------------------------------------------ journey
def _story_clicks(clicks: DataFrame, story_id: str, start: dt.datetime,
                  as_of: dt.datetime) -> DataFrame:
    end = dt.datetime.combine(as_of.date(), dt.time(0))
    return clicks.where(
        F.col("tracked_time").between(ntz_lit(start), ntz_lit(end))
        & (F.col("story_id") == story_id)
    ).select(
        "user_id",
        "event_id",
        "story_id",
        classify_click_url("click_url").alias("tracking_type"),
        F.col("click_url").alias("location_url"),
        F.date_trunc("day", "tracked_time").cast("timestamp_ntz").alias("tracked_date"),
    )


def _with_customer(c: DataFrame, bridge: DataFrame) -> DataFrame:
    b = bridge.where(F.col("user_id").isNotNull()).select("user_id", "customer_id")
    return c.join(b, "user_id", "inner").select(
        "customer_id", "event_id", "story_id", "tracking_type", "location_url", "tracked_date"
    )


def journey_clicks(
    clicks: DataFrame,
    bridge: DataFrame,
    story_id: str,
    start: dt.datetime,
    as_of: dt.datetime,
) -> DataFrame:
    """Classified clicks of one story from ``start`` to the start of ``as_of``'s day
    (both ends included), day-truncated, with the customer id of the clicking user."""
    return _with_customer(_story_clicks(clicks, story_id, start, as_of), bridge)


def journey_clicks_linked(
    clicks: DataFrame,
    links: DataFrame,
    sign_ins: DataFrame,
    story_id: str,
    start: dt.datetime,
    as_of: dt.datetime,
) -> DataFrame:
    """``journey_clicks`` with the identity bridge built only for the users who
    clicked: the link table and the sign-ins are semi-joined with those user ids
    before the full outer join. A bridge row can only meet a click through its
    user id, so the result is the same while the outer join sees a story's users
    instead of every customer."""
    c = _story_clicks(clicks, story_id, start, as_of)
    users = c.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    bridge = identity_bridge(
        links.join(users, "user_id", "left_semi"), sign_ins.join(users, "user_id", "left_semi")
    )
    return _with_customer(c, bridge)


# ----------------------------------------------------------------- segments
def _touch_profile(journey: DataFrame, active: DataFrame, types: Sequence[str]) -> DataFrame:
    """Per active customer: which listed types were clicked, whether an unlisted
    non-NULL type was clicked. One aggregation over the journey (map-side
    combined), then a semi join with the active customers."""
    t = F.col("tracking_type")
    flags = [F.max(F.when(t == x, 1).otherwise(0)).alias(f"_has{i}") for i, x in enumerate(types)]
    other = F.max(F.when(t.isNotNull() & ~t.isin(list(types)), 1).otherwise(0)).alias("_other")
    prof = (
        journey.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(*flags, other)
    )
    act = active.select("customer_id").where(F.col("customer_id").isNotNull()).distinct()
    return prof.join(act, "customer_id", "left_semi")


def _null_customer_types(journey: DataFrame):
    """(number of distinct non-NULL types, smallest type) over clicks without a
    customer id, as one scalar subquery. A NOT IN list holding NULL rejects all."""
    j = journey.where(F.col("customer_id").isNull() & F.col("tracking_type").isNotNull())
    return j.select(
        F.struct(
            F.count_distinct("tracking_type").alias("n"), F.min("tracking_type").alias("t")
        )
    ).scalar()


def touch_segments(
    journey: DataFrame, active: DataFrame, types: Sequence[str] = CLICK_TYPES
) -> DataFrame:
    """(customer_id, tracking_type) of active customers: the one type they clicked
    when every non-NULL click is of that listed type, or 'Multiple Visit' when they
    clicked more than one listed type. Equal to the five ``NOT IN`` single-type
    segments plus the multi-visit count, including their NULL behaviour, in one pass."""
    types = list(types)
    prof = _touch_profile(journey, active, types).withColumn(
        "_nulls", _null_customer_types(journey)
    )
    n_listed = sum((F.col(f"_has{i}") for i in range(len(types))), F.lit(0))
    the_type = F.coalesce(
        *[F.when(F.col(f"_has{i}") == 1, F.lit(x)) for i, x in enumerate(types)]
    )
    n_null, t_null = F.col("_nulls.n"), F.col("_nulls.t")
    blocked = (n_null > 1) | ((n_null == 1) & (t_null != the_type))
    single = (n_listed == 1) & (F.col("_other") == 0) & ~blocked
    seg = F.when(single, the_type).when(n_listed > 1, F.lit(MULTIPLE))
    return prof.select("customer_id", seg.alias("tracking_type")).where(
        F.col("tracking_type").isNotNull()
    )


def single_touch_users(journey: DataFrame, active: DataFrame,
                       types: Sequence[str] = CLICK_TYPES) -> DataFrame:
    return touch_segments(journey, active, types).where(F.col("tracking_type") != MULTIPLE)


def multi_touch_users(journey: DataFrame, active: DataFrame,
                      types: Sequence[str] = CLICK_TYPES) -> DataFrame:
    return touch_segments(journey, active, types).where(F.col("tracking_type") == MULTIPLE)


def segment_counts(journey: DataFrame, active: DataFrame,
                   types: Sequence[str] = CLICK_TYPES) -> DataFrame:
    """Distinct active customers per segment (segments with no customer are absent)."""
    seg = touch_segments(journey, active, types)  # one row per customer already
    return seg.groupBy("tracking_type").agg(F.count(F.lit(1)).alias("total_active_user"))


# ---------------------------------------------------------------- audiences
def in_range(col: str, start: dt.datetime, end: dt.datetime, bounds: str = "[]"):
    lo, hi = ntz_lit(start), ntz_lit(end)
    c = F.col(col)
    left = c >= lo if bounds[0] == "[" else c > lo
    right = c <= hi if bounds[1] == "]" else c < hi
    return left & right


def source_audience(activity: DataFrame, start: dt.datetime, end: dt.datetime,
                    bounds: str = "[]") -> DataFrame:
    """Distinct customer ids (NULL included) active in the range."""
    return activity.where(in_range("tracked_time", start, end, bounds)).select(
        "customer_id"
    ).distinct()


def activity_on_day(activity: DataFrame, day: dt.date) -> DataFrame:
    """Distinct customer ids active on one calendar day."""
    return activity.where(day_range("tracked_time", day)).select("customer_id").distinct()


def signed_in_emails(sign_ins: DataFrame, product_views: DataFrame, customers: DataFrame,
                     start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Distinct (customer_id, email) of customers who signed in during the range;
    the email comes through the product-view audience (NULL for customers who did
    not view a product in the range)."""
    si = source_audience(sign_ins, start, end)
    pv = source_audience(product_views, start, end).select(
        F.col("customer_id").alias("_pv"), F.lit(True).alias("_viewed")
    )
    c = customers.select(F.col("customer_id").alias("_c"), "email")
    # sign-ins without a product view carry a NULL key into the second join:
    # both joins use the NULL-salted left join so those rows do not pile up.
    j = left_join_split_nulls(si, pv, ["customer_id"], ["_pv"])
    j = j.withColumn("_k", F.when(F.col("_viewed"), F.col("customer_id")))
    j = left_join_split_nulls(j, c, ["_k"], ["_c"])
    return j.select("customer_id", "email").distinct()


def emails_of_active(customers: DataFrame, activity: DataFrame, start: dt.datetime,
                     end: dt.datetime) -> DataFrame:
    act = source_audience(activity, start, end).where(F.col("customer_id").isNotNull())
    return customers.join(act, "customer_id", "left_semi").select("email").distinct()


def active_any_left_key(product_views: DataFrame, sign_ins: DataFrame, clicks: DataFrame,
                        customers: DataFrame, start: dt.datetime, end: dt.datetime,
                        bounds: str = "()") -> DataFrame:
    """The full-outer chain keeping only the product-view key: customers who
    viewed a product (the other sources cannot add anyone)."""
    pv = source_audience(product_views, start, end, bounds).where(F.col("customer_id").isNotNull())
    return customers.join(pv, "customer_id", "left_semi").select("email", "customer_id").distinct()


def active_any(sources: Sequence[DataFrame], customers: DataFrame, start: dt.datetime,
               end: dt.datetime, bounds: str = "()") -> DataFrame:
    """Customer ids active in any source during the range."""
    ids = any_of([source_audience(s, start, end, bounds) for s in sources], "customer_id")
    return customers.select("customer_id").join(ids, "customer_id", "left_semi").distinct()


def inactive_emails(sources: Sequence[DataFrame], customers: DataFrame, start: dt.datetime,
                    end: dt.datetime, bounds: str = "[]") -> DataFrame:
    """Emails of customers active in none of the sources (``LEFT JOIN ... IS NULL``
    written as an anti join; customers without an id are never matched)."""
    ids = any_of([source_audience(s, start, end, bounds) for s in sources], "customer_id")
    return customers.join(ids, "customer_id", "left_anti").select("email").distinct()
