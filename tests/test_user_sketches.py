"""Stored distinct-user sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from touchpoint.operators import reports as RP
from touchpoint.operators import user_sketches as US
from touchpoint.sources import day_builds as DB
from touchpoint.sources import fixtures as FX

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark):
    return FX.ga_events(spark, SF)


@pytest.fixture(scope="module")
def days(events):
    r = events.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).first()
    return r["a"], r["b"]


@pytest.fixture(scope="module")
def stored(spark, events, days, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sketches"))
    between = DB.days_between(*days)
    US.update(events, root, between[0], between[-4])
    for day in between[-3:]:
        US.update(events, root, day)
    return root


def near(exact, estimate):
    return abs(exact - estimate) <= US.error_bound() * exact + 1


def test_months_from_days(spark, events, days, stored):
    got = {r["month_year"]: r["total_users"] for r in US.monthly_users(US.read_sketches(spark, stored, *days)).collect()}
    want = {r["month_year"]: r["total_users"] for r in RP.monthly_users(events).collect()}
    assert got.keys() == want.keys() and all(near(want[m], got[m]) for m in want)


def test_channels_from_days(spark, events, days, stored):
    keys = ["event_date", "event_name", "default_channel_grouping"]
    sums = ["total_users", "paid_users", "non_paid_users", "membership_paid_users", "membership_non_paid_users"]
    rows = lambda df: {tuple(r[k] for k in keys): [r[s] for s in sums] for r in df.collect()}
    got, want = rows(US.channel_users(US.read_sketches(spark, stored, *days))), rows(RP.channel_users(events))
    assert got.keys() == want.keys()
    assert all(near(a, b) for k in want for a, b in zip(want[k], got[k]))


def test_large_counts_stay_within_the_bound(spark, scratch):
    n = 300_000
    rows = spark.range(n).select(
        F.concat(F.lit("2024010"), (F.col("id") % 3 + 1).cast("string")).alias("event_date"),
        (F.lit(1704153600000000) + F.col("id")).alias("event_timestamp"),
        F.lit("visit").alias("event_name"),
        F.when(F.col("id") % 1000 > 0, F.pmod(F.xxhash64("id"), F.lit(90_000)).cast("string")).alias("user_pseudo_id"),
        F.lit("cpc").alias("traffic_medium"),
    )
    US.update(rows, scratch, "20240101", "20240103")
    US.update(rows, scratch, "20240102")
    got = US.monthly_users(US.read_sketches(spark, scratch, "20240101", "20240103")).collect()
    exact = rows.agg(F.count_distinct("user_pseudo_id")).first()[0]
    assert len(got) == 1 and abs(got[0]["total_users"] - exact) <= US.error_bound() * exact
    day = US.monthly_users(US.read_sketches(spark, scratch, "20240102", "20240102")).first()["total_users"]
    one = rows.where("event_date = '20240102'").agg(F.count_distinct("user_pseudo_id")).first()[0]
    assert abs(day - one) <= US.error_bound() * one
    # a few rows a day, not a row per user
    assert US.read_sketches(spark, scratch, "20240101", "20240103").count() == 3


def test_a_replaced_day_counts_once(spark, events, days, stored, scratch):
    US.update(events.where("event_timestamp % 2 = 0"), scratch, *days)
    US.update(events, scratch, *days)
    a, b = (US.monthly_users(US.read_sketches(spark, r, *days)).collect() for r in (scratch, stored))
    assert a == b


def test_reports_read_no_events_and_sketches_combine_map_side(spark, events, days, stored):
    assert "partial_hll_sketch_agg" in US.day_sketches(events, *days)._jdf.queryExecution().executedPlan().toString()
    plan = US.monthly_users(US.read_sketches(spark, stored, *days))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "users" in plan.partition("FileScan")[2]
    with pytest.raises(ValueError, match="without a build"):
        US.read_sketches(spark, stored, "20200101", days[1])
