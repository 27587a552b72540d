"""The touch state, day by day, against the full run over the events."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchpoint.operators import attribution as A
from touchpoint.operators import touch_state as TS
from touchpoint.plans import catalog as C
from touchpoint.sources import day_builds as DB
from touchpoint.sources import fixtures as FX

SF = "/root/testdata/sf0.001"
WINDOW = A.lookback_window(C.AS_OF, 6)
FIRST_DAY, LAST_DAY = WINDOW.event_days()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def given(spark):
    return FX.ga_events(spark, SF), FX.phone_map(spark, SF)


@pytest.fixture(scope="module")
def daily(spark, given, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("state"))
    for day in DB.days_between(FIRST_DAY, LAST_DAY):
        TS.update(given[0], root, day)
    return root


def full(given, leads=None, conversion=A.TEST_DRIVE_CONVERSION):
    return A._touches(A.AttributionInputs(None, *given), WINDOW, conversion, False, leads=leads)


def test_day_by_day_equals_the_full_run(spark, given, daily):
    phones = given[1]
    touches, conv = full(given)
    want = rows(A.first_paid_touch(touches, conv))
    assert want and rows(A.first_paid_touch(*TS.touches_from_state(spark, daily, phones, WINDOW))) == want
    assert rows(A.first_paid_touch_converted(*TS.touches_from_state(spark, daily, phones, WINDOW))) == rows(A.first_paid_touch_converted(touches, conv))
    last = TS.touches_from_state(spark, daily, phones, WINDOW, TS.LAST)
    assert rows(A.best_source_per_session(last[0], True, last[1])) == rows(A.best_source_per_session(touches, True, conv))
    state, events = TS.read_state(spark, daily, FIRST_DAY, LAST_DAY)[0].count(), given[0].where(F.col("event_date").between(FIRST_DAY, LAST_DAY)).count()
    assert state < events


def test_a_backfill_equals_single_days(spark, given, daily, scratch):
    TS.update(given[0], scratch, FIRST_DAY, LAST_DAY)
    for kind in (TS.FIRST, TS.LAST):
        one, many = (TS.read_state(spark, r, FIRST_DAY, LAST_DAY, kind) for r in (scratch, daily))
        assert rows(one[0].select(sorted(one[0].columns))) == rows(many[0].select(sorted(many[0].columns)))
        assert rows(one[1]) == rows(many[1])


def test_a_window_inside_the_state(spark, given, daily):
    w = A.LoadWindow(WINDOW.lower + dt.timedelta(days=2), WINDOW.upper - dt.timedelta(days=1))
    touches, conv = A._touches(A.AttributionInputs(None, *given), w, A.TEST_DRIVE_CONVERSION, False)
    assert rows(A.first_paid_touch(*TS.touches_from_state(spark, daily, given[1], w))) == rows(A.first_paid_touch(touches, conv))


def test_late_events_and_replays_replace_a_day(spark, given, scratch):
    events, phones = given
    part = events.where(F.col("event_timestamp") % 3 > 0)
    TS.update(part, scratch, FIRST_DAY, LAST_DAY)
    for _ in range(2):
        for day in DB.days_between(FIRST_DAY, LAST_DAY)[2:4]:
            TS.update(events, scratch, day)
    mixed = part.unionByName(events.where((F.col("event_timestamp") % 3 == 0) & F.col("event_date").isin(DB.days_between(FIRST_DAY, LAST_DAY)[2:4])))
    touches, conv = A._touches(A.AttributionInputs(None, mixed, phones), WINDOW, A.TEST_DRIVE_CONVERSION, False)
    assert rows(A.first_paid_touch(*TS.touches_from_state(spark, scratch, phones, WINDOW))) == rows(A.first_paid_touch(touches, conv))
    TS.compact(spark, scratch, FIRST_DAY, LAST_DAY)
    assert DB.published_days(spark, scratch).select("attempt").distinct().count() == 1
    assert rows(A.first_paid_touch(*TS.touches_from_state(spark, scratch, phones, WINDOW))) == rows(A.first_paid_touch(touches, conv))


def test_a_build_that_dies_changes_nothing(spark, given, scratch):
    TS.update(given[0], scratch, FIRST_DAY, LAST_DAY)
    before = rows(TS.read_state(spark, scratch, FIRST_DAY, LAST_DAY)[0])
    TS.stage(given[0].where("event_timestamp % 2 = 0"), scratch, FIRST_DAY, LAST_DAY)  # never published
    assert rows(TS.read_state(spark, scratch, FIRST_DAY, LAST_DAY)[0]) == before


def test_a_missing_day_is_an_error(spark, given, scratch):
    TS.update(given[0], scratch, FIRST_DAY)
    with pytest.raises(ValueError, match="without a build"):
        TS.read_state(spark, scratch, FIRST_DAY, LAST_DAY)


def test_phones_that_come_later_count(spark, given, daily):
    """The state knows users, so a changed phone map needs no rebuild."""
    phones = given[1].where("user_pseudo_id <> '1'").unionByName(spark.createDataFrame([("anon-1", "08123"), ("anon-2", "+62 8124")], "user_pseudo_id string, phone_no string"))
    touches, conv = full((given[0], phones))
    assert rows(A.first_paid_touch(*TS.touches_from_state(spark, daily, phones, WINDOW))) == rows(A.first_paid_touch(touches, conv))


def test_only_the_days_folders_are_read(spark, given, daily):
    plan = TS.read_state(spark, daily, FIRST_DAY, LAST_DAY)[0]._jdf.queryExecution().executedPlan().toString()
    filters = plan.partition("PartitionFilters: [")[2].split("], ")[0]
    assert "attempt" in filters and "event_date" in filters and "kind" in filters


def test_one_day_of_events_is_scanned_by_an_update(spark, given, scratch):
    from touchpoint.sources.tables import read_events, write_events

    write_events(given[0], f"{scratch}/events", "overwrite", 2)
    plan = TS.day_touches(read_events(spark, f"{scratch}/events"), LAST_DAY, LAST_DAY)._jdf.queryExecution().executedPlan().toString()
    assert all("event_date" in line.partition("PartitionFilters")[2] for line in plan.splitlines() if "FileScan" in line)
    TS.update(read_events(spark, f"{scratch}/events"), f"{scratch}/state", FIRST_DAY, LAST_DAY)
    assert rows(TS.read_state(spark, f"{scratch}/state", FIRST_DAY, LAST_DAY)[1])


def test_attribution_and_last_touch_of_leads(spark, given, daily):
    inp = A.AttributionInputs(FX.test_drive_leads(spark, SF), *given, FX.matched_sink(spark, SF))
    for method in ("first_paid_touch", "best_per_session"):
        assert rows(TS.attribute_from_state(inp, daily, WINDOW, method)) == rows(A.attribute(inp, WINDOW, method))
    with pytest.raises(ValueError):
        TS.attribute_from_state(inp, daily, WINDOW, "best_per_phone")
    cols = [c for c in A.LEAD_COLS if c != "dealer_name"]
    leads = A.load_leads(FX.brochure_leads(spark, SF), WINDOW, A.BROCHURE_DEDUPE_KEYS, out_cols=cols)
    touches, conv = full(given, leads, A.BROCHURE_CONVERSION)
    mapped = A.attribute_leads(leads, A.first_paid_touch_converted(touches, conv), cols, extra_cols=["log_time"])
    assert rows(TS.last_touch_from_state(leads, given[1], daily, WINDOW)) == rows(A.last_touch_per_lead(mapped))
