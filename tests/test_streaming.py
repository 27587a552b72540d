import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchpoint.functions.timeutil import local_to_utc, ntz_lit
from touchpoint.operators import attribution as A
from touchpoint.operators.incremental import load_new_leads, read_sink
from touchpoint.plans import catalog as C
from touchpoint.sources import fixtures as FX
from touchpoint.streaming import release_pending, start_lead_stream
from touchpoint.streaming.lead_stream import late_runs, load_batch, read_pending, ready_windows

SF = "/root/testdata/sf0.001"
DAYS = [dt.date(2024, 1, 12), dt.date(2024, 1, 20), C.AS_OF]


@pytest.fixture(scope="module")
def tables(spark):
    return FX.test_drive_leads(spark, SF), FX.ga_events(spark, SF), FX.phone_map(spark, SF)


def stream(spark, scratch, tables, as_of, name="ckpt"):
    start_lead_stream(spark, f"{scratch}/leads", tables[1], tables[2], f"{scratch}/sink", as_of,
                      C.LOOKBACK_DAYS, checkpoint=f"{scratch}/{name}").awaitTermination(300)
    return read_sink(spark, f"{scratch}/sink")


def distinct(df):
    return set(map(str, df.drop("created_date").distinct().collect()))


def loaded_by_batches(spark, scratch, tables, days):
    for day in days:
        load_new_leads(spark, A.AttributionInputs(*tables), f"{scratch}/batch", day, C.LOOKBACK_DAYS)
    return read_sink(spark, f"{scratch}/batch")


def created_between(leads, first, last):
    """Leads created from ``first`` to before ``last`` (local days; None: open)."""
    at = lambda d: ntz_lit(local_to_utc(dt.datetime.combine(d, dt.time(0))))
    if first is not None:
        leads = leads.where(F.col("created_at") >= at(first))
    if last is not None:
        leads = leads.where(F.col("created_at") < at(last))
    return leads


@pytest.mark.parametrize("days", [DAYS[1:], DAYS])
def test_moving_dates_on_one_checkpoint_equal_the_batch_loads(spark, scratch, tables, days):
    """The first run already finds leads of later days; each further run finds one late file
    (leads of long ended days) and one of the day that follows."""
    early = created_between(tables[0], None, days[1])
    files = [early] + [created_between(tables[0], a, b) for a, b in zip(days[1:], [*days[2:], None])]
    for day, leads in zip(days, files):
        leads.write.mode("append").parquet(f"{scratch}/leads")
        stream(spark, scratch, tables, day)
    late = tables[0].limit(1).withColumn("created_at", F.expr("timestamp_ntz'2023-06-01 05:00:00'"))
    late.write.mode("append").parquet(f"{scratch}/leads")
    got = stream(spark, scratch, tables, days[-1])
    batch = loaded_by_batches(spark, scratch, tables, days)
    assert distinct(batch) <= distinct(got)
    # every lead of an ended day is there, the late one too, and no other
    ever = A.LoadWindow(dt.datetime(2000, 1, 1), dt.datetime.combine(days[-1], dt.time(0)))
    want = A.load_leads(tables[0].unionByName(late), ever)
    assert distinct(got.select(*A.LEAD_COLS)) == distinct(want.select(*A.LEAD_COLS))


def test_one_run_equals_the_batch_and_a_replay_adds_nothing(spark, scratch, tables):
    window = A.lookback_window(C.AS_OF, C.LOOKBACK_DAYS)
    A.filter_window(tables[0], window).write.parquet(f"{scratch}/leads")
    got = stream(spark, scratch, tables, C.AS_OF)
    want = A.attribute_test_drive(A.AttributionInputs(*tables), C.AS_OF, C.LOOKBACK_DAYS)
    assert distinct(got) == distinct(want) and got.count() == want.count()
    assert stream(spark, scratch, tables, C.AS_OF, "other-ckpt").count() == want.count()


def test_leads_of_an_open_day_wait_and_old_ones_are_taken(spark, scratch, tables):
    day = dt.date(2024, 1, 25)
    tables[0].write.parquet(f"{scratch}/leads")
    got = stream(spark, scratch, tables, lambda: day)
    days = [r[0] for r in got.selectExpr("min(created_date)").collect() + got.selectExpr("max(created_date)").collect()]
    assert days[0] < day - dt.timedelta(days=C.LOOKBACK_DAYS) and days[1] < day
    before = got.count()
    release_pending(spark, 0, tables[1], tables[2], f"{scratch}/sink", f"{scratch}/ckpt-pending", C.AS_OF)
    after = read_sink(spark, f"{scratch}/sink")
    assert after.count() > before and after.selectExpr("max(created_date)").first()[0] >= day


def test_runs_of_late_days():
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    assert late_runs([], 18) == []
    assert late_runs([d(40), d(0), d(18), d(0)], 18) == [(d(0), d(18)), (d(40), d(40))]


def test_an_old_lead_does_not_stretch_the_events_of_others(spark, tables):
    at = ["2001-02-03 04:00:00", "2023-12-01 01:00:00", "2023-12-10 01:00:00"]
    one = tables[0].limit(1)
    leads = one
    for t in at:
        leads = leads.unionByName(one.withColumn("created_at", F.expr(f"timestamp_ntz'{t}'")))
    windows = ready_windows(leads.where("created_at < '2023-12-31'"), dt.date(2024, 1, 20), 18)
    assert [w[1].event_days() for w in windows] == [
        ("20240102", "20240119"), ("20010116", "20010203"), ("20231113", "20231210")]
    # a lead at the very bound of the daily window belongs to the late ones, and to one window
    edge = one.withColumn("created_at", ntz_lit(local_to_utc(dt.datetime(2024, 1, 2))))
    windows = ready_windows(edge, dt.date(2024, 1, 20), 18)
    assert [A.filter_window(edge, w[0]).count() for w in windows] == [0, 1]


def test_leads_without_a_time_are_set_aside_once(spark, scratch, tables):
    untimed = tables[0].limit(2).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    timed = tables[0].limit(1).withColumn("created_at", F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    args = (tables[1], tables[2], f"{scratch}/sink", f"{scratch}/wait", dt.date(2024, 1, 20))
    load_batch(spark, untimed.unionByName(timed), 0, *args)
    load_batch(spark, timed.limit(0), 1, *args)
    aside = lambda n: spark.read.parquet(f"{scratch}/wait-untimed/batch={n}").count()
    assert (aside(0), aside(1)) == (2, 0)
    assert read_pending(spark, f"{scratch}/wait/1").count() == 1


def test_a_checkpoint_place_is_needed(spark, monkeypatch, tables):
    import touchpoint.streaming.lead_stream as L

    monkeypatch.setattr(L, "checkpoint_dir", lambda spark: None)
    with pytest.raises(ValueError, match="checkpoint"):
        start_lead_stream(spark, "x", tables[1], tables[2], "y")
