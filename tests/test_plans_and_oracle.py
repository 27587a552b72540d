"""Plan properties of every registered query, and the DuckDB oracle at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck_connect, rows_of, type_diff  # noqa: E402
from touchpoint.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "utm_source" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_plan_invariants(spark, name):
    """No Python UDF, no cross or nested-loop join in any registered query, and no window
    but a ranking that is cut before its shuffle."""
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                 "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert node not in plan, node
    windows = [line for line in plan.splitlines() if "Window [" in line]
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert len(windows) == len(limits)


def test_production_events_read_prunes_partitions(spark, scratch):
    from touchpoint.sources import fixtures as FX
    from touchpoint.sources.tables import flatten_events, read_events, write_events

    # AQE merges small shuffle partitions (at scale it keeps ~64 MB ones); switch
    # the merging off here to see that one day is spread over several writers
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_events(FX.ga_events(spark, SF), f"{scratch}/events", "overwrite", files_per_day=8)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    day_files = [f for f in os.listdir(f"{scratch}/events/event_date=20240105")
                 if f.endswith(".parquet")]
    assert len(day_files) > 1  # a day is written by several tasks
    assert read_events(spark, f"{scratch}/events").count() == FX.ga_events(spark, SF).count()
    df = read_events(spark, f"{scratch}/events", "20240105", "20240106")
    plan = df.select("user_pseudo_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert df.select("event_date").distinct().count() == 2


EVENT_REPORTS = ["page_users_by_instant", "page_users_by_day", "monthly_users", "channel_users",
                 "traffic_sources", "daily_page_class"]


def event_reports():
    from touchpoint.operators import attribution as A
    from touchpoint.operators import reports as RP
    from touchpoint.plans import catalog as C
    from touchpoint.sources import fixtures as FX

    out = {name: getattr(RP, name) for name in EVENT_REPORTS[:-1]}
    out["daily_page_class"] = lambda e: RP.daily_page_class(e, C.PAGE_CLASS_PREFIX)
    out["event_log_between"] = lambda e: RP.event_log_between(e, C.EVENT_LOG_RANGES)
    out["first_user_per_page"] = lambda e: RP.first_user_per_page(e, C.FIRST_USER_PREFIXES)
    out["registered_events"] = lambda e: A.registered_events(e, FX.phone_map(e.sparkSession, SF), "20240105", "20240120")
    return out


def test_event_reports_agree_on_raw_and_flat_events(spark, scratch):
    from pyspark.sql import functions as F
    from touchpoint.sources import fixtures as FX
    from touchpoint.sources import schemas as S
    from touchpoint.sources.tables import flatten_events, read_flat_events, write_silver_events

    raw = FX.ga_events(spark, SF)
    # events with repeated, NULL and missing page entries
    entry = S.EVENT_PARAM.simpleString()
    first = F.get("event_params", 0)
    null_page = F.lit(None).cast(entry)
    null_page = F.struct(F.lit("page_location").alias("key"), F.lit(None).cast(S.PARAM_VALUE.simpleString()).alias("value"))
    odd = F.when(F.col("event_timestamp") % 5 == 0, F.concat("event_params", F.array(first)))
    odd = odd.when(F.col("event_timestamp") % 5 == 1, F.concat("event_params", F.array(null_page)))
    odd = odd.when(F.col("event_timestamp") % 5 == 2, F.array().cast(f"array<{entry}>"))
    raw = raw.withColumn("event_params", odd.otherwise(F.col("event_params")))
    assert flatten_events(raw).columns == S.FLAT_EVENTS.fieldNames()
    write_silver_events(raw, f"{scratch}/flat", "overwrite", 2)
    flat = read_flat_events(spark, f"{scratch}/flat")
    for name, report in event_reports().items():
        a, b = report(raw), report(flat)
        assert rows_of(a.columns, [tuple(r) for r in a.collect()]) == rows_of(b.columns, [tuple(r) for r in b.collect()]), name
        scan = next(x for x in b._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
        assert "event_params" not in scan and "struct<" not in scan.partition("ReadSchema: struct<")[2]


def test_snapshot_reader_reads_one_folder(spark, scratch):
    import datetime as dt

    from touchpoint.sources import schemas as S
    from touchpoint.sources.tables import read_snapshot

    rows = [(dt.date(2024, 1, d), f"c{d}", "e", "n") for d in (1, 1, 2)]
    spark.createDataFrame(rows, "snapshot_date date, customer_id string, email string, name string").write.partitionBy("snapshot_date").parquet(f"{scratch}/snap")
    got = read_snapshot(spark, f"{scratch}/snap", S.CUSTOMERS, dt.date(2024, 1, 1))
    assert got.count() == 2 and got.columns == S.CUSTOMERS.fieldNames()
    assert "PartitionFilters: [isnotnull(snapshot_date" in got._jdf.queryExecution().executedPlan().toString()


def test_snapshot_as_of_a_day_reads_one_folder(spark, scratch):
    import datetime as dt

    from touchpoint.sources import schemas as S
    from touchpoint.sources.tables import read_snapshot_as_of, write_snapshot

    def day(d, n):
        return spark.createDataFrame([(f"c{k}", f"{d}", "n") for k in range(n)], S.CUSTOMERS), dt.date(2024, 1, d)

    for d, n in ((3, 5), (7, 4), (9, 3)):
        df, at = day(d, n)
        write_snapshot(df, f"{scratch}/snap", at)
    write_snapshot(day(7, 2)[0], f"{scratch}/snap", dt.date(2024, 1, 7))  # replaced
    got = {d: [r["email"] for r in read_snapshot_as_of(spark, f"{scratch}/snap", S.CUSTOMERS, dt.date(2024, 1, d)).collect()] for d in (2, 3, 6, 7, 8, 30)}
    assert got == {2: [], 3: ["3"] * 5, 6: ["3"] * 5, 7: ["7"] * 2, 8: ["7"] * 2, 30: ["9"] * 3}
    df = read_snapshot_as_of(spark, f"{scratch}/snap", S.CUSTOMERS, dt.date(2024, 1, 8))
    df.collect()
    assert len(df.select("_metadata.file_path").distinct().collect()) == len([f for f in os.listdir(f"{scratch}/snap/snapshot_date=2024-01-07") if f.endswith(".parquet")])
    assert "PartitionFilters: [isnotnull(snapshot_date" in df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_needs_no_exchange(spark):
    from touchpoint.operators.attribution import registered_events
    from touchpoint.plans import catalog as C

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = C.q_registered_events_bucketed(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        plain = registered_events(C.FX.ga_events(spark, SF), C.FX.phone_map(spark, SF), *C._window().event_days())
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(plain.columns, [tuple(r) for r in plain.collect()])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checks_tell_the_operators_apart(spark):
    """The derived tables hold the cases that separate rules which otherwise agree."""
    sf = "/root/testdata/sf0.01"
    q = {k: E.queries()[k](spark, sf) for k in ("attribute_by_session_unchecked", "attribute_joined_conversions", "attribute_own_sessions",
                                                 "registered_events", "journey_clicks", "attribute_leads", "monthly_users",
                                                 "single_touch_users", "single_touch_users_unknown")}
    n = {k: v.count() for k, v in q.items()}
    assert len({n[k] for k in ("attribute_by_session_unchecked", "attribute_joined_conversions", "attribute_own_sessions")}) == 3
    assert q["registered_events"].where("ga_session_id IS NULL").count() > 0
    assert q["journey_clicks"].where("customer_id IS NULL").count() > 0
    assert q["attribute_leads"].where("phone = '62' AND utm_source IS NOT NULL").count() > 0
    assert n["monthly_users"] > 3 and 0 < n["single_touch_users_unknown"] < n["single_touch_users"]


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in d_cols)
    assert not type_diff(df.schema, duck, E.oracle_sql()[name])
    assert rows_of(df.columns, s_rows) == rows_of(d_cols, d_rows)
