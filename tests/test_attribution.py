"""Attribution on hand-written sessions and leads, checked against the rules in Python."""

import datetime as dt
from collections import Counter

import pytest

from touchpoint.operators import attribution as A

GA_UTM_SCHEMA = (
    "user_pseudo_id string, phone_no string, log_time timestamp_ntz, ga_session_id bigint, "
    "conv_flag string, utm_source string, utm_medium string, utm_campaign string, utm_content string"
)
T = dt.datetime(2024, 1, 10, 10, 0)


def m(n):
    return T + dt.timedelta(minutes=n)


GA_UTM = [
    # session 1: unpaid first, paid later -> paid wins
    ("u1", "62811", m(0), 1, "conv", "!Non-Paid", None, None, None),
    ("u1", "62811", m(5), 1, "conv", "google", "cpc", "c1", "a1"),
    ("u1", "62811", m(9), 1, "conv", "facebook", "social", "c2", "a2"),
    # session 2: two paid at the same time, same source, different content -> both kept
    ("u2", "62822", m(1), 2, "conv", "tiktok", "cpc", "c3", "a1"),
    ("u2", "62822", m(1), 2, "conv", "tiktok", "cpc", "c3", "a2"),
    # session 3: not converting
    ("u3", "62833", m(2), 3, "null", "google", "cpc", "c9", "a9"),
    # NULL session
    ("u4", "62844", m(3), None, "null", "google", "cpc", "c1", "a1"),
    # session 5 shared by two users/phones; NULL content with medium
    ("u5", "62855", m(4), 5, "conv", "fb", "cpc", "c5", None),
    ("u6", "62866", m(6), 5, "conv", "!Non-Paid", None, None, None),
    # NULL phone
    ("u7", None, m(7), 7, "conv", "google", "cpc", "c7", "a7"),
]


FIELDS = [c.split()[0] for c in GA_UTM_SCHEMA.split(", ")]


def low(v):
    """NULL sorts first."""
    return (v is not None, v)


def touch_rows(data):
    return [dict(zip(FIELDS, r)) for r in data]


def sessions(data, whole=True):
    """Converting (session, phone) groups; ``whole``: only with both known."""
    ids = {t["ga_session_id"] for t in data if t["conv_flag"] == "conv"} - {None}
    out = {}
    for t in data:
        if t["ga_session_id"] in ids and not (whole and t["phone_no"] is None):
            out.setdefault((t["ga_session_id"], t["phone_no"]), []).append(t)
    return out


UTM = ["utm_source", "utm_medium", "utm_campaign", "utm_content"]


def pick(t):
    return (t["phone_no"], *[t[c] for c in UTM])


def first_paid(data):
    """The rule: earliest paid touch of the session, else the earliest; its source and
    instant name the rows whose other fields are given."""
    out = Counter()
    for group in sessions(data).values():
        best = min(group, key=lambda t: (t["utm_source"] == "!Non-Paid", low(t["log_time"]), low(t["utm_source"])))
        if best["utm_source"] is not None and best["log_time"] is not None:
            same = [t for t in group if (t["utm_source"], t["log_time"]) == (best["utm_source"], best["log_time"])]
            out.update({pick(t) for t in same})
    return out


def first_paid_converted(data):
    out = Counter()
    for (_, phone), group in sessions(data, whole=False).items():
        best = min(group, key=lambda t: (t["utm_source"] == "!Non-Paid", low(t["log_time"]), *[low(t[c]) for c in UTM]))
        known = phone is not None and best["log_time"] is not None and all(best[c] is not None for c in UTM)
        out[(phone, best["utm_source"], *[best[c] if known else None for c in UTM[1:]], best["log_time"])] += 1
    return out


def last_source(data):
    out = Counter()
    for group in sessions(data).values():
        named = [t["utm_source"] for t in group if t["utm_source"] is not None]
        if named:
            out.update({pick(t) for t in group if t["utm_source"] == max(named)})
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def ga(spark):
    return spark.createDataFrame(GA_UTM, GA_UTM_SCHEMA)


def test_first_paid_touch(spark):
    got = rows(A.first_paid_touch(ga(spark)))
    assert got == first_paid(touch_rows(GA_UTM))
    assert got[("62811", "google", "cpc", "c1", "a1")] == 1
    assert got[("62822", "tiktok", "cpc", "c3", "a1")] == 1
    assert got[("62822", "tiktok", "cpc", "c3", "a2")] == 1


def test_ranking_cuts_groups_before_the_shuffle(spark):
    for choose in (A.first_paid_touch, A.best_source_per_session):
        plan = choose(ga(spark))._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan
        # the cut to converting sessions lies below the ranking
        assert plan.index("WindowGroupLimit") < plan.index("LeftSemi")


def test_first_paid_touch_converted(spark):
    assert rows(A.first_paid_touch_converted(ga(spark))) == first_paid_converted(touch_rows(GA_UTM))


def test_best_source_per_session(spark):
    assert rows(A.best_source_per_session(ga(spark))) == last_source(touch_rows(GA_UTM))


def test_event_window_is_read_once_beside_the_conversions(spark):
    from touchpoint.plans import catalog as C

    plan = C.q_first_paid_touch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "event_type" in line]
    assert len(scans) == 2  # the window, and the conversion events


def test_users_who_share_a_session_id(spark):
    schema = "user_pseudo_id string, phone_no string, log_time timestamp_ntz, page_location string, ga_session_id bigint, conv_flag string"
    reg = spark.createDataFrame([("u1", "p1", T, "x", 1, "conv"), ("u2", "p2", T, "x", 1, "null"), ("u3", "p3", T, "x", None, "conv")], schema)
    by_id = {r.user_pseudo_id: r.conv_flag for r in A.flag_conversion_sessions(reg).collect()}
    own = {r.user_pseudo_id: r.conv_flag for r in A.flag_conversion_sessions(reg, session_keys=("user_pseudo_id", "ga_session_id")).collect()}
    assert by_id == {"u1": "conv", "u2": "conv", "u3": "null"} and own == {"u1": "conv", "u2": "null", "u3": "null"}


def test_load_leads_refuses_columns_its_keys_do_not_settle(spark):
    leads = lead_rows(spark, [dt.datetime(2024, 1, 20, 3, 0)])
    window = A.lookback_window(dt.date(2024, 1, 31), 18)
    with pytest.raises(ValueError, match="fullname"):
        A.load_leads(leads, window, ["phone_raw", "created_raw"])
    assert A.load_leads(leads, window, ["phone_raw", "created_raw"], out_cols=["phone", "created_at"]).count() == 1


def test_exclude_loaded_null_safe(spark):
    schema = "fullname string, city string, phone string, email string, created_at timestamp_ntz, car_name string"
    new = spark.createDataFrame([("a", None, "p", "e", T, "c"), ("b", "x", "p", "e", T, "c")], schema)
    assert A.exclude_loaded(new, new).count() == 1
    assert A.exclude_loaded(new, new, null_safe=True).count() == 0


def test_lookback_window_bounds():
    w = A.lookback_window(dt.date(2024, 1, 31), 18)
    assert w.lower == dt.datetime(2024, 1, 13) and w.upper == dt.datetime(2024, 1, 31)
    assert w.event_days() == ("20240113", "20240130")


def lead_rows(spark, times):
    return spark.createDataFrame(
        [((f"n{i}", "City", "0812", "e@x", "soon", None), t, "Terra", "D1", None)
         for i, t in enumerate(times)],
        "customer struct<fullname string, city string, phone string, email string, "
        "estimated_buying_time string, referer string>, created_at timestamp_ntz, "
        "car_name string, dealer_name string, description string",
    )


def test_load_leads_window_edges(spark):
    # local (UTC+7) 2024-01-13 00:00 exactly is out; 00:00:00.000001 is in; 2024-01-30 23:59 in
    utc = [dt.datetime(2024, 1, 12, 17, 0), dt.datetime(2024, 1, 12, 17, 0, 0, 1),
           dt.datetime(2024, 1, 30, 16, 59), dt.datetime(2024, 1, 30, 17, 0)]
    df = A.load_leads(lead_rows(spark, utc), A.lookback_window(dt.date(2024, 1, 31), 18))
    got = sorted(r.created_at for r in df.collect())
    assert got == [dt.datetime(2024, 1, 13, 0, 0, 0, 1), dt.datetime(2024, 1, 30, 23, 59)]


def test_load_leads_dedupes_identical_submissions(spark):
    t = dt.datetime(2024, 1, 20, 3, 0)
    df = A.load_leads(lead_rows(spark, [t]).unionByName(lead_rows(spark, [t])),
                      A.lookback_window(dt.date(2024, 1, 31), 18))
    assert df.count() == 1
    assert df.first().phone == "62812"


def test_last_touch_per_lead(spark):
    df = spark.createDataFrame(
        [("a", "c", "p", "e", "b", T, "car", "s1", None, None, None, m(1)),
         ("a", "c", "p", "e", "b", T, "car", "s2", "m", None, None, m(5)),
         ("a", "c", "p", "e", "b", T, "car", "s3", None, None, None, None)],
        "fullname string, city string, phone string, email string, estimated_buying_time string, "
        "created_at timestamp_ntz, car_name string, utm_source string, utm_medium string, "
        "utm_campaign string, utm_content string, log_time timestamp_ntz")
    out = A.last_touch_per_lead(df).collect()
    assert len(out) == 1 and out[0].utm_source == "s2"
