"""Skewed inputs: one (session, phone) holding a third of the rows, a third of the
rows with NULL keys. Results must equal the rules in plain Python; hot groups are cut
or combined before the shuffle."""

import datetime as dt
from collections import Counter

from test_attribution import first_paid, last_source, touch_rows
from touchpoint.operators import attribution as A
from pyspark.sql import functions as F
from touchpoint.operators.relational import exclude_existing, frequent_values, left_join_split_nulls
from touchpoint.sources import schemas as S

SCHEMA = (
    "user_pseudo_id string, phone_no string, log_time timestamp_ntz, ga_session_id bigint, "
    "conv_flag string, utm_source string, utm_medium string, utm_campaign string, utm_content string"
)
T0 = dt.datetime(2024, 1, 10)


def skewed_rows(n=3000):
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(seconds=i % 700)
        src = ["!Non-Paid", "google", "fb"][i % 3]
        if i % 3 == 0:  # the hot group: one session, one phone
            rows.append(("hot", "62800", t, 1, "conv", src, "cpc", f"c{i % 5}", f"a{i % 4}"))
        elif i % 3 == 1:  # NULL session or NULL phone
            rows.append((f"u{i}", None if i % 2 else "62801", t, None if i % 2 == 0 else i,
                         "null", src, "cpc", "c", "a"))
        else:
            rows.append((f"u{i}", f"628{i}", t, i, "conv" if i % 4 == 2 else "null", src,
                         "email", "c", "a"))
    return rows


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_first_paid_touch_on_skewed_input(spark):
    g = spark.createDataFrame(skewed_rows(), SCHEMA)
    out = A.first_paid_touch(g)
    assert rows(out) == first_paid(touch_rows(skewed_rows()))
    assert rows(A.best_source_per_session(g)) == last_source(touch_rows(skewed_rows()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the hot group is cut before the shuffle


LEADS = "fullname string, city string, phone string, email string, estimated_buying_time string, created_at timestamp_ntz, car_name string, dealer_name string"
UTM = "phone_no string, utm_source string, utm_medium string, utm_campaign string, utm_content string"


def leads_of(spark, phones):
    return spark.createDataFrame([("n", "c", p, "e", "b", T0, "car", str(i)) for i, p in enumerate(phones)], LEADS)


def test_hot_phones_are_found_and_spread(spark):
    """A third of the leads carry one phone, 2 % another, 0.5 % a third one."""
    phones = ["62" if i % 3 == 0 else "6299" if i % 50 == 1 else "6277" if i % 200 == 2 else None if i % 7 == 0 else f"628{i}" for i in range(6000)]
    leads = leads_of(spark, phones)
    given = [("62", "google"), ("62", "fb"), ("6299", "fb"), ("6277", "fb"), ("62801", "x"), (None, "none")]
    utm = spark.createDataFrame([(p, s, None, None, None) for p, s in given], UTM)
    out = A.attribute_leads(leads, utm)
    want = Counter((str(i), s) for i, p in enumerate(phones) for s in ([s for q, s in given if p and q == p] or [None]))
    assert Counter((r["dealer_name"], r["utm_source"]) for r in out.collect()) == want
    hot = frequent_values(leads, "phone")
    assert set(leads.select(hot.alias("h")).first()["h"]) == {"62", "6299"}
    salted = left_join_split_nulls(leads, utm, ["phone"], ["phone_no"], hot)
    salt = salted._jdf.queryExecution().analyzed().toString()
    assert "approx_top_k" in salt and "explode" in salt
    # the rows of the hot phones reach the join under many salts, those of others under one
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = salted.withColumn("task", F.spark_partition_id()).groupBy("phone").agg(F.countDistinct("task").alias("n"))
        n = {r["phone"]: r["n"] for r in tasks.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n["62"] > 1 and n["6299"] > 1 and n["6277"] == 1


EVENTS = "event_date string, event_timestamp bigint, event_name string, user_pseudo_id string, page_location string, ga_session_id bigint"


def test_a_shortened_phone_of_many_leads_and_touches_makes_no_product(spark, monkeypatch):
    """300 leads and 300 converting sessions share the phone 62."""
    n, day = 300, dt.datetime(2024, 1, 10)
    micros = lambda k: int((day - dt.datetime(1970, 1, 1)).total_seconds() + k) * 1_000_000
    url = "https://e.com/?utm_source=s{0}&utm_medium=m&utm_campaign=c{0}&utm_content=a&gclid=1"
    events = spark.createDataFrame([("20240110", micros(k), A.BROCHURE_CONVERSION, f"u{k}", url.format(k) if k % 2 else "https://e.com/", k) for k in range(n)], EVENTS)
    phones = spark.createDataFrame([(f"u{k}", "62") for k in range(n)], "user_pseudo_id string, phone_no string")
    submitted = [((f"n{k}", "c", f"+62081{k}" if k < n else "0899", "e", "b", None), day, "car", None, None) for k in range(n + 1)]
    leads = spark.createDataFrame(submitted, S.LEADS)
    met, latest = [], A.last_touch_per_lead
    monkeypatch.setattr(A, "last_touch_per_lead", lambda mapped, *a: (met.append(mapped.count()), latest(mapped, *a))[1])
    out = A.attribute_brochure(A.AttributionInputs(leads, events, phones), dt.date(2024, 1, 31), exclude=False)
    got = {r["fullname"]: (r["utm_source"], r["utm_medium"], r["utm_campaign"], r["utm_content"]) for r in out.collect()}
    assert got == {f"n{k}": ("s299", "m", "c299", "a") if k < n else (None,) * 4 for k in range(n + 1)}
    assert met == [n + 1]


def test_latest_touch_per_phone_compares_sources_as_shown(spark):
    """At one time '!Non-Paid' counts as 'Non-Paid', above 'Google'; a touch without a time is last."""
    given = [("1", "!Non-Paid", T0), ("1", "Google", T0), ("1", "x", None), ("2", "a", None), ("2", None, T0), (None, "z", T0)]
    touches = spark.createDataFrame([(p, s, None, None, None, t) for p, s, t in given], f"{UTM}, log_time timestamp_ntz")
    assert {(r["phone_no"], r["utm_source"], r["log_time"]) for r in A.latest_touch_per_phone(touches).collect()} == {("1", "Non-Paid", T0), ("2", None, T0)}


def test_converting_sessions_are_not_repeated(spark, monkeypatch):
    """400 converting sessions; a third of the touches belong to one of them."""
    data = [("u", f"628{i % 9}", T0 + dt.timedelta(seconds=i), 1 if i % 3 == 0 else 1000 + i, "conv" if i < 600 else "null", "s", "m", "c", "a") for i in range(3000)]
    touches, lists, join = spark.createDataFrame(data, SCHEMA), [], type(spark.range(1)).join

    def spy(self, other, on=None, how=None):
        if how == "left_semi":
            lists.append(other.count())
        return join(self, other, on, how)

    monkeypatch.setattr(type(touches), "join", spy)
    kept = A._converting(touches, None)
    assert rows(kept.select(touches.columns)) == Counter(r for r in data if r[3] == 1 or r[2] < T0 + dt.timedelta(seconds=600))
    assert lists == [401]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.first_paid_touch(touches)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # dealt by session and phone after the join, so that a skewed join may be split
    assert "hashpartitioning(ga_session_id" in plan[: plan.index("SortMergeJoin")]


def test_joined_leads_are_distinct_without_another_gathering(spark):
    lead = ("n", "c", "62", "e", "b", T0, "car", "d")
    leads = spark.createDataFrame([lead, lead, (*lead[:2], None, *lead[3:])], LEADS)
    utm = spark.createDataFrame([("62", s, "m", None, None) for s in ("!Non-Paid", "Non-Paid", "g", "g")], UTM)
    out = A.attribute_leads(leads, utm)
    assert rows(out) == Counter({(*lead, s, "m", None, None): 1 for s in ("Non-Paid", "g")} | {(*lead[:2], None, *lead[3:], *[None] * 4): 1})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("HashAggregate")


def test_no_phone_is_hot(spark):
    leads = leads_of(spark, [f"628{i}" for i in range(300)])
    assert leads.select(frequent_values(leads, "phone").alias("h")).first()["h"] == []
    assert leads_of(spark, []).agg(F.count("*")).select(frequent_values(leads_of(spark, [None]), "phone").alias("h")).first()["h"] == []
    assert A.attribute_leads(leads, spark.createDataFrame([("6281", "a", None, None, None)], UTM)).where("utm_source = 'a'").count() == 1


def test_campaign_totals_and_date_parts_on_one_hot_campaign(spark):
    from touchpoint.operators.reports import ad_date_parts, campaign_totals_on_rows

    day = dt.date(2024, 1, 1)
    data = [(day, "hot" if i % 3 else f"c{i % 5}", i % 50, i % 7) for i in range(3000)]
    ads = spark.createDataFrame(data, "date date, campaign_name string, impressions long, clicks_all long")
    out = campaign_totals_on_rows(ads, day, day).collect()
    assert len(out) == 3000
    hot = [r for r in data if r[1] == "hot"]
    assert {(r.sum_impressions, r.count_impressions) for r in out if r.campaign_name == "hot"} == {(sum(r[2] for r in hot), len(hot))}
    often = spark.createDataFrame([(day, f) for f in (1, 1, 2, None) for _ in range(50)], "date date, frequency long")
    parts = ad_date_parts(ads, often)
    campaigns = {r[1] for r in data if r[2] >= 20}
    assert Counter((r.campaign_name, r.frequency) for r in parts.collect()) == Counter((c, f) for c in campaigns for f in (1, 2, None))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("HashAggregate")  # both sides are reduced below the join


def test_null_key_joins_on_skewed_input(spark):
    left = spark.createDataFrame(
        [(None if i % 3 else f"k{i % 7}", i) for i in range(3000)], "k string, v int")
    right = spark.createDataFrame([(f"k{i}", i) for i in range(7)], "k string, w int")
    left.createOrReplaceTempView("l")
    right.createOrReplaceTempView("r")
    want = rows(spark.sql("SELECT l.k, l.v, r.w FROM l LEFT JOIN r ON l.k = r.k"))
    assert rows(left_join_split_nulls(left, right, ["k"]).select("k", "v", "w")) == want
    kept = exclude_existing(left, right.select("k"), ["k"])
    assert kept.count() == 2000  # every NULL-key row survives, every matched key leaves


def test_segments_on_skewed_input(spark):
    """One customer with a third of all clicks, many NULL-customer clicks of one type."""
    from test_audience import segments
    from touchpoint.operators.audience import segment_counts

    types = ["Forget password", "Homepage", "Download Catalogue", "Log-in page", "Social Media"]
    j = []
    for i in range(3000):
        if i % 3 == 0:
            j.append(("hot", types[i % 2]))
        elif i % 3 == 1:
            j.append((None, "Homepage"))
        else:
            j.append((f"c{i % 40}", types[(i // 3) % 5] if i % 7 else "Homepage"))
    act = [("hot", "s")] + [(f"c{i}", "s") for i in range(0, 40, 2)]
    jd = spark.createDataFrame(j, "customer_id string, tracking_type string")
    ad = spark.createDataFrame(act, "customer_id string, story_id string")
    assert rows(segment_counts(jd, ad)) == Counter(dict.fromkeys(segments(j, act).items(), 1))
    plan = segment_counts(jd, ad)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan  # per-customer flags combine map-side


def test_approximate_distinct_users_opt_in(spark):
    from touchpoint.operators.reports import channel_users, monthly_users
    from touchpoint.sources import fixtures as FX

    ev = FX.ga_events(spark, "/root/testdata/sf0.01")
    exact = {r.month_year: r.total_users for r in monthly_users(ev).collect()}
    approx = {r.month_year: r.total_users for r in monthly_users(ev, approx_rsd=0.02).collect()}
    assert exact.keys() == approx.keys()
    for k in exact:
        assert abs(approx[k] - exact[k]) <= max(2, 0.1 * exact[k])
    plan = channel_users(ev, approx_rsd=0.02)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan
