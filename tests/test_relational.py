"""Differential tests of the relational rewrites against literal Spark SQL."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from touchpoint.operators.relational import (
    any_of,
    exclude_existing,
    full_outer_coalesce,
    left_join_split_nulls,
    not_in,
    top1_per_group,
    with_total_count,
)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_not_in_matches_sql(spark):
    outers = [[], [1], [1, 2, None], [None]]
    subs = [[], [1], [None], [2, None], [3]]
    for o, s in itertools.product(outers, subs):
        od = spark.createDataFrame([(x,) for x in o], "k int")
        sd = spark.createDataFrame([(x,) for x in s], "k int")
        od.createOrReplaceTempView("o")
        sd.createOrReplaceTempView("s")
        want = rows(spark.sql("SELECT k FROM o WHERE k NOT IN (SELECT k FROM s)"))
        got = rows(not_in(od, "k", sd, "k").select("k"))
        assert got == want, (o, s)


def test_exclude_existing_null_never_matches(spark):
    new = spark.createDataFrame([("a", "x"), ("b", None), (None, None)], "k1 string, k2 string")
    old = spark.createDataFrame([("a", "x"), ("b", None), (None, None)], "k1 string, k2 string")
    got = rows(exclude_existing(new, old, ["k1", "k2"]))
    assert got == Counter([("b", None), (None, None)])


def test_exclude_existing_self_is_empty_without_nulls(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert exclude_existing(df, df, ["a", "b"]).count() == 0


def test_left_join_split_nulls_matches_sql(spark):
    random.seed(1)
    l = spark.createDataFrame([(random.choice([1, 2, None]), i) for i in range(40)], "k int, v int")
    r = spark.createDataFrame([(random.choice([1, 3, None]), i) for i in range(10)], "k int, w int")
    l.createOrReplaceTempView("l")
    r.createOrReplaceTempView("r")
    want = rows(spark.sql("SELECT l.k, l.v, r.w FROM l LEFT JOIN r ON l.k = r.k"))
    got = rows(left_join_split_nulls(l, r, ["k"]).select("k", "v", "w"))
    assert got == want


def test_full_outer_coalesce_matches_sql(spark):
    random.seed(2)
    a = spark.createDataFrame([(random.choice(["u1", "u2", None]), random.choice(["c1", None]))
                               for _ in range(20)], "user_id string, customer_id string")
    b = spark.createDataFrame([(random.choice(["u2", "u3", None]), "c9") for _ in range(8)],
                              "user_id string, customer_id string")
    a.createOrReplaceTempView("a")
    b.createOrReplaceTempView("b")
    want = rows(spark.sql(
        "SELECT COALESCE(a.user_id, b.user_id), COALESCE(a.customer_id, b.customer_id) "
        "FROM a FULL OUTER JOIN b ON a.user_id = b.user_id"))
    got = rows(full_outer_coalesce(a, b, "user_id", ["user_id", "customer_id"]))
    assert got == want


def test_top1_per_group_matches_row_number(spark):
    random.seed(3)
    data = [(random.choice(["g1", "g2", None]), random.choice([1, 2, None]),
             random.choice(["a", "b", None])) for _ in range(60)]
    df = spark.createDataFrame(data, "g string, t int, s string")
    df.createOrReplaceTempView("t")
    want = rows(spark.sql("""SELECT g, t, s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g
        ORDER BY t ASC NULLS FIRST, s ASC NULLS FIRST) rn FROM t) WHERE rn = 1"""))
    assert rows(top1_per_group(df, ["g"], ["t", "s"])) == want
    want_desc = rows(spark.sql("""SELECT g, t, s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g
        ORDER BY t DESC NULLS LAST, s DESC NULLS LAST) rn FROM t) WHERE rn = 1"""))
    assert rows(top1_per_group(df, ["g"], ["t", "s"], descending=True)) == want_desc


def test_with_total_count_no_single_partition_window(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 3)
    out = with_total_count(df, "n")
    assert {r.n for r in out.collect()} == {100}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_any_of_equals_full_outer_chain(spark):
    random.seed(4)
    srcs = [spark.createDataFrame([(random.choice(["a", "b", "c", "d", None]),) for _ in range(6)],
                                  "customer_id string") for _ in range(3)]
    for i, s in enumerate(srcs):
        s.distinct().createOrReplaceTempView(f"s{i}")
    want = rows(spark.sql("""SELECT DISTINCT COALESCE(s0.customer_id, s1.customer_id, s2.customer_id)
        FROM s0 FULL OUTER JOIN s1 ON s0.customer_id = s1.customer_id
        FULL OUTER JOIN s2 ON s0.customer_id = s2.customer_id"""))
    want.pop((None,), None)
    assert rows(any_of(srcs, "customer_id")) == want
