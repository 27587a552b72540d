"""Randomised checks of the column rules against plain-Python statements of the
specified behaviour (one Spark job per property; seeds are fixed)."""

import random
import re

from pyspark.sql import functions as F

from touchpoint.functions import channel_grouping, extract_utm, normalize_phone
from touchpoint.functions.classify import CHANNEL_RULES


def py_phone(p):
    if p is None:
        return None
    if " " in p:
        s = p
    elif p.startswith("0"):
        s = "62" + p[1:]
    elif p.startswith("62"):
        s = p
    elif p.startswith("+"):
        s = p[1:]
    else:
        s = "62" + p
    s = s.strip().replace(" ", "").replace("O", "").replace("-", "")
    a = "62" if s.startswith("620") else s
    b = a if a.startswith("62") else "62" + a
    return "62" + b[2:] if b.startswith("620") else b


def py_utm(url):
    spec = [("utm_source", "?utm_source=", "&utm_medium"),
            ("utm_medium", "&utm_medium=", "&utm_campaign"),
            ("utm_campaign", "&utm_campaign=", "&utm_content"),
            ("utm_content", "&utm_content=", "&")]
    out = []
    for word, start, end in spec:
        if url is None or word not in url:
            out.append("!Non-Paid" if word == "utm_source" else None)
            continue
        parts = url.split(start)
        out.append(parts[1].split(end)[0] if len(parts) > 1 else None)
    return tuple(out)


def py_channel(m):
    if m is None:
        return "Null Medium"
    for pattern, label in CHANNEL_RULES:
        if re.search(pattern, m):
            return label
    return "Unassigned"


def test_phone_rule_matches_specification(spark):
    rnd = random.Random(7)
    alphabet = "0126789+ O-"
    cases = [None, ""] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9)))
                          for _ in range(600)]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = [r[0] for r in df.select(normalize_phone("p")).collect()]
    assert got == [py_phone(c) for c in cases]


def test_phone_rule_is_identity_on_clean_numbers(spark):
    rnd = random.Random(8)
    nums = ["62" + rnd.choice("123456789") + "".join(rnd.choice("0123456789")
            for _ in range(rnd.randint(0, 10))) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in nums], "p string")
    assert [r[0] for r in df.select(normalize_phone("p")).collect()] == nums


def test_utm_cut_matches_specification(spark):
    rnd = random.Random(9)
    pieces = ["?utm_source=", "&utm_medium=", "&utm_campaign=", "&utm_content=", "&",
              "utm_source", "?", "fb", "cpc", "c1", "ad", "x=1", "#top", "=", "/p"]
    cases = [None] + ["https://s" + "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))
                      for _ in range(600)]
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    got = [tuple(r) for r in df.select(*extract_utm("u")).collect()]
    assert got == [py_utm(c) for c in cases]


def test_channel_grouping_matches_specification(spark):
    rnd = random.Random(10)
    words = ["none", "(none)", "organic", "referral", "cpc", "ppc", "cpm", "email", "social",
             "video", "Social", "CPC", "x", " ", "-"]
    cases = [None] + ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 3)))
                      for _ in range(400)]
    df = spark.createDataFrame([(c,) for c in cases], "m string")
    got = [r[0] for r in df.select(channel_grouping(F.col("m"))).collect()]
    assert got == [py_channel(c) for c in cases]
