import pytest
from pyspark.sql import functions as F

from touchpoint.functions import (
    channel_grouping,
    classify_click_url,
    event_param,
    extract_utm,
    normalize_mapped_phone,
    normalize_phone,
    page_class,
)

PHONES = [
    ("0812", "62812"), ("+62812", "62812"), ("812", "62812"),
    ("O812", "62812"), ("0812 34", "62081234"), ("+62 812", "62+62812"),
    ("62-0812", "62"), ("+620812", "62"), ("+0812", "620812"),
    ("", "62"), (None, None), ("62812", "62812"),
]


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_normalize_phone_reference_rules(spark):
    got = col1(spark, [p for p, _ in PHONES], normalize_phone)
    assert got == [e for _, e in PHONES]


def test_normalize_phone_clean_mode(spark):
    got = col1(spark, ["0812-34", "+62 812", "620812", "812", "", None],
               lambda c: normalize_phone(c, "clean"))
    assert got == ["6281234", "62812", "62812", "62812", None, None]


def test_normalize_phone_identity_on_clean_numbers(spark):
    nums = ["62812345", "6281", "62999"]
    assert col1(spark, nums, normalize_phone) == nums


def test_normalize_mapped_phone(spark):
    assert col1(spark, ["6262812", "62812", None], normalize_mapped_phone) == [
        "62812", "62812", None,
    ]


UTM_CASES = [
    ("https://x/p?utm_source=fb&utm_medium=cpc&utm_campaign=c1&utm_content=ad&gclid=1",
     ("fb", "cpc", "c1", "ad")),
    ("https://x/p?utm_source=fb", ("fb", None, None, None)),
    ("https://x/p?utm_source=&utm_medium=m", ("", "m", None, None)),
    ("https://x/p?a=1&utm_source=fb", (None, None, None, None)),  # safe form: NULL
    ("https://x/p?utm_source=a?utm_source=b&utm_medium=z", ("a", "z", None, None)),
    ("https://x/p?ref=home", ("!Non-Paid", None, None, None)),
    (None, ("!Non-Paid", None, None, None)),
]


def test_extract_utm_safe(spark):
    df = spark.createDataFrame([(u,) for u, _ in UTM_CASES], "url string")
    got = [tuple(r) for r in df.select(*extract_utm("url")).collect()]
    assert got == [e for _, e in UTM_CASES]


def test_extract_utm_strict_raises(spark):
    df = spark.createDataFrame([("https://x/p?a=1&utm_source=fb",)], "url string")
    with pytest.raises(Exception):
        df.select(*extract_utm("url", strict=True)).collect()


def test_channel_grouping(spark):
    mediums = ["(none)", "organic", "referral", "cpc", "ppc", "cpm", "email", "social",
               "video", None, "xyz", "cpc email"]
    assert col1(spark, mediums, channel_grouping) == [
        "Direct", "Organic", "Referral", "Paid Search/Display", "Paid Search/Display",
        "Paid Search/Display", "Email", "Organic Social", "Organic Video", "Null Medium",
        "Unassigned", "Paid Search/Display",
    ]


def test_classify_click_url(spark):
    urls = [
        "https://s/sg-en?next=/account/forget-password",
        "https://s/sg-en", "https://s/sg-en?x=1",
        "https://s/sg-en/contactus/contact-us", "https://s/sg-en/account/sign-in",
        "https://s/sg-en/other", None,
    ]
    assert col1(spark, urls, classify_click_url) == [
        "Forget password", "Homepage", "Homepage", "Download Catalogue", "Log-in page",
        "Social Media", "Social Media",
    ]


def test_page_class(spark):
    assert col1(spark, ["/serena/x", "/kicks", "/livina", None], page_class) == [
        "Type 1", "Type 2", "Type 3", "Type 3",
    ]


def test_event_param(spark):
    df = spark.sql(
        """SELECT array(named_struct('key','page_location','value',named_struct('string_value','u','int_value',CAST(NULL AS BIGINT))),
                        named_struct('key','ga_session_id','value',named_struct('string_value',CAST(NULL AS STRING),'int_value',7L)),
                        named_struct('key','ga_session_id','value',named_struct('string_value',CAST(NULL AS STRING),'int_value',8L))) AS event_params"""
    )
    r = df.select(
        event_param("page_location"), event_param("ga_session_id", "int"), event_param("nope")
    ).first()
    assert tuple(r) == ("u", 7, None)
    with pytest.raises(Exception):
        df.select(event_param("ga_session_id", "int", strict=True)).collect()
