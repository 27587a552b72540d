"""Logical table schemas.

The operators are written against these shapes (web-analytics export events,
lead-form submissions, the user->phone mapping, journey clicks, audiences).
Production readers apply them with ``spark.read.schema(...)``: no inference.
Timestamps are zone-less (``timestamp_ntz``) and hold UTC wall-clock values unless
the column name says ``local``.
"""

from pyspark.sql import types as T

PARAM_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
    ]
)

EVENT_PARAM = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", PARAM_VALUE)]
)

# Web-analytics export, one partition per `event_date` (yyyyMMdd text).
EVENTS = T.StructType(
    [
        T.StructField("event_date", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),  # microseconds since epoch
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("event_params", T.ArrayType(EVENT_PARAM)),
        T.StructField(
            "device",
            T.StructType(
                [
                    T.StructField(
                        "web_info",
                        T.StructType([T.StructField("hostname", T.StringType())]),
                    )
                ]
            ),
        ),
        T.StructField(
            "traffic_source", T.StructType([T.StructField("medium", T.StringType())])
        ),
        T.StructField(
            "collected_traffic_source",
            T.StructType(
                [
                    T.StructField("manual_medium", T.StringType()),
                    T.StructField("gclid", T.StringType()),
                    T.StructField("dclid", T.StringType()),
                    T.StructField("srsltid", T.StringType()),
                ]
            ),
        ),
    ]
)

# The same events with the parameters and leaves the operators use as flat columns.
# `page_locations` keeps every page_location entry, NULL values included.
FLAT_EVENTS = T.StructType(
    [
        T.StructField("event_date", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("page_location", T.StringType()),
        T.StructField("ga_session_id", T.LongType()),
        T.StructField("medium", T.StringType()),
        T.StructField("page_locations", T.ArrayType(T.StringType())),
        T.StructField("hostname", T.StringType()),
        T.StructField("traffic_medium", T.StringType()),
        T.StructField("manual_medium", T.StringType()),
        T.StructField("gclid", T.StringType()),
        T.StructField("dclid", T.StringType()),
        T.StructField("srsltid", T.StringType()),
    ]
)

LEAD_CUSTOMER = T.StructType(
    [
        T.StructField("fullname", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("estimated_buying_time", T.StringType()),
        T.StructField("referer", T.StringType()),
    ]
)

# Lead-form submissions (test drive / brochure download / offer).
LEADS = T.StructType(
    [
        T.StructField("customer", LEAD_CUSTOMER),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("car_name", T.StringType()),
        T.StructField("dealer_name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

PHONE_MAP = T.StructType(
    [
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("phone_no", T.StringType()),
    ]
)

# Sink of attributed leads; created_at is local time (lead time zone).
MATCHED_LEADS = T.StructType(
    [
        T.StructField("fullname", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("estimated_buying_time", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("car_name", T.StringType()),
        T.StructField("dealer_name", T.StringType()),
        T.StructField("utm_source", T.StringType()),
        T.StructField("utm_medium", T.StringType()),
        T.StructField("utm_campaign", T.StringType()),
        T.StructField("utm_content", T.StringType()),
    ]
)

USER_LINK = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
    ]
)

CLICKS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("story_id", T.StringType()),
        T.StructField("click_url", T.StringType()),
        T.StructField("tracked_time", T.TimestampNTZType()),
    ]
)

JOURNEY = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("story_id", T.StringType()),
        T.StructField("tracking_type", T.StringType()),
        T.StructField("location_url", T.StringType()),
        T.StructField("tracked_date", T.TimestampNTZType()),
    ]
)

ACTIVITY = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("tracked_time", T.TimestampNTZType()),
    ]
)

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

ADS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("campaign_name", T.StringType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("clicks_all", T.LongType()),
    ]
)
