"""Lookup of one key in the repeated ``event_params`` key/value list.

The list is an array of ``struct<key, value struct<string_value, int_value>>``;
keys may repeat, so it is not a map. ``event_param`` returns the value of the first
entry with the key (NULL when absent); ``strict=True`` fails the query instead when
the key occurs more than once, like a scalar subquery over the array would.

Scale note: a higher-order ``filter`` over the array cannot be column-pruned at
the Parquet scan (the whole struct array is read). Pipelines that need several
parameters extract them once into flat columns (see
``touchpoint.sources.tables.flatten_events``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = {"string": "string_value", "int": "int_value"}


def event_param(
    key: str,
    kind: str = "string",
    params: Column | str = "event_params",
    strict: bool = False,
) -> Column:
    arr = F.col(params) if isinstance(params, str) else params
    hits = F.filter(arr, lambda p: p["key"] == F.lit(key))
    value = F.get(hits, 0)["value"][_KINDS[kind]]
    if strict:
        return F.when(
            F.size(hits) > 1,
            F.raise_error(F.lit(f"event_params: key {key!r} occurs more than once")),
        ).otherwise(value)
    return value


def param_column(df, key: str, kind: str = "string") -> Column:
    """``key`` from a flattened ("silver") events table when it has that column,
    else looked up in ``event_params``. Flat columns are pruned at the scan; the
    nested list is read whole."""
    if key in df.columns:
        return F.col(key)
    return event_param(key, kind)


# flat column -> place in the raw export
RAW_LEAVES = {
    "hostname": "device.web_info.hostname",
    "traffic_medium": "traffic_source.medium",
    "manual_medium": "collected_traffic_source.manual_medium",
    "gclid": "collected_traffic_source.gclid",
    "dclid": "collected_traffic_source.dclid",
    "srsltid": "collected_traffic_source.srsltid",
}


def leaf_column(df, name: str) -> Column:
    """A leaf of the raw export, or its column in the flat layout."""
    return F.col(name) if name in df.columns else F.col(RAW_LEAVES[name])


def values_column(df, key: str) -> Column:
    """All string values of ``key``, one per entry: the flat layout's ``<key>s`` column, or
    the entries of ``event_params``."""
    if f"{key}s" in df.columns:
        return F.col(f"{key}s")
    return all_values(key)


def all_values(key: str, params: str = "event_params") -> Column:
    hits = F.filter(F.col(params), lambda p: p["key"] == F.lit(key))
    return F.transform(hits, lambda p: p["value"]["string_value"])
