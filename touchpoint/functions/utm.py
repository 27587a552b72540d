"""Campaign (UTM) parameters cut out of a page URL.

The cut is purely textual and assumes the parameter order source, medium, campaign,
content. "After ``d``" means the text between the first and the second occurrence
of ``d``; "up to ``e``" means the text before the first ``e``. Nothing is URL-decoded.

* field word absent from the URL -> source ``'!Non-Paid'``, other fields NULL;
* word present but its delimiter absent -> NULL (``strict=False``) or a query
  error (``strict=True``, the behaviour of a strict array offset).

All cuts use ``instr``/``substring_index`` (literal, no regex), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field name, presence word, start delimiter, end delimiter.
UTM_FIELDS = [
    ("utm_source", "utm_source", "?utm_source=", "&utm_medium"),
    ("utm_medium", "utm_medium", "&utm_medium=", "&utm_campaign"),
    ("utm_campaign", "utm_campaign", "&utm_campaign=", "&utm_content"),
    ("utm_content", "utm_content", "&utm_content=", "&"),
]
# Marker for "no campaign parameters". The leading '!' sorts it below every
# real source under binary string order, so MAX prefers any paid source.
NON_PAID_MARK = "!Non-Paid"
NON_PAID = "Non-Paid"


def _between(url: Column, start: str, end: str, strict: bool, name: str) -> Column:
    second_piece = F.substring_index(
        F.substring_index(url, start, 2), start, -1
    )  # text between 1st and 2nd occurrence of `start`
    cut = F.substring_index(second_piece, end, 1)
    missing = (
        F.raise_error(F.lit(f"{name}: delimiter {start!r} not found in URL")).cast(
            "string"
        )
        if strict
        else F.lit(None).cast("string")
    )
    return F.when(F.instr(url, start) > 0, cut).otherwise(missing)


def utm_field(url: Column | str, field: str, strict: bool = False) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    for name, word, start, end in UTM_FIELDS:
        if name == field:
            value = _between(u, start, end, strict, name)
            absent = (
                F.lit(NON_PAID_MARK) if name == "utm_source" else F.lit(None).cast("string")
            )
            return F.when(u.contains(word), value).otherwise(absent)
    raise ValueError(f"unknown UTM field {field!r}")


def extract_utm(url: Column | str, strict: bool = False) -> list[Column]:
    """The four UTM columns, aliased ``utm_source .. utm_content``."""
    return [utm_field(url, name, strict).alias(name) for name, *_ in UTM_FIELDS]


def display_source(source: Column | str) -> Column:
    """``'!Non-Paid'`` -> ``'Non-Paid'`` for reporting; other values unchanged."""
    s = F.col(source) if isinstance(source, str) else source
    return F.when(s == NON_PAID_MARK, F.lit(NON_PAID)).otherwise(s)


def is_non_paid(source: Column | str) -> Column:
    """1 for the no-UTM marker, else 0 (NULL source counts as paid)."""
    s = F.col(source) if isinstance(source, str) else source
    return F.when(s == NON_PAID_MARK, F.lit(1)).otherwise(F.lit(0))
