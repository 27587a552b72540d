"""Indonesian phone-number cleanup used to link lead forms to web users.

``normalize_phone`` reproduces the two-step rule of the lead pipeline exactly,
including its quirks (numbers that start ``620`` after step 1 collapse to ``62``;
numbers with an inner space keep their leading ``0``). ``mode="clean"`` is the
intended behaviour: keep digits, map ``0...``/``620...`` to ``62...``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rule: country code, characters removed after step 1.
COUNTRY_CODE = "62"
STRIPPED_CHARS = " O-"


def _cc(c: Column) -> Column:
    return F.concat(F.lit(COUNTRY_CODE), c)


def _rest(c: Column, start: int) -> Column:
    # 1-based substring to the end of the text
    return F.substring(c, start, 1 << 30)


def normalize_phone(col: Column | str, mode: str = "reference") -> Column:
    p = F.col(col) if isinstance(col, str) else col
    if mode == "clean":
        d = F.nullif(F.regexp_replace(p, "[^0-9]", ""), F.lit(""))
        d = F.regexp_replace(F.regexp_replace(d, "^620", COUNTRY_CODE), "^0", COUNTRY_CODE)
        return F.regexp_replace(d, "^(?!62)", COUNTRY_CODE)
    if mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    # Step 1 (numbers without a space; first rule wins): starts '0' -> '62' + rest,
    # starts '62' -> unchanged, starts '+' -> drop it, otherwise -> '62' + number.
    # Written as anchored rewrites so the input is read once per step (a nested
    # CASE would copy the input expression dozens of times into generated code).
    step1 = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(p, r"^(?![0+]|62)", COUNTRY_CODE), "^0", COUNTRY_CODE),
        r"^\+",
        "",
    )
    step1 = F.when(p.contains(" "), p).otherwise(step1)
    s = F.translate(F.regexp_replace(step1, r"^\s+|\s+$", ""), STRIPPED_CHARS, "")
    # Step 2: a number starting '620' is replaced by '62'; others get '62' prefixed
    # unless they already start with it.
    a = F.regexp_replace(s, r"(?s)^620.*", COUNTRY_CODE)
    return F.regexp_replace(a, r"^(?!62)", COUNTRY_CODE)


def normalize_mapped_phone(col: Column | str) -> Column:
    """Phones in the user->phone mapping table may carry the code twice."""
    p = F.col(col) if isinstance(col, str) else col
    return F.when(p.startswith(COUNTRY_CODE * 2), _cc(_rest(p, 5))).otherwise(p)
