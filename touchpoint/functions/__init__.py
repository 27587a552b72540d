"""Column-level functions (``Column -> Column``), all built-in expressions."""

from touchpoint.functions.classify import (
    CHANNEL_RULES,
    CLICK_TYPES,
    channel_grouping,
    classify_click_url,
    page_class,
)
from touchpoint.functions.params import event_param
from touchpoint.functions.phone import normalize_mapped_phone, normalize_phone
from touchpoint.functions.timeutil import (
    local_to_utc,
    micros_to_ntz,
    ntz_lit,
    ntz_to_micros,
    to_local,
)
from touchpoint.functions.utm import (
    NON_PAID,
    NON_PAID_MARK,
    display_source,
    extract_utm,
    is_non_paid,
    utm_field,
)

__all__ = [
    "CHANNEL_RULES",
    "CLICK_TYPES",
    "NON_PAID",
    "NON_PAID_MARK",
    "channel_grouping",
    "classify_click_url",
    "display_source",
    "event_param",
    "extract_utm",
    "is_non_paid",
    "local_to_utc",
    "micros_to_ntz",
    "normalize_mapped_phone",
    "normalize_phone",
    "ntz_lit",
    "ntz_to_micros",
    "page_class",
    "to_local",
    "utm_field",
]
