"""Rule-based classifiers: default channel grouping, journey click type, car type.

Each is an ordered ``CASE`` (first match wins) built from the fixed rule lists
below, so it compiles to one JVM expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel grouping of a traffic medium, in order; regex "contains",
# case-sensitive. After the list: NULL medium -> 'Null Medium', else 'Unassigned'.
CHANNEL_RULES = [
    ("(none)", "Direct"),
    ("(organic)", "Organic"),
    ("(referral)", "Referral"),
    ("(cpc|ppc|cpm)", "Paid Search/Display"),
    ("(email)", "Email"),
    ("(social)", "Organic Social"),
    ("(video)", "Organic Video"),
]
CHANNEL_NULL = "Null Medium"
CHANNEL_OTHER = "Unassigned"

# Journey click classes by URL, in order; SQL LIKE patterns
# (any pattern of a class matches). Everything else, NULL included: 'Social Media'.
CLICK_RULES = [
    ("Forget password", ["%account/forget-password%"]),
    ("Homepage", ["%/sg-en?%", "%/sg-en"]),
    ("Download Catalogue", ["%/sg-en/contactus/contact-us%"]),
    ("Log-in page", ["%/sg-en/account/sign-in%"]),
]
CLICK_OTHER = "Social Media"
CLICK_TYPES = [name for name, _ in CLICK_RULES] + [CLICK_OTHER]

# Car type of a page URL, in order; regex "contains".
PAGE_CLASS_RULES = [
    ("(serena|terra)", "Type 1"),
    ("(magnite|kicks)", "Type 2"),
]
PAGE_CLASS_OTHER = "Type 3"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def channel_grouping(medium: Column | str) -> Column:
    m = _c(medium)
    expr = None
    for pattern, label in CHANNEL_RULES:
        cond = m.rlike(pattern)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.when(m.isNull(), CHANNEL_NULL).otherwise(CHANNEL_OTHER)


def classify_click_url(url: Column | str) -> Column:
    u = _c(url)
    expr = None
    for label, patterns in CLICK_RULES:
        cond = None
        for pat in patterns:
            c = u.like(pat)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(CLICK_OTHER)


def page_class(page: Column | str) -> Column:
    p = _c(page)
    expr = None
    for pattern, label in PAGE_CLASS_RULES:
        cond = p.rlike(pattern)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(PAGE_CLASS_OTHER)
