"""One-pass touch segments against the rule in plain Python."""

import random
from collections import Counter

from touchpoint.operators.audience import segment_counts, touch_segments

TYPES = ["Forget password", "Homepage", "Download Catalogue", "Log-in page", "Social Media"]


def segments(journey, active):
    """Customers per segment, by the rule: one listed type alone (and no unknown customer
    with another type, which a NOT IN list cannot rule out), or several listed types."""
    known = {c for c, _ in active if c is not None}
    unknown = {t for c, t in journey if c is None and t is not None}
    count = Counter()
    for c in known:
        clicked = {t for who, t in journey if who == c and t is not None}
        listed = clicked & set(TYPES)
        if len(listed) > 1:
            count["Multiple Visit"] += 1
        elif len(clicked) == 1 and listed and not unknown - listed:
            count[listed.pop()] += 1
    return dict(count)


def test_segments_on_random_inputs(spark):
    for seed in range(8):
        rnd = random.Random(seed)
        cust = [None, "c1", "c2", "c3", "c4", "c5", "c6"]
        types = TYPES + ["Other", None]
        j = [(rnd.choice(cust), rnd.choice(types if seed % 2 else TYPES)) for _ in range(25)]
        if seed % 3 == 0:
            j = [r for r in j if r[0] is not None]
        act = [(c, rnd.choice(["s1", "s2"])) for c in cust[1:] if rnd.random() < 0.8]
        jd = spark.createDataFrame(j, "customer_id string, tracking_type string")
        ad = spark.createDataFrame(act, "customer_id string, story_id string")
        assert {r[0]: r[1] for r in segment_counts(jd, ad).collect()} == segments(j, act), seed


def test_segment_null_customer_blocks_other_types(spark):
    j = spark.createDataFrame([("c1", "Homepage"), (None, "Social Media")],
                              "customer_id string, tracking_type string")
    a = spark.createDataFrame([("c1", "s")], "customer_id string, story_id string")
    assert touch_segments(j, a).count() == 0
