import datetime as dt

import pytest

from touchpoint.operators import attribution as A
from touchpoint.operators.incremental import load_new_leads, read_sink
from touchpoint.operators.quality import NO_DATA, assert_fresh, freshness_check
from touchpoint.plans import catalog as C
from touchpoint.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_freshness_sentinel_and_assert(spark):
    offers = FX.offer_leads(spark, SF)
    fresh = freshness_check(offers, dt.date(2001, 8, 2), 3)
    assert all(r.total_row != NO_DATA for r in fresh.collect())
    assert_fresh(fresh)  # does not raise
    stale = freshness_check(offers, dt.date(2030, 1, 1), 3).collect()
    assert len(stale) == 1 and stale[0].total_row == NO_DATA and stale[0].car_name is None
    with pytest.raises(Exception):
        assert_fresh(freshness_check(offers, dt.date(2030, 1, 1), 3))


def test_incremental_load_is_idempotent(spark, scratch):
    sink = f"{scratch}/sink"
    inp = A.AttributionInputs(FX.test_drive_leads(spark, SF), FX.ga_events(spark, SF),
                              FX.phone_map(spark, SF))
    load_new_leads(spark, inp, sink, C.AS_OF, C.LOOKBACK_DAYS)
    first = read_sink(spark, sink).count()
    assert first > 0
    load_new_leads(spark, inp, sink, C.AS_OF, C.LOOKBACK_DAYS)
    loaded = read_sink(spark, sink)
    key_cols = A.LOADED_KEYS
    with_null = loaded.where(" OR ".join(f"{k} IS NULL" for k in key_cols)).count()
    # a second run only re-appends leads with a NULL identifying column
    assert loaded.count() == first + with_null // 2


def test_watermark_load_appends_nothing_new(spark, scratch):
    sink = f"{scratch}/sink"
    inp = A.AttributionInputs(FX.test_drive_leads(spark, SF), FX.ga_events(spark, SF),
                              FX.phone_map(spark, SF))
    # empty sink and no bootstrap: nothing is loaded
    assert load_new_leads(spark, inp, sink, C.AS_OF, None).lower is None
    assert read_sink(spark, sink).count() == 0
    load_new_leads(spark, inp, sink, C.AS_OF, C.LOOKBACK_DAYS)
    n = read_sink(spark, sink).count()
    load_new_leads(spark, inp, sink, C.AS_OF, None)
    assert read_sink(spark, sink).count() == n  # nothing newer than the watermark


def test_null_safe_load_appends_each_lead_once(spark, scratch):
    sink = f"{scratch}/sink"
    inp = A.AttributionInputs(FX.test_drive_leads(spark, SF), FX.ga_events(spark, SF),
                              FX.phone_map(spark, SF))
    window = load_new_leads(spark, inp, sink, C.AS_OF, C.LOOKBACK_DAYS, null_safe=True)
    assert window == A.lookback_window(C.AS_OF, C.LOOKBACK_DAYS)
    n = read_sink(spark, sink).count()
    load_new_leads(spark, inp, sink, C.AS_OF, C.LOOKBACK_DAYS, null_safe=True)
    assert read_sink(spark, sink).count() == n


def test_freshness_rows_are_newest_first(spark):
    rows = [r.created_at for r in freshness_check(FX.offer_leads(spark, SF), dt.date(1998, 1, 1), 900).collect()]
    assert len(rows) > 10 and rows == sorted(rows, reverse=True)
