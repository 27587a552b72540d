"""Exactly-once loads: dead, repeated and racing loads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchpoint.operators import attribution as A
from touchpoint.operators import ledger as L
from touchpoint.plans import catalog as C
from touchpoint.session import shared_folder
from touchpoint.sources import fixtures as FX
from touchpoint.sources.schemas import MATCHED_LEADS

SF = "/root/testdata/sf0.001"


def lead(k, day=5):
    return (f"n{k}", "c", None if k % 3 == 0 else f"62{k}", "e", "b", dt.datetime(2024, 1, day, k % 24), "car", "d", "google", None, None, None)


@pytest.fixture()
def leads(spark):
    return lambda ks, day=5: spark.createDataFrame([lead(k, day) for k in ks], MATCHED_LEADS)


def names(spark, root):
    return sorted(r["fullname"] for r in L.read_published(spark, root).collect())


def test_nothing_is_there_before_the_first_load(spark, scratch):
    assert L.read_published(spark, f"{scratch}/s").count() == 0 and L.read_ledger(spark, f"{scratch}/s").count() == 0
    assert L.unpublished(spark, f"{scratch}/s").count() == 0


def test_a_load_that_dies_before_its_publish_leaves_no_row(spark, scratch, leads):
    root = f"{scratch}/s"
    L.append_once(leads(range(4)), root, "a")
    dead = L.stage(leads(range(10, 30)), root, "b")
    assert names(spark, root) == ["n0", "n1", "n2", "n3"]
    assert [(r["batch_id"], r["attempt"], r["n_rows"]) for r in L.unpublished(spark, root).collect()] == [("b", dead, 20)]
    assert L.append_once(leads(range(10, 13)), root, "b")  # run again, with a new attempt
    assert names(spark, root) == ["n0", "n1", "n10", "n11", "n12", "n2", "n3"]


def test_a_load_that_dies_while_it_writes_leaves_no_row(spark, scratch, leads):
    root = f"{scratch}/s"
    broken = leads(range(40)).withColumn("email", F.when(F.col("fullname") == "n17", F.raise_error(F.lit("lost"))).otherwise(F.col("email")))
    with pytest.raises(Exception, match="lost"):
        L.append_once(broken, root, "a")
    assert names(spark, root) == [] and not L.is_published(spark, root, "a")
    assert L.append_once(leads(range(2)), root, "a") and names(spark, root) == ["n0", "n1"]


def test_replays_and_races_add_nothing(spark, scratch, leads):
    root = f"{scratch}/s"
    assert L.append_once(leads(range(4)), root, "a")
    assert not L.append_once(leads(range(4)), root, "a")
    # two runs of one batch that both find it unpublished
    one, two = L.stage(leads([7]), root, "b"), L.stage(leads([7]), root, "b")
    L.publish(spark, root, "b", one)
    L.publish(spark, root, "b", two)
    assert names(spark, root) == ["n0", "n1", "n2", "n3", "n7"]
    assert L.read_ledger(spark, root).count() == 2 and L.unpublished(spark, root).count() == 1


def test_ledger_rows(spark, scratch, leads):
    root = f"{scratch}/s"
    w = A.lookback_window(dt.date(2024, 1, 31), 18)
    L.append_once(leads(range(30), 5).unionByName(leads(range(50, 60), 7)), root, "a", w)
    L.append_once(leads([]), root, "none", w)
    got = {r["batch_id"]: r for r in L.read_ledger(spark, root).collect()}
    assert (got["a"]["n_rows"], got["a"]["first_day"], got["a"]["last_day"]) == (40, dt.date(2024, 1, 5), dt.date(2024, 1, 7))
    assert (got["a"]["window_from"], got["a"]["window_to"]) == (w.lower, w.upper)
    assert sum(f["n_rows"] for f in got["a"]["files"]) == 40 and len({f["file"] for f in got["a"]["files"]}) == len(got["a"]["files"]) > 1
    assert got["none"]["n_rows"] == 0 and got["none"]["files"] == []


def test_many_batches_are_joined_instead_of_listed(spark, scratch, leads, monkeypatch):
    root = f"{scratch}/s"
    for k in range(4):
        L.append_once(leads([k]), root, f"b{k}")
    L.stage(leads([9]), root, "b9")
    listed = names(spark, root)
    monkeypatch.setattr(L, "LISTED_BATCHES", 2)
    assert names(spark, root) == listed == ["n0", "n1", "n2", "n3"]


def test_only_published_folders_are_read(spark, scratch, leads):
    root = f"{scratch}/s"
    L.append_once(leads([1]), root, "a")
    plan = L.read_published(spark, root).where("created_date = DATE'2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "attempt" in plan.partition("PartitionFilters")[2].split("]")[0] and "created_date" in plan.partition("PartitionFilters")[2]


def test_load_once(spark, scratch):
    root = f"{scratch}/s"
    inp = A.AttributionInputs(FX.test_drive_leads(spark, SF), FX.ga_events(spark, SF), FX.phone_map(spark, SF))
    window, wrote = L.load_once(spark, inp, root, C.AS_OF, C.LOOKBACK_DAYS)
    first = L.read_published(spark, root)
    n = first.count()
    assert wrote and n > 0 and window == A.lookback_window(C.AS_OF, C.LOOKBACK_DAYS)
    assert first.where("fullname IS NULL OR phone IS NULL OR email IS NULL OR city IS NULL").count() > 0
    assert L.load_once(spark, inp, root, C.AS_OF, C.LOOKBACK_DAYS) == (window, False)
    assert L.read_published(spark, root).count() == n  # leads with NULL columns too
    # by watermark, read off the ledger: nothing newer than the newest lead
    plan = L.watermark(spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "dealer_name" not in plan and L.watermark(spark, root).first()["newest"] == first.agg(F.max("created_at")).first()[0]
    later, wrote = L.load_once(spark, inp, root, C.AS_OF, None)
    assert later.lower == first.agg(F.max("created_at")).first()[0] and L.read_published(spark, root).count() == n


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(Session)
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://x/ckpt/")
    assert shared_folder(Session) == "hdfs://x/ckpt"
