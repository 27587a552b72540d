import pytest
from pyspark.sql import functions as F

from touchpoint.sources import fixtures as FX
from touchpoint.sources.registry import Registry

SF = "/root/testdata/sf0.001"


def test_bound_by_name(spark, scratch):
    names = Registry()
    names.bind("project.web.`web_events`", FX.ga_events(spark, SF).withColumn("more", F.lit(1)))
    assert "more" in names["web_events"].columns
    FX.phone_map(spark, SF).write.parquet(f"{scratch}/map")
    names.bind_path(spark, "phone_map", f"{scratch}/map")
    assert names["x.Phone_Map"].count() == FX.phone_map(spark, SF).count()


def test_wrong_tables_are_refused_when_bound(spark):
    names = Registry()
    with pytest.raises(TypeError, match="phone_no: bigint instead of string"):
        names.bind("phone_map", spark.createDataFrame([("u", 1)], "user_pseudo_id string, phone_no long"))
    with pytest.raises(TypeError, match="phone_no: missing"):
        names.bind("phone_map", spark.createDataFrame([("u",)], "user_pseudo_id string"))
    with pytest.raises(TypeError, match="event_params"):
        names.bind("web_events", FX.ga_events(spark, SF).withColumn("event_params", F.lit("x")))
    with pytest.raises(TypeError, match=r"event_params\[\]"):
        names.bind("web_events", FX.ga_events(spark, SF).withColumn("event_params", F.array(F.struct(F.lit("k").alias("key")))))
    with pytest.raises(KeyError):
        names.bind("nothing", FX.phone_map(spark, SF))
    with pytest.raises(KeyError, match="not bound"):
        names["phone_map"]
