from datetime import datetime

import pytest
from pyspark.sql import functions as F

from censusflow import functions as fn


def values(spark, make, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


TIMES = {
    "2024-01-15T10:00:00Z": datetime(2024, 1, 15, 10),
    "2024-01-15T10:00:00+00:00": datetime(2024, 1, 15, 10),
    "2024-01-15T10:00:00-05:30": datetime(2024, 1, 15, 15, 30),
    "2024-01-15T10:00:00.123456789Z": datetime(2024, 1, 15, 10, 0, 0, 123456),
    "2024-01-15T10:00:00.5Z": datetime(2024, 1, 15, 10, 0, 0, 500000),
    "2024-01-15T10:00:00,5Z": datetime(2024, 1, 15, 10, 0, 0, 500000),
    "2024-01-15T9:00:00Z": datetime(2024, 1, 15, 9),
    "2024-01-15T10:00:00": datetime(2024, 1, 15, 10),
    "2024-01-15T10:00:00.25": datetime(2024, 1, 15, 10, 0, 0, 250000),
    "2024-01-15 10:00:00 +0000 UTC": datetime(2024, 1, 15, 10),
    "2024-01-15 10:00:00.5 +0000 UTC": datetime(2024, 1, 15, 10, 0, 0, 500000),
    "2024-01-15 10:00:00Z": datetime(2024, 1, 15, 10),
    " 2024-01-15 ": datetime(2024, 1, 15),
    "01/15/2024": datetime(2024, 1, 15),
}
MISSING = (
    "2024-01-15 10:00:00|1/5/2024|2024-02-30|2024-1-5|2024|2024-01|garbage|0|N/A||2024-01-15T10:00:60Z|2024-01-15T24:00:00Z|"
    "2024-01-15T10:00Z|2024-01-15t10:00:00z|2024-01-15T10:00:00+0000|0001-01-01T00:00:00Z|13/45/2024"
).split("|")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert values(spark, fn.parse_time, list(TIMES)) == list(TIMES.values())
        assert values(spark, fn.parse_time, [*MISSING, None]) == [None] * (len(MISSING) + 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_texts(spark):
    assert values(spark, fn.trimmed, ["\t x　\u0085", "a b", None, ""]) == ["x", "a b", "", ""]
    assert values(spark, lambda c: fn.strip_tier(fn.alias_base(c)), ["a-t0-t1", "@x", "-t0", "a-T0", "a-t1\n", "a-t3", "bob-t2@corp"]) == ["a-t0", "", "", "a-T0", "a-t1\n", "a-t3", "bob"]
    assert values(spark, fn.client_type, ["Entity Client", "NON_ENTITY", "secrets sync", "", " ", "certificate", "New"]) == ["entity", "non-entity", "secret-sync", "unknown", "unknown", "certificate", "new"]
    assert values(spark, fn.base_name, ["/a/b.csv", "b.csv", "", "/a/b/", "/"]) == ["b.csv", "b.csv", ".", "b", "/"]
    assert values(spark, lambda c: fn.shown_time(fn.parse_time(c)), ["2024-01-15", ""]) == ["2024-01-15 00:00:00Z", "—"]
    assert fn.client_type_value(" ") == "unknown" and fn.client_type_value("Non-Entity Client") == "non-entity"
