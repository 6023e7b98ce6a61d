"""Ordering: one key ascending, missing times first, ties in input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusflow.operators.clean import ORD
from censusflow.sources.shared import kept

# The columns one can sort by.
SORT_KEYS = (
    "namespace_path",
    "client_type",
    "token_creation_time",
    "client_first_usage_time",
    "mount_accessor",
    "mount_path",
    "auth_method",
    "source",
)


def sort_key(name: str) -> str:
    key = name.strip().lower()
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {name!r}; one of: {', '.join(SORT_KEYS)}")
    return key


def sort_columns(name: str) -> list[Column]:
    return [F.col(sort_key(name)).asc_nulls_first(), F.col(ORD).asc()]


def sort(df: DataFrame, by: str = "namespace_path") -> DataFrame:
    return df.orderBy(*sort_columns(by))


def ranked(df: DataFrame, *keys: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """A gapless global row number without a global window.

    Rows are range-partitioned and sorted once and kept in the shared folder; a row's number is its place in its
    partition plus the rows of the partitions before it. Only one count per partition is windowed and broadcast.
    keys must be unique. It runs the sort when called.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    placed = kept(placed.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i") + 1).drop("_p", "_s", "_i", "_m")
