"""Row-wise cleaning: two narrow projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusflow import functions as fn

DATA = (
    "client_id namespace_id namespace_path mount_accessor mount_path mount_type auth_method client_type "
    "token_creation_time client_first_usage_time entity_alias_name"
).split()
COLUMNS = ["source", *DATA]
TIMES = ("token_creation_time", "client_first_usage_time")
ORD = "_ord"


def normalize(raw: DataFrame) -> DataFrame:
    """Clean all rows, keep their number and _ord. Missing columns count as empty, nulls as empty.

    Fields are trimmed in a projection of their own, so that rules that read a field several times don't trim it again.
    """
    whole = ("source", "client_id")

    def get(name):
        if name not in raw.columns:
            return F.lit("").alias(name)
        return (F.coalesce(F.col(name), F.lit("")) if name in whole else fn.trimmed(F.col(name))).alias(name)

    raw = raw.select(F.col(ORD), *[get(c) for c in COLUMNS])
    ns, path, mount = F.col("namespace_id"), F.col("namespace_path"), F.col("mount_path")
    out = {
        "source": F.col("source"),
        "client_id": F.col("client_id"),
        "namespace_id": F.when((ns == "") | (F.lower(ns) == "root"), F.lit("root")).otherwise(ns),
        "namespace_path": F.when((path == "") | (path == "[root]") | (F.lower(path) == "root"), F.lit("[root]")).otherwise(fn.with_slash(path)),
        "mount_accessor": F.col("mount_accessor"),
        "mount_path": F.when(mount == "", mount).otherwise(fn.with_slash(mount)),
        "mount_type": F.lower("mount_type"),
        "auth_method": F.lower("auth_method"),
        "client_type": fn.client_type_of(F.col("client_type")),
        "token_creation_time": fn.time_of(F.col("token_creation_time")),
        "client_first_usage_time": fn.time_of(F.col("client_first_usage_time")),
        "entity_alias_name": F.col("entity_alias_name"),
    }
    return raw.select(F.col(ORD), *[v.alias(k) for k, v in out.items()])
