"""Filters and the predicates they rest on; all null-safe, all narrow."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusflow import functions as fn


def is_pki() -> Column:
    return (F.col("client_type") == "acme") | F.lower("mount_accessor").startswith("auth_cert")


def is_jwt() -> Column:
    return (F.col("mount_type") == "jwt") | (F.col("auth_method") == "jwt")


def at(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def since(df: DataFrame, moment: datetime) -> DataFrame:
    """Rows at or after the moment; rows without a time stay."""
    t = F.col("token_creation_time")
    return df.where(t.isNull() | (t >= at(moment)))


def cutoff_for(path: str, cutoffs: Mapping[str, datetime]) -> datetime | None:
    base = path.rstrip("/").rsplit("/", 1)[-1] if path else "."
    return cutoffs.get(base or "/", cutoffs.get(path))


def since_per_source(df: DataFrame, cutoffs: Mapping[str, datetime]) -> DataFrame:
    """As since(), by file. A base name beats a full path; files without a cutoff stay whole.

    The cutoffs are arguments of a call, so they fold into the expression: no join and no shuffle.
    """
    if not cutoffs:
        return df
    table = F.create_map(*[x for k, v in cutoffs.items() for x in (F.lit(k), at(v))])
    t, cut = F.col("token_creation_time"), F.coalesce(table[fn.base_name(F.col("source"))], table[F.col("source")])
    return df.where(cut.isNull() | t.isNull() | (t >= cut))


def by_namespace(df: DataFrame, part: str) -> DataFrame:
    """Literal, case-insensitive part of the cleaned path."""
    return df.where(F.contains(F.lower("namespace_path"), F.lit(part.lower())))


def by_client_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("client_type") == fn.client_type_value(kind))


def partition_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that fit, and all others."""
    fits = F.coalesce(predicate, F.lit(False))
    return df.where(fits), df.where(~fits)
