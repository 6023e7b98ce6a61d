"""The whole dataflow. Stage order is part of its meaning: only the per-file time filter runs before the dedups."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from censusflow.operators import dedup, filters
from censusflow.operators.clean import normalize
from censusflow.operators.order import sort_key
from censusflow.sources.shared import kept


@dataclass(frozen=True)
class Options:
    sort: str = "namespace_path"
    namespace: str = ""
    client_type: str = ""
    since: datetime | None = None
    since_file: Mapping[str, datetime] = field(default_factory=dict)
    split_pki: bool = False
    dedup_client_id: bool = False
    dedup_alias: bool = False
    dedup_jwt: bool = False
    debug: bool = False
    per_file: bool = False

    def __post_init__(self):
        sort_key(self.sort)


@dataclass(frozen=True)
class Stages:
    """Frames at the points that reports look at; lazy, but for a table kept before the anti join."""

    snapshot: DataFrame
    after_alias: DataFrame
    final: DataFrame


def utc(moment: datetime) -> datetime:
    return moment.astimezone(UTC).replace(tzinfo=None) if moment.tzinfo else moment


def run(raw: DataFrame, options: Options) -> Stages:
    df = normalize(raw)
    if options.since_file:
        df = filters.since_per_source(df, {k: utc(v) for k, v in options.since_file.items()})
    snapshot = df
    if options.dedup_alias:
        df = dedup.by_alias(df)
    after_alias = df
    if options.dedup_client_id:
        df = dedup.by_client_id(df)
    if options.dedup_jwt:
        if options.dedup_alias or options.dedup_client_id:
            df = kept(df, "deduplicated")  # the anti join reads it twice
        df = dedup.jwt_seen_elsewhere(df)
    if options.namespace:
        df = filters.by_namespace(df, options.namespace)
    if options.client_type:
        df = filters.by_client_type(df, options.client_type)
    if options.since:
        df = filters.since(df, utc(options.since))
    return Stages(snapshot, after_alias, df)
