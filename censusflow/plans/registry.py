"""Registered queries over the derived export relation, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusflow import functions as fn
from censusflow.operators import dedup, filters, order, report
from censusflow.operators.clean import COLUMNS, ORD, normalize
from censusflow.plans import csv_queries
from censusflow.plans.pipeline import Options, run
from censusflow.sources.derived import RULES, derived_export

FULL = Options(
    namespace="educ",
    client_type="entity",
    since=datetime(2024, 1, 10),
    since_file={"jan.csv": datetime(2024, 1, 5)},
    dedup_alias=True,
    dedup_client_id=True,
    dedup_jwt=True,
)
JAN = datetime(2024, 1, 15)

# SQL text for DuckDB ---------------------------------------------------------------------------------------------

_RAW = "raw_export as (select event_id as _ord, " + ", ".join(f"{v} as {k}" for k, v in RULES.items()) + " from (select *, strftime(ts, '%Y-%m-%d %H:%M:%S') as s from events))"
_FORMATS = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S+00:00", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S +0000 UTC", "%Y-%m-%d %H:%M:%SZ", "%Y-%m-%d", "%m/%d/%Y"]


def _sql_time(c: str) -> str:
    return f"try_strptime(trim({c}), {_FORMATS!r})"


def _sql_slash(c: str) -> str:
    return f"case when ends_with({c}, '/') then {c} else {c} || '/' end"


_TYPES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in fn.CLIENT_TYPE_ALIASES.items()) + "}"
_SQL_TYPE = f"coalesce({_TYPES}[lower(trim(client_type))], case when trim(client_type) = '' then 'unknown' else lower(trim(client_type)) end)"
_NORM = f"""norm as (select _ord, source, trim(client_id) as client_id,
 case when trim(namespace_id) = '' or lower(trim(namespace_id)) = 'root' then 'root' else trim(namespace_id) end as namespace_id,
 case when trim(namespace_path) in ('', '[root]') or lower(trim(namespace_path)) = 'root' then '[root]' else {_sql_slash("trim(namespace_path)")} end as namespace_path,
 trim(mount_accessor) as mount_accessor,
 case when trim(mount_path) = '' then '' else {_sql_slash("trim(mount_path)")} end as mount_path,
 lower(trim(mount_type)) as mount_type, lower(trim(auth_method)) as auth_method, {_SQL_TYPE} as client_type,
 {_sql_time("token_creation_time")} as token_creation_time, {_sql_time("client_first_usage_time")} as client_first_usage_time,
 trim(entity_alias_name) as entity_alias_name from raw_export)"""
_BASE = "regexp_replace(split_part(entity_alias_name, '@', 1), '-t[0-2]$', '')"
_GROUP = "case when (case when mount_type = '' then auth_method else mount_type end) = 'oidc' then 'ldap' when mount_type = '' then auth_method else mount_type end"
_PKI = "(client_type = 'acme' or starts_with(lower(mount_accessor), 'auth_cert'))"
_JWT = "(mount_type = 'jwt' or auth_method = 'jwt')"
_LABEL = "case when mount_path = '' then '(no mount)' else mount_path end"
_COLS = ", ".join(COLUMNS)
_SHOWN = {c: f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%SZ'), '—')" for c in ("token_creation_time",)}


def _q(body: str, *more: str) -> str:
    return "with " + ", ".join([_RAW, _NORM, *more]) + " " + body


def _sql_client_id(src: str, name: str) -> str:
    cols = ", ".join(c for c in COLUMNS)
    return f"{name} as (select first_ord as _ord, {cols} from (select *, row_number() over (partition by client_id order by (mount_path = ''), _ord) as rn, min(_ord) over (partition by client_id) as first_ord from {src}) where rn = 1)"


def _sql_alias(src: str, name: str) -> str:
    return f"{name} as (select _ord, {_COLS} from (select *, (entity_alias_name = '' or {_PKI}) as ex, row_number() over (partition by {_BASE}, {_GROUP}, (entity_alias_name = '' or {_PKI}) order by _ord) as rn from {src}) where ex or rn = 1)"


def _sql_jwt(src: str, name: str) -> str:
    base = f"(select distinct {_BASE} as b from {src} where not {_JWT} and entity_alias_name <> '' and {_BASE} <> '')"
    return f"{name} as (select * from {src} where not ({_JWT} and entity_alias_name <> '' and {_BASE} in {base}))"


def _sql_since_file(src: str, name: str, day: str) -> str:
    return f"{name} as (select * from {src} where not (source = '/exports/2024/jan.csv' and token_creation_time is not null and token_creation_time < timestamp '{day}'))"


def _sql_summary(src: str, *by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"""select {keys}mount_label, client_type, cast(grouping(mount_label) * 2 + grouping(client_type) as integer) as level, count(*) as n
 from (select {keys}{_LABEL} as mount_label, client_type from {src})
 group by grouping sets (({keys}mount_label, client_type), ({keys}mount_label), ({keys.rstrip(", ")})) having count(*) > 0"""


Query = tuple[Callable[[DataFrame], DataFrame], str]


def _over_norm() -> dict[str, Query]:
    """Name to (function of the cleaned frame, SQL)."""
    rows = f"select _ord, {_COLS} from"
    out: dict[str, Query] = {
        "normalize": (lambda d: d, _q(f"{rows} norm")),
        "filter_since": (lambda d: filters.since(d, JAN), _q(f"{rows} norm where token_creation_time is null or token_creation_time >= timestamp '2024-01-15'")),
        "filter_since_per_source": (lambda d: filters.since_per_source(d, {"jan.csv": JAN}), _q(f"{rows} f", _sql_since_file("norm", "f", "2024-01-15"))),
        "filter_namespace": (lambda d: filters.by_namespace(d, "EDUC"), _q(f"{rows} norm where contains(lower(namespace_path), 'educ')")),
        "filter_client_type": (lambda d: filters.by_client_type(d, "Non-Entity Client"), _q(f"{rows} norm where client_type = 'non-entity'")),
        "pki_only": (lambda d: filters.partition_by(d, filters.is_pki())[0], _q(f"{rows} norm where {_PKI}")),
        "non_pki": (lambda d: filters.partition_by(d, filters.is_pki())[1], _q(f"{rows} norm where not {_PKI}")),
        "jwt_only": (lambda d: d.where(filters.is_jwt()), _q(f"{rows} norm where {_JWT}")),
        "dedup_client_id": (dedup.by_client_id, _q(f"{rows} f", _sql_client_id("norm", "f"))),
        "dedup_alias": (dedup.by_alias, _q(f"{rows} f", _sql_alias("norm", "f"))),
        "dedup_jwt": (dedup.jwt_seen_elsewhere, _q(f"{rows} f", _sql_jwt("norm", "f"))),
        "dedup_all": (lambda d: dedup.jwt_seen_elsewhere(dedup.by_client_id(dedup.by_alias(d))), _q(f"{rows} c", _sql_alias("norm", "a"), _sql_client_id("a", "b"), _sql_jwt("b", "c"))),
        "seen_bases": (lambda d: dedup.seen_bases(d).withColumnRenamed("_base", "alias_base"), _q(f"select distinct {_BASE} as alias_base from norm where not {_JWT} and entity_alias_name <> '' and {_BASE} <> ''")),
        "alias_groups": (dedup.alias_groups, _q(f"select {_BASE} as alias_base, {_GROUP} as alias_group, count(*) as n, min(_ord) as first_ord from norm where entity_alias_name <> '' and not {_PKI} group by 1, 2 having count(*) > 1")),
        "alias_group_members": (
            lambda d: dedup.alias_group_members(d).select("alias_base", "alias_group", "first_ord", "n", ORD, "client_id"),
            _q(f"select * from (select {_BASE} as alias_base, {_GROUP} as alias_group, min(_ord) over w as first_ord, count(*) over w as n, _ord, client_id from norm where entity_alias_name <> '' and not {_PKI} window w as (partition by {_BASE}, {_GROUP})) where n > 1"),
        ),
        "client_id_duplicates": (dedup.client_id_duplicates, _q("select client_id, count(*) as n from norm group by 1 having count(*) > 1")),
        "dedup_stats": (dedup.dedup_stats, _q("select cast(sum(n) as bigint) as rows_before, count(*) as rows_after, cast(sum(n - 1) as bigint) as collapsed, count(case when n > 1 then 1 end) as duplicate_ids from (select client_id, count(*) as n from norm group by 1)")),
        "mount_groups": (
            lambda d: report.mount_groups(d, "namespace_path"),
            _q(f"select mount_label, count(*) as n, min(namespace_path) as first_key, min(_ord) filter (namespace_path = k) as first_ord from (select *, {_LABEL} as mount_label, min(namespace_path) over (partition by {_LABEL}) as k from norm) group by 1"),
        ),
        "alias_hints": (report.alias_hints, _q(f"select {_LABEL} as mount_label, {_BASE} as alias_base, count(*) as n, count(distinct client_id) as n_ids from norm where entity_alias_name <> '' group by 1, 2 having count(*) >= 2 and count(distinct client_id) > 1")),
        "summary": (report.summary, _q(_sql_summary("norm"))),
        "summary_pki_split": (lambda d: report.summary(d.withColumn("is_pki", filters.is_pki()), "is_pki"), _q(_sql_summary(f"(select *, {_PKI} as is_pki from norm)", "is_pki"))),
        "summary_per_file": (lambda d: report.summary(d, "source"), _q(_sql_summary("norm", "source"))),
        "summary_per_file_pki": (lambda d: report.summary(d.withColumn("is_pki", filters.is_pki()), "source", "is_pki"), _q(_sql_summary(f"(select *, {_PKI} as is_pki from norm)", "source", "is_pki"))),
        "display_table": (
            report.display,
            _q(f"select _ord, namespace_path, client_type, auth_method, mount_path, mount_accessor, {_SHOWN['token_creation_time']} as token_created, client_id, split_part(source, '/', -1) as source_file, entity_alias_name from norm"),
        ),
        "display_widths": (
            report.display_widths,
            _q("select " + ", ".join(f"max(length({e})) as w_{n}" for n, e in {"namespace_path": "namespace_path", "client_type": "client_type", "auth_method": "auth_method", "mount_path": "mount_path", "mount_accessor": "mount_accessor", "token_created": _SHOWN["token_creation_time"], "client_id": "client_id", "source_file": "split_part(source, '/', -1)", "entity_alias_name": "entity_alias_name"}.items()) + ", bool_or(entity_alias_name <> '') as has_alias from norm"),
        ),
        "has_alias": (lambda d: d.agg(F.coalesce(F.bool_or(F.col("entity_alias_name") != ""), F.lit(False)).alias("has_alias")), _q("select coalesce(bool_or(entity_alias_name <> ''), false) as has_alias from norm")),
    }
    kinds = " ".join(f"when '{t}' then {i}" for i, t in enumerate(report.TYPE_ORDER))
    out["summary_order"] = (
        lambda d: order.ranked(report.summary(d).withColumn("type_rank", report.type_rank(F.col("client_type"))), *report.summary_order(), name="line").select("line", "mount_label", "client_type", "level", "n"),
        _q(f"select row_number() over (order by level = 3, mount_label, level, case client_type {kinds} else {len(report.TYPE_ORDER)} end, client_type) as line, * from ({_sql_summary('norm')})"),
    )
    out["mount_order"] = (
        lambda d: order.ranked(report.mount_groups(d, "namespace_path"), F.col("first_key").asc_nulls_first(), F.col("first_ord"), name="place").select("place", "mount_label", "n"),
        _q(f"select row_number() over (order by k asc nulls first, o) as place, mount_label, n from (select mount_label, count(*) as n, min(namespace_path) as k, min(_ord) filter (namespace_path = k0) as o from (select *, {_LABEL} as mount_label, min(namespace_path) over (partition by {_LABEL}) as k0 from norm) group by 1)"),
    )
    for key in order.SORT_KEYS:
        out[f"sort_{key}"] = (
            lambda d, k=key: order.ranked(d, *order.sort_columns(k)).select("rank", ORD, k if k == "client_type" else "client_type", F.col(k).alias("sort_value")),
            _q(f"select row_number() over (order by {key} asc nulls first, _ord) as rank, _ord, client_type, {key} as sort_value from norm"),
        )
    return out


def _over_raw() -> dict[str, Query]:
    def text(c: str):
        return fn.trimmed(F.col(c))

    shift = {"client_id": "client_id", "namespace": "namespace_path", "mount": "mount_path", "type": "client_type", "timestamp": "token_creation_time", "alias_name": "entity_alias_name"}

    def header_union(raw: DataFrame) -> DataFrame:
        """The same rows under old headers from one file and new ones from the others."""
        from censusflow.sources.csv_export import resolve

        new = raw.where("source <> 'mar.csv'").select(ORD, *shift.values())
        old = raw.where("source = 'mar.csv'").select(ORD, *[F.col(v).alias(k) for k, v in shift.items()])
        at = resolve(old.columns)
        return new.unionByName(old.select(ORD, *[F.col(old.columns[i]).alias(c) for c, i in at.items()]))

    return {
        "raw_export": (lambda r: r, f"with {_RAW} select * from raw_export"),
        "parse_time": (lambda r: r.select(ORD, F.col("token_creation_time").alias("raw"), fn.parse_time(F.col("token_creation_time")).alias("parsed")), f"with {_RAW} select _ord, token_creation_time as raw, {_sql_time('token_creation_time')} as parsed from raw_export"),
        "alias_base": (lambda r: r.select(ORD, fn.alias_base(text("entity_alias_name")).alias("alias_base")), f"with {_RAW} select _ord, split_part(entity_alias_name, '@', 1) as alias_base from raw_export"),
        "tier_strip": (lambda r: r.select(ORD, fn.strip_tier(text("entity_alias_name")).alias("stripped")), f"with {_RAW} select _ord, regexp_replace(entity_alias_name, '-t[0-2]$', '') as stripped from raw_export"),
        "identity_group": (lambda r: r.select(ORD, fn.identity_group(F.lower(text("mount_type"))).alias("identity_group")), f"with {_RAW} select _ord, case when lower(mount_type) = 'oidc' then 'ldap' else lower(mount_type) end as identity_group from raw_export"),
        "client_type_canon": (lambda r: r.select(ORD, fn.client_type(F.col("client_type")).alias("client_type")), f"with {_RAW} select _ord, {_SQL_TYPE} as client_type from raw_export"),
        "header_alias_union": (header_union, f"with {_RAW} select _ord, {', '.join(shift.values())} from raw_export where source <> 'mar.csv' union all select _ord, {', '.join(shift.values())} from raw_export where source = 'mar.csv'"),
    }


_FULL_SQL = _q(
    f"select _ord, {_COLS} from e where contains(lower(namespace_path), 'educ') and client_type = 'entity' and (token_creation_time is null or token_creation_time >= timestamp '2024-01-10')",
    _sql_since_file("norm", "a", "2024-01-05"),
    _sql_alias("a", "b"),
    _sql_client_id("b", "c"),
    _sql_jwt("c", "e"),
)


def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(derived_export(spark, sf_dir), FULL).final


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline_full": pipeline_full}
    out |= {k: (lambda s, d, f=f: f(derived_export(s, d))) for k, (f, _) in _over_raw().items()}
    out |= {k: (lambda s, d, f=f: f(normalize(derived_export(s, d)))) for k, (f, _) in _over_norm().items()}
    return out | csv_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {"pipeline_full": _FULL_SQL} | {k: q for k, (_, q) in (_over_raw() | _over_norm()).items()} | csv_queries.SQL
