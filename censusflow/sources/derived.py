"""A deliberately dirty export relation from the `events` test table, by fixed rules on event_id and user_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _case(n: int, values: dict[int, str], of: str = "event_id") -> str:
    return f"case {of} % {n} " + " ".join(f"when {k} then {v}" for k, v in values.items()) + " end"


#: Plain SQL expressions; Spark and DuckDB read them alike. s is the time as text, cut to seconds.
RULES = {
    "source": _case(3, {0: "'/exports/2024/jan.csv'", 1: "'/exports/2024/feb.csv'", 2: "'mar.csv'"}),
    "client_id": "concat('c-', cast(user_id as string), '-', cast(event_id % 7 as string))",
    "namespace_id": _case(4, {0: "''", 1: "'ROOT'", 2: "'ns-1'", 3: "' ns-2 '"}),
    "namespace_path": _case(6, {0: "''", 1: "'Root'", 2: "'[root]'", 3: "'education'", 4: "'education/training/'", 5: "' Finance '"}),
    "mount_accessor": "case event_type when 'view' then 'auth_ldap_x' when 'signup' then 'auth_oidc_y' when 'error' then 'AUTH_CERT_z' when 'click' then 'auth_jwt_w' else 'pki_acme_v' end",
    "mount_path": "case when event_id % 5 = 0 then '' else case event_type when 'view' then 'auth/ldap' when 'signup' then 'auth/oidc/' when 'error' then 'auth/cert' when 'click' then 'auth/jwt/' else 'pki' end end",
    "mount_type": "case when event_id % 13 = 0 then '' else case event_type when 'view' then 'LDAP' when 'signup' then 'oidc' when 'error' then 'cert' when 'click' then 'JWT' else 'pki' end end",
    "auth_method": "case event_type when 'view' then 'ldap' when 'signup' then 'OIDC' when 'error' then 'cert' when 'click' then 'jwt' else 'acme' end",
    "client_type": _case(10, {0: "'entity'", 1: "'Entity Client'", 2: "'non_entity'", 3: "'Non-Entity Client'", 4: "'nonentity'", 5: "'ACME'", 6: "'secrets sync'", 7: "''", 8: "'certificate'", 9: "'entity'"}),
    "token_creation_time": _case(
        8,
        {
            0: "concat(replace(s, ' ', 'T'), 'Z')",
            1: "concat(replace(s, ' ', 'T'), '+00:00')",
            2: "replace(s, ' ', 'T')",
            3: "concat(s, ' +0000 UTC')",
            4: "concat(s, 'Z')",
            5: "substring(s, 1, 10)",
            6: "concat(substring(s, 6, 2), '/', substring(s, 9, 2), '/', substring(s, 1, 4))",
            7: _case(3, {0: "'N/A'", 1: "s", 2: "''"}),
        },
    ),
    "client_first_usage_time": "case when event_id % 4 = 0 then '' else concat(replace(s, ' ', 'T'), 'Z') end",
    "entity_alias_name": "case when event_id % 11 = 0 then '' else concat('user', cast(user_id % 50 as string), "
    + _case(7, {0: "''", 1: "'-t0'", 2: "'-t1@corp.com'", 3: "'@corp.com'", 4: "'-t3'", 5: "'-T0'", 6: "'-t2'"})
    + ") end",
}


def derived_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.substring(F.col("ts").cast("timestamp_ntz").cast("string"), 1, 19))
    return events.select(F.col("event_id").alias("_ord"), *[F.expr(v).alias(k) for k, v in RULES.items()])
