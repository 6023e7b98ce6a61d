"""Deterministic first-wins deduplication.

Each is a keyed min_by aggregate: Spark combines on the map side, so a key with a third of all rows sends one row
per map task, where a window would bring the whole key to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusflow import functions as fn
from censusflow.operators.clean import ORD
from censusflow.operators.filters import is_jwt, is_pki


def alias_exempt() -> Column:
    return (F.col("entity_alias_name") == "") | is_pki()


def base_key() -> Column:
    return fn.strip_tier(fn.alias_base(F.col("entity_alias_name")))


def group_key() -> Column:
    return fn.identity_group(F.when(F.col("mount_type") == "", F.col("auth_method")).otherwise(F.col("mount_type")))


def _first(df: DataFrame, keys: list[Column], order: Column, ordinal: Column) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    names = [f"_k{i}" for i in range(len(keys))]
    out = df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min_by(row, order).alias("_r"), F.min(ordinal).alias("_first"))
    return out.select(*[(F.col("_first") if c == ORD else F.col(f"_r.{c}")).alias(c) for c in df.columns])


def by_client_id(df: DataFrame) -> DataFrame:
    """One row per client: the first with a mount, else the first; it takes the place of the client's first row."""
    return _first(df, [F.col("client_id")], F.struct(F.col("mount_path") == "", F.col(ORD)), F.col(ORD))


def by_alias(df: DataFrame) -> DataFrame:
    """First row per (alias base, identity group). Blank aliases and certificate clients are groups of their own."""
    own = F.when(alias_exempt(), F.col(ORD))
    key = F.when(alias_exempt(), F.lit("")).otherwise(base_key())
    group = F.when(alias_exempt(), F.lit("")).otherwise(group_key())
    return _first(df, [key, group, own], F.col(ORD), F.col(ORD))


def seen_bases(df: DataFrame) -> DataFrame:
    """Alias bases of rows that are not token logins, blank ones left out."""
    return df.where(~is_jwt() & (F.col("entity_alias_name") != "")).select(base_key().alias("_base")).where("_base <> ''").distinct()


def jwt_seen_elsewhere(df: DataFrame) -> DataFrame:
    """Drop token logins whose alias base another login method has. An anti join whose strategy AQE picks by size."""
    left = df.withColumn("_jwt_base", F.when(is_jwt() & (F.col("entity_alias_name") != ""), base_key()))
    return left.join(seen_bases(df), F.col("_jwt_base") == F.col("_base"), "left_anti").drop("_jwt_base")


def alias_groups(df: DataFrame) -> DataFrame:
    """Groups of over one member: base, group, n, first _ord."""
    return (
        df.where(~alias_exempt())
        .groupBy(base_key().alias("alias_base"), group_key().alias("alias_group"))
        .agg(F.count("*").alias("n"), F.min(ORD).alias("first_ord"))
        .where("n > 1")
    )


def alias_group_members(df: DataFrame) -> DataFrame:
    """Flat members of those groups; order by (first_ord, _ord) to read them group by group."""
    rows = df.where(~alias_exempt()).withColumns({"alias_base": base_key(), "alias_group": group_key()})
    return rows.join(alias_groups(df), ["alias_base", "alias_group"])


def client_id_duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("client_id").agg(F.count("*").alias("n")).where("n > 1")


def dedup_stats(df: DataFrame) -> DataFrame:
    """One row: rows before, after, collapsed, and ids that occur more than once."""
    per = df.groupBy("client_id").agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("collapsed"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_ids"),
    )
