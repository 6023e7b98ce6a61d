"""Grouped counts and display projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusflow import functions as fn
from censusflow.operators.clean import ORD
from censusflow.operators.dedup import base_key

# Display order of client types; all others follow by name.
TYPE_ORDER = ("entity", "non-entity", "acme", "secret-sync", "unknown")
# Columns of a record table: heading, least width, name in display().
TABLE = (
    ("Namespace Path", 16, "namespace_path"),
    ("Client Type", 12, "client_type"),
    ("Auth Method", 12, "auth_method"),
    ("Mount Path", 12, "mount_path"),
    ("Mount Accessor", 14, "mount_accessor"),
    ("Token Created", 22, "token_created"),
    ("Client ID", 36, "client_id"),
    ("Source File", 12, "source_file"),
)
ALIAS_COLUMN = ("Entity Alias", 12, "entity_alias_name")


def type_rank(c: Column) -> Column:
    rank = F.lit(len(TYPE_ORDER))
    for i, name in reversed(list(enumerate(TYPE_ORDER))):
        rank = F.when(c == name, F.lit(i)).otherwise(rank)
    return rank


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Counts by mount and type with subtotals and a total, within each value of `by`.

    level: 0 count, 1 subtotal of a mount, 3 total. One partial and one final aggregate, one shuffle.
    """
    base = df.select(*by, fn.mount_label(F.col("mount_path")).alias("mount_label"), "client_type")
    view = base.groupingSets(
        [[F.col(c) for c in (*by, *x)] for x in (["mount_label", "client_type"], ["mount_label"], [])],
        *[F.col(c) for c in (*by, "mount_label", "client_type")],
    )
    level = F.grouping("mount_label").cast("int") * 2 + F.grouping("client_type").cast("int")
    out = view.agg(F.count("*").alias("n"), level.alias("level")).select(*by, "mount_label", "client_type", "level", "n")
    return out.where("n > 0")


def summary_order() -> list[Column]:
    """Order of the lines of summary() as they are shown: mounts by name, types by rank, each subtotal after its counts, the total last."""
    return [F.col("level") == 3, F.col("mount_label"), F.col("level"), F.col("type_rank"), F.col("client_type")]


def alias_hints(df: DataFrame) -> DataFrame:
    """Aliases that have several client ids on one mount."""
    return (
        df.where("entity_alias_name <> ''")
        .groupBy(fn.mount_label(F.col("mount_path")).alias("mount_label"), base_key().alias("alias_base"))
        .agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("n_ids"))
        .where("n >= 2 and n_ids > 1")
    )


def mount_groups(df: DataFrame, key: str) -> DataFrame:
    """Rows per mount; first_key and first_ord give the mount's place in the sorted result."""
    first = F.min(F.struct(F.col(key), F.col(ORD)))
    return (
        df.groupBy(fn.mount_label(F.col("mount_path")).alias("mount_label"))
        .agg(F.count("*").alias("n"), first.alias("f"))
        .select("mount_label", "n", F.col(f"f.{key}").alias("first_key"), F.col(f"f.{ORD}").alias("first_ord"))
    )


def display(df: DataFrame, *more) -> DataFrame:
    """The columns of record tables; more: columns to carry along."""
    return df.select(
        ORD,
        "namespace_path",
        "client_type",
        "auth_method",
        "mount_path",
        "mount_accessor",
        fn.shown_time(F.col("token_creation_time")).alias("token_created"),
        "client_id",
        fn.base_name(F.col("source")).alias("source_file"),
        "entity_alias_name",
        *more,
    )


def display_widths(df: DataFrame, *by: Column) -> DataFrame:
    """The longest value of each displayed column in characters, and whether any alias is present; one row, or one per `by`."""
    names = [c for c in display(df).columns if c != ORD]
    shown = display(df, *by)
    return shown.groupBy(*[c for c in shown.columns if c not in (*names, ORD)]).agg(
        *[F.coalesce(F.max(F.length(c)), F.lit(0)).cast("long").alias(f"w_{c}") for c in names],
        F.coalesce(F.bool_or(F.col("entity_alias_name") != ""), F.lit(False)).alias("has_alias"),
    )


def table_widths(m) -> list[int]:
    """Widths of a table's columns from a row of display_widths()."""
    return [max(w, m[f"w_{name}"]) for _, w, name in (*TABLE, *([ALIAS_COLUMN] if m["has_alias"] else []))]
