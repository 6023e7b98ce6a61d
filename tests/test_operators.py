from datetime import datetime

import pytest
from pyspark.sql import functions as F

from censusflow.operators import dedup, filters, order, report
from censusflow.operators.clean import COLUMNS, normalize

BLANK = dict.fromkeys(COLUMNS, "")


def frame(spark, *rows):
    schema = "_ord long, " + ", ".join(f"{c} string" for c in COLUMNS)
    return normalize(spark.createDataFrame([(i, *(BLANK | r).values()) for i, r in enumerate(rows)], schema))


def ids(df):
    return [r["client_id"] for r in df.orderBy("_ord").collect()]


def row(i, **more):
    return {"client_id": i, **more}


def test_cleaning(spark):
    got = frame(spark, row(" a ", namespace_id="ROOT", namespace_path="[ROOT]", mount_path="auth/x", mount_type=" LDAP ", client_type="x"), row("b", namespace_path="root/")).orderBy("_ord").collect()
    assert [got[0][c] for c in ("client_id", "namespace_id", "namespace_path", "mount_path", "mount_type", "client_type")] == [" a ", "root", "[ROOT]/", "auth/x/", "ldap", "x"]
    assert (got[1]["namespace_path"], got[1]["namespace_id"], got[1]["client_type"]) == ("root/", "root", "unknown")


def test_missing_columns_and_nulls(spark):
    df = normalize(spark.createDataFrame([(0, None), (1, "x")], "_ord long, client_id string"))
    assert [(r["client_id"], r["namespace_path"], r["token_creation_time"]) for r in df.orderBy("_ord").collect()] == [("", "[root]", None), ("x", "[root]", None)]


def test_client_id_prefers_mount_and_keeps_place(spark):
    df = frame(spark, row("abc"), row("q"), row("abc", mount_path="ldap"), row("abc", mount_path="other"))
    got = dedup.by_client_id(df).orderBy("_ord").collect()
    assert [(r["_ord"], r["client_id"], r["mount_path"]) for r in got] == [(0, "abc", "ldap/"), (1, "q", "")]


def test_alias(spark):
    df = frame(
        spark,
        row("1", entity_alias_name="sb", mount_type="ldap"),
        row("2", entity_alias_name="sb-t0@corp", mount_type="oidc"),
        row("3", entity_alias_name="sb", mount_type="jwt"),
        row("4"),
        row("5"),
        row("6", entity_alias_name="sb", mount_type="ldap", client_type="acme"),
        row("7", entity_alias_name="@x", mount_type="ldap"),
        row("8", entity_alias_name="@y", mount_type="ldap"),
        row("9", entity_alias_name="sb", auth_method="OIDC"),
    )
    assert ids(dedup.by_alias(df)) == ["1", "3", "4", "5", "6", "7"]
    assert sorted((r["alias_base"], r["n"], r["first_ord"]) for r in dedup.alias_groups(df).collect()) == [("", 2, 6), ("sb", 3, 0)]
    assert ids(dedup.alias_group_members(df)) == ["1", "2", "7", "8", "9"]


def test_jwt(spark):
    df = frame(
        spark,
        row("1", entity_alias_name="bob@c", mount_type="jwt"),
        row("2", entity_alias_name="bob", client_type="acme"),
        row("3", entity_alias_name="@x", auth_method="jwt"),
        row("4", entity_alias_name="@y", mount_type="ldap"),
        row("5", entity_alias_name="amy", mount_type="ldap", auth_method="jwt"),
        row("6", mount_type="jwt"),
    )
    assert ids(dedup.jwt_seen_elsewhere(df)) == ["2", "3", "4", "5", "6"]
    assert ids(dedup.jwt_seen_elsewhere(df.where("client_id <> '2'"))) == ["1", "3", "4", "5", "6"]


def test_filters(spark):
    df = frame(
        spark,
        row("old", source="/x/jan.csv", token_creation_time="2024-01-01", namespace_path="Educ%"),
        row("edge", source="/x/jan.csv", token_creation_time="2024-01-15"),
        row("none", source="/x/jan.csv"),
        row("feb", source="feb.csv", token_creation_time="2023-01-01", mount_accessor="AUTH_CERT_1"),
    )
    day = datetime(2024, 1, 15)
    assert ids(filters.since(df, day)) == ["edge", "none"]
    assert ids(filters.since_per_source(df, {"jan.csv": day})) == ["edge", "none", "feb"]
    assert ids(filters.since_per_source(df, {"jan.csv": day, "/x/jan.csv": datetime(2020, 1, 1)})) == ["edge", "none", "feb"]
    assert ids(filters.since_per_source(df, {"/x/jan.csv": day})) == ["edge", "none", "feb"]
    assert ids(filters.since_per_source(df, {})) == ["old", "edge", "none", "feb"]
    assert ids(filters.by_namespace(df, "DUC%")) == ["old"] and ids(filters.by_namespace(df, "root")) == ["edge", "none", "feb"]
    pki, rest = filters.partition_by(df, filters.is_pki())
    assert ids(pki) == ["feb"] and ids(rest) == ["old", "edge", "none"]


@pytest.mark.parametrize("key", order.SORT_KEYS)
def test_sort_ties_keep_order(spark, key):
    df = frame(spark, row("a", **{key: "2024-01-02"}), row("b"), row("c", **{key: "2024-01-01"}), row("d"), row("e", **{key: "2024-01-02"}))
    got = [r["client_id"] for r in order.sort(df, f" {key.upper()} ").collect()]
    assert [x for x in got if x in "bd"] == ["b", "d"] and got.index("a") < got.index("e") and got.index("c") < got.index("a")
    ranked = order.ranked(df, *order.sort_columns(key)).orderBy("rank").collect()
    assert [r["client_id"] for r in ranked] == got and [r["rank"] for r in ranked] == [1, 2, 3, 4, 5]


def test_bad_sort_key():
    with pytest.raises(ValueError, match="namespace_path"):
        order.sort_key("client_id")


def test_counts(spark):
    df = frame(spark, row("a", mount_path="x"), row("b", mount_path="x", client_type="acme"), row("a"), row("a"))
    got = {(r["mount_label"], r["client_type"], r["level"]): r["n"] for r in report.summary(df).collect()}
    assert got == {("x/", "unknown", 0): 1, ("x/", "acme", 0): 1, ("(no mount)", "unknown", 0): 2, ("x/", None, 1): 2, ("(no mount)", None, 1): 2, (None, None, 3): 4}
    assert report.summary(df.where("1 = 0")).count() == 0
    assert dedup.dedup_stats(df).first().asDict() == {"rows_before": 4, "rows_after": 2, "collapsed": 2, "duplicate_ids": 1}
    assert dedup.dedup_stats(df.where("1 = 0")).first().asDict() == {"rows_before": 0, "rows_after": 0, "collapsed": 0, "duplicate_ids": 0}


def test_partitioning_does_not_matter(spark):
    df = frame(spark, *[row(f"c{i % 7}", mount_path="m" * (i % 3 == 1), entity_alias_name=f"u{i % 5}", mount_type="ldap") for i in range(60)])
    for f in (dedup.by_client_id, dedup.by_alias):
        one = sorted(map(tuple, f(df).collect()), key=str)
        assert sorted(map(tuple, f(df.repartition(5, F.rand(1))).collect()), key=str) == one
        assert sorted(map(tuple, f(f(df)).collect()), key=str) == one
