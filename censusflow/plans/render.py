"""Plain-text reports. Aggregates are small; record tables stream to the driver one partition at a time."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusflow import functions as fn
from censusflow.operators import dedup, report
from censusflow.operators.clean import ORD
from censusflow.operators.filters import is_pki
from censusflow.plans.pipeline import Options, Stages


def summary_text(rows: Iterable, label: str = "") -> Iterator[str]:
    """Lines of a summary; none for no rows."""
    rows = list(rows)
    if not rows:
        return
    label = label or "Summary"
    counts, totals, total = {}, {}, 0
    for r in rows:
        if r["level"] == 0:
            counts.setdefault(r["mount_label"], []).append((r["client_type"], r["n"]))
        elif r["level"] == 1:
            totals[r["mount_label"]] = r["n"]
        else:
            total = r["n"]
    wide = max([len("Mount Path"), *map(len, counts)])
    place = {t: i for i, t in enumerate(report.TYPE_ORDER)}

    def line(a, b, c):
        return f"  {a:<{wide}}  {b:<11}  {c}"

    rule = line("-" * wide, "-" * 11, "-" * 5)
    yield ""
    yield label
    yield "-" * len(label.encode())
    yield line("Mount Path", "Client Type", "Count")
    yield rule
    mounts = sorted(counts, key=str.encode)
    for i, mount in enumerate(mounts):
        ordered = sorted(counts[mount], key=lambda x: (place.get(x[0], len(place)), x[0].encode()))
        for j, (kind, n) in enumerate(ordered):
            yield line("" if j else mount, kind, n)
        yield line("", "subtotal:", totals[mount])
        if i < len(mounts) - 1:
            yield ""
    yield rule
    yield line("", "TOTAL:", total)


def table_text(rows: Iterable, widths: Sequence[int] | None = None, alias: bool | None = None) -> Iterator[str]:
    """Lines of a record table. Give widths and alias to stream rows; else they are taken from the rows at hand."""
    if widths is None:
        rows = list(rows)
        alias = any(r["entity_alias_name"] for r in rows)
    columns = [*report.TABLE, *([report.ALIAS_COLUMN] if alias else [])]
    if widths is None:
        widths = [max([w, *(len(r[name]) for r in rows)]) for _, w, name in columns]
    rows, n = iter(rows), 0

    def line(values):
        return "  ".join(f"{v:<{w}}" for v, w in zip(values, widths, strict=True)).rstrip(" ")

    for n, r in enumerate(rows, 1):
        if n == 1:
            yield line([c[0] for c in columns])
            yield "  ".join("-" * w for w in widths)
        yield line([r[c[2]] for c in columns])
    if not n:
        yield "(no records to display)"


def table(df: DataFrame, *order) -> Iterator[str]:
    """A record table of a whole frame: one aggregate for the widths, then the rows in order."""
    m = report.display_widths(df).first()
    return table_text(report.display(df).orderBy(*(order or [F.col(ORD)])).toLocalIterator(), report.table_widths(m), m["has_alias"])


def _runs(rows: Iterable, key) -> Iterator[list]:
    """Neighbouring rows with one key."""
    run, last = [], None
    for r in rows:
        k = key(r)
        if run and k != last:
            yield run
            run = []
        run.append(r)
        last = k
    if run:
        yield run


def alias_groups_text(df: DataFrame, heading: str, rule: int) -> Iterator[str]:
    groups = dedup.alias_groups(df).count()
    if not groups:
        return
    yield f"{heading} ({groups} group(s))"
    yield "=" * rule
    members = dedup.alias_group_members(df)
    rows = report.display(members, "alias_base", "alias_group", "first_ord").orderBy("first_ord", ORD).toLocalIterator()
    for group in _runs(rows, lambda r: (r["alias_base"], r["alias_group"])):
        yield ""
        yield f'Alias group: "{group[0]["alias_base"]}"  file: {group[0]["source_file"]}'
        yield from table_text(group)
    yield ""


def debug_text(stages: Stages, options: Options) -> Iterator[str]:
    if options.dedup_client_id:
        s = dedup.dedup_stats(stages.after_alias).first()
        yield f"Debug: -d client_id dedup — before: {s['rows_before']}  after: {s['rows_after']}  collapsed: {s['collapsed']}"
        yield "-" * 70
        for r in dedup.client_id_duplicates(stages.after_alias).orderBy("client_id").toLocalIterator():
            yield f"  {r['client_id']}  (x{r['n']} → kept 1)"
        if not s["duplicate_ids"]:
            yield "  (no duplicate client_ids found)"
        yield ""
    if not options.dedup_alias:
        yield from alias_groups_text(stages.snapshot, "Debug: alias groups in input data", 47)
    final, key = stages.final, options.sort.strip().lower()
    mounts = report.mount_groups(final, key).orderBy(F.col("first_key").asc_nulls_first(), "first_ord").collect()
    label = fn.mount_label(F.col("mount_path"))
    widths = {r["_mount"]: r for r in report.display_widths(final, label.alias("_mount")).collect()}
    # all tables in one sort, by the place of the mount's first row
    first = report.mount_groups(final, key).select(F.col("mount_label").alias("_mount"), F.col("first_key").alias("_key"), F.col("first_ord").alias("_first"))
    rows = final.withColumn("_mount", label).join(first, "_mount")
    rows = report.display(rows, "_mount", "_key", "_first", F.col(key).alias("_by")).orderBy(F.col("_key").asc_nulls_first(), "_first", F.col("_by").asc_nulls_first(), ORD).toLocalIterator()
    tables = itertools.groupby(rows, lambda r: r["_mount"])
    yield f"Debug: records by mount path ({len(mounts)} mount(s))"
    yield "=" * 42
    hints = {}
    for r in report.alias_hints(final).orderBy("mount_label", "alias_base").toLocalIterator():
        hints.setdefault(r["mount_label"], []).append(r)
    for m in mounts:
        yield ""
        yield f"Mount: {m['mount_label']} ({m['n']} record(s))"
        _, shown = next(tables)
        w = widths[m["mount_label"]]
        yield from table_text(shown, report.table_widths(w), w["has_alias"])
        for h in hints.get(m["mount_label"], []):
            yield f'  !! alias "{h["alias_base"]}" has {h["n"]} records with different client_ids — use -dedup-alias to collapse'
    yield ""


def report_text(stages: Stages, options: Options, paths: Sequence[str]) -> Iterator[str]:
    """All output of a run, in order."""
    final = stages.final.withColumn("is_pki", is_pki())
    if options.dedup_alias:
        yield from alias_groups_text(stages.snapshot, "Alias duplicates found", 37)
    if options.debug:
        yield from debug_text(stages, options)
    parts = ((False, "Non-PKI"), (True, "PKI"))
    if options.per_file:
        by = ("source", "is_pki") if options.split_pki else ("source",)
        counts: dict = {}
        for r in report.summary(final, *by).collect():
            counts.setdefault(tuple(r[b] for b in by), []).append(r)
        for path in paths:
            base = path.rstrip("/").rsplit("/", 1)[-1]
            if options.split_pki:
                for flag, name in parts:
                    yield from summary_text(counts.get((path, flag), []), f"{base} — {name}")
            else:
                yield from summary_text(counts.get((path,), []), base)
    if options.split_pki:
        rows = report.summary(final, "is_pki").collect()
        for flag, name in parts:
            yield from summary_text([r for r in rows if r["is_pki"] == flag], f"{name} Client Summary")
    else:
        yield from summary_text(report.summary(final).collect())
