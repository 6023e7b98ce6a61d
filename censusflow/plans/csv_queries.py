"""Registered queries of the CSV side: files written from the derived relation by fixed rules, read back by the source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censusflow.operators import order
from censusflow.operators.clean import DATA, ORD
from censusflow.sources.csv_export import read_exports, scan
from censusflow.sources.derived import RULES, derived_export
from censusflow.sources.shared import new_path

FILES = ("jan.csv", "feb.csv", "mar.csv")
ALIASED = {"client_id": "Client_ID", "namespace_path": " namespace", "mount_path": "MOUNT ", "client_type": "type", "token_creation_time": "Timestamp", "entity_alias_name": "alias_name"}
_RAW = "raw_export as (select event_id as _ord, " + ", ".join(f"{v} as {k}" for k, v in RULES.items()) + " from (select *, strftime(ts, '%Y-%m-%d %H:%M:%S') as s from events))"


def write_lines(rows: DataFrame, path: str, header: str, line: Column) -> str:
    """One file of lines in order of _ord below a header."""
    body = rows.select(F.col(ORD), line.alias("value"))
    top = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias(ORD), F.lit(header).alias("value"))
    top.unionByName(body).repartition(1).sortWithinPartitions(ORD).select("value").write.text(path)
    return path


def monthly(spark: SparkSession, sf_dir: str, header: list[str], line: Column) -> dict[str, str]:
    """The relation as a file for each of its sources."""
    rows, root = derived_export(spark, sf_dir), new_path(spark, "exports")
    return {f: write_lines(rows.where(F.element_at(F.split("source", "/"), -1) == f), f"{root}/{f}", ",".join(header), line) for f in FILES}


def _file() -> Column:
    return F.element_at(F.split("source", "/"), -1).alias("file")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical headers, three files, fields trimmed."""
    paths = monthly(spark, sf_dir, list(DATA), F.concat_ws(",", *DATA))
    return read_exports(spark, list(paths.values())).select(_file(), *DATA)


def csv_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows where files may be read in parts."""
    paths = monthly(spark, sf_dir, list(DATA), F.concat_ws(",", *DATA))
    return read_exports(spark, list(paths.values()), multi_line=False).select(_file(), *DATA)


def csv_header_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other names, letter cases and orders of headers, and a column that isn't known."""
    cells = F.concat_ws(",", F.lit("x"), *list(ALIASED)[::-1])
    paths = monthly(spark, sf_dir, ["remark", *list(ALIASED.values())[::-1]], cells)
    return read_exports(spark, list(paths.values())).select(_file(), *DATA)


def _ragged(spark: SparkSession, sf_dir: str) -> list[str]:
    short, long_, blank = (F.col(ORD) % n == 0 for n in (5, 7, 11))
    client = F.when(blank, F.lit("  ")).otherwise(F.col("client_id"))
    line = F.when(short & ~blank, client).when(long_, F.concat_ws(",", client, "mount_type", F.lit("more"))).otherwise(F.concat_ws(",", client, "mount_type"))
    return list(monthly(spark, sf_dir, ["client_id", "mount_type"], line).values())


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another width than the header and rows without a client are left out."""
    return read_exports(spark, _ragged(spark, sf_dir)).select(_file(), "client_id", "mount_type")


def csv_ragged_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per file whose number of fields differs from the header's."""
    out = None
    for path in _ragged(spark, sf_dir):
        # Spark reads the mark of bad rows only beside a column of data
        one = scan(spark, path).select("_bad", F.coalesce(F.col("client_id"), F.lit("")).alias("c")).agg(F.count("_bad").alias("skipped"), F.max("c").alias("c"))
        one = one.where(F.col("c").isNotNull() | (F.col("skipped") == 0)).select(F.lit(path.rsplit("/", 1)[-1]).alias("file"), "skipped")
        out = one if out is None else out.unionByName(one)
    return out


def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas and line breaks inside fields."""
    value = F.concat(F.col("client_id"), F.when(F.col(ORD) % 3 == 0, F.lit(',"x",\n y')).otherwise(F.lit("")))
    cell = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    paths = monthly(spark, sf_dir, ["mount_type", "client_id"], F.concat_ws(",", "mount_type", cell))
    return read_exports(spark, list(paths.values())).select(_file(), "client_id", "mount_type")


def csv_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file given twice is read twice, and rows keep the order of the arguments."""
    paths = monthly(spark, sf_dir, list(DATA), F.concat_ws(",", *DATA))
    rows = read_exports(spark, [paths["feb.csv"], paths["jan.csv"], paths["feb.csv"]])
    return order.ranked(rows, F.col(ORD)).select("rank", _file(), "client_id", "token_creation_time")


_TRIMMED = ", ".join(f"trim({c}) as {c}" for c in DATA)
_FILE = "split_part(source, '/', -1) as file"
_SCAN = f"with {_RAW} select {_FILE}, {_TRIMMED} from raw_export"
SQL = {
    "csv_scan": _SCAN,
    "csv_split_scan": _SCAN,
    "csv_header_aliases": f"with {_RAW} select {_FILE}, " + ", ".join(f"trim({c}) as {c}" if c in ALIASED else f"'' as {c}" for c in DATA) + " from raw_export",
    "csv_ragged": f"with {_RAW} select {_FILE}, client_id, trim(mount_type) as mount_type from raw_export where _ord % 5 <> 0 and _ord % 7 <> 0 and _ord % 11 <> 0",
    "csv_ragged_count": f"with {_RAW} select {_FILE}, count(case when (_ord % 5 = 0 and _ord % 11 <> 0) or _ord % 7 = 0 then 1 end) as skipped from raw_export group by 1",
    "csv_quoted": f"with {_RAW} select {_FILE}, client_id || case when _ord % 3 = 0 then ',\"x\",' || chr(10) || ' y' else '' end as client_id, trim(mount_type) as mount_type from raw_export",
    "csv_input_order": f"""with {_RAW}, f as (select * from (values (1, 'feb.csv'), (2, 'jan.csv'), (3, 'feb.csv')) t(n, name))
 select row_number() over (order by n, _ord) as rank, name as file, client_id, trim(token_creation_time) as token_creation_time from raw_export join f on split_part(source, '/', -1) = name""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (csv_scan, csv_split_scan, csv_header_aliases, csv_ragged, csv_ragged_count, csv_quoted, csv_input_order)}
