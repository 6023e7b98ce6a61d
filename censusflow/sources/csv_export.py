"""CSV exports: header reconciliation on the driver, one positional scan per argument, input order kept in _ord."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusflow import functions as fn
from censusflow.operators.clean import COLUMNS, DATA, ORD

log = logging.getLogger(__name__)

# Other accepted headers and the columns they stand for.
HEADER_ALIASES = {
    "timestamp": "token_creation_time",
    "first_seen": "client_first_usage_time",
    "namespace": "namespace_path",
    "mount": "mount_path",
    "auth_backend": "auth_method",
    "type": "client_type",
    "alias_name": "entity_alias_name",
    "entity_alias": "entity_alias_name",
}

OPTIONS = {
    "header": True,
    "enforceSchema": True,
    "quote": '"',
    "escape": '"',
    "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE",
    "ignoreLeadingWhiteSpace": True,
    "columnNameOfCorruptRecord": "_bad",
    "mode": "PERMISSIVE",
}


class ExportError(ValueError):
    """An export that cannot be read."""


def header(spark: SparkSession, path: str) -> list[str]:
    options = {k: v for k, v in OPTIONS.items() if k not in ("header", "enforceSchema", "columnNameOfCorruptRecord")}
    try:
        first = spark.read.options(**options, multiLine=True, inferSchema=False).csv(path).head()
    except Exception as e:
        raise ExportError(f"error reading {path}: open: {str(e).splitlines()[0]}") from e
    if first is None:
        raise ExportError(f"error reading {path}: read header: the file is empty")
    return [x or "" for x in first]


def resolve(cells: Sequence[str], path: str = "") -> dict[str, int]:
    """Canonical column to position; the first position wins, other headers are left out."""
    found: dict[str, int] = {}
    for i, cell in enumerate(cells):
        name = cell.strip().lower()
        name = HEADER_ALIASES.get(name, name)
        if name in DATA:
            found.setdefault(name, i)
    if "client_id" not in found:
        raise ExportError(f'error reading {path}: required column "client_id" not found')
    return found


def scan(spark: SparkSession, path: str, file_ord: int = 0, multi_line: bool = True) -> DataFrame:
    """All rows of one file before the checks, with _bad set on rows of another width than the header.

    multi_line=False lets Spark split large files; it is for files without line breaks in fields.
    """
    cells = header(spark, path)
    at = resolve(cells, path)
    schema = ", ".join([f"_c{i} string" for i in range(len(cells))] + ["_bad string"])
    # without pruning, so that a row's width is always compared with the whole header's
    rows = spark.read.schema(schema).options(**OPTIONS, multiLine=multi_line, columnPruning=False).csv(path)
    order = F.struct(F.lit(file_ord).alias("file_ord"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    data = [(fn.trimmed(F.col(f"_c{at[c]}")) if c in at else F.lit("")).alias(c) for c in DATA]
    return rows.select(order.alias(ORD), F.lit(path).alias("source"), *data, F.col("_bad"))


def read_exports(spark: SparkSession, paths: Sequence[str], multi_line: bool = True, warn: bool = False) -> DataFrame:
    """Rows of all files in argument order, ragged rows and rows without a client_id left out.

    A path given twice is read twice. warn=True counts ragged rows per file first (one more scan) and logs them.
    """
    if not paths:
        raise ExportError("no input files")
    out = None
    for i, path in enumerate(paths):
        rows = scan(spark, path, i, multi_line)
        if warn and (n := rows.agg(F.count("_bad"), F.max("client_id")).first()[0]):
            log.warning("%s: skipped %d row(s) whose number of fields differs from the header's", path, n)
        rows = rows.where(F.col("_bad").isNull() & (F.col("client_id") != "")).select(ORD, *COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out
