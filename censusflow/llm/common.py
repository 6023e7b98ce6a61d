"""What several corpus operators share: words of whole texts, their hashes, batches of bounded size, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusflow.sources.shared import drop, kept, new_path, shared_dir

__all__ = ["Words", "components", "drop", "held_out", "kept", "mix", "new_path", "partitions", "pieces", "read", "shared_dir", "table"]

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _C[0] + np.uint64(seed)) | np.uint64(1)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of several texts: 64-bit hashes in reading order and where each text's words start."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        space = _SPACE[buf]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(starts, at).astype(np.int64)
        if len(starts):
            sizes = ends - starts
            inside = np.arange(len(buf), dtype=np.int64)
            inside -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(buf)]))))
            h = mix(buf.astype(np.uint64) * _C[0] + inside.astype(np.uint64) * _C[2])
            h[space] = 0
            self.hash = mix(np.add.reduceat(h, starts) + sizes.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, n: int) -> np.ndarray:
        """Hash of n neighbouring words at each start; starts near a text's end reach into the next text."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(size, np.uint64)
        for j, m in enumerate(multipliers(n)):
            out += self.hash[j : j + size] * m
        return mix(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns asked for."""
    return docs.select(*columns)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most `limit` bytes of text (one row at least) with their texts as UTF-8; null reads as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
        start, size = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
            if k > start and size + n > limit:
                yield batch.slice(start, k - start), [t or b"" for t in col.slice(start, k - start).to_pylist()]
                start, size = k, 0
            size += n
        if start < len(col):
            yield batch.slice(start), [t or b"" for t in col.slice(start).to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(n: int, remainder: int):
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == remainder, F.lit(False))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for ids that have a link.

    Each round takes the least label among neighbours, then the label of that label (so long chains halve), and keeps
    the result in the shared folder. All is keyed min aggregates, which combine on the map side: hubs are no bottleneck.
    """
    both = kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("component").alias("top"))
        nxt = kept(step.join(up, "new").select("id", "old", F.least("new", "top").alias("component")), "labels")
        done = nxt.where("old <> component").isEmpty()
        labels = nxt.select("id", "component")
        if done:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")
