"""Content-addressed token store.

A text's ids are cut where a rolling hash over the last 8 ids hits a mask, so equal passages give equal chunks wherever
they stand. A chunk's name is the digest of its bytes; each is stored once. A document is a recipe (names and sizes of
its chunks) with a Merkle root over the names. Layout below one folder, all Parquet:

  data          kind, key, n, payload (ids as little-endian unsigned 16 or 32 bits) of chunks, recipes as they came; one file a
                task, as executors fork for each file and folder on a local disk without Hadoop's native library
  manifest      doc_id, start in its part, n, names, sizes, root, part; parts are ranges in ascending doc_id order
  parts         part, number of documents and ids, start of its first id, Merkle root over its documents' roots

One scan encodes; chunks cross the network once (each task sends a chunk at most once, so a popular one is no hot key).
Reading takes each stored chunk once, checks its name, and joins small checksums, never payloads, to the recipes.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; repeated rows are documents of their
own (their order among each other is that of their content); an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from censusflow.llm.common import multipliers, mix, partitions
from censusflow.llm.tokens import encoded, encoder, forget

SPAN, LEAST, MASK_BITS, MOST = 8, 128, 9, 4096
_MULTIPLIERS = multipliers(SPAN, 7)


def name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; a lone last node moves up unchanged."""
    level = leaves or [name(b"")]
    while len(level) > 1:
        pairs = [name(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        level = pairs
    return level[0]


def cuts(docs: list[np.ndarray]) -> list[list[int]]:
    """Ends of each document's chunks: content-defined, LEAST to MOST ids each but for the last."""
    ends = np.cumsum([len(d) for d in docs])
    wide = np.concatenate([*docs, np.zeros(SPAN, "<u4")])
    hits = []
    for k in range(0, int(ends[-1]), 1 << 15):  # few enough for the processor's cache
        ids = wide[k : k + (1 << 15) + SPAN - 1].astype(np.uint64)
        rolling = np.zeros(max(0, len(ids) - SPAN + 1), np.uint64)
        for j, m in enumerate(_MULTIPLIERS):
            rolling += ids[j : j + len(rolling)] * m
        hits.append(np.flatnonzero((mix(rolling) >> np.uint64(64 - MASK_BITS)) == 0) + (k + SPAN))
    at = np.concatenate(hits)
    begins = ends - [len(d) for d in docs]
    of = np.searchsorted(ends, at)  # the document in which the window ends
    inside = (of < len(docs)) & (at - SPAN >= begins[np.minimum(of, len(docs) - 1)])
    every: list[list[int]] = [[] for _ in docs]
    for i, p in zip(of[inside].tolist(), (at[inside] - begins[of[inside]]).tolist(), strict=True):
        every[i].append(p)
    out = []
    for found, n in zip(every, map(len, docs), strict=True):
        doc, last = [], 0
        for p in [*found, n]:
            while p - last > MOST:
                last += MOST
                doc.append(last)
            if p - last >= LEAST or p == n:
                if p > last:
                    doc.append(p)
                last = p
        out.append(doc)
    return out


_ROW = "kind string, key binary, doc_id long, n long, names binary, sizes binary, payload binary"


def _encode(path: str, end: int, width: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, sent = TaskContext.get().partitionId(), 0, set()
        for batch, every in encoded(batches, path, end):
            rows: list[tuple] = []
            for doc, ids, ends in zip(batch.column("doc_id").to_pylist(), every, cuts(every), strict=True):
                data, names, sizes, at = ids.astype(width), [], [], 0
                for p in ends:
                    blob = data[at:p].tobytes()
                    key = name(blob)
                    names.append(key)
                    sizes.append(p - at)
                    if key not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(key)
                        rows.append(("chunk", key, None, p - at, None, None, blob))
                    at = p
                rows.append(("recipe", b"%016d/%d" % (part, serial), doc, len(ids), b"".join(names), np.array(sizes, "<u4").tobytes(), None))
                serial += 1
            types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _ROW.split(", ")])

    return work


_MANIFEST = "doc_id long, local long, n long, names binary, sizes binary, root binary, part int"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        local = at + np.cumsum(n) - n
        at += int(n.sum())
        roots = [merkle([x[i : i + 16] for i in range(0, len(x), 16)]) for x in batch.column("names").to_pylist()]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(local, pa.int64()), batch.column("n"), batch.column("names"), batch.column("sizes"), pa.array(roots, pa.binary()), pa.array(np.full(len(n), part), pa.int32())],
            names=[c.split()[0] for c in _MANIFEST.split(", ")],
        )


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Root of each part from its documents' roots, in the order of their starts; 2**16 leaves are folded at a time."""
    part, docs, ids, leaves = None, 0, 0, []

    def out():
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([ids], pa.int64()), pa.array([merkle(leaves)], pa.binary())], names=["part", "docs", "ids", "root"])

    for batch in batches:
        for p, n, root in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if p != part:
                if docs:
                    yield out()
                part, docs, ids, leaves = p, 0, 0, []
            docs, ids = docs + 1, ids + n
            leaves.append(root)
            if len(leaves) == 1 << 16:
                leaves = [merkle(leaves)]
    if docs:
        yield out()


def write_store(docs: DataFrame, folder: str, tokenizer: str, end: int = 0) -> None:
    """Encode all texts and write the store below `folder`."""
    spark = docs.sparkSession
    width = "<u2" if max(encoder(tokenizer).library.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    rows = docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, end, width), _ROW)
    first = [F.first(c).alias(c) for c in ("kind", "doc_id", "n", "names", "sizes", "payload")]
    once = rows.repartition(partitions(spark), "key").groupBy("key").agg(*first)  # a recipe's key is longer than a chunk's
    once.write.option("compression", "zstd").parquet(f"{folder}/data")
    recipes = _data(spark, folder, "recipe", "doc_id long, n long, names binary, sizes binary")
    placed = recipes.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "names").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "names")
    placed.select("doc_id", "n", "names", "sizes").mapInArrow(_place, _MANIFEST).write.option("compression", "zstd").parquet(f"{folder}/manifest")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    roots = manifest.select("part", "local", "n", "root").repartition("part").sortWithinPartitions("part", "local").mapInArrow(_part_roots, "part int, docs long, ids long, root binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    roots.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/parts")


def _data(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Rows of one kind."""
    return spark.read.schema(f"kind string, {schema}").parquet(f"{folder}/data").where(F.col("kind") == kind).drop("kind")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        good, crc = [], []
        for key, n, blob in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            good.append(name(blob) == key)
            crc.append(zlib.crc32(np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4").tobytes()))
        yield pa.record_batch([batch.column("key"), pa.array(good, pa.bool_()), pa.array(crc, pa.int64())], names=["key", "good", "crc"])


def _times(rows: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= rows[i]
        v >>= 1
        i += 1
    return out


@lru_cache(1)
def _zeros() -> list[np.ndarray]:
    """Linear maps of a CRC-32 register over GF(2) for 1, 2, 4, ... zero bytes, as tables by each of its four bytes."""
    op, out = [0xEDB88320] + [1 << i for i in range(31)], []  # one zero bit
    for k in range(3 + 40):
        if k >= 3:
            out.append(np.array([[_times(op, v << 8 * byte) for v in range(256)] for byte in range(4)], np.uint32))
        op = [_times(op, x) for x in op]
    return out


def joined_crcs(crc: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of joined data from those of its parts (of `size` bytes); a document's parts start at `first`, it has one at least."""
    ends = np.cumsum(size)
    last = np.repeat(np.append(first[1:], len(size)) - 1, np.diff(np.append(first, len(size))))
    after = ends[last] - ends  # bytes that follow in the document
    out = crc.astype(np.uint32)
    for k, op in enumerate(_zeros()):
        at = np.flatnonzero(after >> k & 1)
        v = out[at]
        out[at] = op[0][v & 255] ^ op[1][v >> 8 & 255] ^ op[2][v >> 16 & 255] ^ op[3][v >> 24]
    return np.bitwise_xor.reduceat(out, first)


_SUMS = "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        chunks = batch.column("chunks")
        sizes = chunks.value_lengths().to_numpy()
        first = np.cumsum(sizes) - sizes
        flat = pa.StructArray.from_arrays(chunks.flatten().flatten(), fields=list(chunks.type.value_type))
        flat = flat.take(pa.array(np.lexsort((flat.field("pos").to_numpy(), np.repeat(np.arange(len(sizes)), sizes)))))
        crc, size = flat.field("crc").to_numpy(), flat.field("size").to_numpy()
        names, n = flat.field("name").to_pylist(), batch.column("n").to_numpy()
        good = np.logical_and.reduceat(flat.field("good").to_numpy(zero_copy_only=False), first) & (np.add.reduceat(size, first) == n)
        roots = [merkle(names[a : a + k]) == root for a, k, root in zip(first.tolist(), sizes.tolist(), batch.column("root").to_pylist(), strict=True)]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(joined_crcs(crc, 4 * size, first).astype(np.int64)), pa.array(good & np.array(roots))],
            names=[c.split()[0] for c in _SUMS.split(", ")],
        )


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows with global starts. `parts` has one row per part, so it may be sent to every task."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    parts = spark.read.schema("part int, docs long, ids long, root binary, base long").parquet(f"{folder}/parts")
    return manifest.join(F.broadcast(parts.select("part", "base")), "part").withColumn("start", F.col("base") + F.col("local"))


def _steps(recipes: DataFrame) -> DataFrame:
    """One row per chunk of a recipe."""
    at = F.explode(F.sequence(F.lit(0), (F.length("names") / 16).cast("int") - 1)).alias("pos")
    rows = recipes.select("start", "doc_id", "n", "root", "names", "sizes", at)
    four = [F.conv(F.hex(F.substring(F.col("sizes"), F.col("pos") * 4 + i, F.lit(1))), 16, 10).cast("long") * (1 << 8 * (i - 1)) for i in (1, 2, 3, 4)]
    return rows.select("start", "doc_id", "n", "root", "pos", F.substring(F.col("names"), F.col("pos") * 16 + 1, F.lit(16)).alias("key"), sum(four[1:], four[0]).alias("size"))


def read_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the stored files: doc_id, start, n_tokens, ids_crc32, verified."""
    chunks = _data(spark, folder, "chunk", "key binary, n long, payload binary").mapInArrow(_checked, "key binary, good boolean, crc long")
    rows = _steps(_recipes(spark, folder)).join(chunks, "key")
    step = F.struct("pos", F.col("key").alias("name"), "size", "good", "crc")
    docs = rows.groupBy("start", "doc_id", "n", "root").agg(F.collect_list(step).alias("chunks"))  # as long as one document
    return docs.mapInArrow(_sums, _SUMS)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for chunks in batch.column("chunks").to_pylist():
            chunks.sort(key=lambda c: c["pos"])
            out.append(np.concatenate([np.frombuffer(c["payload"], "<u2" if len(c["payload"]) == 2 * c["size"] else "<u4") for c in chunks]).astype(np.int64))
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The documents themselves: doc_id, start, ids."""
    chunks = _data(spark, folder, "chunk", "key binary, n long, payload binary").select("key", "payload")
    rows = _steps(_recipes(spark, folder)).join(chunks, "key")
    docs = rows.groupBy("start", "doc_id").agg(F.collect_list(F.struct("pos", "size", "payload")).alias("chunks"))
    return docs.mapInArrow(_ids, "doc_id long, start long, ids array<long>")
