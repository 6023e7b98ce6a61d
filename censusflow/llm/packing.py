"""Packing along a space-filling curve.

A document's token counts, hashed into 256 cells and scaled to length one, are projected to three dimensions by fixed
random signs; the place on a Hilbert curve through them is its key. Documents are range-sorted by (key, doc_id), and
neighbours on the curve are packed one after another. A piece ends only where a sequence of `size` tokens is full; what
is left at the end of a sorted part is cut into sequences of a power of two, so no token of padding is needed.

One scan encodes and keeps the ids in the shared folder; the sort reads them from there, so texts are encoded once.
Equal documents are neighbours but may be split over parts, as doc_id is part of the sort.

Defined cases: null or empty text is the end id alone; a null doc_id sorts first among equal keys; repeated rows are
packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from censusflow.llm.common import kept, mix, partitions
from censusflow.llm.tokens import encoded, forget

SIZE, END, CELLS, DIMS, BITS = 4096, 2, 256, 3, 10


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of x, each coordinate below 2**bits): Skilling's transform."""
    x = x.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(docs: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document from its ids."""
    sizes = np.array([len(d) for d in docs])
    cell = (mix(np.concatenate(docs).astype(np.uint64)) % np.uint64(CELLS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(docs)), sizes) * CELLS + cell, minlength=len(docs) * CELLS).reshape(-1, CELLS)
    unit = np.sqrt(counts / sizes[:, None])  # length one
    signs = np.where(mix(np.arange(CELLS * DIMS, dtype=np.uint64) + np.uint64(99)) & np.uint64(1), 1.0, -1.0).reshape(CELLS, DIMS)
    place = np.tanh(unit @ signs * 0.7) * 0.5 + 0.5
    return hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _encode(path: str, end: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in encoded(batches, path, end):
            blobs = [(d.astype("<u2") if d.max() < 1 << 16 else d).tobytes() for d in docs]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(curve_keys(docs), pa.int64()), pa.array([len(d) for d in docs], pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "key", "n", "ids"],
            )

    return work


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, sequence long, offset long"


def _pack(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, sequence, used = TaskContext.get().partitionId(), 0, 0
        open_: list[list] = []  # pieces of the sequence that is being filled: doc_id, start, ids, doc_tokens, offset
        rows: list[tuple] = []

        def close():
            nonlocal sequence, used, open_
            rows.extend((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, part, sequence, at) for doc, start, ids, total, at in open_)
            sequence, used, open_ = sequence + 1, 0, []

        def put(doc, ids, total, begin, room):
            nonlocal used
            at = 0
            while at < len(ids):
                n = min(room - used, len(ids) - at)
                open_.append([doc, begin + at, ids[at : at + n], total, used])
                used, at = used + n, at + n
                if used == room:
                    close()

        for batch in batches:
            for doc, n, blob in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                put(doc, np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4"), n, 0, size)
            if rows:
                yield _batch(rows)
                rows.clear()
        rest, open_, left, used = open_, [], used, 0
        room = 1 << max(0, left.bit_length() - 1)
        for doc, start, ids, total, _ in rest:
            at = 0
            while at < len(ids):
                n = min(room - used, len(ids) - at)
                put(doc, ids[at : at + n], total, start + at, room)
                at += n
                if not used:
                    left -= room
                    room = 1 << max(0, left.bit_length() - 1)
        if rows:
            yield _batch(rows)

    return work


def _batch(rows):
    types = (pa.int64(),) * 5 + (pa.int32(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])


def pack(docs: DataFrame, tokenizer: str, end: int = END, size: int = SIZE) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. sequence_id is gapless from 0."""
    ids = kept(docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, end), "doc_id long, key long, n long, ids binary"), "ids")
    order = (F.col("key"), F.col("doc_id").asc_nulls_first())
    curve = ids.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    pieces = kept(curve.mapInArrow(_pack(size), _PIECE), "pieces")
    counts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("k"))  # one row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    out = pieces.join(F.broadcast(bases), "part").withColumn("sequence_id", F.col("base") + F.col("sequence"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
