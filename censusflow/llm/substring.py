"""Substring dedup by super-k-mers over words.

A window is k consecutive words of one document. Its minimiser is the least hash among its m-word grams; neighbouring
windows mostly share it, and a run of them (a super-k-mer) travels as one packed string to the minimiser's bucket. Equal
windows have equal minimisers, so they meet in one bucket, where sorting the windows exactly finds the equal ones.

Only minimisers that occur in two documents at least can hold a shared window, so a first pass over (minimiser, doc_id)
pairs decides which runs travel. A string goes to its bucket once per step of a task, with the smallest and largest doc_id
that have it, so copies by the thousand weigh little. The runs of a minimiser that stands in more than `hot` documents are cut
again by a second minimiser over longer grams, which splits its bucket; this changes no result. A bucket gives, for each of
its strings, the smallest doc_id that has each window, and a join by the string's digest, which Spark can split, brings that
back to all documents that have the string.

Windows are sorted by position: words are numbered, and ranks of 1, 2, 4, ... words give the rank of k words, so no window is
copied. Many buckets are sorted at once.

Defined cases: null or empty text has no words; a null doc_id is neither an earlier nor a later document, so its text
stays; rows with one doc_id count as one document and are never removed on each other's account; columns beside doc_id
and text are left out of the work; a very long text is one step of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusflow.llm.common import Words, kept, pieces

K, M, LONG, HOT = 50, 8, 24, 256
#: Words that are sorted at once; a bucket with more is sorted alone.
SORT = 1 << 19


def minimisers(w: Words, k: int, m: int) -> np.ndarray:
    """Least hash of the m-word grams of k words from each word on; there are k words at least."""
    n = len(w.hash) - k + 1
    least, span, width = w.grams(m), 1, k - m + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n])


def runs(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: start word, number of windows, minimiser, index of the text."""
    n = len(w.hash) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    least = minimisers(w, k, m)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    if not len(at):
        return none, none, none, none
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(least[at].view(np.int64)) != 0) | (np.diff(text[at]) != 0)))
    start = at[new]
    length = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
    return start, length, least[start].view(np.int64), text[start]


def _marks(k: int, m: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            _, _, least, text = runs(Words(texts), k, m)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[text]
            pairs = np.unique(np.stack((ids, least), 1), axis=0) if len(ids) else np.zeros((0, 2), np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "minimiser"])

    return work


_TRAVEL = "bucket long, run binary, doc_id long, tag long, start int, n int, lo long, hi long, packed binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.record_batch([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, names, strict=True)], names=[n for n, _ in names])


def _travel(k: int, m: int, long: int):
    """Runs whose minimiser is shared, and their strings: each once, with the documents of this step that have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            w = Words(texts)
            start, length, least, text = runs(w, k, m)
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
            shared = [dict(zip(a, b, strict=True)) for a, b in zip(batch.column("shared").to_pylist(), batch.column("hot").to_pylist(), strict=True)]
            second = minimisers(w, k, long).view(np.int64) if any(h for d in shared for h in d.values()) else None
            rows: list[list] = []
            first: dict[bytes, list] = {}
            words, of = [], -1
            for s, n, x, t in zip(start.tolist(), length.tolist(), least.tolist(), text.tolist(), strict=True):
                hot = shared[t].get(x)
                if hot is None:
                    continue
                if t != of:
                    words, of, base = texts[t].split(), t, int(w.first[t])
                parts = [(s, n, x)]
                if hot:
                    cut = [0, *(np.flatnonzero(np.diff(second[s : s + n])) + 1).tolist(), n]
                    parts = [(s + a, b - a, x ^ int(second[s + a]) >> 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                for s, n, bucket in parts:
                    at = s - base
                    packed = b" ".join(words[at : at + n + k - 1])
                    run = hashlib.blake2b(packed, digest_size=16).digest()
                    row = [bucket, run, ids[t], tags[t], at, n, None, None, None]
                    if run in first:
                        have = first[run]
                        have[6], have[7] = min(have[6], ids[t]), max(have[7], ids[t])
                    else:
                        first[run] = row
                        row[6:] = ids[t], ids[t], packed
                    rows.append(row)
            for lo in range(0, len(rows), 20_000):
                yield _batch(rows[lo : lo + 20_000], _TRAVEL)

    return work


def window_ranks(strings: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window of k words, equal for equal windows alone, and how many windows each string has."""
    words = [s.split(b" ") for s in strings]
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    size = np.array([len(ws) for ws in words], np.int64)
    span = 1
    while span < k:
        step = min(span, k - span)
        rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1]
        span += step
    windows = size - k + 1
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return rank[at], windows


_FIRST = "run binary, firsts binary"


def first_seen(strings: list[list], k: int) -> list[tuple]:
    """(run, smallest doc_id of each of its windows) where that tells some document something. strings: run, lo, hi, packed."""
    rank, windows = window_ranks([s[3] for s in strings], k)
    by = np.argsort(rank, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], np.diff(rank[by]) != 0)))
    lo, hi = (np.repeat(np.array([s[c] for s in strings], np.int64), windows) for c in (1, 2))
    least = np.minimum.reduceat(lo[by], head)
    firsts = np.empty(len(rank), np.int64)
    firsts[by] = np.repeat(least, np.diff(np.append(head, len(rank))))
    ends = np.cumsum(windows)
    useful = np.add.reduceat((firsts < hi).astype(np.int64), ends - windows) > 0
    return [(strings[i][0], firsts[ends[i] - windows[i] : ends[i]].tobytes()) for i in np.flatnonzero(useful).tolist()]


def _buckets(k: int):
    """Buckets are neighbours; equal windows are never in different ones, so several are sorted together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, ready, size = None, {}, [], 0

        def close():
            nonlocal size
            if len(bucket) > 1 or any(lo < hi for _, lo, hi, _ in bucket.values()):
                ready.extend(bucket.values())
                size += sum(len(r[3]) for r in bucket.values()) // 6
            bucket.clear()

        for batch in batches:
            for b, run, lo, hi, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "run", "lo", "hi", "packed")), strict=True):
                if b != now:
                    close()
                    now = b
                    if size > SORT:
                        yield _batch(first_seen(ready, k), _FIRST)
                        ready, size = [], 0
                have = bucket.setdefault(run, [run, lo, hi, packed])
                have[1], have[2] = min(have[1], lo), max(have[2], hi)
        close()
        if ready:
            yield _batch(first_seen(ready, k), _FIRST)

    return work


_RANGE = "doc_id long, tag long, start int, n int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of runs that a smaller doc_id has too."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, tag, start, firsts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "start", "firsts")), strict=True):
            js = np.flatnonzero(np.frombuffer(firsts, np.int64) < doc)
            if len(js):
                rows += [(doc, tag, start + int(p[0]), len(p)) for p in np.split(js, np.flatnonzero(np.diff(js) != 1) + 1)]
        yield _batch(rows, _RANGE)


def repeated_ranges(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT, long: int = LONG) -> DataFrame:
    """(doc_id, tag, start, n): n windows from word `start` on that also start in a smaller doc_id. tag: hash of the text."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).where("doc_id is not null and text is not null")
    marks = kept(docs.select("doc_id", "text").mapInArrow(_marks(k, m), "doc_id long, minimiser long"), "marks")
    shared = marks.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    lists = marks.join(shared, "minimiser").groupBy("doc_id").agg(F.collect_list("minimiser").alias("shared"), F.collect_list(F.col("c") > hot).alias("hot"))
    runs_ = kept(docs.join(lists, "doc_id").select("doc_id", "tag", "text", "shared", "hot").mapInArrow(_travel(k, m, long), _TRAVEL), "runs")
    strings = runs_.where("packed is not null").select("bucket", "run", "lo", "hi", "packed")
    firsts = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(k), _FIRST)
    return runs_.select("run", "doc_id", "tag", "start").join(firsts, "run").select("doc_id", "tag", "start", "firsts").mapInArrow(_meet, _RANGE)


def _cut(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for t, ranges in zip(texts, batch.column("ranges").to_pylist(), strict=True):
                words = t.split()
                left = words
                if ranges:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for r in ranges:
                        gone[r["start"]] += 1
                        gone[min(r["start"] + r["n"] + k - 1, len(words))] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                text = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text if len(left) < len(words) else t)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string()), batch.column("tag")],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "tag"],
            )

    return work


def substring_dedup(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """Cut each word that a repeated window covers: doc_id, n_words, n_removed, kept_sha256, kept_text, tag.

    kept_text is the text itself where nothing was cut, else the kept words joined by one space; tag is xxhash64(text).
    """
    ranges = repeated_ranges(docs, k, m, hot).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).join(ranges, ["doc_id", "tag"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, tag long"
    return rows.select("doc_id", "text", "ranges", "tag").mapInArrow(_cut(k), schema)
