"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 32 words of the documents. A first scan counts in how many passages each benchmark word stands and,
for a fixed random matrix W, sums A'(A W) over all passages A: the sketch of a randomised SVD, of fixed size. With the
inverse document frequencies it gives the leading right singular vectors of the TF-IDF matrix. A second scan looks at every passage, 16
words apart. Those with a fair share of their TF-IDF energy in benchmark words are taken into the latent space (words that no
item has add to the length only, by an estimated weight), and those whose cosine with an item is high are candidates. This
search may miss, so
anchors add every passage around which an item can stand at all: at most n - m of an item's n words may be missing, so of
any A of them at least A - (n - m) stand there; the rarest are taken. Where fewer words are enough with the answer, the
places of the answer are taken, or if it has one or two words, anchors for `some`. So the result is that of comparing every item at every passage. Each candidate
is then compared word by word around the passage: the longest common subsequence with the item, and whether the item's
answer (its last sentence) stands there. An item counts as leaked if the subsequence holds `most` of its words, or `some` of
them together with the answer.

Benchmark items are taken in blocks of `block`, one after another, so what is sent to tasks has a fixed size. Words are in
lower case without punctuation.

Defined cases: null or empty texts and items give nothing; a null doc_id is kept; repeated rows and items are reported once
per (doc_id, item_id); texts of fewer words than a window are one passage; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusflow.llm.common import pieces

WINDOW, HALF, RANK, BLOCK = 32, 16, 96, 2_000
ENERGY, COSINE, MOST, SOME = 0.2, 0.62, 0.7, 0.5
#: Share of an item's words that its anchors have beyond those that may be missing; any value finds the same.
SPARE = 0.15
_SIGNS = b".,;:!?\"'()[]{}|*#$%&"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _SIGNS).split()


def answer(text: bytes) -> list[bytes]:
    """Words of the last sentence."""
    parts = [w for w in map(words, re.split(rb"\n|\.(?=\s|$)", text)) if w]
    return parts[-1] if parts else []


@dataclass
class Block:
    """One block of benchmark items."""

    items: list  # (item_id, words, answer)
    vocabulary: dict  # word to row

    @staticmethod
    def of(rows) -> Block:
        items = [(r["item_id"], words(t), answer(t)) for r in rows for t in [(r["text"] or "").encode()]]
        items = [i for i in items if i[1]]
        vocabulary: dict[bytes, int] = {}
        for _, ws, ans in items:
            for w in (*ws, *ans):
                vocabulary.setdefault(w, len(vocabulary))
        return Block(items, vocabulary)


def _known(texts: list[list[bytes]], vocabulary: dict, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each benchmark word in the texts, its stretch of `span` words, each text's first stretch, and the row of every word (-1: none)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    get = vocabulary.get
    rows = np.fromiter((get(w, -1) for t in texts for w in t), np.int32, int(sizes.sum()))
    stretches = -(-sizes // span)
    first = np.concatenate(([0], np.cumsum(stretches)))
    at = np.flatnonzero(rows >= 0)
    text = np.searchsorted(np.cumsum(sizes), at, side="right")
    inside = at - (np.cumsum(sizes) - sizes)[text]
    return rows[at], first[text] + inside // span, first, rows


def _sketch(sent, rank: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        v = len(vocabulary)
        w = np.random.default_rng(11).normal(size=(v, rank)).astype(np.float32)
        df, g, total = np.zeros(v, np.int64), np.zeros((v, rank)), 0
        for _, texts in pieces(batches):
            rows, passage, first, _ = _known([words(t) for t in texts], vocabulary, WINDOW)
            total += int(first[-1])
            if not len(rows):
                continue
            head = np.flatnonzero(np.concatenate(([True], np.diff(passage) != 0)))
            y = np.add.reduceat(w[rows], head)
            place = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(rows))))
            by = np.argsort(rows.astype(np.uint16) if v < 1 << 16 else rows, kind="stable")
            sorted_ = rows[by]
            start = np.flatnonzero(np.concatenate(([True], np.diff(sorted_) != 0)))
            g[sorted_[start]] += np.add.reduceat(y[place[by]], start)
            fresh = np.concatenate(([True], (np.diff(sorted_) != 0) | (np.diff(place[by]) != 0)))
            df += np.bincount(sorted_[fresh], minlength=v)
        if total:
            parts = np.array_split(np.concatenate((g, df[:, None]), 1), 16)
            yield pa.record_batch([pa.array(range(16), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([total] + [0] * 15, pa.int64())], names=["slice", "sums", "passages"])

    return work


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for s, x, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "sums", "passages")), strict=True):
            x = np.frombuffer(x)
            have = sums.setdefault(s, [np.zeros(len(x)), 0])
            have[0] = have[0] + x
            have[1] += n
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=["slice", "sums", "passages"])


_SKETCH = "slice int, sums binary, passages long"


def latent(docs: DataFrame, block: Block, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weight times latent place of each benchmark word (vocabulary x rank), and weights, that of other words last."""
    v = len(block.vocabulary)
    rank = min(rank, v)
    sent = docs.sparkSession.sparkContext.broadcast(block.vocabulary)
    rows = docs.select("text").mapInArrow(_sketch(sent, rank), _SKETCH).repartition(16, "slice").mapInArrow(_add, _SKETCH).collect()
    parts = np.array_split(np.zeros((v, rank + 1)), 16)
    for r in rows:
        parts[r["slice"]] = np.frombuffer(r["sums"]).reshape(-1, rank + 1)
    sums, total = np.concatenate(parts), sum(r["passages"] for r in rows)
    g, df = sums[:, :rank], sums[:, rank]
    idf = np.log((total + 1) / (df + 1)) + 0.1
    # A'A is near g (W'g)^-1 g'; weighted by idf on both sides, its leading eigenvectors are the right singular vectors
    w = np.random.default_rng(11).normal(size=(v, rank)).astype(np.float32).astype(np.float64)
    core = w.T @ g
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    keep = value > max(1e-9, 1e-7 * value.max(initial=0))
    root = (g @ vector[:, keep]) / np.sqrt(value[keep])
    u, s, _ = np.linalg.svd(idf[:, None] * root, full_matrices=False)
    u = u[:, s > 1e-6 * s.max(initial=0)] if s.size else u
    missing = v - u.shape[1]
    if not u.shape[1] or missing <= 0:
        u = np.eye(v)[:, :rank]
    return (idf[:, None] * u).astype(np.float32), np.append(idf, np.log(total + 1) + 0.1)


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, one bit per word of a."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for w in b:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


_MATCH = "doc_id long, item_id long, start_word long, matched long, item_words long, ratio double, cosine double, answer_found boolean, n_words long"


class Anchors:
    """Passages of a piece of text around which an item can have `most` of its words, or its answer."""

    def __init__(self, block: Block, weight: np.ndarray, most: float, some: float):
        self.items = []  # words of the item, rows of its anchors, how many of them must stand near, rows of the answer, its rarest word
        for _, ws, ans in block.items:
            n, counts = len(ws), Counter(block.vocabulary[w] for w in ws)
            missing = max(0, n - math.ceil((most if len(ans) >= 3 else min(most, some)) * n))  # answers of one or two words are too frequent to look up
            rows, size = [], 0
            for r in sorted(counts, key=lambda r: (-weight[r], r)):
                if size >= min(n, missing + max(1, math.ceil(SPARE * n))):
                    break
                rows.append(r)
                size += counts[r]
            said = np.array([block.vocabulary[w] for w in ans] if len(ans) >= 3 else [], np.int64)
            self.items.append((n, np.array(rows), size - missing, said, int(np.argmax(weight[said])) if len(said) else 0))
        self.size = len(block.vocabulary)

    def near(self, every: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items and their passages. every: row of each word of the texts."""
        at = np.flatnonzero(every >= 0)
        by = at[np.argsort(every[at], kind="stable")]
        cut = np.concatenate(([0], np.cumsum(np.bincount(every[at], minlength=self.size))))
        ends = np.cumsum(sizes)
        for i, (n, rows, k, said, rare) in enumerate(self.items):
            places = np.concatenate([by[cut[r] : cut[r + 1]] for r in rows])
            places.sort()
            lo, hi = places[: max(0, len(places) - k + 1)], places[k - 1 :]
            close = hi - lo < 2 * n + WINDOW
            lo, hi = lo[close], hi[close]
            if len(said):
                start = by[cut[said[rare]] : cut[said[rare] + 1]] - rare
                start = start[(start >= 0) & (start + len(said) <= len(every))]
                for j, r in enumerate(said):
                    start = start[every[start + j] == r]
                lo, hi = np.concatenate((lo, start)), np.concatenate((hi, start + len(said) - 1))
            if not len(lo):
                continue
            text = np.searchsorted(ends, lo, side="right")
            inside = hi < ends[text]
            lo, hi, text = lo[inside], hi[inside], text[inside]
            begin = ends[text] - sizes[text]
            # passages at which words lo to hi are within n words of the passage
            a = first[text] + np.maximum(0, -(-(hi - begin + 1 - WINDOW - n) // HALF))
            b = np.minimum(first[text + 1] - 1, first[text] + (lo - begin + n) // HALF)
            a, b = a[a <= b], b[a <= b]
            if len(a):
                yield i, np.unique(np.repeat(a - np.cumsum(b - a + 1) + (b - a + 1), b - a + 1) + np.arange(int((b - a + 1).sum())))


def queries(block: Block, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors of the windows of the items, 16 words apart, and the item of each."""
    parts = [(i, ws[at : at + WINDOW]) for i, (_, ws, _) in enumerate(block.items) for at in (*range(0, len(ws) - WINDOW, HALF), max(0, len(ws) - WINDOW))]
    return _unit(np.stack([place[[block.vocabulary[w] for w in ws]].sum(0) for _, ws in parts])), np.array([i for i, _ in parts])


def _search(sent, energy: float, cosine: float, most: float, some: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (place, weight) = sent.value
        vocabulary, k = block.vocabulary, place.shape[1]
        counts = [Counter(ws) for _, ws, _ in block.items]
        z, of = queries(block, place)
        by_item = [np.flatnonzero(of == i) for i in range(len(block.items))]
        need = np.array([cosine * min(1.0, (len(ws) / WINDOW) ** 0.5) for _, ws, _ in block.items], np.float32)[of]
        anchors = Anchors(block, weight, most, some)
        for batch, texts in pieces(batches):
            split = [words(t) for t in texts]
            rows, stretch, first, every = _known(split, vocabulary, HALF)
            size = int(first[-1])
            if not len(rows):
                continue
            full = np.full(size, HALF)
            sizes = np.array([len(t) for t in split])
            tails = first[1:][sizes > 0] - 1
            full[tails] = (sizes[sizes > 0] - 1) % HALF + 1
            own = np.bincount(stretch, weight[rows] ** 2, size)
            other = (full - np.bincount(stretch, minlength=size)) * weight[-1] ** 2
            joins = np.ones(size, bool)  # a text's last stretch has none after it
            joins[tails] = False
            own[:-1] += np.where(joins[:-1], own[1:], 0)
            other[:-1] += np.where(joins[:-1], other[1:], 0)
            strong = own >= energy * (own + other)
            pairs = {(int(p), i) for i, ps in anchors.near(every, sizes, first) for p in ps}
            near = strong.copy()
            near[[p for p, _ in pairs]] = True
            near = np.flatnonzero(near)
            if not len(near):
                continue
            wanted = np.zeros(size + 1, bool)
            wanted[near] = True
            wanted[near + 1] |= joins[near]
            take = wanted[stretch]
            rows, stretch = rows[take], stretch[take]
            sums = np.zeros((size + 1, k), np.float32)
            if len(rows):
                head = np.flatnonzero(np.concatenate(([True], np.diff(stretch) != 0)))
                sums[stretch[head]] = np.add.reduceat(place[rows], head)
            passages = _unit(sums[near] + np.where(joins[near, None], sums[near + 1], 0))
            for lo in range(0, len(near), 8192):
                p, i = np.nonzero((passages[lo : lo + 8192] @ z.T >= need) & strong[near[lo : lo + 8192], None])
                pairs.update(zip(near[p + lo].tolist(), of[i].tolist(), strict=True))
            found: dict[tuple[int, int], tuple] = {}
            docs = batch.column("doc_id").to_pylist()
            for p, i in sorted(pairs):
                t = int(np.searchsorted(first, p, side="right")) - 1
                item, ws, ans = block.items[i]
                at = (p - int(first[t])) * HALF
                region = split[t][max(0, at - len(ws)) : at + WINDOW + len(ws)]
                had = found.get((t, i))
                there = set(region)
                if had and had[3] == len(ws) or sum(c for w, c in counts[i].items() if w in there) < some * len(ws):
                    continue
                m = common(ws, region)
                if had and had[3] >= m or m < some * len(ws):
                    continue
                m_ans = bool(ans) and (b" " + b" ".join(ans) + b" ") in (b" " + b" ".join(region) + b" ")
                if m >= most * len(ws) or m_ans:
                    c = float((z[by_item[i]] @ passages[np.searchsorted(near, p)]).max())
                    found[t, i] = (docs[t], item, at, m, len(ws), m / len(ws), c, m_ans, len(split[t]))
            if found:
                types = (*(pa.int64(),) * 5, pa.float64(), pa.float64(), pa.bool_(), pa.int64())
                yield pa.record_batch([pa.array(x, ty) for x, ty in zip(zip(*found.values(), strict=True), types, strict=True)], names=[c.split()[0] for c in _MATCH.split(", ")])

    return work


def leaks(docs: DataFrame, benchmark: DataFrame, energy: float = ENERGY, cosine: float = COSINE, most: float = MOST, some: float = SOME, rank: int = RANK, block: int = BLOCK) -> DataFrame:
    """One row per document and benchmark item that leaked into it, with the best match."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    out, after = None, None
    while True:
        rest = items if after is None else items.where(F.col("item_id") > after)
        rows = rest.orderBy("item_id", "text").limit(block).collect()
        if not rows:
            break
        after = rows[-1]["item_id"]
        if len(rows) == block:  # an item_id is not torn apart
            rows += items.where(F.col("item_id") == after).collect()
        one = Block.of(rows)
        if not one.items:
            continue
        place = latent(docs, one, rank)
        part = docs.mapInArrow(_search(spark.sparkContext.broadcast((one, place)), energy, cosine, most, some), _MATCH)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], _MATCH)
    best = F.max_by(F.struct(*[c.split()[0] for c in _MATCH.split(", ")][2:]), F.struct("matched", "cosine", -F.col("start_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
