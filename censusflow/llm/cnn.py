"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Each chunk's bytes get learned vectors and one fixed channel
(whether the last four bytes also end within the LAGS bytes before), learned filters run over them, and each filter keeps its
highest answer in the chunk. The text's features are, per filter, the highest and the mean of
its chunks' answers; a linear layer makes one probability of them. Labels, language, source and id are never inputs.

Fitting takes a bounded sample of labelled rows: at most `per_class` of each label, those with the smallest hash of doc_id
among texts of at most `longest` bytes, each with all of its chunks. Of a repeated doc_id one text is taken. The intercept is
then moved to the share of labels among all training rows.

Defined cases: null and empty texts are a chunk of padding; very long texts are scored whole, some chunks at a time; without labels of both kinds every score is the share of
label 1 (0.5 without labels); repeated rows are scored each; columns beside doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusflow.llm.common import pieces

CHUNK, STEP, PACE, WIDTH = 512, 448, 4, 3  # a filter sees WIDTH groups of PACE bytes
EMBED, FILTERS, LAGS = 8, 32, 24  # EMBED counts the fixed channel
PER_CLASS, LONGEST, EPOCHS, BATCH, RATE = 1_500, 32 << 10, 8, 64, 4e-3
THRESHOLD = 0.3


def chunks(text: bytes) -> np.ndarray:
    """All chunks of a text, zero bytes at its end."""
    n = max(1, -(-(len(text) - (CHUNK - STEP)) // STEP))
    buf = np.zeros(STEP * n + CHUNK - STEP, np.uint8)
    buf[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[::STEP]


def repeats(c: np.ndarray) -> np.ndarray:
    """Whether the four bytes that end here also end up to LAGS bytes earlier in the chunk."""
    wide = c.astype(np.uint32)
    four = wide[:, :-3] | (wide[:, 1:-2] << np.uint32(8)) | (wide[:, 2:-1] << np.uint32(16)) | (wide[:, 3:] << np.uint32(24))
    out = np.zeros(c.shape, bool)
    for lag in range(1, LAGS + 1):
        out[:, 3 + lag :] |= four[:, lag:] == four[:, :-lag]
    return out & (c != 0)


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED - 1
    filters: np.ndarray  # WIDTH * PACE * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # highest, then mean
    shift: np.ndarray  # intercept

    def params(self):
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def inputs(self, c: np.ndarray) -> np.ndarray:
        x = np.empty((*c.shape, EMBED), np.float32)
        x[..., :-1] = self.embed[c]
        x[..., -1] = repeats(c)
        return x.reshape(len(c), CHUNK // PACE, PACE * EMBED)

    def windows(self, c: np.ndarray) -> np.ndarray:
        x = self.inputs(c)
        k = CHUNK // PACE - WIDTH + 1
        return np.concatenate([x[:, i : i + k] for i in range(WIDTH)], 2)

    def pooled(self, c: np.ndarray) -> np.ndarray:
        """Highest answer of each filter in each chunk."""
        step = PACE * EMBED
        x = self.inputs(c)
        k = CHUNK // PACE - WIDTH + 1
        y = sum(x[:, i : i + k] @ self.filters[i * step : (i + 1) * step] for i in range(WIDTH))
        return np.maximum(y.max(1) + self.bias, 0)

    def logits(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(pooled, first)
        mean = np.add.reduceat(pooled, first) / np.diff(np.append(first, len(pooled)))[:, None]
        return np.concatenate((top, mean), 1) @ self.out + self.shift


def _gradients(net: Net, c: np.ndarray, first: np.ndarray, label: np.ndarray):
    n, f = len(c), net.filters.shape[1]
    win = net.windows(c)
    y = win @ net.filters
    arg = y.argmax(1)
    pooled = np.maximum(np.take_along_axis(y, arg[:, None], 1)[:, 0] + net.bias, 0)
    size = np.diff(np.append(first, n))
    owner = np.repeat(np.arange(len(first)), size)
    top = np.maximum.reduceat(pooled, first)
    mean = np.add.reduceat(pooled, first) / size[:, None]
    feats = np.concatenate((top, mean), 1)
    p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.shift, -30, 30)))
    d = (p - label) / len(first)
    g_out, g_shift = feats.T @ d, np.array([d.sum()])
    df = d[:, None] * net.out[None]
    winner = (pooled == top[owner]) / np.maximum(1, np.add.reduceat((pooled == top[owner]).astype(np.float32), first))[owner]
    dm = (df[owner, :f] * winner + df[owner, f:] / size[owner][:, None]) * (pooled > 0)
    rows = np.arange(n)[:, None]
    chosen = win[rows, arg]
    g_filters = np.einsum("nf,nfw->wf", dm, chosen)
    g_bias = dm.sum(0)
    back = (dm[:, :, None] * net.filters.T[None]).reshape(n, f, WIDTH * PACE, EMBED)
    at = arg[:, :, None] * PACE + np.arange(WIDTH * PACE)
    seen = c[rows[:, :, None], at].ravel()
    flat = back.reshape(-1, EMBED)
    g_embed = np.stack([np.bincount(seen, flat[:, e], 256) for e in range(EMBED - 1)], 1)
    return [g_embed, g_filters, g_bias, g_out, g_shift]


def batches_of(order: np.ndarray, samples: list[np.ndarray], most: int = 8 * BATCH) -> Iterator[np.ndarray]:
    """Up to BATCH texts of up to `most` chunks together, one text at least."""
    start, size = 0, 0
    for k, i in enumerate(order):
        if k > start and (k - start == BATCH or size + len(samples[i]) > most):
            yield order[start:k]
            start, size = k, 0
        size += len(samples[i])
    if start < len(order):
        yield order[start:]


def fit(samples: list[np.ndarray], labels: np.ndarray, share: float, seed: int = 7) -> Net:
    """samples: chunks of each text; share: of label 1 among all training rows."""
    rng = np.random.default_rng(seed)
    width = WIDTH * PACE * EMBED
    net = Net(*(a.astype(np.float32) for a in (rng.normal(0, 0.5, (256, EMBED - 1)), rng.normal(0, width**-0.5, (width, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1))))
    if len(set(labels.tolist())) == 2:
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.params()]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(samples))
            for part in batches_of(order, samples):
                first = np.cumsum([0, *(len(samples[i]) for i in part[:-1])])
                grads = _gradients(net, np.concatenate([samples[i] for i in part]), first, labels[part].astype(np.float32))
                step += 1
                rate = RATE * (0.5 if epoch >= EPOCHS // 2 else 1) * (0.4 if epoch >= EPOCHS - 2 else 1)
                for p, g, (m, v) in zip(net.params(), grads, moments, strict=True):
                    g = g.astype(np.float32)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        had = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        net.shift += np.float32(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))) - np.log(had / (1 - had)))
    else:
        net.out[:] = 0
        net.shift[:] = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Net:
    """labels: doc_id, label (0 or 1; others are left out). Only sampled texts reach the driver: 2 * per_class * longest bytes at most."""
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    total = {r["label"]: r["c"] for r in labels.groupBy("label").agg(F.count("*").alias("c")).collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).select("doc_id", "text")
    named = short.select("doc_id").join(labels, "doc_id").distinct()
    picked = None
    for k in (0, 1):
        part = named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    return fit([chunks(r["text"].encode()) for r in rows], np.array([r["label"] for r in rows]), share)


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    parts = [chunks(t) for t in texts]
    first = np.cumsum([0, *(len(p) for p in parts[:-1])])
    every = np.concatenate(parts)
    pooled = np.concatenate([net.pooled(every[k : k + 256]) for k in range(0, len(every), 256)])
    return 1 / (1 + np.exp(-np.clip(net.logits(pooled, first), -30, 30).astype(np.float64)))


def _score(net):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(probabilities(net.value, texts))], names=["doc_id", "held_out", "score"])

    return work


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for all texts; rows where held_out is true never teach."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out), **bounds))
    scored = docs.select("doc_id", "text", held_out.alias("held_out")).select("doc_id", "held_out", "text").mapInArrow(_score(net), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
