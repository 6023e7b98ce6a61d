"""Class-based bigram scoring with Brown classes from exchange clustering.

1. One scan counts all words of the training texts. The `top` most frequent ones (a fixed number) are sent to every task.
2. A second scan turns texts into blocks of numbers, kept in the shared folder: the place of a word among those sent, or
   its place in the block's own list of other words. All later passes read numbers.
3. Exchange clustering puts the `own` most frequent words in classes, one word at a time, on their bigram counts. All other
   words take part as ENDINGS units, by a hash of their last two bytes; that is only where they start. Then `rounds` rounds
   of exchange over the other words sent: the classes beside each word are counted by word, and all of these words go at
   once to the class in which their neighbours are most likely.
4. All other words travel once to the bucket of their word, with the classes that stand beside them. There a word's training
   count is summed and it goes to the class in which its neighbours are most likely. Both go back to the blocks that asked,
   so counts and classes of any number of words are exact and nothing that grows with the corpus is sent to every task.
5. Class bigrams are counted over all training texts, and P(text) = product of P(class | class before) * P(word | class).

Beside a word, neighbours outside those sent count with the class in which they start, and a word that no training text
has stays in that class.

Base: log10((c + 0.1) / (N + 0.1 (V + 1))) summed over tokens. Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; each
text ends with one end token, which is counted like a word.

Defined cases: null or empty text is the end token alone; without training texts all counts are 0; repeated rows count
and score each; a null doc_id is in training; ties go to the word or class that comes first; columns beside doc_id, text
and those that held_out reads are left out; a very long text is a block of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusflow.llm.common import kept, partitions, pieces

TOP, OWN, ENDINGS, CLASSES, SWEEPS, ROUNDS = 50_000, 1_000, 256, 64, 12, 3
#: Bytes of text of a block, tokens per bucket of other words on average, words handled at once, parts of a summed table.
TEXT, BUCKET, AT_ONCE, SLICES = 1 << 20, 4 << 20, 20_000, 64
ADD = 0.1
_END = b"\n"
_NONE = 255  # class of a word without one
_NULL = -(1 << 63)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for _, texts in pieces(batches):
        for t in texts:
            counts.update(t.lower().split())
        counts[_END] += len(texts)
        if len(counts) > 400_000:
            yield out()
            counts = Counter()
    if counts:
        yield out()


_BLOCK = "block long, ids binary, held binary, sizes binary, tokens binary, words binary, ends binary, cuts binary"


def _blocks(sent, buckets: int):
    """Texts as numbers. A token below 0 is -1 - its place in the block's other words, which come bucket by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(sent.value)}
        block = TaskContext.get().partitionId() << 32
        for batch, texts in pieces(batches, limit=TEXT):
            split = [t.lower().split() for t in texts]
            words = [w for t in split for w in (*t, _END)]
            tokens = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
            at = np.flatnonzero(tokens < 0)
            other = [words[i] for i in at.tolist()]
            list_ = list(dict.fromkeys(other))
            of = np.fromiter((zlib.crc32(w) % buckets for w in list_), np.int64, len(list_))
            by = np.argsort(of, kind="stable")
            list_ = [list_[i] for i in by.tolist()]
            number = {w: -1 - i for i, w in enumerate(list_)}
            tokens[at] = np.fromiter(map(number.__getitem__, other), np.int32, len(other))
            ends = np.fromiter((ending(w) for w in list_), np.uint8, len(list_))
            used, first = np.unique(of[by], return_index=True)
            ids = np.array([_NULL if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            held = np.array(batch.column("held_out").to_pylist(), np.uint8)
            sizes = np.array([len(t) + 1 for t in split], np.int32)
            yield _batch([(block, *(x.tobytes() for x in (ids, held, sizes, tokens)), b" ".join(list_), ends.tobytes(), np.stack((used, first)).tobytes())], _BLOCK)
            block += 1

    return work


def _rows(batches: Iterator[pa.RecordBatch], columns: str) -> Iterator[list]:
    """Rows with their binary columns as arrays."""
    kinds = {"ids": np.int64, "held": np.uint8, "sizes": np.int32, "tokens": np.int32, "ends": np.uint8, "classes": np.uint8, "counts": np.int64}
    names = columns.split()
    for batch in batches:
        for row in zip(*(batch.column(n) for n in names), strict=True):
            yield [np.frombuffer(x.as_py(), kinds[n]) if n in kinds else x.as_py() for n, x in zip(names, row, strict=True)]


def _trained(held: np.ndarray, sizes: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values of the tokens of training texts, in reading order. Each text ends with the end token, so texts may be joined."""
    if not held.any():
        return list(values)
    keep = np.repeat(held == 0, sizes)
    return [v[keep] for v in values]


def _places(tokens: np.ndarray, ends: np.ndarray, sent: int) -> np.ndarray:
    """Places of tokens among the words sent, and after them the units of other words."""
    out = tokens.astype(np.int64)
    at = np.flatnonzero(tokens < 0)
    out[at] = sent + ends[-1 - tokens[at]].astype(np.int64)
    return out


_SUM = "slice int, keys binary, sums binary"


class Table:
    """A table of counts of fixed size, summed over a task and sent on as the cells that aren't 0."""

    def __init__(self, size: int):
        self.size, self.sums, self.waiting = size, np.zeros(size, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        if sum(map(len, self.waiting)) > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.sums += np.bincount(np.concatenate(self.waiting), minlength=self.size)
            self.waiting = []

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        edges = np.linspace(0, self.size, SLICES + 1).astype(np.int64)
        rows = []
        for k in range(SLICES):
            part = self.sums[edges[k] : edges[k + 1]]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((k, at.astype(np.int32).tobytes(), part[at].astype(np.int64).tobytes()))
        yield _batch(rows, _SUM)


def _add(size: int):
    """Rows of a slice are neighbours; each slice's sums leave as one row."""
    edges = np.linspace(0, size, SLICES + 1).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def out():
            at = np.flatnonzero(sums)
            return _batch([(now, at.astype(np.int32).tobytes(), sums[at].tobytes())], _SUM)

        for batch in batches:
            for k, keys, more in zip(*(batch.column(c).to_pylist() for c in ("slice", "keys", "sums")), strict=True):
                if k != now:
                    if now is not None:
                        yield out()
                    now, sums = k, np.zeros(int(edges[k + 1] - edges[k]), np.int64)
                sums[np.frombuffer(keys, np.int32)] += np.frombuffer(more, np.int64)
        if now is not None:
            yield out()

    return work


def summed(parts: DataFrame, work: Callable, size: int) -> np.ndarray:
    """Sum of the tables of all tasks; its size doesn't depend on the rows."""
    edges = np.linspace(0, size, SLICES + 1).astype(np.int64)
    out = np.zeros(size, np.int64)
    found = parts.mapInArrow(work, _SUM).repartition(min(SLICES, partitions(parts.sparkSession)), "slice").sortWithinPartitions("slice").mapInArrow(_add(size), _SUM)
    for r in found.collect():
        out[edges[r["slice"]] + np.frombuffer(r["keys"], np.int32)] = np.frombuffer(r["sums"], np.int64)
    return out


def _pairs(of: np.ndarray, units: int):
    """Bigrams of units in training texts. of: unit of each place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(units * units)
        for held, sizes, tokens, ends in _rows(batches, "held sizes tokens ends"):
            (tokens,) = _trained(held, sizes, tokens)
            if len(tokens):
                unit = of[_places(tokens, ends, len(of) - ENDINGS)].astype(np.int64)
                table.add(np.roll(unit, 1) * units + unit)
        yield from table.rows()

    return work


def _class_pairs(classes: int):
    """Bigrams of classes in training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(classes * classes)
        for held, sizes, k in _rows(batches, "held sizes classes"):
            (k,) = _trained(held, sizes, k)
            if len(k):
                k = k.astype(np.int64)
                table.add(np.roll(k, 1) * classes + k)
        yield from table.rows()

    return work


def _beside(of: np.ndarray, classes: int):
    """Classes after (first) and before each place, in training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(len(of) * 2 * classes)
        for held, sizes, tokens, ends in _rows(batches, "held sizes tokens ends"):
            (tokens,) = _trained(held, sizes, tokens)
            if not len(tokens):
                continue
            at = _places(tokens, ends, len(of) - ENDINGS)
            k = of[at].astype(np.int64)
            table.add(at * 2 * classes + np.roll(k, -1))
            table.add(at * 2 * classes + classes + np.roll(k, 1))
        yield from table.rows()

    return work


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: each unit in turn goes where the bigram likelihood of classes is highest, until none moves."""
    units = len(pairs)
    b = pairs.astype(np.float64)
    weight = b.sum(0) + b.sum(1)
    of = np.empty(units, np.int64)
    order = np.argsort(-weight, kind="stable")
    of[order] = np.arange(units) % classes
    member = np.eye(classes)[of]
    left, right = b @ member, b.T @ member  # unit to class after it, and before it
    n = member.T @ left
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, self_ = of[u], b[u, u]
            n[a] -= left[u]
            n[:, a] -= right[u]
            n[a, a] += self_
            to, fro = left[u].copy(), right[u].copy()
            to[a] -= self_
            fro[a] -= self_
            gain = (_xlogx(n + to) - _xlogx(n)).sum(1) + (_xlogx(n + fro[:, None]) - _xlogx(n)).sum(0)
            d = np.diag(n)
            gain += _xlogx(d + to + fro + self_) - _xlogx(d + to) - _xlogx(d + fro) + _xlogx(d)
            rows, cols = n.sum(1), n.sum(0)
            gain -= _xlogx(rows + to.sum() + self_) - _xlogx(rows) + _xlogx(cols + fro.sum() + self_) - _xlogx(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            n[best] += to
            n[:, best] += fro
            n[best, best] += self_
            if best != a:
                moved += 1
                of[u] = best
                left[:, a] -= b[:, u]
                left[:, best] += b[:, u]
                right[:, a] -= b[u]
                right[:, best] += b[u]
        if not moved:
            break
    return of


def likely(n: np.ndarray) -> np.ndarray:
    """What each class beside a word (after it, then before it) says for each class of the word, given class bigram counts."""
    n = n + 0.01
    return np.concatenate((np.log(n / n.sum(1, keepdims=True)).T, np.log(n / n.sum(0))))


def moved(beside: np.ndarray, had: np.ndarray, classes: int, own: int) -> np.ndarray:
    """A round of exchange: best class of each word sent after the first `own`, given all places' classes before the round."""
    n = np.zeros((classes, classes))
    np.add.at(n, had, beside[:, :classes])
    gain = beside @ likely(n)
    best = gain.argmax(1)
    rows = np.arange(len(had))
    return np.where((rows >= own) & (rows < len(had) - ENDINGS) & (gain[rows, best] > gain[rows, had] + 1e-9), best, had).astype(np.uint8)


@dataclass
class Model:
    tokens: int  # N
    types: int  # V
    step: np.ndarray  # log10 P(class | class before)
    mass: np.ndarray  # log10 of each class's denominator

    def base(self, c):
        return np.log10((c + ADD) / (self.tokens + ADD * (self.types + 1)))


_ASK = "bucket int, block long, first int, words binary, counts binary, beside binary, lengths binary"


def _ask(of: np.ndarray, classes: int):
    """A block's other words by bucket: training counts and the classes beside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, sizes, tokens, words, ends, cuts in _rows(batches, "block held sizes tokens words ends cuts"):
            if not words:
                continue
            words = words.split(b" ")
            (tokens,) = _trained(held, sizes, tokens)
            k = of[_places(tokens, ends, len(of) - ENDINGS)].astype(np.int64)
            at = np.flatnonzero(tokens < 0)
            mine = -1 - tokens[at].astype(np.int64)
            counts = np.bincount(mine, minlength=len(words))
            code = np.concatenate((np.roll(k, -1)[at], np.roll(k, 1)[at] + classes))
            mine = np.concatenate((mine, mine))
            code = code[np.argsort(mine, kind="stable")].astype(np.uint8)
            lengths = np.bincount(mine, minlength=len(words))
            start = np.concatenate(([0], np.cumsum(lengths)))
            used, first = np.frombuffer(cuts, np.int64).reshape(2, -1)
            stops = np.append(first[1:], len(words))
            yield _batch(
                [
                    (b, block, i, b" ".join(words[i:j]), counts[i:j].astype(np.int32).tobytes(), code[start[i] : start[j]].tobytes(), lengths[i:j].astype(np.int32).tobytes())
                    for b, i, j in zip(used.tolist(), first.tolist(), stops.tolist(), strict=True)
                ],
                _ASK,
            )

    return work


_ANSWER = "block long, first int, classes binary, counts binary"


def _answer(says: np.ndarray, classes: int):
    """Each word's class and count over all blocks, for the blocks that asked; and classes' counts and types (block null)."""

    def bucket(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        place = []
        for _, _, words, *_ in rows:
            split = words.split(b" ")
            place.append(np.fromiter((number.setdefault(w, len(number)) for w in split), np.int64, len(split)))
        size = len(number)
        every = np.concatenate(place)
        counts = np.bincount(every, np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]), size).astype(np.int64)
        code = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows])
        word = np.repeat(every, np.concatenate([np.frombuffer(r[5], np.int32) for r in rows]))
        by = np.argsort(word, kind="stable")
        code, word = code[by], word[by]
        best = np.empty(size, np.uint8)
        for lo in range(0, size, AT_ONCE):
            hi = min(size, lo + AT_ONCE)
            i, j = np.searchsorted(word, (lo, hi))
            table = np.bincount((word[i:j] - lo) * 2 * classes + code[i:j], minlength=(hi - lo) * 2 * classes)
            best[lo:hi] = (table.reshape(-1, 2 * classes).astype(np.float32) @ says).argmax(1)
        best[counts == 0] = _NONE
        seen = counts > 0
        sums = np.stack((np.bincount(best[seen], counts[seen], classes), np.bincount(best[seen], minlength=classes))).astype(np.int64)
        yield _batch([(None, None, None, sums.tobytes())], _ANSWER)
        for lo in range(0, len(rows), 512):
            yield _batch([(r[0], r[1], best[p].tobytes(), counts[p].tobytes()) for r, p in zip(rows[lo : lo + 512], place[lo : lo + 512], strict=True)], _ANSWER)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(c.split()[0]).to_pylist() for c in _ASK.split(", ")), strict=True):
                if b != now and rows:
                    yield from bucket(rows)
                    rows = []
                now = b
                rows.append(row)
        if rows:
            yield from bucket(rows)

    return work


_CLASSED = "ids binary, held binary, sizes binary, classes binary, counts binary"


def _classed(sent):
    """Class and count of each token, of a block and the answers to it, which follow it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, have = sent.value  # classes of all places, counts of the words sent
        block, text, cls, counts = None, None, [], []

        def out():
            ids, held, sizes, tokens, ends = text
            at = np.frombuffer(tokens, np.int32)
            at = np.where(at < 0, len(have) - 1 - at, at)  # the block's words come after those sent
            starts = of[len(have) + np.frombuffer(ends, np.uint8).astype(np.int64)]
            others = np.concatenate(cls) if cls else starts
            k = np.concatenate((of[: len(have)], np.where(others == _NONE, starts, others)))
            c = np.concatenate([have, *counts])
            return _batch([(ids, held, sizes, k[at].tobytes(), c[at].tobytes())], _CLASSED)

        for batch in batches:
            names = ("block", "ids", "held", "sizes", "tokens", "ends", "classes", "counts")
            for b, ids, held, sizes, tokens, ends, k, c in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if b != block:
                    if text is not None:
                        yield out()
                    block, text, cls, counts = b, None, [], []
                if ids is not None:
                    text = (ids, held, sizes, tokens, ends)
                else:
                    cls.append(np.frombuffer(k, np.uint8))
                    counts.append(np.frombuffer(c, np.int64))
        if text is not None:
            yield out()

    return work


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for ids, held, sizes, k, c in _rows(batches, "ids held sizes classes counts"):
            size = len(ids)
            of = np.repeat(np.arange(size), sizes)
            before = np.roll(k, 1)  # the end token of the text before
            terms = np.bincount(of, m.step[before, k] + np.log10(c + ADD) - m.mass[k], size)
            cols = [
                pa.array(ids, mask=ids == _NULL),
                pa.array(held.astype(bool)),
                pa.array(sizes.astype(np.int64)),
                pa.array(np.bincount(of, c > 0, size).astype(np.int64)),
                pa.array(np.full(size, m.tokens, np.int64)),
                pa.array(np.bincount(of, m.base(c), size)),
                pa.array(terms),
                pa.array(10 ** np.minimum(300, -terms / sizes)),
            ]
            yield pa.record_batch(cols, names=[x.split()[0] for x in _OUT.split(", ")])

    return work


def score(docs: DataFrame, held_out: Column, top: int = TOP, own: int = OWN, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Score all texts with a model of those where held_out is false."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    found = kept(rows.where("not held_out").select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total = found.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    best = found.where(F.col("word") != F.lit(_END)).orderBy(F.desc("c"), "word").limit(top - 1).collect()
    ends = found.where(F.col("word") == F.lit(_END)).collect()
    words = [_END, *(bytes(r["word"]) for r in best)]
    counts = np.array([ends[0]["c"] if ends else 0, *(r["c"] for r in best)], np.int64)
    parts = partitions(spark)
    buckets = max(parts, total["n"] // BUCKET + 1)
    blocks = kept(rows.mapInArrow(_blocks(spark.sparkContext.broadcast(words), buckets), _BLOCK), "blocks")

    own, sent = min(own, len(words)), len(words)
    places = np.concatenate((np.arange(own), own + np.fromiter(map(ending, words[own:]), np.int64, sent - own), own + np.arange(ENDINGS)))
    units = own + ENDINGS
    of = exchange(summed(blocks, _pairs(places, units), units * units).reshape(units, units), classes)[places].astype(np.uint8)
    for _ in range(rounds):
        of = moved(summed(blocks, _beside(of, classes), len(of) * 2 * classes).reshape(-1, 2 * classes), of, classes, own)

    n = summed(blocks, _pairs(of, classes), classes * classes).reshape(classes, classes)
    asked = blocks.mapInArrow(_ask(of, classes), _ASK)
    answers = kept(asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(likely(n).astype(np.float32), classes), _ANSWER), "answers")
    mine = of[:sent]
    sums = np.stack((np.bincount(mine, counts, classes), np.bincount(mine[counts > 0], minlength=classes)))
    for r in answers.where("block is null").select("counts").toLocalIterator():  # one row per bucket
        sums = sums + np.frombuffer(r["counts"], np.int64).reshape(2, classes)
    null = F.lit(None).cast("binary")
    texts = blocks.select("block", F.lit(-1).alias("first"), "ids", "held", "sizes", "tokens", "ends", null.alias("classes"), null.alias("counts"))
    told = answers.where("block is not null").select("block", "first", *[null.alias(c) for c in ("ids", "held", "sizes", "tokens", "ends")], "classes", "counts")
    both = texts.unionByName(told).repartition(parts, "block").sortWithinPartitions("block", "first")
    classed = kept(both.mapInArrow(_classed(spark.sparkContext.broadcast((of, counts))), _CLASSED), "classed")

    n = summed(classed, _class_pairs(classes), classes * classes).reshape(classes, classes)
    prior = (n.sum(0) + 1) / (n.sum() + classes)
    step = np.log10((n + prior) / (n.sum(1, keepdims=True) + 1))
    mass = np.log10(sums[0] + ADD * (sums[1] + 1))
    return classed.mapInArrow(_score(spark.sparkContext.broadcast(Model(total["n"], total["v"], step, mass))), _OUT)
