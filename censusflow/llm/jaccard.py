"""Similarity join on sets of word n-grams: rare-first prefix filtering with length, positional and suffix filters.

1. One scan makes a set digest, a histogram of the set over 64 hash ranges and the size for each text, and counts all
   n-grams into 2**18 hash cells. The cells have a fixed size (1 MB), so they can be sent to every task.
2. A second scan sorts each set by (cell count in log steps, hash), rare first. Two sets that link share an n-gram among
   their first |x| - ceil(0.85 |x|) + 1. Entries (n-gram, set digest, size, position) travel as packed blocks, so equal
   sets count once and a bucket is a few arrays.
3. Within a bucket, n-grams of at most `hub` sets give all pairs that the length and positional filters let through;
   the suffix filter (an upper bound of the overlap by the histograms) sees each pair once, then the texts are compared.
4. Larger groups make no pairs. Their sets travel once to each bucket of groups that needs them and are compared there by
   an index of their n-grams, labels of a union-find beside them: what already hangs together isn't compared, and only
   links that join two components leave the task, fewer than the group has sets. The first round groups each set by its
   rarest such n-gram alone, which joins most copies; the second takes all groups whose sets still lie in different
   components, and compares a pair only at the first n-gram it shares, so each pair is compared once. Groups too large
   for one task are cut into blocks of sets, and tasks take pairs of blocks.
5. An n-gram whose hash cell holds far more than its share goes past the buckets straight to step 4.

Neither `hub` nor the block size changes a result. Sets are told apart by two 64-bit digests and compared by 64-bit hashes
of their n-grams.

Defined cases: null or blank text has an empty set and links with nothing; a text of fewer words than n has one n-gram;
equal sets always link; a row with a null doc_id keeps its count, links with nothing and has a null component; repeated
rows give one row each; of texts that share a doc_id each brings its links to that id; columns beside doc_id and text are
left out; an empty table gives an empty result. A very long text is one step of its own in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from censusflow.llm.common import Words, components, kept, mix, partitions, pieces

N, PERCENT, HUB = 4, 85, 64
CELLS, RANGES = 18, 64
#: Prefix entries of a bucket, and n-gram hashes of a block of sets, on average.
ENTRIES, BLOCK = 1 << 21, 1 << 20
SECOND = 0x9E3779B97F4A7C15  # salt of the second digest
_U = np.uint64


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of each text, in lower case."""
    w = Words([t.lower() for t in texts])
    grams, out = w.grams(n), []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(w.hash[a:b] * _U(3) + np.arange(1, b - a + 1, dtype=_U)))], _U) + _U(b - a)))
        else:
            out.append(w.hash[:0])
    return out


def digest(x: np.ndarray, salt: int = 1) -> int:
    """Order-free 64-bit digest of a set of hashes."""
    return int(mix(x * _U(salt)).sum(dtype=_U).astype(np.int64)) if len(x) else 0


def needed(a, b, percent: int):
    """Least overlap with which sets of sizes a and b link: ceil(p (a + b) / (100 + p))."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


_SCAN = "doc_id long, n long, s1 long, s2 long, hist binary, slice int, cells binary"


def _scan(n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, some = np.zeros(1 << CELLS, np.uint32), False
        for batch, texts in pieces(batches):
            sets = shingles(texts, n)
            some = True
            every = np.concatenate(sets)
            cells += np.bincount((every >> _U(64 - CELLS)).astype(np.int64), minlength=1 << CELLS).astype(np.uint32)
            s1, s2 = [digest(x) for x in sets], [digest(x, SECOND) for x in sets]
            hist = [np.bincount(((x >> _U(20)) & _U(RANGES - 1)).astype(np.int64), minlength=RANGES).astype(np.int32).tobytes() for x in sets]
            k = len(sets)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array(hist, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=[c.split()[0] for c in _SCAN.split(", ")],
            )
        if some:
            parts = np.split(cells, 64)
            yield pa.record_batch(
                [pa.nulls(64, pa.int64())] * 4 + [pa.nulls(64, pa.binary()), pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=[c.split()[0] for c in _SCAN.split(", ")],
            )

    return work


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the slices of a partition; rows of one slice are neighbours."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            c = np.frombuffer(c, np.uint32).astype(np.uint64)
            sums[s] = sums[s] + c if s in sums else c
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "cells"])


def cell_steps(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all cells in 256 steps of an eighth of a doubling, the order that rare-first sorting needs, and which hold
    over 16 times their share and over a bucket's entries. Fixed size."""
    spark = scan.sparkSession
    parts = scan.where("slice is not null").select("slice", "cells").repartition(min(64, partitions(spark)), "slice").mapInArrow(_add_cells, "slice int, cells binary").collect()
    cells = np.zeros((64, (1 << CELLS) // 64), np.uint64)
    for p in parts:
        cells[p["slice"]] += np.frombuffer(p["cells"], np.uint64)
    count = cells.ravel().astype(np.float64)
    return np.minimum(255, 8 * np.log2(count + 1)).astype(np.uint64), count > max(ENTRIES, 16 * count.mean())


_BLOCK = "bucket int, tokens binary, sets binary, sizes binary, places binary"


def in_order(x: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's hashes, rare first, and the hashes in that order. Keys are not negative as signed numbers."""
    key = (steps[(x >> _U(64 - CELLS)).astype(np.int64)] << _U(55)) | (mix(x) >> _U(9))
    by = np.argsort(key, kind="stable")
    return key[by], x[by]


def _prefixes(n: int, percent: int, sent, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, hot = sent.value
        for _, texts in pieces(batches):
            tokens, sets, sizes, places, past, seen = [], [], [], [], [], set()
            for x in shingles(texts, n):
                if not len(x):
                    continue
                s = digest(x), digest(x, SECOND)
                if s in seen:
                    continue
                seen.add(s)
                key, x = in_order(x, steps)
                p = len(x) - (percent * len(x) + 99) // 100 + 1
                tokens.append(key[:p])
                past.append(hot[(x[:p] >> _U(64 - CELLS)).astype(np.int64)])
                sets.append(np.full(p, s[0], np.int64))
                sizes.append(np.full(p, len(x), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if not tokens:
                continue
            t, s, z, q, h = (np.concatenate(a) for a in (tokens, sets, sizes, places, past))
            bucket = (mix(t) % _U(buckets)).astype(np.int64)
            bucket[h] = -1 - (mix(s[h].view(np.uint64)) % _U(buckets)).astype(np.int64)
            by = np.lexsort((t, bucket))
            t, s, z, q, bucket = t[by], s[by], z[by], q[by], bucket[by]
            keep, cut = np.unique(bucket, return_index=True)
            cut = np.append(cut, len(bucket)).tolist()
            yield pa.record_batch(
                [pa.array(keep, pa.int32())] + [pa.array([a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for a in (t, s, z, q)],
                names=[c.split()[0] for c in _BLOCK.split(", ")],
            )

    return work


_PAIR = "token long, a long, b long, size int, place int"


def _pair_batch(token, a, b, size, place):
    k = len(a)
    cols = [token, a, b, size, place]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, t) if c is not None else pa.nulls(k, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in _PAIR.split(", ")])


def _through(x, y, size, place, percent):
    """Length and positional filters for index arrays x and y."""
    small, large = np.minimum(size[x], size[y]).astype(np.int64), np.maximum(size[x], size[y]).astype(np.int64)
    most = 1 + np.minimum(size[x] - place[x], size[y] - place[y]) - 1
    return (100 * small >= percent * large) & (most >= needed(small, large, percent))


def _meet(percent: int, hub: int):
    """Pairs of a bucket (token null), and the members of groups of over `hub` sets (b null)."""

    def bucket(blocks, past: bool) -> Iterator[pa.RecordBatch]:
        t, s, z, q = (np.concatenate([np.frombuffer(b[i], d) for b in blocks]) for i, d in enumerate((np.uint64, np.int64, np.int32, np.int32)))
        by = np.lexsort((q, s, z, t))
        t, s, z, q = t[by], s[by], z[by], q[by]
        fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (z[1:] != z[:-1]) | (q[1:] != q[:-1])))
        t, s, z, q = t[fresh], s[fresh], z[fresh], q[fresh]
        head = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        count = np.diff(np.concatenate((head, [len(t)])))
        large = np.repeat((count > hub) | past, count)
        if large.any():
            yield _pair_batch(t[large].view(np.int64), s[large], None, z[large], q[large])
        if past:
            return
        # all pairs of small groups, all groups at once by distance in the group
        xs, ys = [], []
        small = np.repeat((count > 1) & (count <= hub), count)
        last = np.repeat(head + count - 1, count)
        for gap in range(1, min(hub, int(count.max(initial=1)))):
            x = np.flatnonzero(small[:-gap] & (np.arange(len(t) - gap) + gap <= last[:-gap]))
            if not len(x):
                break
            ok = _through(x, x + gap, z, q, percent)
            xs.append(x[ok])
            ys.append(x[ok] + gap)
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            pairs = np.unique(np.stack((np.minimum(s[x], s[y]), np.maximum(s[x], s[y])), 1), axis=0)
            yield _pair_batch(None, pairs[:, 0], pairs[:, 1], None, None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "tokens", "sets", "sizes", "places")]
            for b, *block in zip(*cols, strict=True):
                if b != at and blocks:
                    yield from bucket(blocks, at < 0)
                    blocks = []
                at = b
                blocks.append(block)
        if blocks:
            yield from bucket(blocks, at < 0)

    return work


class Union:
    """Union-find over the components that a bucket has met; the smaller name stands for both."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, c: int) -> int:
        while (d := self.up.get(c, c)) != c:
            self.up[c] = c = self.up.get(d, d)
        return c

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def group_links(sets: list[np.ndarray], place: np.ndarray, component: np.ndarray, side: np.ndarray | None, met: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links (places of two sets in the group) that join components of a group whose n-gram stands at `place` in each set.

    A set outside the largest component is compared with all that lie in other components: overlaps come from an index of
    the group's n-grams, one count for all. `component` is brought up to date in place. side: only sets of different sides
    are compared. met: sets compared with each other before; then pairs that share an earlier n-gram are left out as well.
    """
    s = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    gram, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(s), size)[np.argsort(inverse, kind="stable")]
    cut = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(gram)))))
    done = np.zeros(s, bool)

    def overlaps(grams: np.ndarray) -> np.ndarray:
        lo, n = cut[grams], cut[grams + 1] - cut[grams]
        many = n > 1
        lo, n = lo[many], n[many]
        if not len(n):
            return np.zeros(s, np.int64)
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return np.bincount(owner[at], minlength=s)

    while True:
        names, code, count = np.unique(component, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(~done & (code != count.argmax()))
        if len(names) < 2 or not len(open_):
            return
        for x in open_.tolist():
            joined = False
            done[x] = True
            y = ~done & (component != component[x])
            if side is not None:
                y &= side != side[x]
            if met is not None and met[x]:
                y &= ~met
            y = np.flatnonzero(y)
            y = y[_through(np.full(len(y), x), y, size, place, percent)]
            if len(y) and met is not None and place[x]:
                y = y[overlaps(inverse[first[x] : first[x] + place[x]])[y] == 0]
            if not len(y):
                continue
            both = overlaps(inverse[first[x] : first[x + 1]])[y]
            y = y[100 * both >= percent * (size[x] + size[y] - both)]
            for c in np.unique(component[y]).tolist():
                yield x, int(y[np.flatnonzero(component[y] == c)[0]])
                joined = True
            if joined:
                component[np.isin(component, component[y])] = component[x]
                break  # the largest component may be another one now


_HOT = "bucket int, kind int, token long, i int, j int, id long, place int, component long, side int, met boolean, grams binary"


def _settle(percent: int, first: bool):
    """Links of buckets of large groups. Rows of a bucket: its sets, then its groups one after another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sets, key, rows, union = None, {}, None, [], Union()

        def group() -> Iterator[pa.RecordBatch]:
            ids, place, component, side, met = (np.array(c) for c in zip(*rows, strict=True))
            component = np.array([union.find(c) for c in component.tolist()])
            if (component == component[0]).all():
                return
            before = component.copy()
            off = key[1] != key[2]
            links = list(group_links([sets[i] for i in ids.tolist()], place, component, side if off else None, None if first else met, percent))
            if links:
                a, b = np.array(links).T
                for x, y in links:
                    union.join(int(before[x]), int(before[y]))
                yield _pair_batch(None, np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), None, None)

        for batch in batches:
            cols = [batch.column(c.split()[0]).to_pylist() for c in _HOT.split(", ")]
            for b, kind, t, i, j, id_, place, component, side, met, grams in zip(*cols, strict=True):
                if (b, t, i, j) != (bucket, *(key or (None,) * 3)) and rows:
                    yield from group()
                    rows = []
                if b != bucket:
                    bucket, sets, union = b, {}, Union()
                if kind == 0:
                    sets[id_] = np.frombuffer(grams, np.uint64)
                    key = None
                else:
                    key = (t, i, j)
                    rows.append((id_, place, component, side, met))
        if rows:
            yield from group()

    return work


def _ordered(n: int, sent):
    """Hashes of sets, rare first, of the texts that have the digests asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, _ = sent.value
        for batch, texts in pieces(batches):
            sets = shingles(texts, n)
            keep = [i for i, (x, s1, s2) in enumerate(zip(sets, batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)) if digest(x) == s1 and digest(x, SECOND) == s2]
            yield pa.record_batch(
                [batch.column("id").take(pa.array(keep, pa.int64())), pa.array([in_order(sets[i], steps)[1].tobytes() for i in keep], pa.binary())],
                names=["id", "grams"],
            )

    return work


def _suffix(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, RANGES) for c in ("hist_a", "hist_b")]
            most = np.minimum(*h).sum(1, dtype=np.int64)
            ok = most >= needed(h[0].sum(1, dtype=np.int64), h[1].sum(1, dtype=np.int64), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return work


def _verify(n: int, percent: int):
    """A repeated doc_id may bring texts of other sets along; the digests tell them apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            ok = []
            for x, y, *want in zip(*(batch.column(c).to_pylist() for c in ("text_a", "text_b", "s1_a", "s2_a", "s1_b", "s2_b")), strict=True):
                if x != last:
                    last, mine = x, shingles([x.encode()], n)[0]
                other = shingles([y.encode()], n)[0]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(mine) + len(other) - both) and [digest(mine), digest(mine, SECOND), digest(other), digest(other, SECOND)] == want)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def _settled(entries: DataFrame, sets: DataFrame, percent: int, block: int, first: bool) -> DataFrame:
    """Links of large groups. entries: token, id, place, size, component, met; sets: id, grams."""
    parts = partitions(entries.sparkSession)
    stats = entries.groupBy("token").agg(F.sum("size").alias("z"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    stats = kept(stats.select("token", (F.floor(F.col("z") / block) + 1).cast("int").alias("blocks"), "z"), "groups")
    total = stats.agg(F.coalesce(F.sum(F.col("z") * F.col("blocks")), F.lit(0)).alias("z")).first()["z"]
    buckets = max(parts, total // block + 1)
    rows = entries.join(stats.drop("z"), "token").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", "id", "place", "component", "met", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    rows = kept(rows.withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(buckets)).cast("int")), "entries")
    null = F.lit(None)
    members = rows.select("bucket", F.lit(1).alias("kind"), "token", "i", "j", "id", "place", "component", "side", "met", null.cast("binary").alias("grams"))
    needed_ = rows.select("bucket", "id").distinct().join(sets, "id")
    carried = needed_.select("bucket", F.lit(0).alias("kind"), null.cast("long").alias("token"), null.cast("int").alias("i"), null.cast("int").alias("j"), "id", null.cast("int").alias("place"), null.cast("long").alias("component"), null.cast("int").alias("side"), null.cast("boolean").alias("met"), "grams")
    both = kept(carried.unionByName(members), "hot")
    return kept(both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "token", "i", "j").mapInArrow(_settle(percent, first), _PAIR).select("a", "b"), "links")


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (id, component) after more links: only components that they join go through components() again."""
    for end in ("a", "b"):
        links = links.join(label.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    ends = kept(links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct(), "joined")
    if ends.isEmpty():
        return label
    more = components(ends)
    up = more.select(F.col("id").alias("component"), F.col("component").alias("top"))
    old = label.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return kept(old.unionByName(more.join(label.select("id"), "id", "left_anti")), "labels")  # a set without a link was a component of its own


def similar(docs: DataFrame, n: int = N, percent: int = PERCENT, hub: int = HUB, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, of sets with 100 |x & y| >= percent |x | y|."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scan = kept(docs.mapInArrow(_scan(n), _SCAN), "sets")
    sets = scan.where("slice is null").drop("slice", "cells")
    steps = spark.sparkContext.broadcast(cell_steps(scan))
    docs = docs.where("doc_id is not null")
    # a set's number is that of its row in the table that is kept, and its document the smallest doc_id that has it
    reps = sets.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min_by(F.struct("doc_id", "hist", "n"), "doc_id").alias("r")).select("s1", "s2", "r.*")
    reps = kept(reps.withColumnRenamed("doc_id", "doc").withColumn("id", F.monotonically_increasing_id()), "reps")
    size = reps.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0)).alias("e")).first()["e"]
    buckets = max(partitions(spark), int(size // ENTRIES) + 1)
    blocks = docs.mapInArrow(_prefixes(n, percent, steps, buckets), _BLOCK)
    met = kept(blocks.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(percent, hub), _PAIR), "pairs")

    left = reps.select(F.col("s1").alias("a"), F.col("id").alias("x"), F.col("hist").alias("hist_a"))
    right = reps.select(F.col("s1").alias("b"), F.col("id").alias("y"), F.col("hist").alias("hist_b"))
    pairs = met.where("token is null").select("a", "b").distinct().join(left, "a").join(right, "b")
    near = kept(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "hist_a", "hist_b").mapInArrow(_suffix(percent), "a long, b long"), "near")
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).distinct().join(reps.select("id", "s1", "s2", "doc"), "id")
    texts = kept(docs.join(wanted, docs.doc_id == wanted.doc).select("id", "s1", "s2", "text"), "texts")

    def side(k: str) -> DataFrame:
        return texts.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("s1", "s2", "text")])

    full = near.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b", "s1_a", "s2_a", "s1_b", "s2_b")
    label = components(kept(full.mapInArrow(_verify(n, percent), "a long, b long"), "links"))

    large = met.where("token is not null")
    if not large.isEmpty():
        names = reps.select(F.col("s1").alias("a"), F.col("n").cast("int").alias("size"), "id")
        large = large.join(names, ["a", "size"]).select("token", "id", "size", "place")
        rarest = F.min("token").over(Window.partitionBy("id")) == F.col("token")
        large = kept(large.withColumn("met", rarest), "large")
        asked = large.select("id").distinct().join(reps.select("id", "s1", "s2", "doc"), "id")
        grams = kept(docs.join(asked, docs.doc_id == asked.doc).select("id", "s1", "s2", "text").mapInArrow(_ordered(n, steps), "id long, grams binary"), "grams")
        for first in (True, False):
            named = (large.where("met") if first else large).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
            label = relabelled(label, _settled(named, grams, percent, block, first))

    own = sets.where("n > 0 and doc_id is not null").join(reps.select("s1", "s2", "id", "doc"), ["s1", "s2"]).select("doc_id", "id", "doc")
    per = kept(own.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("doc").alias("doc")), "owners")
    several = per.where("lo <> hi")  # texts that share a doc_id
    if not several.isEmpty():
        label = relabelled(label, kept(own.join(several.select("doc_id", "lo"), "doc_id").where("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b")), "shared"))
    least = label.join(reps.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("least"))
    top = label.join(least, "component").select("id", "least")
    top = per.join(top, per.lo == top.id, "left").select("doc_id", F.coalesce("least", "doc").alias("top"))
    return sets.join(top, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top", "doc_id").alias("component_id"))
