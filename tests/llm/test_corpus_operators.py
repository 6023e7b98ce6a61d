"""Corpus operators against plain versions on small fixtures with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import math
import pathlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from censusflow.llm import brown, cnn, jaccard, jpeg, langid, latent, packing, store, substring, tokens, urls
from censusflow.llm.common import components, held_out, new_path
from censusflow.llm.queries import tokenizer

RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefgéñ"), RNG.integers(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


PASSAGE, BASE = prose(80), prose(150)
TEXTS = [
    (0, BASE),
    (1, "  lead " + PASSAGE + " end\n" + prose(30)),
    (2, prose(60) + "\t" + PASSAGE),
    (3, None),
    (4, ""),
    (5, BASE),
    (6, BASE.upper() + " one more"),
    (7, BASE.replace(" ", "\n", 3)),
    (8, "two words"),
    (9, "TWO words"),
    (10, " \n\t "),
    (11, (PASSAGE + " ") * 4),
    (12, prose(6000)),
    (13, "日本語 text, <|endoftext|> and 12  spaces \x0b x" + PASSAGE),
    (14, "?!"),
    (14, "?!"),
    (15, BASE + " " + prose(100)),
    (None, PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, i) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, tag long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def split(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("hot", [1, 256])
def test_substring(docs, none, hot):
    first = {}
    for i, t in TEXTS:
        w = split(t)
        for j in range(len(w) - 49):
            if i is not None:
                first[tuple(w[j : j + 50])] = min(first.get(tuple(w[j : j + 50]), i), i)
    want = []
    for i, t in TEXTS:
        w = split(t)
        gone = {x for j in range(len(w) - 49) if i is not None and first[tuple(w[j : j + 50])] < i for x in range(j, j + 50)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    got = substring.substring_dedup(docs, hot=hot)
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got.collect())
    assert substring.substring_dedup(none).count() == 0


def test_windows_are_told_apart_exactly_without_copies():
    strings = [" ".join(RNG.choice(["a", "b"], int(RNG.integers(7, 40)))).encode() for _ in range(30)]
    rank, windows = substring.window_ranks(strings, 7)
    texts = [tuple(w[i : i + 7]) for s in strings for w in [s.split()] for i in range(len(w) - 6)]
    assert len(rank) == len(texts) == windows.sum() and len(set(zip(rank.tolist(), texts))) == len(set(texts)) == len(set(rank.tolist()))
    group = [[bytes([i]), i, i, b" ".join([b"word"] * (20_000 + i))] for i in range(4)]
    tracemalloc.start()
    found = substring.first_seen(group, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[0] for r in found] == [b"\1", b"\2", b"\3"] and not np.frombuffer(found[0][1], np.int64).any() and peak < 20 << 20


@pytest.mark.parametrize("hub,parts", [(1, 8), (64, 8), (1, 3)])
def test_jaccard(spark, docs, none, hub, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = dict((i, t) for i, t in TEXTS if i is not None)
    sets = {}
    for i, t in rows.items():
        w = [x.lower() for x in split(t)]
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    try:
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, hub=hub).collect()}
        assert got == {(i, len(sets[i]), label[i]) for i in sets} | {(None, 77, None)}
        assert jaccard.similar(none).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def brute_components(rows, n=4, percent=85):
    """Component of each document by comparing all pairs."""
    sets = {i: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for i, t in rows for w in [t.split()]}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label, links


def test_links_go_through_components_once(spark, monkeypatch):
    """Copies bring no edges, and later rounds only those between components; texts that share a doc_id still join theirs."""
    a, b = prose(80).split(), prose(60)
    near = [" ".join([*a[:79], f"x{i}"]) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(near)] + [(100 + i, near[0]) for i in range(40)] + [(50, b), (60, b), (60, near[2]), (70, None), (70, b)]
    seen, plain = [], jaccard.components

    def counted(edges):
        seen.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(jaccard, "components", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hub in (1, 64):
        seen.clear()
        got = [(r.doc_id, r.component_id) for r in jaccard.similar(frame, hub=hub).collect()]
        assert sorted(got) == sorted((i, 0) for i, _ in rows)
        assert sum(seen) <= 15 + 1, seen  # pairs of the six, and the doc_id that joins both groups


@pytest.mark.parametrize("hub,block,parts", [(8, 1 << 20, 2), (8, 3000, 29), (1, 700, 5)])
def test_near_copies_by_the_hundred(spark, hub, block, parts):
    """Near copies of one text, of which many don't link, with a passage that unlike texts share."""
    words = prose(120).split()
    rows = []
    for i in range(160):
        w = list(words)
        for _ in range(int(RNG.integers(0, 9))):
            w[int(RNG.integers(0, 120))] = str(RNG.choice(VOCABULARY))
        rows.append((i, " ".join(w)))
    rows += [(200 + i, prose(int(RNG.integers(1, 30))) + " " + " ".join(words[:25])) for i in range(60)]
    label, links = brute_components(rows)
    assert 30 < len(set(label.values())) < 200
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in jaccard.similar(frame, hub=hub, block=block).collect()} == label
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_large_groups_emit_few_links_and_compare_a_pair_once():
    words = [f"w{i}" for i in range(150)]
    sets, seen = [], Counter()
    for i in range(60):
        w = list(words)
        for j in RNG.choice(150, int(RNG.integers(0, 9)), replace=False):
            w[j] = f"x{i}.{j}"
        sets.append(jaccard.shingles([" ".join(w).encode()], 4)[0])
    steps = np.zeros(1 << jaccard.CELLS, np.uint64)
    sets = [jaccard.in_order(x, steps)[1] for x in sets]
    groups: dict[int, list] = {}
    for i, x in enumerate(sets):
        for place, g in enumerate(x[: len(x) - (85 * len(x) + 99) // 100 + 1].tolist()):
            groups.setdefault(g, []).append((i, place))
    found = set()
    for members in groups.values():
        ids, place = (np.array(c) for c in zip(*members, strict=True))
        label = ids.copy()
        links = list(jaccard.group_links([sets[i] for i in ids], place, label, None, np.zeros(len(ids), bool), 85))
        assert len(links) < max(1, len(ids))
        for a, b in links:
            seen[tuple(sorted((int(ids[a]), int(ids[b]))))] += 1
        found.update(seen)
    every = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(both := set(sets[a].tolist()) & set(sets[b].tolist())) >= 85 * (len(sets[a]) + len(sets[b]) - len(both))}
    assert found <= every and max(seen.values()) == 1

    def roots(links):
        u = jaccard.Union()
        for a, b in links:
            u.join(a, b)
        return [u.find(i) for i in range(60)]

    assert roots(found) == roots(every)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (100, 101)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {i: 0 for i in range(41)} | {i: 99 for i in (99, 100, 101)}
    assert components(edges.where("1 = 0")).count() == 0


def ids_of(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in TEXTS]


def test_store(spark, docs, none):
    folder = new_path(spark, "store")
    store.write_store(docs, folder, tokenizer("byte_bpe_50k.json"), 0)
    want, at = [], 0
    for i, ids in sorted(ids_of("byte_bpe_50k.json", 0), key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes()), True))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in store.read_sums(spark, folder).collect())
    back = {r.start: list(r.ids) for r in store.read_ids(spark, folder).collect()}
    assert len(back) == len(TEXTS) and sum(map(len, back.values())) == at
    folder = new_path(spark, "store")
    store.write_store(none, folder, tokenizer("byte_bpe_50k.json"), 0)
    assert store.read_sums(spark, folder).count() == 0
    data = RNG.bytes(3000)
    parts = [data[a:b] for a, b in ((0, 7), (7, 7), (7, 2048), (2048, 3000), (0, 5), (9, 9), (3, 1000), (1, 2))]  # documents of 4, 1, 3 parts
    joined = store.joined_crcs(np.array([zlib.crc32(x) for x in parts]), np.array([len(x) for x in parts]), np.array([0, 4, 5]))
    assert joined.tolist() == [zlib.crc32(b"".join(parts[a:b])) for a, b in ((0, 4), (4, 5), (5, 8))]


def test_store_leaves_little_to_the_steps_that_follow(spark, docs):
    """One file a task (each file and folder is a fork of the executor on local disks), and no encoder stays in a worker."""
    folder = new_path(spark, "store")
    store.write_store(docs, folder, tokenizer("byte_bpe_50k.json"), 0)
    data = pathlib.Path(folder.removeprefix("file://").removeprefix("file:"), "data")
    assert data.is_dir() and not [p for p in data.iterdir() if p.is_dir()]
    assert len(list(data.glob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens.encoder(tokenizer("byte_bpe_50k.json"))
    assert list(store._checked(iter([]))) == [] and not tokens._ENCODERS


def test_cuts_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(11)
    docs = [rng.integers(0, k, n).astype("<u4") for n in (1, 7, 8, 9, 128, 129, 5000, 40_000, 1, 300) for k in (2, 50_000)]
    every = store.cuts(docs)
    assert every == [store.cuts([d])[0] for d in docs] and [c[-1] for c in every] == [len(d) for d in docs]
    sizes = np.concatenate([np.diff([0, *c[:-1]]) for c in every])
    assert sizes.min() >= store.LEAST and sizes.max() <= store.MOST


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    """Random texts of Latin letters, signs, white space and special strings in all letter cases."""
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(tokenizer(name)), tokens.encoder(tokenizer(name))
    special = [t.content for t in library.get_added_tokens_decoder().values()] + ["<|startoftext|>", "<|endoftext|>"]
    parts = [*VOCABULARY[:40], *"!?.,'\"()-_/#<|>0123456789éÀß¼", "don't", "it'LL", " ", " ", " ", "  ", "\n", "\t", "<|", "|>", "日本"]
    parts += [f(s) for s in special for f in (str, str.upper, str.title, str.swapcase)]
    weight = np.array([8 if p in VOCABULARY or p == " " else 1 for p in parts], float)
    texts = ["".join(RNG.choice(parts, int(RNG.integers(0, 60)), p=weight / weight.sum())) for _ in range(1500)]
    texts += ["hello <|ENDOFTEXT|> there", "<|STARTOFTEXT|>", "x<|EndOfText|>y", "<|endoftext|", "|><|endoftext", " ".join(VOCABULARY * 40)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in mine.ids(texts)] == want
    assert [x.tolist() for x in mine.ids(texts)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_learned_once_whatever_signs_follow(name):
    enc, texts = tokens.Encoder(tokenizer(name), limit=50), ["foo\nfoo, foo. foo; foo", "foo ,foo", "日本", ""]
    assert [x.tolist() for x in enc.ids(texts)] == [x.tolist() for x in enc.whole(texts)]
    words = [p for p in enc.known if "foo" in p]
    assert len(words) == (3 if enc.keeps_spaces else 2), words  # with a space before it, at a line's start, and after a sign
    for k in range(40):  # the cache stays bounded, and long pieces don't stay
        step = [" ".join(f"w{k}x{i}" for i in range(30)), "y" * 200, "日本"]
        assert [x.tolist() for x in enc.ids(step)] == [x.tolist() for x in enc.whole(step)]
        assert len(enc.known) + len(enc.old) <= 2 * (50 + 31) and max(map(len, enc.known)) <= tokens.LONGEST
    assert [x.tolist() for x in enc.ids(["日本"])] == [x.tolist() for x in enc.whole(["日本"])]


def test_packing(docs, none):
    got = packing.pack(docs, tokenizer("word_bpe_49k.json"), size=64).collect()
    want = Counter((i, len(x)) for i, x in ids_of("word_bpe_49k.json", 2))
    assert {(r.doc_id, r.doc_tokens) for r in got} == set(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1].tolist()]
        assert (n := sum(r.length for r in rows)) == 64 or n & (n - 1) == 0
    assert sorted(by) == list(range(len(by)))
    ids = {i: x for i, x in ids_of("word_bpe_49k.json", 2)}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
    assert packing.pack(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_drops_the_encoder(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    tokens.encoder(tokenizer("word_bpe_49k.json"))
    assert list(packing._pack(64)(iter([]))) == [] and not tokens._ENCODERS


def test_hilbert_is_a_walk():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_jpeg(docs, none):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in jpeg.media_features(jpeg.to_media(docs)).collect()}
    want = set()
    for i, t in TEXTS:
        p = jpeg.padded((t or "").encode())
        want.add((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == want and jpeg.media_features(jpeg.to_media(none)).count() == 0
    every = bytes(range(256)) * 9
    assert jpeg.payload(jpeg.read(jpeg.encode([(every, 7)]))[0]) == (every, 7)
    long = RNG.bytes(jpeg.ROW * (jpeg.MOST_ROWS + 3))
    (images,) = jpeg.read(jpeg.encode([(long, len(long))]))
    assert len(images) == 2 and jpeg.payload(images)[0] == long
    with pytest.raises(ValueError, match="JPEG"):
        jpeg.read([b"\xff\xd8\xff"])


def test_brown(docs, none):
    got = [r for r in brown.score(docs, held_out(10, 0), top=50, own=20, classes=4).collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in TEXTS}
    c = Counter(w for i, t in TEXTS if not held[i] for w in [*(x.lower() for x in split(t)), b"\n"])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in TEXTS:
        w = [*(x.lower() for x in split(t)), b"\n"]
        want.append((str(i), held[i], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted(want) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got) and brown.score(none, held_out(10, 0)).count() == 0


def test_brown_score_by_the_formula(spark):
    """Scores from the classes that exchange gives, by plain sums over texts; all words are sent, none stays behind."""
    rows = [(i, prose(int(RNG.integers(0, 30)))) for i in range(60)] + [(100, "unknown words " + prose(5)), (None, prose(9)), (7, None)]
    train, classes = [split(t) + [b"\n"] for i, t in rows if i != 100], 5
    c = Counter(w for t in train for w in t)
    order = [b"\n", *sorted(set(c) - {b"\n"}, key=lambda w: (-c[w], w))]
    place = {w: i for i, w in enumerate(order)}
    pairs = np.zeros((len(order) + brown.ENDINGS,) * 2, np.int64)
    for t in train:
        for a, b in zip([b"\n", *t], t):
            pairs[place[a], place[b]] += 1
    of = brown.exchange(pairs, classes)
    member = np.eye(classes, dtype=np.int64)[of]
    n = member.T @ pairs @ member
    prior = (n.sum(0) + 1) / (n.sum() + classes)
    mass = [sum(c[w] for w in order if of[place[w]] == k) + 0.1 * (sum(of[place[w]] == k for w in order) + 1) for k in range(classes)]

    def plain(text):
        k, total = of[0], 0.0
        for w in [x.lower() for x in split(text)] + [b"\n"]:
            j = of[place[w] if w in place else len(order) + brown.ending(w)]
            total += math.log10((n[k, j] + prior[j]) / (n[k].sum() + 1)) + math.log10((c[w] + 0.1) / mass[j])
            k = j
        return round(total, 6)

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = brown.score(frame, F.coalesce(F.col("doc_id") == 100, F.lit(False)), own=10_000, classes=classes).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), plain(t)) for i, t in rows)


def test_exchange_never_loses_likelihood():
    pairs = RNG.integers(0, 9, (30, 30))

    def likelihood(of):
        m = np.eye(5)[of]
        x = m.T @ pairs @ m
        return brown._xlogx(x).sum() - brown._xlogx(x.sum(0)).sum() - brown._xlogx(x.sum(1)).sum()

    assert likelihood(brown.exchange(pairs, 5)) >= likelihood(brown.exchange(pairs, 5, sweeps=0))


def test_quality(spark):
    good = [(i, prose(int(RNG.integers(5, 400))), 1) for i in range(300)]
    bad = [(i, "!! ".join(prose(int(RNG.integers(5, 400))).upper().split()), 0) for i in range(300, 450)]
    rows = spark.createDataFrame([*good, *bad, (900, None, None), (901, "", None)], "doc_id long, text string, label int")
    got = cnn.classify(rows.select("doc_id", "text", F.lit("x").alias("score")), rows.select("doc_id", "label"), held_out(5, 0)).toPandas().merge(rows.select("doc_id", "label").toPandas(), on="doc_id")
    test = got[got.held_out & got.label.notna()]
    assert len(got) == 452 and got.score.between(0, 1).all() and (test.predicted == test.label).mean() > 0.95
    blind = cnn.classify(rows, rows.select("doc_id", "label").where("1 = 0"), held_out(5, 0))
    assert blind.where("score <> 0.5").count() == 0


def test_language(spark):
    words = {"aa": [w + "ka" for w in VOCABULARY[:60]], "bb": [w[::-1] + "zu" for w in VOCABULARY[:60]]}
    rows = [(i, " ".join(RNG.choice(words[lang], 60)), lang) for i in range(200) for lang in ["aa" if i % 2 else "bb"]]
    frame = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    got = langid.identify(frame, held_out(4, 2)).toPandas().merge(frame.select("doc_id", "lang").toPandas(), on="doc_id").set_index("doc_id")
    assert list(got.loc[[900, 901, 902], "lang_pred"]) == ["und"] * 3
    assert (got[got.index < 900].lang_pred == got[got.index < 900].lang).mean() > 0.97
    assert set(langid.identify(frame.withColumn("lang", F.lit(None).cast("string")), held_out(4, 2)).toPandas().lang_pred) == {"und"}


URLS = [
    ("http://A.Example.COM/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/9#t", "www.example.com", "/en/9", "www.example.com/en/", "allow"),
    ("https://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.com/", "x.com", "/", "com/", "allow"),
    ("https://xcom/", "xcom", "/", None, None),
    ("https://x.com", "x.com", "", None, None),
    ("ftp://y.net/fr/a://b", "y.net", "/fr/a://b", "net/fr/", "block"),
    ("https://y.net/FR/", "y.net", "/FR/", None, None),
    ("y.net/fr/", "", "", None, None),
    (None, "", "", None, None),
    ("https://cheappillsonline.org/en", "cheappillsonline.org", "/en", None, "block"),
    ("https://n1cheappills24.org/p", "n1cheappills24.org", "/p", None, "block"),
    ("https://newsblog.org/", "newsblog.org", "/", None, "allow"),
]


def test_urls(spark):
    """Hosts under rules teach their words; hosts without a rule come out both ways."""
    seeds = [(100 + i, f"http://{'cheap-pills' if i % 3 else 'casino-win'}.example.com/en/{i}") for i in range(30)] + [(200 + i, f"http://news-{'abcdefgh'[i % 8]}blog.com/p/{i}") for i in range(30)]
    seeds += [(300 + i, f"http://{'win-cheap' if i % 2 else 'blog-news'}.org/p/{i}") for i in range(20)]
    pages = spark.createDataFrame([*((i, u[0]) for i, u in enumerate(URLS)), *seeds], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages.withColumn("host", F.lit("x"))).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict, i
    assert got[10].words == "cheap pills online org" and got[11].words == "n1 cheap pills 24 org"
    assert all(got[300 + i].verdict == ("block" if i % 2 else "allow") and got[300 + i].rule is None for i in range(20))
    assert urls.judge(pages.where("1 = 0")).count() == 0
    assert {r.verdict for r in urls.judge(pages, teaches=F.lit(False)).where("rule is null").collect()} == {"allow"}


def test_viterbi_by_all_segmentations():
    words = {"ab": 9, "abc": 4, "ca": 7, "bca": 1, "cc": 3, "aab": 2}
    seg = urls.Segmenter(words, 30, 3)

    def cost(parts):
        total, unknown = 0.0, False
        for p in parts:
            if p in seg.cost:
                total, unknown = total + seg.cost[p], False
            else:
                total, unknown = total + len(p) * urls.PER_LETTER + (0 if unknown else urls.UNKNOWN), True
        return total

    for _ in range(300):
        name = "".join(RNG.choice(list("abc"), int(RNG.integers(1, 10))))
        every = [[name[i:j] for i, j in zip((0, *cut), (*cut, len(name)))] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)]
        got = seg.split(name, {})
        assert "".join(got) == name and abs(cost(got) - max(map(cost, every))) < 1e-9


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
        best = row
    return best[-1]


def test_latent(spark):
    items = [(i, prose(int(RNG.integers(20, 50))) + ". " + prose(8) + ".") for i in range(12)] + [(90, None), (91, "")]
    rows = [(i, prose(int(RNG.integers(1, 600)))) for i in range(150)]
    want = set()
    for k, (item, text) in enumerate(items[:12]):
        words = text.split()
        if k % 2:
            words[5], words[11] = "changed", "again"
        rows.append((200 + k, prose(100) + "\n" + " ".join(words).replace("a", "A") + " " + prose(40)))
        want.add((200 + k, item))
    rows += [(300, None), (301, "")]
    big = [f"w{int(x)}" for x in RNG.integers(0, 5000, 40_000)]
    rows.append((302, " ".join(big)))
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent.leaks(frame, bench).collect()}
    assert want <= got and all(d >= 200 for d, _ in got) and len(got) <= len(want) + 1
    assert {(r.doc_id, r.item_id) for r in latent.leaks(frame, bench, block=5).collect()} >= want
    assert latent.leaks(frame, bench.where("1 = 0")).count() == 0 and latent.leaks(frame.where("1 = 0"), bench).count() == 0
    a, b = list(RNG.integers(0, 9, 40)), list(RNG.integers(0, 9, 90))
    assert latent.common(a, b) == lcs(a, b)


def leaked(docs, items):
    """Every item at every passage, by the plain subsequence."""
    out = {}
    for d, text in docs:
        w = latent.words((text or "").encode())
        for i, item in items:
            ws = latent.words((item or "").encode())
            if ws:
                best = max((lcs(ws, w[max(0, at - len(ws)) : at + 32 + len(ws)]) for at in range(0, len(w), 16)), default=0)
                if best >= 0.7 * len(ws):
                    out[d, i] = best
    return out


def altered(text, keep, foreign):
    """The text with all but a share of its words replaced, each by a word of its own or one that stands everywhere."""
    w = text.split()
    for j in RNG.choice(len(w), int(len(w) * (1 - keep)), replace=False):
        w[j] = f"new{RNG.integers(1e9)}" if foreign else VOCABULARY[j % 3]
    return " ".join(w)


def test_altered_items_as_by_brute_force(spark):
    items = [(i, prose(n)) for i, n in enumerate((6, 15, 16, 22, 33, 48, 64))]
    rows = [(i, prose(int(RNG.integers(1, 120)))) for i in range(20)]
    rows += [(100 + 10 * i + j, prose(int(RNG.integers(0, 40))) + " " + altered(t, (0.71, 0.8)[j % 2], j < 4) + " " + " ".join(f"x{k}" for k in range(40))) for i, t in items for j in range(8)]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in latent.leaks(frame, bench).where("ratio >= 0.7").collect()}
    assert got == leaked(rows, items) and len(got) > 40


def test_windows_over_whole_item():
    text = " ".join(f"w{i}" for i in range(160))
    block = latent.Block.of([{"item_id": 1, "text": text}])
    z, of = latent.queries(block, np.eye(160, dtype=np.float32))
    words_ = [{f"w{j}" for j in np.flatnonzero(q)} for q in z]
    runs = [{f"w{j}" for j in range(i, i + 32)} for i in range(129)]
    assert set(of) == {0} and all(max(len(r & q) for q in words_) >= 24 for r in runs)


@pytest.mark.parametrize("end", ["Yes.", "No. It is.", "Of 3.5."])
def test_short_answers(spark, end):
    text = prose(30) + ". " + end
    ws = text.split()
    half = [w if j % 5 < 3 or j > 27 else f"new{j}" for j, w in enumerate(ws)]
    other = [w if j % 5 < 3 and j < 26 else f"new{j}" for j, w in enumerate(ws)]
    frame = spark.createDataFrame([(1, " ".join(half)), (2, " ".join(other))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert [(r.doc_id, r.answer_found) for r in latent.leaks(frame, bench).collect()] == [(1, True)]


@pytest.mark.parametrize("top", [1, 12])
def test_urls_beyond_the_words_sent(spark, top):
    names = ["".join(RNG.choice(list("bcdfgklmnr"), 5)) for _ in range(60)]
    rows = [(i, f"http://{names[i % 60]}-{names[(7 * i) % 60]}.net/{names[(3 * i) % 60]}/{i}") for i in range(200)]
    rows += [(300 + i, f"http://viagra-{names[i]}{names[i + 1]}.com/{names[0]}") for i in range(5)] + [(400, None), (300, rows[0][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string")

    def told(n):
        return sorted((str(r.page_id), r.host, r.path, r.verdict, r.words, round(r.score, 9)) for r in urls.judge(pages, top=n).collect())

    assert told(top) == told(50_000) and urls.judge(pages.where("1 = 0"), top=top).count() == 0


def test_rare_words_get_classes_by_context(spark):
    """Rare words of equal counts and endings score by what stands before them."""
    rows = [(i, " ".join(f"left a{(i + j) % 30}zz right b{(i + j) % 30}zz" for j in range(30))) for i in range(60)]
    frame = spark.createDataFrame([*rows, (1000, "left a3zz right b3zz"), (1001, "left b3zz right a3zz")], "doc_id long, text string")
    got = {r.doc_id: r for r in brown.score(frame, F.col("doc_id") >= 1000, top=13, own=13, classes=16).collect()}
    assert abs(got[1000].base_score - got[1001].base_score) < 1e-9 and got[1000].score > got[1001].score + 1


def test_every_picked_text_is_in_the_dictionary(spark):
    rows = [(i, f"{VOCABULARY[i]}qx " * 100, "aa") for i in range(40)]
    (raw,) = langid.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=2000, texts=40).values()
    assert len(raw) <= 2000 and all(f"{VOCABULARY[i]}qx".encode() in raw for i in range(40))
