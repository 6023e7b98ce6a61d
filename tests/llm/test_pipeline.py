import os

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from test_corpus_operators import BASE, PASSAGE, RNG, VOCABULARY, altered, brute_components, leaked, prose, split

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(pieces.doc_id) == left
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(zip(pieces.doc_id, pieces.start, pieces.length, pieces.ids_crc32, strict=True))


ITEM = prose(40) + ". " + prose(6) + "."
ROWS = [(i, prose(int(RNG.integers(1, 200)))) for i in range(30)]
ROWS += [(100, BASE), (101, BASE), (102, BASE.replace(VOCABULARY[3], "other", 1)), (103, BASE + " tail"), (104, prose(20) + " " + PASSAGE), (105, PASSAGE + "\n" + prose(60)), (106, PASSAGE)]
ROWS += [(110, prose(50) + " " + ITEM), (111, altered(ITEM, 0.8, True) + " " + prose(30)), (112, ITEM.replace("a", "A")), (120, ""), (121, " \t"), (7, ROWS[7][1])]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with nulls, repeated rows and names that the operators use themselves, and the tables beside them."""
    folder = str(tmp_path_factory.mktemp("made"))
    rows = [(i, t, "en", "s", len(t), "tag", 3, "kept", 4, 0.5) for i, t in ROWS] + [(130, None, None, None, None, None, None, None, None, None), (None, PASSAGE, None, "s", 1, "x", 1, "y", 1, 0.1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tag string, n_removed int, kept_text string, component_id int, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "a b c"), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def ids(frame):
    return sorted(str(r.doc_id) for r in frame.select("doc_id").collect())


def test_stages_by_plain_versions(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    everything = [*ROWS, (130, None), (None, PASSAGE)]
    label, _ = brute_components([(i, t.lower()) for i, t in dict(ROWS).items()], 5, 80)
    for i, t in ROWS:  # fewer words than a shingle: equal or apart
        if len(t.split()) < 5:
            label[i] = min([j for j, u in ROWS if t.split() and u.lower().split() == t.lower().split()] or [i])
    got = stage["near copies"](spark, docs, made)
    assert got.columns == docs.columns and ids(got) == sorted(str(i) for i, _ in everything if label.get(i, i) == i)

    first: dict = {}
    for i, t in ROWS:
        w = split(t)
        for j in range(len(w) - 49):
            first[tuple(w[j : j + 50])] = min(i, first.get(tuple(w[j : j + 50]), i))
    want = []
    for i, t in everything:
        w = split(t)
        gone = {x for j in range(len(w) - 49) if i is not None and first[tuple(w[j : j + 50])] < i for x in range(j, j + 50)}
        if not gone:
            want.append((i, t))
        elif len(gone) < len(w):
            want.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = stage["passages"](spark, docs, made)
    assert got.columns == docs.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in got.collect())
    assert all(r.n_chars == len(r.text) for r in got.where("doc_id < 130").collect()) and got.where("tag = 'tag'").count() > 30

    hits = {d for d, _ in leaked(ROWS, [(1, ITEM)])}
    got = stage["decontaminate"](spark, docs, made)
    assert {110, 112} <= hits and got.columns == docs.columns and ids(got) == sorted(str(i) for i, _ in everything if i not in hits)

    kept_ = stage["quality"](spark, docs, made)
    assert kept_.columns == docs.columns and "None" in ids(kept_) and "130" in [str(r.doc_id) for r in docs.select("doc_id").collect()]


def test_empty_tables(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, made).count() == 0, name
