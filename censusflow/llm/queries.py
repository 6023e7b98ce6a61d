"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusflow.llm import brown, cnn, jaccard, jpeg, langid, latent, packing, store, substring, urls
from censusflow.llm.common import held_out, kept, new_path, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir)).drop("kept_text", "tag")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "store")
    store.write_store(documents(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"), 0)
    return store.read_sums(spark, folder)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return cnn.classify(documents(spark, sf_dir), labels, held_out(5, 0))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), held_out(4, 2))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir), held_out(10, 0))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(documents(spark, sf_dir))


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(kept(jpeg.to_media(documents(spark, sf_dir)), "media", codec="uncompressed"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORDS = r"list_filter(string_split_regex({text}, '[\x09-\x0D\x20]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1 = f"""with w as (select doc_id, coalesce({_WORDS.format(text="text")}, []) as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
f as (select s, min(doc_id) as first from win group by s),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join f using (s) where first < doc_id),
cut as (select doc_id, list(p) as ps from gone group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
 sha256(array_to_string(list_filter(ws, lambda x, i: not list_contains(coalesce(ps, []), i)), ' ')) as kept_sha256
from w left join cut using (doc_id)"""
_OP7 = f"""with recursive w as (select doc_id, coalesce({_WORDS.format(text=_LOWER)}, []) as ws from documents),
sets as (select distinct doc_id, s from (select doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w)),
n as (select doc_id, count(*) as n from sets group by doc_id),
both_ as (select a.doc_id as x, b.doc_id as y, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from both_ join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
edge as (select x, y from link union all select y, x from link),
reach as (select doc_id, doc_id as other from documents union select reach.doc_id, edge.y from reach join edge on edge.x = reach.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(other) from reach where reach.doc_id = d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_token_store, op3_quality, op4_url_filter, op5_language, op6_brown_lm, op7_jaccard_join, op8_jpeg_media, op9_decontamination, op10_packing, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op7_jaccard_join": _OP7}
