"""A training corpus from raw documents: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusflow.llm import cnn, jaccard, latent, packing, substring
from censusflow.llm.common import held_out, kept, table
from censusflow.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a row without doc_id stays."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = kept(cnn.classify(docs, labels, held_out(5, 0)).where("predicted = 0").select("doc_id").distinct(), "rejected")
    return docs.join(scored, "doc_id", "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 of their 5-word shingles the one with the smallest doc_id stays."""
    other = jaccard.similar(docs, n=5, percent=80).where("component_id <> doc_id").select("doc_id")
    return docs.join(kept(other.distinct(), "copies"), "doc_id", "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut; documents left without words go. Other columns may have any name."""
    doc, tag, found = (max(docs.columns, key=len) + f"_{x}" for x in ("doc", "tag", "cut"))  # longer than any name of docs
    cut = substring.substring_dedup(docs).where("n_removed > 0").dropDuplicates(["doc_id", "tag"])
    cut = cut.select(F.col("doc_id").alias(doc), F.col("tag").alias(tag), F.struct("n_words", "n_removed", "kept_text").alias(found))
    rows = docs.join(cut, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(tag)), "left")
    rows = rows.where(F.col(found).isNull() | (F.col(f"{found}.n_removed") < F.col(f"{found}.n_words")))
    text = F.col(f"{found}.kept_text")
    new = {"text": F.coalesce(text, F.col("text")), "n_chars": F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go."""
    found = latent.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(kept(found, "leaks"), "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the curve."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near copies", near_copies), ("passages", passages), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't express the classifier, the latent search or the tokenizer; tests/llm/test_pipeline.py holds near copies, passages
#: and decontamination against plain versions, the classifier's stage against its operator, packing against whole-text ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each kept in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
