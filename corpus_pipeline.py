"""The corpus pipeline: documents in, packed training sequences out; every stage is one operator of ``scanloom.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All but the last give the columns of ``documents``.  Null, empty, very long and repeated rows go through every stage; a null
``doc_id`` is decided by nothing that joins on ids, so such rows stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontam, neardup, packing, substring, toxicity
from scanloom.llm.tables import documents, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go.  The model is fitted on all labelled rows."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    keep = toxicity.toxicity_score(model, F.col("text")) < toxicity.language_threshold(model, F.col("lang"))
    return docs.filter(keep)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, five words a shingle: the one with the smallest id."""
    gone = neardup.near_duplicates(docs, words=5, percent=80).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of smaller id too are cut out; ``n_chars`` follows the text.  No row goes."""
    cut = substring.remove_repeats(docs)
    changed = F.col("removed_bytes") > 0
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    hit = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, in its sequence of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("substring_dedup", cut_repeats), ("decontamination", decontaminate), ("packing", pack)]

#: A trained model, a hash-cut text and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
