"""Registered queries ``opN_<name>``: each applies its operator to its whole table.  DuckDB statements are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontam, hardneg, hpylm, langid, licenses, neardup, oracles, packing, quality, substring, topk, toxicity, urlrules, whitening
from scanloom.llm.tables import documents, of_rest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_benchmark_decontamination": oracles.OP2, "op3_exact_top_k": oracles.OP3}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder), words=4, percent=80)


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = documents(spark, folder), of_rest("doc_id", 4, 2)
    model = toxicity.fit(docs, table(spark, folder, "labels"), learn=~held)
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, folder)).select("doc_id", "text", "removed_spans", "removed_bytes")


@query
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(documents(spark, folder), table(spark, folder, "benchmark"), window=10)


@query
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = documents(spark, folder), of_rest("doc_id", 5, 0)
    model = langid.fit(docs, learn=~held)
    return docs.select("doc_id", held.alias("held_out"), langid.identify(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


@query
def op6_hierarchical_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = documents(spark, folder), of_rest("doc_id", 5, 1)
    return hpylm.score(hpylm.fit(docs, learn=~held), docs, held)


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, trusted = documents(spark, folder), table(spark, folder, "labels").filter("quality = 1")
    # A fifth of the trusted rows sets the thresholds; the model learns from all others.
    return quality.classify(quality.fit(docs, trusted.filter(~of_rest("doc_id", 5, 2))), docs, trusted)


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


ORACLES["op8_license_scan"] = oracles.licenses_sql(licenses.TEMPLATES, 5, 80)


#: The list that op 11 starts from.
URL_RULES = [urlrules.UrlRule("com", "/", "allow"), urlrules.UrlRule("example.com", "/en/", "block"), urlrules.UrlRule("www.example.com", "/en/", "allow"),
             urlrules.UrlRule("net", "/es/", "block"), urlrules.UrlRule("net", "/fr/", "block")]


@query
def op11_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = urlrules.filter_urls(table(spark, folder, "pages"), URL_RULES)
    return found.withColumn("mined", F.array_join("mined", " "))


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), components=8, scale=1024, shift=100_000)


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


ORACLES |= {"op11_url_rules": oracles.url_rules_sql(URL_RULES, 0.01, 0.9), "op13_hard_negatives": oracles.OP13}
