"""Joins with small fixed dimensions, and matching answers back to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.prompts import prompt
from scanloom.rules.knowledge import knowledge_base, normalise_cwe, search_expr

# Price per million tokens (model, input, output), and the provider chain with its models.
PRICES = [
    ("deepseek-chat", 0.14, 0.28), ("deepseek-coder", 0.14, 0.28), ("gpt-4o", 5.0, 15.0), ("gpt-4o-mini", 0.15, 0.6),
    ("claude-3-opus-20240229", 15.0, 75.0), ("claude-3-sonnet-20240229", 3.0, 15.0), ("codellama:13b", 0.0, 0.0),
]
PROVIDERS = [("deepseek", "deepseek-coder"), ("openai", "gpt-4o"), ("anthropic", "claude-3-sonnet-20240229"), ("ollama", "codellama:13b")]
OUTPUT_TOKENS = 1000


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


def enrich_cwe(findings: DataFrame, kb: DataFrame | None = None) -> DataFrame:
    """Findings with their weakness guidance; unknown ids get nulls.  The built-in guidance has nine fixed rows and is
    broadcast; how a table of the caller's is joined is left to Spark."""
    kb = F.broadcast(knowledge_base(findings.sparkSession)) if kb is None else kb
    return findings.withColumn("kb_id", normalise_cwe(F.col("cwe_id"))).join(kb, "kb_id", "left")


def fix_example(enriched: DataFrame, language: Column | str = "python") -> DataFrame:
    """Adds ``example``: the vulnerable/fixed pair for a language, or null."""
    lang = F.lit(language) if isinstance(language, str) else language
    return enriched.withColumn("example", F.col("fix_example")[lang])


def owasp_category(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("kb_owasp", F.coalesce("owasp", F.lit("")))


def kb_search(keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """``(keyword, kb_id)`` for every entry whose name or description contains the keyword.  No join: the
    entries are literals."""
    return keywords.select(column, F.explode(search_expr(F.col(column))).alias("kb_id"))


def price_calls(calls: DataFrame) -> DataFrame:
    """Model calls with prices and cost; an unknown model costs nothing.  The seven-row price table is broadcast."""
    priced = calls.join(F.broadcast(price_table(calls.sparkSession)), "model", "left")
    priced = priced.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("price_in", "price_out")})
    return priced.withColumn("cost_usd", call_cost(F.col("tokens_prompt"), F.col("tokens_completion")))


def call_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1_000_000 * F.col("price_in") + tokens_out / 1_000_000 * F.col("price_out")


def estimate_cost(prompts: DataFrame, column: str = "prompt", output_tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """Expected cost of each prompt at each provider of the chain: four literal rows per prompt, no join.
    Rounded to 4 places; the inner rounding drops binary noise, so halves always go up."""
    price = {m: (i, o) for m, i, o in PRICES}
    chain = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(price[m][0]).alias("price_in"), F.lit(price[m][1]).alias("price_out"))
                      for p, m in PROVIDERS])
    tokens = F.floor(F.length(column) / 4)
    return (prompts.withColumn("input_tokens", tokens).select("*", F.inline(chain))
            .withColumn("estimated_usd", F.round(F.round(call_cost(F.col("input_tokens"), F.lit(output_tokens)), 10), 4))
            .drop("price_in", "price_out"))


def token_usage(calls: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Calls, tokens and cost per model."""
    return price_calls(calls).groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_prompt").alias("tokens_prompt"),
        F.sum("tokens_completion").alias("tokens_completion"),
        F.sum(F.col("tokens_prompt") + F.col("tokens_completion")).alias("tokens_used"), F.sum("cost_usd").alias("cost_usd"))


def pair_by_finding(findings: DataFrame, answers: DataFrame, *, key: str, answer: str, into: str,
                    order: str | None = None, fallback: Column | str = "") -> DataFrame:
    """Attach answers to findings by id; a missing answer becomes the fallback text.

    Of several answers to one id the last by ``order`` stands; without an order column ids should be unique, and of
    several the greatest text stands.
    """
    last = F.max(answer) if order is None else F.max_by(answer, F.struct(order, answer))
    one = answers.groupBy(key).agg(last.alias("__answer"))
    alt = F.lit(fallback) if isinstance(fallback, str) else fallback
    return (findings.drop(into).join(one, key, "left")
            .withColumn(into, F.coalesce("__answer", alt)).drop("__answer"))


def prompts(findings: DataFrame, kind: str) -> DataFrame:
    """Findings with a ``prompt`` column of the given kind."""
    return findings.withColumn("prompt", prompt(kind))
