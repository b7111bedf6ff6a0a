"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is the set of its windows of ``window`` consecutive words; one with fewer words is one window.  A document holds a
window only if it holds all of its words, so of the words ordered by rarity in the corpus the rarest one is a sufficient prefix
(containment 1 leaves a prefix of one token).  Documents' words meet these prefix words; a hit at word p of a window whose prefix
word has offset o can only be the window p - o .. p - o + length, which must lie inside the document (positional and length bound),
and is then compared word by word.

The words of a document stay in its row: the join against the prefix table runs inside the scan's stage, only matches and one
closing row per document are shuffled, by document.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of digits, lower-case letters and everything beyond ASCII, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a benchmark table that are broadcast at a time, some 200 bytes each; a larger table is met in slices of this size.
SLICE = 100_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept.  Of pure ASCII, ``lower`` does the same faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(win, items): the distinct windows, with the items that have them."""
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter("size(w) > 0")
    starts = items.select("item", "w", F.explode(F.expr(f"sequence(1, greatest(size(w) - {window} + 1, 1))")).alias("s"))
    return starts.groupBy(F.expr(f"slice(w, s, {window})").alias("win")).agg(F.collect_set("item").alias("items"))


def _slices(small: DataFrame, key: Column) -> list[DataFrame]:
    """The table cut by hash into parts of about ``SLICE`` rows, each small enough to broadcast."""
    parts = max(1, math.ceil(small.count() / SLICE))
    return [small if parts == 1 else small.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window, each once; ``n_items`` items with such windows, whose ids sorted as
    strings and comma-joined are hashed.  Null or wordless text: no words, no hits, the hash of the empty string.  Items without
    an id or a word take no part; repeated items count once.  Repeated rows come back as often as they are given.  Other columns are
    not read.  Empty documents: no rows; empty benchmark: no hits.
    """
    wins = benchmark_windows(benchmark, window, item_col, item_text_col).cache()
    words = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), words_of(F.col(text_col)).alias("words"))

    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    often = None
    for part in _slices(vocabulary, F.col("word")):
        # The outer forms: the plain ones would tokenise every text again in a filter against empty arrays.
        one = words.select(F.explode_outer("words").alias("word")).join(F.broadcast(part), "word").groupBy("word").count()
        often = one if often is None else often.unionByName(one)
    spots = wins.select("win", "items", F.posexplode("win").alias("o", "word")).join(often, "word", "left")
    prefix = spots.groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "o")).alias("p"), F.first("items").alias("items"))
    prefix = prefix.select(F.col("p.word").alias("word"), F.col("p.o").alias("o"), "win", "items").cache()

    # '' is no word: the closing row of each document, whatever else it holds.
    ended = words.select("doc", "version", "words", F.posexplode_outer(F.concat("words", F.array(F.lit("")))).alias("at", "word"))
    found = None
    for part in _slices(prefix, F.col("win")):
        closing = part.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("o"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"))
        start = F.col("at") - F.col("o")
        inside = (F.col("word") != "") & (start >= 0) & (start + F.size("win") <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win"))
        one = (ended.join(F.broadcast(part.unionByName(closing) if found is None else part), "word").filter((F.col("word") == "") | inside)
               .select("doc", "version", start.alias("start"), F.size("win").alias("n"), "items", F.size("words").alias("n_words")))
        found = one if found is None else found.unionByName(one)

    key = ["doc", "version"]
    # Closing rows have n = 0; repeated rows of a document repeat its matches, which are then counted once.
    spans = found.groupBy(*key, "start", "n").agg(F.first("items").alias("items"), F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    reached = F.max(F.col("start") + F.col("n")).over(Window.partitionBy(*key).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(reached, F.lit(0))))
    per_doc = spans.withColumn("hit", F.when(F.col("n") > 0, new).otherwise(0)).groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("hit").cast("long").alias("n_hit"),
        F.max(F.when(F.col("n") == 0, F.col("copies"))).cast("int").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = per_doc.select(F.col("doc").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                         F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return out.drop("copy")
