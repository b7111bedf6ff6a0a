"""URL filtering by association rules: a fixed list decides what it covers, mined token combinations decide the rest.

URLs with a label (blocked or allowed) are transactions of tokens plus their class.  Spark's FP-growth gives the frequent
combinations; those with a class are rules ``tokens -> class``.  A rule stays if it is confident enough and no rule with one token
less and the same class is as confident.  Rules are posted under their rarest token only (an inverted index), so a token that
every URL holds posts next to nothing; an URL meets the rules posted under its tokens and the whole combination is verified.

Everything is DataFrame functions; the index joins without a hint, so Spark broadcasts it only where its written size allows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.tables import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASS = "class:"


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): the host is what follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; the path goes on up to
    ``?`` or ``#``; the rest is what is left.  Null or without ``://``: all empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    tail = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    part = lambda i: F.regexp_extract(tail, r"(?s)^([^/?#]*)([^?#]*)(.*)$", i)
    return F.translate(part(1), UPPER, LOWER), part(2), part(3)


def listed(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null for none.  Equal lengths: the longer host, then the smaller text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def url_tokens(host: Column, path: Column, rest: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased, each with its place: host, path, or query and fragment."""
    def of(text: Column, mark: str) -> Column:
        runs = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        return F.transform(runs, lambda t: F.concat(F.lit(mark), t))
    return F.array_distinct(F.concat(of(host, "h:"), of(path, "p:"), of(rest, "q:")))


def mine(labelled: DataFrame, *, tokens: str = "tokens", verdict: str = "verdict", min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """(tokens, verdict, n, confidence, posted): the pruned rules and the token each is posted under.

    ``min_support`` is the least share of labelled URLs with the tokens and the class, ``min_confidence`` the least share of
    that class among URLs with the tokens.  Rows without a class or a token teach nothing.  No rows: no rules.
    """
    spark = labelled.sparkSession
    items = F.array_append(F.array_distinct(F.col(tokens)), F.concat(F.lit(CLASS), F.col(verdict)))
    sets = labelled.filter(F.col(verdict).isNotNull() & (F.size(tokens) > 0)).select(items.alias("items"))
    schema = "tokens array<string>, verdict string, n long, confidence double, posted string"
    if sets.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(sets)
    frequent = materialise(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    is_class = lambda t: t.startswith(CLASS)
    held = (frequent.select(F.filter("items", lambda t: ~is_class(t)).alias("tokens"), F.get(F.filter("items", is_class), F.lit(0)).alias("class"), "freq")
            .filter(F.size("tokens") > 0))
    alone = held.filter("class IS NULL").select("tokens", F.col("freq").alias("all"))
    rules = materialise(held.filter("class IS NOT NULL").join(alone, "tokens")
                        .select("tokens", "class", F.col("freq").alias("n"), (F.col("freq") / F.col("all")).alias("confidence"))
                        .filter(F.col("confidence") >= min_confidence), "rules")
    shorter = F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))
    wider = rules.select(F.col("tokens").alias("less"), "class", F.col("confidence").alias("by"))
    beaten = (rules.filter(F.size("tokens") > 1).select("tokens", "class", "confidence", F.explode(shorter).alias("less"))
              .join(wider, ["less", "class"]).filter("by >= confidence").select("tokens", "class").distinct())
    kept = rules.join(beaten, ["tokens", "class"], "left_anti")
    single = alone.filter(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("token"), "all")
    rarest = (kept.select("tokens", "class", F.explode("tokens").alias("token")).join(single, "token")
              .groupBy("tokens", "class").agg(F.min(F.struct("all", "token"))["token"].alias("posted")))
    out = kept.join(rarest, ["tokens", "class"]).select("tokens", F.substring("class", len(CLASS) + 1, 1000).alias("verdict"), "n", "confidence", "posted")
    return materialise(out, "urlrules")


def match(urls: DataFrame, rules: DataFrame, *, tokens: str = "tokens", default: str = "allow") -> DataFrame:
    """``urls`` with ``verdict`` and ``mined`` (the tokens of the deciding rule, null for none) in place of ``tokens``.

    Of all rules whose tokens an URL holds, the most confident decides, then the one with most labelled URLs, the fewest tokens, the
    smaller tokens, the smaller verdict.  Without any: ``default``.  Every row stays, repeated rows too.
    """
    columns = [c for c in urls.columns if c != tokens]
    order = ["c", "n", "few", "tokens", "verdict"]
    index = rules.select(F.col("posted").alias("_token"), F.struct(
        (-F.col("confidence")).alias("c"), (-F.col("n")).alias("n"), F.size("tokens").alias("few"), "tokens", "verdict").alias("_rule"))
    keyed = urls.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns).alias("_own"), F.col(tokens).alias("_held"))
    asked = keyed.select("_row", "_own", "_held", F.explode_outer("_held").alias("_token"))
    whole = F.size(F.array_except(F.col("_rule.tokens"), F.col("_held"))) == 0
    met = asked.join(index, "_token", "left").withColumn("_rule", F.when(whole, F.col("_rule")))
    best = met.groupBy("_row").agg(F.first("_own").alias("_own"), F.min(F.when(F.col("_rule").isNotNull(), F.struct(*[F.col("_rule")[c].alias(c) for c in order]))).alias("_rule"))
    return best.select("_own.*", F.coalesce(F.col("_rule.verdict"), F.lit(default)).alias("verdict"), F.col("_rule.tokens").alias("mined"))


def filter_urls(pages: DataFrame, listed_rules: list[UrlRule], labels: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url",
                min_support: float = 0.01, min_confidence: float = 0.9, default: str = "allow") -> DataFrame:
    """(``id_col``, host, path, rule, verdict, mined) of every row.

    ``labels`` has (``url_col``, verdict) of URLs judged elsewhere.  Without it, the URLs that the list decides are the labelled ones,
    and the mined rules carry its decisions to URLs it does not cover.  A null or odd URL has no tokens and gets ``default``.  Null and
    repeated ids keep their rows; other columns are not read.  Empty table: no rows.
    """
    def parsed(df: DataFrame, *keep: str) -> DataFrame:
        host, path, rest = host_path(F.col(url_col))
        cut = df.select(*keep, host.alias("host"), path.alias("path"), rest.alias("rest"))
        text, verdict = listed(F.col("host"), F.col("path"), listed_rules)
        return cut.select(*keep, "host", "path", text.alias("rule"), verdict.alias("ruled"), url_tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"))

    rows = parsed(pages, id_col)
    taught = rows.filter("ruled IS NOT NULL").select("tokens", F.col("ruled").alias("verdict")) if labels is None else parsed(labels, "verdict").select("tokens", "verdict")
    rules = mine(taught, min_support=min_support, min_confidence=min_confidence)
    columns = [id_col, "host", "path", "rule"]
    by_list = rows.filter("ruled IS NOT NULL").select(*columns, F.col("ruled").alias("verdict"), F.lit(None).cast("array<string>").alias("mined"))
    return by_list.unionByName(match(rows.filter("ruled IS NULL").select(*columns, "tokens"), rules, default=default))
