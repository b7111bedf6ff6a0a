"""Scanners over source files: configuration rules, rules given as a table, and secrets.

All are narrow: files -> lines -> hits, no shuffle of texts.  The fixed catalogue is compiled into the plan; rule tables and secrets
first look for the literals of all patterns at once, and only lines that hold one meet their patterns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions.scalar import rule_family_of, rule_name_of
from scanloom.functions.text import shannon_entropy, split_lines
from scanloom.rules import catalogue as cat
from scanloom.rules import secrets as sec
from scanloom.rules.literals import LineMatcher

# Rules of one automaton; a larger table is read in several passes.
RULES_A_PASS = 20_000
# Characters of candidate lines and patterns that a task hands on at a time.
PIECE = 1 << 22


def routed_files(files: DataFrame) -> DataFrame:
    """Files with their rule family; files in no family are dropped before their text is split."""
    return files.withColumn("family", cat.route_file(F.col("path"), F.col("content"))).filter("family IS NOT NULL")


def scan_rules(files: DataFrame, rules: list[cat.Rule] = cat.RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hits of the configuration rules: one row per (file, rule, line); absence rules report line 1.

    ``rules`` is a plain list, so user rules extend or replace the catalogue.
    """
    wanted = sorted({cat.family_of(r) for r in rules})
    split = (routed_files(files).filter(F.col("family").isin(wanted))
             .withColumn("lines", split_lines(F.col("content")))
             .withColumn("file_hits", cat.file_rules(F.col("family"), F.col("content"), F.col("lines"), rules)))
    # Position 0 stands for the file itself, so files and lines are covered by one generator.
    each = split.select(
        *keep, "path", "family", "file_hits",
        F.posexplode_outer(F.concat(F.array(F.lit("")), F.col("lines"))).alias("pos", "text"))
    hits = each.select(
        *keep, "path", "pos", "text",
        # The outer forms: before the plain ones, Spark would test all patterns again in a filter against empty arrays.
        F.explode_outer(F.when(F.col("pos") == 0, F.col("file_hits"))
                        .otherwise(cat.line_rules(F.col("family"), F.col("text"), rules))).alias("rule_id")).filter("rule_id IS NOT NULL")
    line = F.greatest(F.col("pos"), F.lit(1))
    return hits.select(
        *keep, F.lit("config_audit").alias("scanner"), "rule_id",
        rule_name_of(F.col("rule_id")).alias("rule_name"),
        *[c.alias(n) for n, c in cat.rule_attributes(F.col("rule_id"), rules).items()],
        F.lit(cat.CONFIG_CONFIDENCE).alias("confidence"), F.lit(cat.CONFIG_OWASP).alias("owasp"),
        F.col("path").alias("file_path"), line.alias("line_start"), line.alias("line_end"),
        F.col("text").alias("code_snippet"),
        rule_family_of(F.col("rule_id")).alias("config_type"))


def pattern_candidates(files: DataFrame, patterns: dict[str | None, list[tuple[str, str]]], *, keep: tuple[str, ...] = (),
                       family: str | None = None) -> DataFrame:
    """``(keep, path, family, candidates)``: each file with the lines that may match, as ``(line_no, text, rules)``; ``rules`` has
    ``(rule_id, pattern)``.

    ``patterns`` has ``(rule_id, pattern)`` by family; the patterns of family None meet every file.  A file whose family (the column
    ``family``) has no patterns is dropped.  One pass of an automaton over the text; the texts of other lines go no further.  Files
    are read one at a time and handed on in pieces of some :data:`PIECE` characters, and a line stands in them once.
    """
    common = patterns.get(None, [])
    of_family = {f: p if f is None else [*common, *p] for f, p in patterns.items()}
    columns = [*dict.fromkeys([*keep, "path", *([family] if family else [])])]
    rule = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("pattern", T.StringType())])
    line = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("rules", T.ArrayType(rule))])
    schema = T.StructType([*[files.schema[c] for c in columns], T.StructField("candidates", T.ArrayType(line))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(dict.fromkeys(r for rules in of_family.values() for r in rules))
        number = {r: i for i, r in enumerate(every)}
        names_of = [pa.array([r[k] for r in every], pa.string()) for k in (0, 1)]
        matchers: dict = {}

        def piece(batch: pa.RecordBatch, rows: list[int], found: list[list]) -> pa.RecordBatch:
            lines = [x for f in found for x in f]
            at = pa.array([n for x in lines for n in x[2]], pa.int32())
            rules = pa.StructArray.from_arrays([c.take(at) for c in names_of], ["rule_id", "pattern"])
            rules = pa.ListArray.from_arrays(pa.array([0, *accumulate(len(x[2]) for x in lines)], pa.int32()), rules)
            each = pa.StructArray.from_arrays([pa.array([x[0] for x in lines], pa.int32()), pa.array([x[1] for x in lines], pa.string()), rules], ["line_no", "text", "rules"])
            kept = batch.select(columns).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), each)], [*columns, "candidates"])

        for batch in batches:
            names = batch.column(columns.index(family)).to_pylist() if family else [None] * batch.num_rows
            rows, found, size = [], [], 0
            for i, (text, name) in enumerate(zip(batch.column(len(columns)), names)):
                name = name if name in of_family else None
                if not text.is_valid or name not in of_family:
                    continue
                if name not in matchers:
                    matchers[name] = LineMatcher([p for _, p in of_family[name]]), [number[r] for r in of_family[name]]
                matcher, place = matchers[name]
                found.append([(n, line, [place[r] for r in hits]) for n, line, hits in matcher.lines(text.as_py())])
                rows.append(i)
                size += sum(len(line) + 100 * len(hits) for _, line, hits in found[-1])
                if size > PIECE:
                    yield piece(batch, rows, found)
                    rows, found, size = [], [], 0
            if rows:
                yield piece(batch, rows, found)

    return files.select(*columns, "content").mapInArrow(run, schema)


def scan_rule_table(files: DataFrame, rules: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hits of rules given as a table: one row per (file, rule, line), with the columns of :func:`scan_rules`.

    ``rules``: ``rule_id``, ``family`` (null: every file, routed or not), ``pattern`` (searched in every line, ignoring case, as
    regular expression), ``absent`` (true: the rule reports line 1 of files without any matching line, case counts), ``message``,
    ``severity``, ``cwe_id``.  Patterns are tested only on lines that hold one of their required literals; the result is that of
    testing all.  The table is read in passes of at most :data:`RULES_A_PASS` rules, each one automaton a task.
    """
    n = rules.count()
    passes = max(1, math.ceil(n / RULES_A_PASS))
    routed = files.withColumn("family", cat.route_file(F.col("path"), F.col("content")))
    columns = [*keep, "path"]
    parts = []
    for p in range(passes):
        own = rules.filter(F.pmod(F.xxhash64("rule_id"), F.lit(passes)) == p)
        by_family: dict[str | None, list[tuple[str, str]]] = {}
        absent: dict[str | None, list[str]] = {}
        for r in own.select("rule_id", "family", "pattern", "absent").collect():
            by_family.setdefault(r.family, []).append((r.rule_id, ("(?U)" if r.absent else cat.FLAGS) + r.pattern))
            if r.absent:
                absent.setdefault(r.family, []).append(r.rule_id)
        if not by_family:
            continue
        hit = F.transform("candidates", lambda c: F.struct(c["line_no"].alias("line_no"), c["text"].alias("text"), F.transform(
            F.filter(c["rules"], lambda r: F.rlike(c["text"], r["pattern"])), lambda r: r["rule_id"]).alias("rules")))
        found = pattern_candidates(routed, by_family, keep=keep, family="family").select(*columns, "family", hit.alias("hits"))
        missing = F.array().cast("array<string>")
        for name, ids in absent.items():
            listed = F.array(*[F.lit(i) for i in ids])
            missing = F.concat(missing, F.when((F.lit(True) if name is None else F.col("family") == name),
                                               F.array_except(listed, F.flatten(F.transform("hits", lambda c: c["rules"])))).otherwise(F.array().cast("array<string>")))
        every = F.array(*[F.lit(i) for ids in absent.values() for i in ids]).cast("array<string>")
        rows = F.concat(
            F.transform("hits", lambda c: F.struct(c["line_no"].alias("line_no"), c["text"].alias("text"), F.filter(c["rules"], lambda r: ~F.array_contains(every, r)).alias("rules"))),
            F.array(F.struct(F.lit(1).alias("line_no"), F.lit("").alias("text"), missing.alias("rules"))))
        # Lines first, then their rules, so that a line's text stands once in a file's row.
        lines = found.select(*columns, F.explode_outer(rows).alias("hit")).filter("size(hit.rules) > 0")
        parts.append(lines.select(*columns, F.explode_outer("hit.rules").alias("rule_id"), "hit.line_no", "hit.text"))
    if not parts:
        parts = [files.select(*columns, F.lit("").alias("rule_id"), F.lit(1).alias("line_no"), F.lit("").alias("text")).limit(0)]
    hits = reduce(DataFrame.unionByName, parts)
    line = F.col("line_no")
    return hits.join(rules.select("rule_id", "message", "severity", "cwe_id"), "rule_id").select(
        *keep, F.lit("config_audit").alias("scanner"), "rule_id", rule_name_of(F.col("rule_id")).alias("rule_name"), "message", "severity", "cwe_id",
        F.lit(cat.CONFIG_CONFIDENCE).alias("confidence"), F.lit(cat.CONFIG_OWASP).alias("owasp"), F.col("path").alias("file_path"),
        line.alias("line_start"), line.alias("line_end"), F.col("text").alias("code_snippet"), rule_family_of(F.col("rule_id")).alias("config_type"))


def allowed(value: Column) -> Column:
    """Values that name themselves as samples."""
    return reduce(lambda a, b: a | b, [F.lower(value).contains(w) for w in sec.ALLOWED_WORDS])


def secret_candidates(lines: DataFrame, *, min_entropy: float = sec.MIN_ENTROPY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every credential match in every line, before the allow-list: rule, value, entropy."""
    text = F.col("text")

    def matches(r: sec.SecretRule) -> Column:
        values = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(r.name).alias("kind"), v.alias("value")))

    found = [matches(r) for r in [*sec.SECRET_RULES, sec.ENTROPY_RULE]]
    rows = lines.select(*keep, "path", "line_no", "text", F.inline(F.concat(*found)))
    rows = rows.withColumn("entropy", shannon_entropy(F.col("value")))
    return rows.filter((F.col("kind") != sec.ENTROPY_RULE.name) | (F.col("entropy") > min_entropy))


def may_hold_secret(text: Column) -> Column:
    """Cheap exact gate: false only when no secret pattern can match anywhere in the text.

    Every pattern needs one of these literals (ignoring case) or a quoted run of 20 token characters.
    """
    words = "akia|asia|aiza|service_account|gh[pousr]_|sk-|xoxb-|glpat-|eyj|private key|api_?key|api-key|secret|token|passw|db_pass|database_url|://"
    return text.rlike(f"(?i){words}") | text.rlike(sec.ENTROPY_RULE.pattern)


def _secret_hits(files: DataFrame, min_entropy: float, keep: tuple[str, ...]) -> DataFrame:
    """Credential matches of whole files: the patterns meet only lines that hold one of their literals."""
    patterns = {None: [(r.name, r.pattern) for r in [*sec.SECRET_RULES, sec.ENTROPY_RULE]]}
    each = (pattern_candidates(files, patterns, keep=keep)
            .select(*keep, "path", F.explode_outer("candidates").alias("c")).filter("c IS NOT NULL")
            .select(*keep, "path", "c.line_no", "c.text", F.explode_outer("c.rules").alias("r"))
            .select(*keep, "path", "line_no", "text", F.col("r.rule_id").alias("kind"), F.explode_outer(F.regexp_extract_all("text", F.col("r.pattern"), F.lit(1))).alias("value")).filter("value IS NOT NULL")
            .withColumn("entropy", shannon_entropy(F.col("value"))))
    return each.filter((F.col("kind") != sec.ENTROPY_RULE.name) | (F.col("entropy") > min_entropy))


def scan_secrets(files: DataFrame, *, min_entropy: float = sec.MIN_ENTROPY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Credential findings: 14 patterns and the entropy test, minus allow-listed values."""
    hits = _secret_hits(files, min_entropy, keep).filter(~allowed(F.col("value")))

    def attr(field: str) -> Column:
        return F.create_map(*[F.lit(x) for r in [*sec.SECRET_RULES, sec.ENTROPY_RULE]
                              for x in (r.name, getattr(r, field))])[F.col("kind")]

    by_pattern = F.col("kind") != sec.ENTROPY_RULE.name
    return hits.select(
        *keep, F.lit("secret_scanner").alias("scanner"),
        F.concat(F.lit("secret."), "kind").alias("rule_id"), F.col("kind").alias("rule_name"),
        attr("message").alias("message"), attr("severity").alias("severity"), F.lit(sec.SECRET_CWE).alias("cwe_id"),
        F.when(by_pattern, sec.PATTERN_CONFIDENCE).otherwise(sec.ENTROPY_CONFIDENCE).alias("confidence"),
        F.lit(sec.SECRET_OWASP).alias("owasp"),
        F.col("path").alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"),
        F.col("text").alias("code_snippet"), "value", "entropy")
