"""Configuration rules and secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators.scan import allowed, scan_rule_table, scan_rules, scan_secrets, secret_candidates
from scanloom.plans.queries.sourcing import RULE_VALUES
from scanloom.plans.registry import query
from scanloom.plans.views import VIEWS
from scanloom.rules import secrets as sec
from scanloom.rules.catalogue import RULES, family_of, pattern_table, route_file, rules_table
from scanloom.sources.files import python_only, source_lines


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_predicate(rule) -> str:
    """Line test in a dialect without look-around."""
    if rule.id == "docker.apt_no_clean":
        return "(contains(lower(text), 'apt-get install') AND NOT regexp_matches(text, '(?i)apt-get install.*&&.*rm -rf /var/lib/apt'))"
    return f"regexp_matches(text, {_quoted('(?i)' + rule.pattern)})"


def _rule_hits(rule) -> str:
    """Hits of one rule as SQL: (path, line_no, rule_id, text)."""
    fam = family_of(rule)
    if rule.pattern:
        return f"SELECT path, line_no, '{rule.id}' AS rule_id, text FROM o_config_lines WHERE family = '{fam}' AND {_rule_predicate(rule)}"
    missing = {
        "user_instruction": r"NOT EXISTS (SELECT 1 FROM o_config_lines l WHERE l.path = f.path AND (regexp_matches(l.text, '^USER\s\s') OR (regexp_matches(l.text, '^USER\s') AND NOT regexp_matches(l.text, '^USER\sroot'))))",
        "resources_block": "NOT contains(content, 'resources:')",
        "frame_header": "NOT (contains(content, 'X-Frame-Options') OR contains(content, 'x-frame-options'))",
    }[rule.absent]
    return f"SELECT path, 1 AS line_no, '{rule.id}' AS rule_id, '' AS text FROM o_config_routed f WHERE family = '{fam}' AND {missing}"


ALL_HITS = " UNION ALL ".join(_rule_hits(r) for r in RULES)
VIEWS["o_rule_hits"] = ALL_HITS


@query("rule_catalogue", f"""
    SELECT fixed.rule_id, fixed.message, fixed.severity, fixed.cwe_id, split_part(fixed.rule_id, '.', 1) AS family, split_part(fixed.rule_id, '.', 2) AS rule_name,
      CAST(count(h.rule_id) AS BIGINT) AS hits FROM {RULE_VALUES} LEFT JOIN o_rule_hits h ON h.rule_id = fixed.rule_id
    GROUP BY fixed.rule_id, fixed.message, fixed.severity, fixed.cwe_id""")
def rule_catalogue(t):
    """The catalogue with what each rule found."""
    hits = scan_rules(t.config_files).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return (rules_table(t.spark).join(hits, "rule_id", "left")
            .select("rule_id", "message", "severity", "cwe_id", "family", "rule_name", F.coalesce("hits", F.lit(0)).alias("hits")))


@query("file_routing", "SELECT family, CAST(count(*) AS BIGINT) AS files, CAST(sum(length(content)) AS BIGINT) AS chars FROM o_config_routed GROUP BY family")
def file_routing(t):
    return (t.config_files.withColumn("family", route_file(F.col("path"), F.col("content"))).groupBy("family")
            .agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("chars")))


@query("python_only", "SELECT path FROM v_py_files WHERE path LIKE '%.py' UNION ALL SELECT path FROM v_config_files WHERE path LIKE '%.py'")
def python_files(t):
    return python_only(t.py_files.unionByName(t.config_files)).select("path")


def _rule_rows(df):
    return df.select("file_path", F.col("line_start").cast("long").alias("line_start"), "rule_id", "rule_name", "message", "severity",
                     "cwe_id", F.round("confidence", 6).alias("confidence"), "owasp", "code_snippet", "config_type")


RULE_ROWS = """
    SELECT h.path AS file_path, CAST(h.line_no AS BIGINT) AS line_start, h.rule_id, split_part(h.rule_id, '.', 2) AS rule_name, fixed.message, fixed.severity,
      fixed.cwe_id, 0.9::DOUBLE AS confidence, 'A05:2021 – Security Misconfiguration' AS owasp, h.text AS code_snippet, split_part(h.rule_id, '.', 1) AS config_type
    FROM ({hits}) h JOIN """ + RULE_VALUES + " ON fixed.rule_id = h.rule_id"


@query("rule_scan", RULE_ROWS.replace("{hits}", "SELECT * FROM o_rule_hits"))
def rule_scan(t):
    return _rule_rows(scan_rules(t.config_files))


@query("rule_lines_join", "SELECT rule_id, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT path) AS BIGINT) AS files FROM o_rule_hits GROUP BY rule_id")
def rule_lines_join(t):
    """Files by a table of rules: literals pick the few patterns that a line meets."""
    return scan_rule_table(t.config_files, pattern_table(t.spark)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("file_path").alias("files"))


@query("rule_table_scan", RULE_ROWS.replace("{hits}", "SELECT * FROM o_rule_hits"))
def rule_table_scan(t):
    """Every hit of the rule table, absence rules too."""
    return _rule_rows(scan_rule_table(t.config_files, pattern_table(t.spark)))


# Watch words from the data, one rule each, over every line of the documents: the rule table grows with the input.
@query("rule_table_words", """
    SELECT rule_id, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT path) AS BIGINT) AS files
    FROM o_doc_lines l JOIN o_words w ON regexp_matches(l.text, '(?i)(^|[^[:alnum:]])' || w.word || '([^[:alnum:]]|$)') GROUP BY rule_id""",
       {"o_words": """
    SELECT 'watch.' || word AS rule_id, word FROM (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{9,}')) AS word FROM benchmark) WHERE word <> ''"""})
def rule_table_words(t):
    words = t.benchmark.select(F.lower(F.regexp_extract("text", "[A-Za-z]{9,}", 0)).alias("word")).filter("word <> ''").distinct()
    table = words.select(F.concat(F.lit("watch."), "word").alias("rule_id"), F.lit(None).cast("string").alias("family"),
                         F.concat(F.lit(r"(?-U)(?:^|[^\p{Alnum}])"), "word", F.lit(r"(?:[^\p{Alnum}]|$)")).alias("pattern"), F.lit(False).alias("absent"),
                         F.lit("watch word").alias("message"), F.lit("INFO").alias("severity"), F.lit("").alias("cwe_id"))
    return scan_rule_table(t.docs, table).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("file_path").alias("files"))


@query("absence_rules", RULE_ROWS.replace("{hits}", " UNION ALL ".join(_rule_hits(r) for r in RULES if r.absent)))
def absence_rules(t):
    return _rule_rows(scan_rules(t.config_files, [r for r in RULES if r.absent]))


def _register_single(rule):
    @query("rule_" + rule.id.replace(".", "_"), RULE_ROWS.replace("{hits}", _rule_hits(rule)))
    def one(t):
        return _rule_rows(scan_rules(t.config_files, [rule]))


for _rule in RULES:
    _register_single(_rule)


# ---------------------------------------------------------------- secrets

def _matches(rule, lines: str) -> str:
    return f"SELECT path, line_no, text, '{rule.name}' AS kind, unnest(regexp_extract_all(text, {_quoted(rule.pattern)}, 1)) AS value FROM {lines}"


ENTROPY = """(SELECT -sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / length(c.value) AS p FROM
      (SELECT unnest(string_split(c.value, '')) AS ch) x GROUP BY ch) y)"""


def _candidates(lines: str) -> str:
    return " UNION ALL ".join(_matches(r, lines) for r in [*sec.SECRET_RULES, sec.ENTROPY_RULE])


def _with_entropy(lines: str) -> str:
    return f"""SELECT c.*, e.entropy FROM ({_candidates(lines)}) c JOIN (
      SELECT value, -sum(p * log2(p)) AS entropy FROM (
        SELECT value, ch, count(*)::DOUBLE / length(value) AS p FROM (
          SELECT value, unnest(string_split(value, '')) AS ch FROM (SELECT DISTINCT value FROM ({_candidates(lines)}))) GROUP BY value, ch)
      GROUP BY value) e ON e.value = c.value"""


KINDS = "CASE kind " + " ".join(f"WHEN '{r.name}' THEN '{r.severity}'" for r in [*sec.SECRET_RULES, sec.ENTROPY_RULE]) + " END"
NOT_ALLOWED = " AND ".join(f"NOT contains(lower(value), '{w}')" for w in sec.ALLOWED_WORDS)


@query("secret_scan", f"""
    SELECT path AS file_path, CAST(line_no AS BIGINT) AS line_start, 'secret.' || kind AS rule_id, {KINDS} AS severity, 'CWE-798' AS cwe_id, md5(value) AS value_md5
    FROM o_secrets WHERE (kind <> 'high_entropy' OR entropy > 4.5) AND {NOT_ALLOWED}""", {"o_secrets": _with_entropy("o_secret_lines")})
def secret_scan(t):
    return scan_secrets(t.secret_files).select(
        "file_path", F.col("line_start").cast("long").alias("line_start"), "rule_id", "severity", "cwe_id", F.md5("value").alias("value_md5"))


@query("secret_entropy", """
    SELECT path, CAST(line_no AS BIGINT) AS line_no, kind, round(entropy, 6) AS entropy FROM o_secrets WHERE kind <> 'high_entropy' OR entropy > 3.0""",
       {"o_secrets": _with_entropy("o_secret_lines")})
def secret_entropy(t):
    """Entropy of every candidate, with the threshold lowered to 3."""
    return secret_candidates(source_lines(t.secret_files), min_entropy=3.0, keep=()).select(
        "path", F.col("line_no").cast("long").alias("line_no"), "kind", F.round("entropy", 6).alias("entropy"))


@query("secret_allowlist", f"""
    SELECT kind, CAST(count(*) FILTER (NOT ({NOT_ALLOWED})) AS BIGINT) AS dropped, CAST(count(*) FILTER ({NOT_ALLOWED}) AS BIGINT) AS kept
    FROM o_secrets WHERE kind <> 'high_entropy' OR entropy > 4.5 GROUP BY kind""", {"o_secrets": _with_entropy("o_secret_lines")})
def secret_allowlist(t):
    return secret_candidates(source_lines(t.secret_files)).groupBy("kind").agg(
        F.count_if(allowed(F.col("value"))).alias("dropped"), F.count_if(~allowed(F.col("value"))).alias("kept"))
