"""Fusion, cross-validation, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.text import collapse_spaces, ratio_bound
from scanloom.operators import fusion as fu
from scanloom.plans import full_scan as plan
from scanloom.plans.queries.rules import KINDS, NOT_ALLOWED, _with_entropy
from scanloom.plans.queries.sourcing import RULE_VALUES
from scanloom.plans.registry import query

KEYS = "target, file_path, cwe_id"

NEXT = """
    SELECT a.target, a.file_path, a.cwe_id, a.line_start, min(b.line_start) AS next_line FROM o_sites a LEFT JOIN o_sites b
      ON a.target = b.target AND a.file_path = b.file_path AND a.cwe_id = b.cwe_id AND b.line_start > a.line_start + 3
    GROUP BY a.target, a.file_path, a.cwe_id, a.line_start"""
LEADS = """
    SELECT target, file_path, cwe_id, min(line_start) AS leader FROM o_sites GROUP BY target, file_path, cwe_id
    UNION ALL
    SELECT n.target, n.file_path, n.cwe_id, n.next_line FROM o_leads l JOIN o_next n
      ON n.target = l.target AND n.file_path = l.file_path AND n.cwe_id = l.cwe_id AND n.line_start = l.leader WHERE n.next_line IS NOT NULL"""
PLACED = """
    SELECT f.*, (SELECT max(l.leader) FROM o_leads l WHERE l.target = f.target AND l.file_path = f.file_path AND l.cwe_id = f.cwe_id AND l.leader <= f.line_start) AS leader_line
    FROM v_findings f WHERE f.cwe_id <> ''"""
MERGED = """
    SELECT *, row_number() OVER (PARTITION BY target, file_path, cwe_id, leader_line
        ORDER BY line_start, scan_id, scanner, severity, confidence, rule_id, line_end, code_snippet, ai_patch) AS seq,
      CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS rk FROM o_placed"""
FUSED = """
    SELECT target, file_path, cwe_id, leader_line AS line_start, max(confidence) AS confidence,
      CASE max(rk) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity,
      max(scan_id) FILTER (seq = 1) AS scan_id, max(rule_name) FILTER (seq = 1) AS rule_name, max(rule_id) FILTER (seq = 1) AS rule_id,
      max(code_snippet) FILTER (seq = 1) AS code_snippet, max(line_end) FILTER (seq = 1) AS line_end,
      max(ai_patch) FILTER (seq = 1) AS ai_patch, bool_or(patch_validated) FILTER (seq = 1) AS patch_validated,
      max(message) FILTER (seq = 1) AS lead_message, list_sort(list(DISTINCT message)) AS messages,
      list_sort(list(DISTINCT scanner)) AS scanners, count(*) - 1 AS duplicate_count
    FROM o_merged GROUP BY target, file_path, cwe_id, leader_line
    UNION ALL
    SELECT target, file_path, cwe_id, line_start, confidence, severity, scan_id, rule_name, rule_id, code_snippet, line_end, ai_patch, patch_validated,
      message, [message], [scanner], 0 FROM v_findings WHERE cwe_id = ''"""
FUSED_TEXT = """
    SELECT *, 'fusion(' || array_to_string(scanners, ',') || ')' AS scanner,
      lead_message || CASE WHEN len(messages) > 1 THEN chr(10) || chr(10) || '[Also detected: ' || array_to_string(list_filter(messages, lambda m: m <> lead_message), '; ') || ']' ELSE '' END AS message
    FROM o_fused"""
FUSION_VIEWS = {
    "o_sites": "SELECT DISTINCT target, file_path, cwe_id, line_start FROM v_findings WHERE cwe_id <> ''",
    "o_next": NEXT, "o_leads": LEADS, "o_placed": PLACED, "o_merged": MERGED, "o_fused": FUSED, "o_fused_text": FUSED_TEXT,
}


@query("group_by_file", "SELECT target, file_path, CAST(count(*) AS BIGINT) AS n FROM v_findings GROUP BY target, file_path")
def group_by_file(t):
    return t.findings.groupBy("target", "file_path").agg(F.count(F.lit(1)).alias("n"))


# Pairs of findings more than 3 lines apart with similar code.  The ratio is that of the sequence matcher: the longest common run, the first of
# equals, then the same on both its sides; for codes under 200 characters, beyond which the matcher leaves out characters that are frequent there.
FAR_VIEWS = {
    "o_counts": "SELECT target, file_path, line_start, count(*) AS n FROM v_findings GROUP BY target, file_path, line_start",
    "o_coded": r"""
    SELECT target, file_path, line_start, code, count(*) AS n FROM (
      SELECT *, trim(regexp_replace(lower(code_snippet), '\s+', ' ', 'g')) AS code FROM v_findings WHERE length(code_snippet) > 10)
    WHERE code <> '' GROUP BY target, file_path, line_start, code""",
    "o_code_pairs": """
    SELECT DISTINCT x.code AS a, y.code AS b FROM o_coded x JOIN o_coded y
      ON x.target = y.target AND x.file_path = y.file_path AND y.line_start > x.line_start + 3 AND x.code <> y.code""",
    "o_runs": """
    SELECT a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi, 0 AS size FROM o_code_pairs
    UNION ALL
    SELECT a, b, unnest([alo, i + k]), unnest([i, ahi]), unnest([blo, j + k]), unnest([j, bhi]), unnest([k, 0]) FROM (
      SELECT * FROM (
        SELECT a, b, alo, ahi, blo, bhi, min(i) AS i, min(j) AS j, count(*) AS k FROM (
          SELECT *, i - row_number() OVER (PARTITION BY a, b, alo, blo, i - j ORDER BY i) AS run FROM (
            SELECT c.*, d.j FROM (SELECT *, unnest(range(alo, ahi)) AS i FROM o_runs WHERE ahi > alo AND bhi > blo) c,
              LATERAL (SELECT unnest(range(c.blo, c.bhi)) AS j) d WHERE substr(c.a, c.i + 1, 1) = substr(c.b, d.j + 1, 1)))
        GROUP BY a, b, alo, ahi, blo, bhi, i - j, run)
      QUALIFY row_number() OVER (PARTITION BY a, b, alo, blo ORDER BY k DESC, i, j) = 1)""",
    "o_alike": """
    SELECT a, b FROM o_runs GROUP BY a, b HAVING 2.0 * sum(size) / (length(a) + length(b)) >= 0.75 UNION ALL SELECT DISTINCT code, code FROM o_coded""",
    "o_links": """
    SELECT x.target, x.file_path, x.line_start AS leader_line, y.line_start AS other_line, x.n * y.n AS n FROM o_coded x JOIN o_coded y
      ON x.target = y.target AND x.file_path = y.file_path AND y.line_start > x.line_start + 3 JOIN o_alike s ON s.a = x.code AND s.b = y.code""",
    "o_far": """
    SELECT target, file_path, line_start, sum(n) AS n FROM (
      SELECT target, file_path, leader_line AS line_start, n FROM o_links UNION ALL SELECT target, file_path, other_line, n FROM o_links)
    GROUP BY target, file_path, line_start""",
}


@query("fusion_pairs", """
    SELECT a.target, a.file_path, CAST(a.line_start AS BIGINT) AS line_start, CAST(a.n AS BIGINT) AS n_here, CAST(sum(b.n) AS BIGINT) AS n_near,
      CAST(coalesce(max(f.n), 0) AS BIGINT) AS n_far
    FROM o_counts a JOIN o_counts b ON a.target = b.target AND a.file_path = b.file_path AND abs(a.line_start - b.line_start) <= 3
      LEFT JOIN o_far f ON f.target = a.target AND f.file_path = a.file_path AND f.line_start = a.line_start
    GROUP BY a.target, a.file_path, a.line_start, a.n""", FAR_VIEWS)
def fusion_pairs(t):
    """Candidate partners per site, near ones and far ones of similar code, without producing pairs."""
    return fu.near_candidates(t.findings).select("target", "file_path", F.col("line_start").cast("long").alias("line_start"), "n_here", "n_near", "n_far")


@query("fusion_location_cwe", """
    SELECT target, file_path, cwe_id, CAST(leader_line AS BIGINT) AS leader_line, CAST(count(*) AS BIGINT) AS n FROM o_placed
    GROUP BY target, file_path, cwe_id, leader_line
    UNION ALL SELECT target, file_path, cwe_id, CAST(line_start AS BIGINT), CAST(1 AS BIGINT) FROM v_findings WHERE cwe_id = ''""", FUSION_VIEWS)
def fusion_location_cwe(t):
    key = ["target", "file_path", "cwe_id"]
    led = fu.location_leaders(t.findings).select(*key, F.col("leader_line").cast("long").alias("leader_line"), "n")
    named = led.filter("cwe_id <> ''").groupBy(*key, "leader_line").agg(F.sum("n").alias("n"))
    return named.unionByName(led.filter("cwe_id = ''"))


@query("fusion_accounts", "SELECT target, CAST(count(*) AS BIGINT) AS n FROM v_findings GROUP BY target")
def fusion_accounts(t):
    """Leaders and their duplicates together are all findings of a target."""
    return fu.fuse_by_location(t.findings).groupBy("target").agg(F.sum(F.col("duplicate_count") + 1).alias("n"))


@query("fusion_merge", """
    SELECT target, file_path, cwe_id, CAST(line_start AS BIGINT) AS line_start, severity, round(confidence, 6) AS confidence, message, scanner,
      CAST(duplicate_count AS BIGINT) AS duplicate_count, scan_id, rule_id FROM o_fused_text""", FUSION_VIEWS)
def fusion_merge(t):
    return fu.fuse_by_location(t.findings).select(
        "target", "file_path", "cwe_id", F.col("line_start").cast("long").alias("line_start"), "severity", F.round("confidence", 6).alias("confidence"),
        "message", "scanner", F.col("duplicate_count").cast("long").alias("duplicate_count"), "scan_id", "rule_id")


@query("message_difference", """
    SELECT target, file_path, cwe_id, CAST(line_start AS BIGINT) AS line_start,
      array_to_string(list_filter(messages, lambda m: m <> lead_message), '; ') AS others FROM o_fused""", FUSION_VIEWS)
def message_difference(t):
    """Messages of a cluster other than the leader's."""
    found = F.regexp_extract("message", r"(?s)\n\n\[Also detected: (.*)\]$", 1)
    return fu.fuse_by_location(t.findings).select("target", "file_path", "cwe_id", F.col("line_start").cast("long").alias("line_start"), found.alias("others"))


@query("cross_validate", """
    SELECT target, file_path, cwe_id, CAST(line_start AS BIGINT) AS line_start, CASE WHEN len(scanners) >= 2 THEN 'validated' ELSE 'unconfirmed' END AS validation,
      round(CASE WHEN len(scanners) >= 2 THEN least(1.0, confidence + 0.1) ELSE confidence END, 6)::DOUBLE AS confidence FROM o_fused""", FUSION_VIEWS)
def cross_validate(t):
    return fu.cross_validate(fu.fuse_by_location(t.findings)).select(
        "target", "file_path", "cwe_id", F.col("line_start").cast("long").alias("line_start"), "validation", F.round("confidence", 6).alias("confidence"))


@query("fusion_cluster")
def fusion_cluster(t):
    """All duplicate tests; text similarity has no SQL form, so unit tests check it against a plain sequential pass."""
    return fu.fuse_exact(t.findings).select(
        "target", "file_path", F.col("line_start").cast("long").alias("line_start"), "severity", "confidence", "scanner",
        F.col("duplicate_count").cast("long").alias("duplicate_count"))


# The sequential pass itself, as a fold over the rows of a file; with all ratios at 1 the text tests are equality.
SAME = """(abs(l.line - x.line) <= 3 OR (l.len > 10 AND x.len > 10 AND l.code <> '' AND l.code = x.code))
      AND ((l.cwe <> '' AND l.cwe = x.cwe) OR (l.msg <> '' AND l.msg = x.msg) OR (l.code <> '' AND l.code = x.code))"""
STRICT_VIEWS = {
    "o_ordered": """
    SELECT *, row_number() OVER (PARTITION BY target, file_path ORDER BY line_start, scan_id, scanner, severity, confidence, rule_id, line_end, code_snippet, ai_patch) AS pos,
      CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS rk FROM v_findings""",
    "o_each": r"""
    SELECT *, {'pos': pos, 'line': line_start, 'cwe': cwe_id, 'msg': lower(message), 'code': trim(regexp_replace(lower(code_snippet), '\s+', ' ', 'g')), 'len': length(code_snippet)} AS item
    FROM o_ordered""",
    "o_folded": f"""
    SELECT target, file_path, list_reduce(list(item ORDER BY pos), lambda acc, x: CASE WHEN len(list_filter(acc, lambda l: {SAME})) > 0 THEN acc ELSE list_append(acc, x) END,
      list(item)[:0]) AS leaders FROM o_each GROUP BY target, file_path""",
    "o_claimed": f"""
    SELECT e.*, list_filter(leaders, lambda l: {SAME.replace("x.", "e.item.")})[1] AS leader FROM o_each e JOIN o_folded f ON e.target = f.target AND e.file_path = f.file_path""",
}


@query("fusion_cluster_strict", """
    SELECT target, file_path, CAST(leader.line AS BIGINT) AS line_start,
      CASE max(rk) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity, round(max(confidence), 6) AS confidence,
      'fusion(' || array_to_string(list_sort(list(DISTINCT scanner)), ',') || ')' AS scanner, CAST(count(*) - 1 AS BIGINT) AS duplicate_count
    FROM o_claimed GROUP BY target, file_path, leader""", STRICT_VIEWS)
def fusion_cluster_strict(t):
    """The exact form over all findings with every ratio at 1, where SQL can say what a duplicate is."""
    return fu.fuse_exact(t.findings, sim_far=1.0, sim_msg=1 - 1e-9, sim_code=1.0).select(
        "target", "file_path", F.col("line_start").cast("long").alias("line_start"), "severity", F.round("confidence", 6).alias("confidence"), "scanner",
        F.col("duplicate_count").cast("long").alias("duplicate_count"))


# The whole scan over files: hits of both scanners, led per file and weakness by a fold over their lines.
SCAN_VIEWS = {
    "o_secrets": _with_entropy("o_secret_lines"),
    "o_hits": f"""
    SELECT h.path AS file_path, h.line_no AS line_start, 'config_audit' AS scanner, fixed.severity, fixed.cwe_id, 0.9 AS confidence
      FROM o_rule_hits h JOIN {RULE_VALUES} ON fixed.rule_id = h.rule_id
    UNION ALL SELECT path, line_no, 'secret_scanner', {KINDS}, 'CWE-798', CASE kind WHEN 'high_entropy' THEN 0.7 ELSE 0.9 END
      FROM o_secrets WHERE (kind <> 'high_entropy' OR entropy > 4.5) AND {NOT_ALLOWED}""",
    "o_led": """
    SELECT file_path, cwe_id, list_reduce(list_sort(list(DISTINCT line_start)), lambda acc, x: CASE WHEN len(acc) > 0 AND x - acc[-1] <= 3 THEN acc ELSE list_append(acc, x) END,
      list(line_start)[:0]) AS leaders FROM o_hits GROUP BY file_path, cwe_id""",
    "o_scanned": """
    SELECT h.*, list_max(list_filter(leaders, lambda l: l <= h.line_start)) AS leader, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS rk
    FROM o_hits h JOIN o_led l ON l.file_path = h.file_path AND l.cwe_id = h.cwe_id""",
}


def answer(prompts: list[str]) -> list[str]:
    """A model client for the query: one line of code for every prompt that asks for code, nothing for the others."""
    return ["Here:\n```\nfixed()\n```" for _ in prompts]


@query("full_scan", """
    SELECT 'all' AS target, file_path, cwe_id, CAST(leader AS BIGINT) AS line_start,
      CASE max(rk) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity, round(max(confidence), 6)::DOUBLE AS confidence,
      'fusion(' || array_to_string(list_sort(list(DISTINCT scanner)), ',') || ')' AS scanner, CAST(count(*) - 1 AS BIGINT) AS duplicate_count, 'fixed()' AS ai_patch, TRUE AS explained
    FROM o_scanned GROUP BY file_path, cwe_id, leader""", SCAN_VIEWS)
def full_scan(t):
    """Files through both scanners, fusion, context, and a client's explanations and patches."""
    fused = plan.scan_and_fuse(t.config_files.unionByName(t.secret_files), target="all", mode="location_cwe")
    done = plan.explain_and_patch(fused, answer)
    return done.select("target", "file_path", "cwe_id", F.col("line_start").cast("long").alias("line_start"), "severity", F.round("confidence", 6).alias("confidence"), "scanner",
                       F.col("duplicate_count").cast("long").alias("duplicate_count"), "ai_patch", F.col("ai_analysis").contains("fixed()").alias("explained"))


@query("code_normalise", r"""
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, md5(trim(regexp_replace(lower(prompt), '[\s\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))) AS text_md5 FROM v_llm_calls""")
def code_normalise(t):
    return t.llm_calls.select("conv_id", F.col("turn").cast("long").alias("turn"), F.md5(collapse_spaces(F.col("prompt"))).alias("text_md5"))


@query("similarity_bounds", """
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, round(2.0 * least(length(prompt), length(response)) / (length(prompt) + length(response)), 6)::DOUBLE AS bound FROM v_llm_calls""")
def similarity_bounds(t):
    return t.llm_calls.select("conv_id", F.col("turn").cast("long").alias("turn"), F.round(ratio_bound(F.col("prompt"), F.col("response")), 6).alias("bound"))
