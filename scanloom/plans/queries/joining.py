"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.scalar import finding_id
from scanloom.operators import enrich
from scanloom.operators import feedback as fb
from scanloom.operators import incremental as inc
from scanloom.operators import repair
from scanloom.operators.context import add_context
from scanloom.plans.queries.sourcing import CHANGES, literal_rows
from scanloom.plans.registry import query
from scanloom.rules.knowledge import ENTRIES, FIX_EXAMPLES
from scanloom.sinks import history
from scanloom.sources.scanners import unify, union_findings

KB = literal_rows([(e[0], e[1], e[2], e[4]) for e in ENTRIES], ["kb_id", "name", "owasp", "description"])
EXAMPLES = literal_rows(FIX_EXAMPLES, ["kb_id", "language", "vulnerable", "fixed"])
PRICES = literal_rows(enrich.PRICES, ["model", "price_in", "price_out"])

# Weakness ids spelled in several ways, one unknown.
SPELLED = """
    SELECT *, CASE line_start % 4 WHEN 0 THEN cwe_id WHEN 1 THEN lower(cwe_id) WHEN 2 THEN substr(cwe_id, 5) ELSE CASE WHEN line_start % 8 = 3 THEN 'CWE-99999' ELSE cwe_id END END AS spelled,
      CASE WHEN cwe_id = '' THEN '' WHEN line_start % 8 = 3 THEN 'CWE-99999' ELSE cwe_id END AS plain FROM v_findings"""


def _spelled(t):
    q, c = F.col("line_start") % 4, F.col("cwe_id")
    odd = F.when(F.col("line_start") % 8 == 3, "CWE-99999").otherwise(c)
    return t.findings.withColumn("cwe_id", F.when(q == 0, c).when(q == 1, F.lower(c)).when(q == 2, F.substr(c, F.lit(5))).otherwise(odd))


@query("kb_lookup", f"""
    SELECT s.spelled AS cwe_id, k.kb_id, k.name, CAST(count(*) AS BIGINT) AS n FROM o_spelled s
    LEFT JOIN (SELECT * FROM {KB}) k ON k.kb_id = s.plain GROUP BY s.spelled, k.kb_id, k.name""", {"o_spelled": SPELLED})
def kb_lookup(t):
    found = enrich.enrich_cwe(_spelled(t)).withColumn("kb_id", F.when(F.col("name").isNotNull(), F.col("kb_id")))
    return found.groupBy("cwe_id", "kb_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("kb_fix_example", f"""
    SELECT f.cwe_id, l.language, e.vulnerable, e.fixed, CAST(count(*) AS BIGINT) AS n
    FROM v_findings f JOIN (SELECT 'python' AS language, '.py' AS ext UNION ALL SELECT 'java', '.java' UNION ALL SELECT 'js', '.js' UNION ALL SELECT 'tf', '.tf') l ON f.file_path LIKE '%' || l.ext
    LEFT JOIN (SELECT * FROM {EXAMPLES}) e ON e.kb_id = f.cwe_id AND e.language = l.language GROUP BY f.cwe_id, l.language, e.vulnerable, e.fixed""")
def kb_fix_example(t):
    ext = F.substring_index("file_path", ".", -1)
    lang = F.when(ext == "py", "python").otherwise(ext)
    out = enrich.fix_example(enrich.enrich_cwe(t.findings.withColumn("language", lang)), F.col("language"))
    return (out.groupBy("cwe_id", "language", F.col("example.vulnerable").alias("vulnerable"), F.col("example.fixed").alias("fixed"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("kb_owasp", f"""
    SELECT coalesce(k.owasp, '') AS kb_owasp, CAST(count(*) AS BIGINT) AS n FROM o_spelled s LEFT JOIN (SELECT * FROM {KB}) k ON k.kb_id = s.plain GROUP BY 1""",
       {"o_spelled": SPELLED})
def kb_owasp(t):
    return enrich.owasp_category(enrich.enrich_cwe(_spelled(t))).groupBy("kb_owasp").agg(F.count(F.lit(1)).alias("n"))


@query("kb_search", f"""
    SELECT DISTINCT w.keyword, k.kb_id FROM (SELECT DISTINCT unnest(string_split(rule_name, '_')) AS keyword FROM v_findings) w
    JOIN (SELECT * FROM {KB}) k ON contains(lower(k.name), lower(w.keyword)) OR contains(lower(k.description), lower(w.keyword))""")
def kb_search(t):
    """Every word of the rule names, searched in the guidance."""
    words = t.findings.select("rule_name").distinct().select(F.explode(F.split("rule_name", "_")).alias("keyword")).distinct()
    return enrich.kb_search(words)


@query("context_join", """
    SELECT f.file_path, CAST(f.line_start AS BIGINT) AS line_start, CAST(f.line_end AS BIGINT) AS line_end, CAST(f.n AS BIGINT) AS n,
      md5(coalesce((SELECT string_agg(text || CASE WHEN l.line_no < z.n_lines THEN chr(10) ELSE '' END, '' ORDER BY line_no) FROM o_py_lines l WHERE l.path = f.file_path AND f.line_start <= z.n_lines AND l.line_no BETWEEN f.line_start - 5 AND f.line_start - 1), '')) AS before_md5,
      md5(coalesce((SELECT string_agg(text || CASE WHEN l.line_no < z.n_lines THEN chr(10) ELSE '' END, '' ORDER BY line_no) FROM o_py_lines l WHERE l.path = f.file_path AND f.line_start <= z.n_lines AND l.line_no BETWEEN f.line_end + 1 AND f.line_end + 5), '')) AS after_md5
    FROM (SELECT file_path, line_start, line_end, count(*) AS n FROM v_code_findings GROUP BY file_path, line_start, line_end) f
    LEFT JOIN (SELECT path, max(line_no) AS n_lines FROM o_py_lines GROUP BY path) z ON z.path = f.file_path""")
def context_join(t):
    out = add_context(t.code_findings, t.py_files)
    sites = out.groupBy("file_path", "line_start", "line_end", F.md5("context_before").alias("before_md5"), F.md5("context_after").alias("after_md5")).agg(F.count(F.lit(1)).alias("n"))
    return sites.withColumns({c: F.col(c).cast("long") for c in ("line_start", "line_end")})  # cast last: the rows are grouped where the join left them


@query("pair_by_finding", """
    SELECT d.doc_id AS finding_id, coalesce(a.answer, 'no answer for ' || d.source) AS ai_analysis
    FROM {documents} d LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS answer FROM {conversations} GROUP BY conv_id) a ON a.conv_id = d.doc_id""")
def pair_by_finding(t):
    findings = t.documents.select(F.col("doc_id").alias("finding_id"), "source")
    answers = t.conversations.select(F.col("conv_id").alias("finding_id"), "turn", "text")
    return enrich.pair_by_finding(findings, answers, key="finding_id", answer="text", into="ai_analysis", order="turn",
                                  fallback=F.concat(F.lit("no answer for "), "source")).drop("source")


@query("validation_join", """
    SELECT l.doc_id AS id, (l.quality = 1) AS patch_validated, 'quality ' || CAST(l.quality AS STRING) AS patch_validation_result FROM {labels} l
    UNION ALL SELECT doc_id, FALSE, '' FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})""")
def validation_join(t):
    verdicts = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_valid"),
                               F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("check_message"))
    return repair.attach_verdicts(t.documents.select(F.col("doc_id").alias("id")), verdicts)


@query("history_fk", """
    SELECT s.target, f.severity, CAST(count(*) AS BIGINT) AS n FROM v_findings f JOIN v_scans s ON s.scan_id = f.scan_id GROUP BY s.target, f.severity
    UNION ALL SELECT 'orphans', 'none', CAST(count(*) AS BIGINT) FROM v_findings f WHERE f.scan_id NOT IN (SELECT scan_id FROM v_scans)""")
def history_fk(t):
    scans = t.scan_heads.withColumnRenamed("target_path", "target").select("scan_id", "target")
    findings = t.findings.drop("target")
    per = history.with_scans(findings, scans).groupBy("target", "severity").agg(F.count(F.lit(1)).alias("n"))
    lost = history.orphans(findings, scans).agg(F.lit("orphans").alias("target"), F.lit("none").alias("severity"), F.count(F.lit(1)).alias("n"))
    return per.unionByName(lost)


@query("feedback_apply", """
    SELECT f.finding_id, CAST(coalesce(u.label, f.is_true_positive) AS BIGINT) AS is_true_positive FROM v_feedback f
    LEFT JOIN (SELECT user_id * 3 AS finding_id, arg_max(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) AS label FROM {events} GROUP BY user_id) u ON u.finding_id = f.finding_id""")
def feedback_apply(t):
    updates = t.events.select((F.col("user_id") * 3).alias("finding_id"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("is_true_positive"), "event_id")
    return (fb.apply_feedback(t.feedback, updates, order="event_id")
            .select("finding_id", F.col("is_true_positive").cast("long").alias("is_true_positive")))


@query("pricing_join", f"""
    SELECT c.model, coalesce(p.price_in, 0)::DOUBLE AS price_in, coalesce(p.price_out, 0)::DOUBLE AS price_out, CAST(count(*) AS BIGINT) AS calls
    FROM v_llm_calls c LEFT JOIN (SELECT * FROM {PRICES}) p ON p.model = c.model GROUP BY 1, 2, 3""")
def pricing_join(t):
    return enrich.price_calls(t.llm_calls).groupBy("model", "price_in", "price_out").agg(F.count(F.lit(1)).alias("calls"))


@query("incremental_semi", """
    SELECT h.path, CAST(length(h.content) AS BIGINT) AS n_chars FROM v_head h WHERE h.path IN (SELECT path FROM o_changes WHERE change IN ('added', 'modified'))""",
       {"o_changes": CHANGES})
def incremental_semi(t):
    changed = inc.changed_files(inc.manifest(t.base), inc.manifest(t.head))
    return inc.only_changed(t.head, changed).select("path", F.length("content").cast("long").alias("n_chars"))


ID_SQL = "substr(sha256(file_path || ':' || CAST(line_start AS STRING) || ':' || rule_id || ':' || code_snippet), 1, 16)"
OLD = f"SELECT {ID_SQL} AS id FROM v_findings WHERE scanner <> 'bandit'"
NEW = f"SELECT {ID_SQL} AS id FROM v_findings WHERE scanner <> 'semgrep'"


@query("new_resolved_findings", """
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'resolved' ELSE 'kept' END AS status
    FROM (SELECT DISTINCT id FROM o_old) o FULL OUTER JOIN (SELECT DISTINCT id FROM o_new) n ON o.id = n.id""", {"o_old": OLD, "o_new": NEW})
def new_resolved_findings(t):
    """An older scan without one scanner against a newer one without another."""
    ids = t.findings.select(finding_id(F.col("file_path"), F.col("line_start"), F.col("rule_id"), F.col("code_snippet")).alias("id"), "scanner")
    return inc.compare_scans(ids.filter("scanner <> 'bandit'"), ids.filter("scanner <> 'semgrep'"))


@query("union_scanners", """
    SELECT scanner, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT rule_id) AS BIGINT) AS rules FROM v_findings GROUP BY scanner""")
def union_scanners(t):
    """Each scanner's rows unified on their own, then one table."""
    names = ["semgrep", "bandit", "secret_scanner", "config_audit"]
    f = t.findings
    return (union_findings([unify(f.filter(F.col("scanner") == n), n) for n in names])
            .groupBy("scanner").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("rules")))


@query("union_changed_distinct", "SELECT path FROM v_staged UNION SELECT path FROM v_head")
def union_changed_distinct(t):
    return inc.union_changed(t.staged, t.head)


DIFF = """
    SELECT conv_id, turn, line, sum(d) AS d FROM (
      SELECT conv_id, turn, unnest(string_split(prompt, chr(10))) AS line, -1 AS d FROM v_llm_calls
      UNION ALL SELECT conv_id, turn, unnest(string_split(response, chr(10))), 1 FROM v_llm_calls) GROUP BY conv_id, turn, line HAVING sum(d) <> 0"""


@query("line_diff_multiset", """
    SELECT CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS pair, md5(line) AS line_md5, CAST(greatest(-d, 0) AS BIGINT) AS removed, CAST(greatest(d, 0) AS BIGINT) AS added FROM o_diff""",
       {"o_diff": DIFF})
def line_diff_multiset(t):
    calls = t.llm_calls.withColumn("pair", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return (inc.line_diff(calls, F.col("prompt"), F.col("response"), "pair")
            .select("pair", F.md5("line").alias("line_md5"), F.col("removed").cast("long").alias("removed"), F.col("added").cast("long").alias("added")))
