"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import falsepos, patches, responses, scalar
from scanloom.functions.prompts import TEMPLATES, prompt
from scanloom.operators import enrich, feedback, repair
from scanloom.plans.queries.joining import PRICES, literal_rows
from scanloom.plans.registry import query

SEM = "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' THEN 'Warning' WHEN event_type = 'view' THEN 'INFO' WHEN event_type = 'signup' THEN 'other' END"


@query("severity_map", f"""
    SELECT event_type, CASE upper(coalesce({SEM}, 'INFO')) WHEN 'ERROR' THEN 'HIGH' WHEN 'WARNING' THEN 'MEDIUM' WHEN 'INFO' THEN 'LOW' ELSE 'MEDIUM' END AS severity, CAST(count(*) AS BIGINT) AS n
    FROM {{events}} GROUP BY 1, 2""")
def severity_map(t):
    e = F.col("event_type")
    raw = F.when(e == "error", "error").when(e == "click", "Warning").when(e == "view", "INFO").when(e == "signup", "other")
    return t.events.select("event_type", scalar.severity_map(raw).alias("severity")).groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("confidence_map", """
    SELECT event_type, round(CASE event_type WHEN 'error' THEN 0.9 WHEN 'click' THEN 0.5 ELSE 0.7 END, 6)::DOUBLE AS folded,
      round(CASE event_type WHEN 'error' THEN 0.9 WHEN 'click' THEN 0.7 ELSE 0.7 END, 6)::DOUBLE AS exact, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY 1, 2, 3""")
def confidence_map(t):
    e = F.col("event_type")
    raw = F.when(e == "error", "HIGH").when(e == "click", "low").when(e == "view", "odd")
    return (t.events.select("event_type", scalar.confidence_map(raw, fold_case=True).alias("folded"), scalar.confidence_map(raw, fold_case=False).alias("exact"))
            .groupBy("event_type", "folded", "exact").agg(F.count(F.lit(1)).alias("n")))


@query("severity_rank", """
    SELECT event_type, CAST(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 0 END AS BIGINT) AS rank_fusion,
      CAST(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'click' THEN 0 ELSE 2 END AS BIGINT) AS rank_feature, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY 1, 2, 3""")
def severity_rank(t):
    e = F.col("event_type")
    sev = F.when(e == "error", "CRITICAL").when(e == "purchase", "HIGH").when(e == "click", "INFO").otherwise("unknown")
    return (t.events.select("event_type", scalar.severity_rank(sev).cast("long").alias("rank_fusion"), scalar.severity_rank(sev, 2).cast("long").alias("rank_feature"))
            .groupBy("event_type", "rank_fusion", "rank_feature").agg(F.count(F.lit(1)).alias("n")))


@query("rule_parts", """
    SELECT DISTINCT rule_id || '.x' AS rule_id, split_part(rule_id, '.', 2) || '.x' AS rest, 'rule' AS family, rule_name AS whole FROM v_findings""")
def rule_parts(t):
    rid = F.concat("rule_id", F.lit(".x"))
    return t.findings.select(rid.alias("rule_id"), scalar.rule_name_of(rid).alias("rest"), scalar.rule_family_of(rid).alias("family"),
                             scalar.rule_name_of(F.col("rule_name")).alias("whole")).distinct()


@query("finding_id", """
    SELECT substr(sha256(file_path || ':' || CAST(line_start AS STRING) || ':' || rule_id || ':' || code_snippet), 1, 16) AS id, CAST(count(*) AS BIGINT) AS n FROM v_findings GROUP BY 1""")
def finding_id(t):
    return (t.findings.select(scalar.finding_id(F.col("file_path"), F.col("line_start"), F.col("rule_id"), F.col("code_snippet")).alias("id"))
            .groupBy("id").agg(F.count(F.lit(1)).alias("n")))


def _score(scanner: str) -> str:
    return f"""least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + (
      (((CASE WHEN confidence >= 0.9 THEN -0.3 WHEN confidence <= 0.5 THEN 0.3 ELSE 0 END)::DOUBLE
      + (CASE severity WHEN 'CRITICAL' THEN -0.4 WHEN 'INFO' THEN 0.4 ELSE 0 END)::DOUBLE)
      + (CASE WHEN regexp_matches(lower(rule_name), 'eval|exec|pickle|assert') THEN 0.2 ELSE 0 END)::DOUBLE)
      + (CASE WHEN length(code_snippet) < 30 THEN 0.15 ELSE 0 END)::DOUBLE
      + (CASE WHEN contains({scanner}, 'fusion') THEN -0.25 ELSE 0 END)::DOUBLE)))"""


MIXED = "SELECT *, CASE WHEN line_start % 2 = 0 THEN 'fusion(' || scanner || ')' ELSE scanner END AS label FROM v_findings"


def _mixed(t):
    return t.findings.withColumn("scanner", F.when(F.col("line_start") % 2 == 0, F.concat(F.lit("fusion("), "scanner", F.lit(")"))).otherwise(F.col("scanner")))


@query("fp_heuristic", f"""
    SELECT severity, confidence, rule_name, label AS scanner, CAST(length(code_snippet) AS BIGINT) AS n_chars, round({_score('label')}, 6) AS fp_confidence,
      {_score('label')} > 0.7 AS is_false_positive, CAST(count(*) AS BIGINT) AS n FROM o_mixed GROUP BY 1, 2, 3, 4, 5, 6, 7""", {"o_mixed": MIXED})
def fp_heuristic(t):
    return (feedback.score_fp(_mixed(t)).groupBy("severity", "confidence", "rule_name", "scanner", F.length("code_snippet").cast("long").alias("n_chars"),
                                                 F.round("fp_confidence", 6).alias("fp_confidence"), "is_false_positive").agg(F.count(F.lit(1)).alias("n")))


@query("fp_filter_drop", f"""
    SELECT severity, CAST(count(*) AS BIGINT) AS kept FROM o_mixed WHERE NOT ({_score('label')} > 0.7 AND {_score('label')} > 0.8) GROUP BY severity""", {"o_mixed": MIXED})
def fp_filter_drop(t):
    """Two thresholds: flagged above 0.7, dropped above 0.8."""
    return feedback.drop_false_positives(feedback.score_fp(_mixed(t)), threshold=0.8).groupBy("severity").agg(F.count(F.lit(1)).alias("kept"))


@query("fp_features", """
    SELECT scan_id, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END::DOUBLE AS f_severity, confidence AS f_confidence,
      length(code_snippet)::DOUBLE AS f_snippet_len, length(message)::DOUBLE AS f_message_len, CASE WHEN length(ai_patch) > 0 THEN 1 ELSE 0 END::DOUBLE AS f_has_before, 0::DOUBLE AS f_has_after,
      CASE split_part(label, '(', 1) WHEN 'bandit' THEN 1 WHEN 'fusion' THEN 3 ELSE 0 END::DOUBLE AS f_scanner, CASE WHEN cwe_id <> '' THEN 1 ELSE 0 END::DOUBLE AS f_cwe,
      (line_end - line_start + 1)::DOUBLE AS f_span FROM o_mixed""", {"o_mixed": MIXED})
def fp_features(t):
    df = _mixed(t).withColumns({"context_before": F.col("ai_patch"), "context_after": F.lit("")})
    return feedback.with_features(df).select("scan_id", *falsepos.FEATURES)


@query("detect_language", """
    SELECT CASE WHEN file_path LIKE '%.py' THEN 'Python' WHEN file_path LIKE '%.js' THEN 'JavaScript' WHEN file_path LIKE '%.java' THEN 'Java' ELSE 'Unknown' END AS language,
      CAST(count(*) AS BIGINT) AS n FROM v_findings GROUP BY 1""")
def detect_language(t):
    return t.findings.select(scalar.detect_language(F.col("file_path")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def _category(cwe: str, msg: str) -> str:
    arms = []
    for label, in_cwe, in_msg in scalar.FIX_CATEGORIES:
        tests = [f"contains(lower({cwe}), '{w}')" for w in in_cwe] + [f"contains(lower({msg}), '{w}')" for w in in_msg]
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{label}'")
    return f"CASE {' '.join(arms)} ELSE '{scalar.DEFAULT_FIX}' END"


# Messages with the words the categories look for, from the rule names and brands.
WORDY = """SELECT *, CASE scan_id % 9 WHEN 0 THEN rule_name WHEN 1 THEN 'cross-site ' || message WHEN 2 THEN 'Path TRAVERSAL' WHEN 3 THEN 'weak hash' WHEN 4 THEN 'session fixation'
    WHEN 5 THEN 'race condition' WHEN 6 THEN message ELSE 'command injection' END AS words, CASE WHEN scan_id % 9 = 6 THEN 'deserialization' ELSE cwe_id END AS odd_cwe FROM v_findings"""


@query("categorize_fix", f"SELECT {_category('odd_cwe', 'words')} AS fix_type, CAST(count(*) AS BIGINT) AS n FROM o_wordy GROUP BY 1", {"o_wordy": WORDY})
def categorize_fix(t):
    k = F.col("scan_id") % 9
    words = (F.when(k == 0, F.col("rule_name")).when(k == 1, F.concat(F.lit("cross-site "), "message")).when(k == 2, "Path TRAVERSAL").when(k == 3, "weak hash")
             .when(k == 4, "session fixation").when(k == 5, "race condition").when(k == 6, F.col("message")).otherwise("command injection"))
    cwe = F.when(k == 6, "deserialization").otherwise(F.col("cwe_id"))
    return t.findings.select(scalar.categorize_fix(cwe, words).alias("fix_type")).groupBy("fix_type").agg(F.count(F.lit(1)).alias("n"))


# ---- prompts: the oracle splices columns into the same fixed texts

_SQL_PARTS = {
    "severity_words": "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalar.SEVERITY_WORDS.items()) + " ELSE 'Unknown' END",
    "icon": "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalar.SEVERITY_ICONS.items()) + " ELSE '⚪' END",
    "confidence_percent": "CAST(CAST(round_even(confidence * 100, 0) AS INT) AS STRING) || '%'",
    "cwe_or_na": "coalesce(nullif(cwe_id, ''), 'N/A')", "cwe_or_unknown": "coalesce(nullif(cwe_id, ''), 'Unknown')",
    "cwe_or_documentation": "coalesce(nullif(cwe_id, ''), 'documentation')", "owasp_or_unknown": "'Unknown'",
    "fix_type": _category("cwe_id", "message"),
    "language": "CASE WHEN file_path LIKE '%.py' THEN 'Python' WHEN file_path LIKE '%.js' THEN 'JavaScript' WHEN file_path LIKE '%.java' THEN 'Java' ELSE 'Unknown' END",
    "line_start": "CAST(line_start AS STRING)", "line_end": "CAST(line_end AS STRING)", "context_before": "ai_patch", "context_after": "''",
    "root_cause": "message", "fix_strategy": "'strategy ' || rule_name", "numbered_steps": "'  1. look' || chr(10) || '  2. ' || rule_name",
    "failed_patch": "ai_patch", "validation_error": "'error in ' || rule_id",
}


def _prompt_sql(kind: str) -> str:
    import re
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", TEMPLATES[kind])):
        parts.append(_SQL_PARTS.get(piece, piece) if i % 2 else "'" + piece.replace("'", "''") + "'")
    return f"SELECT scan_id, rule_id, md5({' || '.join(f'({p})' for p in parts)}) AS prompt_md5 FROM v_findings"


def _prompt_input(t):
    return t.findings.withColumns({
        "context_before": F.col("ai_patch"), "context_after": F.lit(""), "owasp_category": F.lit(""), "root_cause": F.col("message"),
        "fix_strategy": F.concat(F.lit("strategy "), "rule_name"), "steps": F.array(F.lit("look"), F.col("rule_name")),
        "failed_patch": F.col("ai_patch"), "validation_error": F.concat(F.lit("error in "), "rule_id")})


def _register_prompt(name: str, kind: str):
    @query(name, _prompt_sql(kind))
    def one(t):
        return _prompt_input(t).select("scan_id", "rule_id", F.md5(prompt(kind)).alias("prompt_md5"))


for _name, _kind in (("patch_prompt", "patch"), ("explain_prompt", "explain"), ("plan_prompts", "plan"), ("repair_prompt", "repair"),
                     ("reflect_prompt", "reflect"), ("fallback_explanation", "fallback")):
    _register_prompt(_name, _kind)


FENCE = r"(?s)```(?:\w+)?\n(.*?)\n```"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
CODE = STRIP.format(x=f"CASE WHEN regexp_matches(response, '{FENCE}') THEN regexp_extract(response, '{FENCE}', 1) ELSE response END")
BLOCK = STRIP.format(x=f"regexp_extract(response, '{FENCE}', 1)")
CHATTY = "list_filter(string_split(response, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(Here is|The fix|Fixed code|Below is)'))"
PATCH = f"""CASE WHEN regexp_matches(response, '{FENCE}') THEN CASE WHEN starts_with({BLOCK}, 'UNABLE_TO_FIX') THEN '' ELSE {BLOCK} END
    WHEN regexp_matches(response, '^\\s*UNABLE_TO_FIX') THEN '' ELSE {STRIP.format(x=f"array_to_string({CHATTY}, chr(10))")} END"""


@query("extract_code", f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, md5({CODE}) AS code_md5 FROM v_answers")
def extract_code(t):
    return t.answers.select("conv_id", F.col("turn").cast("long").alias("turn"), F.md5(responses.extract_code(F.col("response"))).alias("code_md5"))


@query("extract_patch", f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, md5({PATCH}) AS patch_md5 FROM v_answers")
def extract_patch(t):
    return t.answers.select("conv_id", F.col("turn").cast("long").alias("turn"), F.md5(responses.extract_patch(F.col("response"))).alias("patch_md5"))


@query("parse_plan", """
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN conv_id % 3 = 0 THEN 'cause ' || CAST(conv_id AS STRING) ELSE prompt END AS root_cause,
      CASE WHEN conv_id % 3 = 0 THEN 'escape' ELSE 'Apply secure coding pattern' END AS fix_strategy,
      CASE WHEN conv_id % 3 = 0 THEN 'a;b ' || CAST(turn AS STRING) ELSE 'Identify vulnerability;Apply fix;Verify' END AS steps,
      CASE WHEN conv_id % 3 = 0 THEN 'low' ELSE 'medium' END AS estimated_complexity, '' AS side_effects,
      CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'No vulnerability flagged on rescan' END AS success_criteria FROM v_answers""")
def parse_plan(t):
    p = t.answers.withColumn("p", responses.parse_plan(F.col("plan_text"), F.col("prompt")))
    return p.select("conv_id", F.col("turn").cast("long").alias("turn"), "p.root_cause", "p.fix_strategy", F.array_join("p.steps", ";").alias("steps"),
                    "p.estimated_complexity", F.array_join("p.potential_side_effects", ";").alias("side_effects"), "p.success_criteria")


# Python-looking patches, one danger each, around the given texts.
PATCHY = """SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'x = literal_eval(y)' WHEN 1 THEN 'exec(z)' || chr(10) || 'os.system(q)' WHEN 2 THEN 'data = pickle.loads(b)' WHEN 3 THEN 'v = user_input(' || CAST(doc_id AS STRING) || ')' WHEN 4 THEN text ELSE 'ok = ' || CAST(length(text) AS STRING) END AS patch,
    CASE doc_id % 4 WHEN 0 THEN 'a/b.rb' WHEN 1 THEN 'Makefile' WHEN 2 THEN '.py' ELSE 'c.py' END AS file_path FROM {documents}"""


def _patchy(t):
    k, j = F.col("doc_id") % 6, F.col("doc_id") % 4
    n = F.col("doc_id").cast("string")
    patch = (F.when(k == 0, "x = literal_eval(y)").when(k == 1, "exec(z)\nos.system(q)").when(k == 2, "data = pickle.loads(b)")
             .when(k == 3, F.concat(F.lit("v = user_input("), n, F.lit(")"))).when(k == 4, F.col("text")).otherwise(F.concat(F.lit("ok = "), F.length("text").cast("string"))))
    path = F.when(j == 0, "a/b.rb").when(j == 1, "Makefile").when(j == 2, ".py").otherwise("c.py")
    return t.documents.withColumn("patch", patch).withColumn("file_path", path)


DANGER_SQL = "concat_ws('; ', " + ", ".join(f"CASE WHEN contains(patch, '{s}') THEN '{d}' END" for s, d in patches.DANGERS) + ")"


@query("danger_patterns", f"SELECT doc_id, {DANGER_SQL} AS issues FROM o_patchy", {"o_patchy": PATCHY})
def danger_patterns(t):
    return _patchy(t).select("doc_id", F.array_join(patches.danger_list(F.col("patch")), "; ").alias("issues"))


@query("validate_routing", """
    SELECT file_path, TRUE AS is_valid, CASE WHEN file_path = 'a/b.rb' THEN 'No validator for .rb, assuming valid' ELSE 'No validator for ., assuming valid' END AS check_message,
      CAST(count(*) AS BIGINT) AS n FROM o_patchy WHERE file_path <> 'c.py' GROUP BY file_path""", {"o_patchy": PATCHY})
def validate_routing(t):
    df = _patchy(t).withColumn("v", patches.native_verdict(F.col("file_path"), F.col("patch"), {})).filter("v IS NOT NULL")
    return df.groupBy("file_path", "v.is_valid", F.col("v.message").alias("check_message")).agg(F.count(F.lit(1)).alias("n"))


@query("patched_only", "SELECT scan_id, rule_id FROM v_findings WHERE ai_patch <> ''")
def patched_only(t):
    return repair.patched_only(t.findings).select("scan_id", "rule_id")


@query("patch_status", """
    SELECT CASE WHEN ai_patch = '' THEN 'No Patch' WHEN patch_validated THEN 'Validated' ELSE 'Unvalidated' END AS status, CAST(count(*) AS BIGINT) AS n FROM v_findings GROUP BY 1""")
def patch_status(t):
    return t.findings.select(scalar.patch_status(F.col("ai_patch"), F.col("patch_validated")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("short_fields", """
    SELECT substr(sha256(rule_id), 1, 8) AS short_id, split_part(file_path, '/', 3) || ':' || CAST(line_start AS STRING) AS location, coalesce(nullif(cwe_id, ''), 'N/A') AS cwe,
      CAST(count(*) AS BIGINT) AS n FROM v_findings GROUP BY 1, 2, 3""")
def short_fields(t):
    return (t.findings.select(scalar.short_id(F.sha2("rule_id", 256)).alias("short_id"), scalar.short_location(F.col("file_path"), F.col("line_start")).alias("location"),
                              scalar.or_default(F.col("cwe_id"), "N/A").alias("cwe")).groupBy("short_id", "location", "cwe").agg(F.count(F.lit(1)).alias("n")))


@query("call_cost", f"""
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, round(tokens_prompt / 1e6 * coalesce(p.price_in, 0)::DOUBLE + tokens_completion / 1e6 * coalesce(p.price_out, 0)::DOUBLE, 6) AS cost_usd
    FROM v_llm_calls c LEFT JOIN (SELECT * FROM {PRICES}) p ON p.model = c.model""")
def call_cost(t):
    return enrich.price_calls(t.llm_calls).select("conv_id", F.col("turn").cast("long").alias("turn"), F.round("cost_usd", 6).alias("cost_usd"))


CHAIN_PRICES = literal_rows([(p, *[(i, o) for m2, i, o in enrich.PRICES if m2 == m][0]) for p, m in enrich.PROVIDERS], ["provider", "price_in", "price_out"])


@query("estimate_cost", f"""
    SELECT doc_id, fixed.provider, round(CAST(floor(length(text) / 4) / 1e6 * price_in::DOUBLE + 1000 / 1e6 * price_out::DOUBLE AS DECIMAL(18, 10)), 4)::DOUBLE AS estimated_usd FROM {{documents}}, {CHAIN_PRICES}""")
def estimate_cost(t):
    return enrich.estimate_cost(t.documents.select("doc_id", "text"), "text").select("doc_id", "provider", "estimated_usd")


MARKED = "SELECT doc_id, '## ' || lang || chr(10) || '### ' || source || chr(10) || '**' || lang || '** and `' || source || '`' || chr(10) || text AS md FROM {documents}"


@query("markdown_to_html", r"""
    SELECT doc_id, md5(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '\*\*([^\n]+?)\*\*', '<strong>\1</strong>', 'g'), '(?m)^### ([^\n]+)$', '<h3>\1</h3>', 'g'),
      '(?m)^## ([^\n]+)$', '<h2>\1</h2>', 'g'), '`([^`]+)`', '<code>\1</code>', 'g'), chr(10), '<br>')) AS html_md5 FROM o_marked""", {"o_marked": MARKED})
def markdown_to_html(t):
    md = F.concat(F.lit("## "), "lang", F.lit("\n### "), "source", F.lit("\n**"), "lang", F.lit("** and `"), "source", F.lit("`\n"), "text")
    return t.documents.select("doc_id", F.md5(scalar.markdown_to_html(md)).alias("html_md5"))
