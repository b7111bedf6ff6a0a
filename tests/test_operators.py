"""Context, guidance, prompts, answers, scores, repair, incremental and history on inline fixtures."""

import ast
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scanloom.functions import patches, responses, scalar
from scanloom.functions.prompts import prompt
from scanloom.functions.text import collapse_spaces, ratio_bound, text_similarity
from scanloom.operators import context, enrich, feedback, filters, incremental, plugins, repair, stats, trends
from scanloom.rules.knowledge import knowledge_base
from scanloom.sinks import history, reports

CODE = "# head\nimport os\nfrom sys import path\n\n'''doc'''\nclass A:\n    def f(self):\n        x = 1\n\n# note\n        y = 2\n    z = 3\nw = 4\nimport late\n"


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("v")).first().v


def reference_context(text, start, end, before=5, after=5):
    lines = text.splitlines(keepends=True)
    s, e = max(0, start - 1), min(len(lines), end)
    if s >= len(lines):
        return "", ""
    return "".join(lines[max(0, s - before):s]), "".join(lines[e:min(len(lines), e + after)])


@pytest.mark.parametrize("text", [CODE, CODE.rstrip("\n"), "one", ""])
def test_add_context(spark, text):
    spots = [(s, e) for s in range(0, 18) for e in (s, s + 2)]
    f = spark.createDataFrame([("a.py", s, e) for s, e in spots] + [("missing.py", 1, 1)], "file_path string, line_start int, line_end int")
    files = spark.createDataFrame([("a.py", text)], "path string, content string")
    got = {(r.file_path, r.line_start, r.line_end): (r.context_before, r.context_after) for r in context.add_context(f, files).collect()}
    assert got.pop(("missing.py", 1, 1)) == ("", "")
    assert got == {("a.py", s, e): reference_context(text, s, e) for s, e in spots}
    per_line = {r.line_no: (r.context_before, r.context_after) for r in context.line_context(files).collect()}
    assert per_line == {i: reference_context(text, i, i) for i in range(1, len(text.splitlines()) + 1)}


def test_context_joins_once_unless_findings_are_long(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", CODE)], "path string, content string")
    spots = [(s, e) for s in range(-70, 18, 3) for e in (s - 1, s, s + 1, s + 63, s + 64)]
    rows = lambda spots: spark.createDataFrame([("a.py", s, e, "x") for s, e in spots], "file_path string, line_start int, line_end int, id string")
    plan = context.add_context(rows([(1, 2)]), files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftOuter") == 1
    want = {("a.py", s, e): reference_context(CODE, s, e) for s, e in spots if s >= 0}
    got = {(r.file_path, r.line_start, r.line_end): (r.context_before, r.context_after) for r in context.add_context(rows(spots), files).collect()}
    assert {k: got[k] for k in want} == want and len(got) == len(spots)
    monkeypatch.setattr(context, "CHUNK", 5)
    chunked = {(r.file_path, r.line_start, r.line_end): (r.context_before, r.context_after) for r in context.add_context(rows(spots), files).collect()}
    by_line = {(r.file_path, r.line_start, r.line_end): (r.context_before, r.context_after) for r in context._by_line(rows(spots), files, 5, 5).collect()}
    assert chunked == got == by_line


def reference_function(lines, target):
    start = next((i for i in range(target, -1, -1) if lines[i].lstrip().startswith(("def ", "class "))), -1)
    if start < 0:
        return None
    depth = len(lines[start]) - len(lines[start].lstrip())
    for i in range(target + 1, len(lines)):
        s = lines[i].strip()
        if s and not s.startswith("#") and len(lines[i]) - len(lines[i].lstrip()) <= depth and i > start + 1:
            return start + 1, i
    return start + 1, len(lines)


def test_enclosing_function(spark):
    lines = CODE.splitlines()
    files = spark.createDataFrame([("a.py", CODE)], "path string, content string")
    targets = spark.createDataFrame([("a.py", i) for i in range(1, len(lines) + 3)], "path string, line_no int")
    found = context.enclosing_function(targets, files)
    got = {r.line_no: (r.func_start, r.func_end) if r.func_start else None for r in found.collect()}
    assert got == {i: reference_function(lines, i - 1) if i <= len(lines) else None for i in range(1, len(lines) + 3)}
    text = {r.line_no: r.function_text for r in context.function_text(found, files).collect()}
    keep = CODE.splitlines(keepends=True)
    assert text == {i: "".join(keep[g[0] - 1:g[1]]) if g else "" for i, g in got.items()}


def test_enclosing_function_in_random_files(spark):
    rng = random.Random(4)
    lines = lambda: ["    " * rng.randint(0, 3) + rng.choice(["def f():", "class C:", "x = 1", "# note", "", "return"]) for _ in range(rng.randint(0, 60))]
    texts = {f"f{i}.py": lines() for i in range(25)}
    files = spark.createDataFrame([(p, "\n".join(t)) for p, t in texts.items()] + [("none.py", None)], "path string, content string")
    wanted = [(p, i) for p, t in texts.items() for i in range(-1, len(t) + 3)] + [("none.py", 1), ("gone.py", 3), (None, 1), ("f1.py", None)]
    found = context.enclosing_function(spark.createDataFrame(wanted + wanted[:40], "path string, line_no int"), files)
    got = {(r.path, r.line_no): (r.func_start, r.func_end) if r.func_start else None for r in found.collect()}
    assert found.count() == len(set(wanted)) == len(got)
    for p, i in wanted:
        t = "\n".join(texts.get(p, [])).splitlines() if p in texts else []
        assert got[p, i] == (reference_function(t, i - 1) if i and 1 <= i <= len(t) else None), (p, i)


def test_enclosing_function_reads_files_once_and_moves_no_lines(spark, tmp_path):
    spark.createDataFrame([("a.py", CODE)], "path string, content string").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([("a.py", 3)], "path string, line_no int").write.parquet(str(tmp_path / "t"))
    files, targets = spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "t"))
    plan = context.enclosing_function(targets, files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Generate" not in plan and "Window" not in plan
    alone = context.line_context(files)._jdf.queryExecution().executedPlan().toString()
    assert alone.count("FileScan parquet") == 1 and "Exchange" not in alone


def test_line_context_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(context, "CHUNK", 7)
    for text in ("\n".join(f"l{i}" for i in range(40)) + "\n", "a\r\nb\rc", "", "\n", "\n\n", None):
        files = spark.createDataFrame([("a.py", text)], "path string, content string")
        per_line = {r.line_no: (r.context_before, r.context_after) for r in context.line_context(files).collect()}
        n = len(re.split("\r\n|\r|\n", text)) - (text == "" or text.endswith("\n")) if text is not None else 0
        assert per_line == {i: reference_context(text.replace("\r\n", "\n").replace("\r", "\n"), i, i) for i in range(1, n + 1)}


def test_import_block(spark):
    files = spark.createDataFrame([("a.py", CODE), ("b.txt", CODE), ("c.py", "x = 1\nimport a"), ("d.py", "y")], "path string, content string")
    got = {r.path: (r.imports, r.import_count) for r in context.import_block(files).collect()}
    assert got == {"a.py": ("import os\nfrom sys import path\n", 2), "c.py": ("import a", 1), "d.py": ("", 0)}


def test_guidance(spark):
    f = spark.createDataFrame([(c,) for c in ("CWE-89", "cwe-89", "89", "CWE-99999", "", None)], "cwe_id string")
    out = enrich.fix_example(enrich.enrich_cwe(f))
    names = {r.cwe_id: (r.name, r.example) for r in out.collect()}
    assert all("SQL Injection" in names[c][0] and names[c][1].fixed for c in ("CWE-89", "cwe-89", "89"))
    assert names["CWE-99999"] == (None, None) and names[""] == (None, None) and names[None] == (None, None)
    assert enrich.fix_example(enrich.enrich_cwe(f), "cobol").filter("example IS NOT NULL").count() == 0
    words = spark.createDataFrame([("injection",), ("nothing-like-it",)], "keyword string")
    assert enrich.kb_search(words).count() >= 2
    assert knowledge_base(spark).count() == 9


def test_prompt_text(spark):
    values = dict(severity="INFO", rule_name="sqli", cwe_id="", owasp_category="", file_path="a/b.py", line_start=3, line_end=4, confidence=0.85,
                  message="SQL here", code_snippet="c", context_before="b\n", context_after="")
    text = one(spark, prompt("patch"), **values)
    assert "- Severity: INFO - Unknown\n- Type: sqli\n- CWE: N/A\n- Location: a/b.py:3\n- Confidence: 85%\n" in text
    assert "- Fix Type: Parameterized Query / Prepared Statement\n- Language: Python\n" in text and "```\nb\n\n```" in text
    assert "`a/b.py:3-4`" in one(spark, prompt("explain"), **values)
    assert one(spark, prompt("fallback"), **values).startswith("## 🔵 sqli\n")


def test_answers(spark):
    cases = {"x\n```python\n a = 1 \n```\nb\n```\nc\n```": "a = 1", "```\nUNABLE_TO_FIX: no\n```": "", " UNABLE_TO_FIX": "",
             "Here is it\ncode\n  Fixed code below\nmore": "code\nmore", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", responses.extract_patch(F.col("r")).alias("p"), responses.extract_code(F.col("r")).alias("c"))
    for r in df.collect():
        assert r.p == cases[r.r]
    assert {r.r: r.c for r in df.collect()}["```\nUNABLE_TO_FIX: no\n```"] == "UNABLE_TO_FIX: no"


def test_plan(spark):
    good = 'ok {"root_cause": "r", "steps": ["a", "b"], "potential_side_effects": ["x"]} bye'
    df = spark.createDataFrame([(good,), ("none",), ("{bad}",), ("{}",)], "r string").select("r", responses.parse_plan(F.col("r"), F.lit("msg")).alias("p"))
    p = {r.r: r.p for r in df.collect()}
    assert (p[good].root_cause, p[good].steps, p[good].estimated_complexity, p[good].fix_strategy) == ("r", ["a", "b"], "medium", "")
    assert p["none"] == p["{bad}"] and p["none"].steps == ["Identify vulnerability", "Apply fix", "Verify"] and p["none"].root_cause == "msg"
    assert p["{}"].steps == [] and p["{}"].root_cause == ""


def test_patch_checks(spark):
    rows = [("a.py", "def broken(\n  pass\n"), ("a.py", "import os\nx = 1"), ("a.py", "r = eval(user_input)"), ("a.py", "literal_eval(x)"), ("a.rb", "eval("), ("Makefile", "x"), (".py", "x")]
    out = {(r.file_path, r.ai_patch): (r.is_valid, r.check_message) for r in repair.check_patches(spark.createDataFrame(rows, "file_path string, ai_patch string")).collect()}
    assert not out[rows[0]][0] and out[rows[0]][1].startswith("Python syntax error")
    assert out[rows[1]] == (True, patches.PYTHON_OK)
    assert out[rows[2]] == (False, "New issues introduced: Use of eval()") and not out[rows[3]][0]
    assert out[rows[4]] == (True, "No validator for .rb, assuming valid") and out[rows[5]] == (True, "No validator for ., assuming valid")
    assert out[rows[6]] == (True, "No validator for ., assuming valid")
    with pytest.raises(SyntaxError):
        ast.parse(rows[0][1])


def finding(spark, **kw):
    base = dict(severity="HIGH", confidence=0.8, rule_name="sqli", code_snippet="x" * 40, scanner="semgrep", cwe_id="CWE-89", message="m", context_before="", context_after="",
                line_start=10, line_end=11)
    base.update(kw)
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in base.items()))


@pytest.mark.parametrize("kw,score", [
    (dict(severity="CRITICAL", confidence=0.95), 0.0), (dict(severity="INFO", confidence=0.3, rule_name="eval_usage"), 1.0),
    (dict(rule_name="TODO_left"), 0.5), (dict(scanner="fusion(a)", code_snippet="short"), 0.4), (dict(confidence=0.5), 0.8)])
def test_heuristic(spark, kw, score):
    r = feedback.score_fp(finding(spark, **kw)).first()
    assert r.fp_confidence == pytest.approx(score) and r.is_false_positive == (score > 0.7)


def test_two_thresholds(spark):
    scored = feedback.score_fp(finding(spark, confidence=0.5))
    assert feedback.drop_false_positives(scored).count() == 0
    assert feedback.drop_false_positives(scored, threshold=0.9).count() == 1
    assert feedback.drop_false_positives(feedback.score_fp(finding(spark, confidence=0.5), threshold=0.95)).count() == 1
    assert feedback.drop_false_positives(scored, enabled=False).count() == 1


def test_features(spark):
    r = feedback.with_features(finding(spark, scanner="fusion(a,b)", severity="odd", context_before="b", cwe_id="89")).first()
    assert (r.f_severity, r.f_scanner, r.f_has_before, r.f_has_after, r.f_cwe, r.f_span) == (2.0, 3.0, 1.0, 0.0, 0.0, 2.0)


def test_training(spark, tmp_path):
    few = spark.createDataFrame([(i, "HIGH", "c", "m", "semgrep", 1) for i in range(49)], "finding_id int, severity string, code_snippet string, message string, scanner string, is_true_positive int")
    model, report = feedback.train_fp(few)
    assert model is None and report.first().status == "insufficient_data" and report.first().samples == 49
    rows = [(i, "INFO" if i % 3 == 0 else "HIGH", "c" * (5 if i % 3 == 0 else 50), "m", "semgrep", 0 if i % 3 == 0 else 1) for i in range(120)]
    many = spark.createDataFrame(rows, few.schema)
    model, report = feedback.train_fp(many, trees=10)
    r = report.first()
    assert r.status == "trained" and r.samples == 120 and r.accuracy > 0.9
    feedback.save_model(model, str(tmp_path / "m"))
    scored = feedback.score_fp(many.withColumns({c: F.lit(v) for c, v in feedback.UNRECORDED.items()}), feedback.load_model(str(tmp_path / "m")))
    assert scored.filter("severity = 'INFO' AND fp_confidence < 0.5").count() == 0


def test_feedback_updates(spark):
    stored = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "finding_id string, is_true_positive int")
    upd = spark.createDataFrame([("b", 0, 1), ("b", 1, 2), ("z", 1, 1)], "finding_id string, is_true_positive int, at int")
    got = {r.finding_id: r.is_true_positive for r in feedback.apply_feedback(stored, upd, order="at").collect()}
    assert got == {"a": 1, "b": 1, "c": 0}


def test_repair_and_chain(spark):
    rows = [(1, 1, False, "p1"), (1, 2, True, "p2"), (1, 3, True, "p3"), (2, 1, False, "q1"), (2, 3, False, "q3"), (3, 1, False, "")]
    got = {r.finding_id: (r.success, r.total_attempts, r.final_patch, r.agent_reasoning) for r in
           repair.repair_rollup(spark.createDataFrame(rows, "finding_id int, attempt_num int, validation_passed boolean, patch string"), strategy=F.lit("s")).collect()}
    assert got[1] == (True, 2, "p2", "Fixed in 2 attempt(s). Strategy: s") and got[2][:3] == (False, 3, "q3") and got[3][3] == ""
    assert repair.provider_chain("openai", ["openai", "deepseek"]) == ["openai", "deepseek", "ollama"]
    assert repair.provider_chain("anthropic", ["openai"]) == ["openai", "ollama"]


def test_completion_failures_become_fallbacks(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, prompt string")

    def client(texts):
        if "q" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    for options in ({}, {"concurrency": 2}, {"batch": 1}):
        answers = plugins.completion_stage(df.coalesce(1), client, **options)
        paired = enrich.pair_by_finding(df, answers, key="id", answer="response", into="ai", fallback="none")
        assert {r.id: r.ai for r in paired.collect()} == {"a": "P", "b": "none"}  # one failure costs one answer


def test_last_answer_stands(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    answers = spark.createDataFrame([("a", 1, "z"), ("a", 2, "m")], "id string, turn int, text string")
    out = enrich.pair_by_finding(df, answers, key="id", answer="text", into="ai", order="turn", fallback="none")
    assert {r.id: r.ai for r in out.collect()} == {"a": "m", "b": "none"}


def test_verdicts_of_repeated_ids(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    verdicts = spark.createDataFrame([("a", True, "ok"), ("a", False, "bad"), ("c", True, "ok")], "id string, is_valid boolean, check_message string")
    out = repair.attach_verdicts(df, verdicts).collect()
    assert sorted((r.id, r.patch_validated, r.patch_validation_result) for r in out) == [("a", False, "bad"), ("a", False, "bad"), ("b", False, "")]


def test_chain_position(spark):
    df = spark.createDataFrame([("openai",), ("ollama",), ("none",)], "p string")
    assert [r.c for r in df.select(repair.chain_position(F.col("p"), ["openai", "ollama"]).alias("c")).collect()] == [0, 1, None]


def test_statistics_read_their_input_once(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.createDataFrame([(1, "HIGH", "s", "CWE-1", True), (1, "LOW", "t", "", False), (2, None, "s", None, None)],
                          "scan_id int, severity string, scanner string, cwe_id string, patch_validated boolean").write.parquet(path)
    df = spark.read.parquet(path)
    out = {r.scan_id: r for r in stats.scan_statistics(df).collect()}
    assert (out[1].total_findings, out[1].high_count, out[1].validated_patches, out[1].scanner_distribution, out[1].top_cwes) == (2, 1, 1, "s=1,t=1", "CWE-1=1")
    assert (out[2].total_findings, out[2].top_cwes) == (1, "")
    for one in (stats.scan_statistics(df), stats.scan_counts(df)):
        assert one._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_statistics_send_each_cell_once(spark):
    """One exchange counts the cube and one gathers it; the rows of the cube are not multiplied by the columns they are counted by."""
    rows = [(1, s, n, c, True) for s, n, c in [("HIGH", "b", "CWE-2"), ("HIGH", "a", "CWE-2"), ("LOW", "b", "CWE-1"), ("LOW", None, "CWE-1"), ("INFO", "b", ""), (None, "a", "CWE-9")]]
    rows += [(1, "LOW", "c", f"CWE-{i}", None) for i in range(20, 30)]
    df = spark.createDataFrame(rows, "scan_id int, severity string, scanner string, cwe_id string, patch_validated boolean")
    for one in (stats.scan_statistics(df), stats.scan_counts(df)):
        plan = one._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and "Generate" not in plan and plan.count("Aggregate(") <= 4
    r = stats.scan_statistics(df).first()
    assert (r.total_findings, r.high_count, r.low_count, r.info_count, r.validated_patches) == (16, 2, 12, 1, 6)
    assert r.scanner_distribution == "a=2,b=3,c=10"
    assert r.top_cwes == "CWE-1=2,CWE-2=2," + ",".join(f"CWE-{i}=1" for i in range(20, 28))
    assert stats.scan_counts(df).first().scanner_results == '{"a":2,"b":3,"c":10}'
    none = stats.scan_statistics(df.filter("scan_id = 0"), by=()).collect()
    assert [(x.total_findings, x.top_cwes) for x in none] == [(0, "")]


def test_labels_keep_their_rows(spark):
    labels = spark.createDataFrame([("a", 1, "LOW", "x", "m", "s"), ("gone", 0, "LOW", "x", "m", "s")],
                                   "finding_id string, is_true_positive int, severity string, code_snippet string, message string, scanner string")
    full = spark.createDataFrame([("a", 0.9, "", "", "CWE-1", "r", 1, 3), ("a", 0.8, "", "", "CWE-2", "r", 1, 2)],
                                 "id string, confidence double, context_before string, context_after string, cwe_id string, rule_name string, line_start int, line_end int")
    rows = {r.finding_id: r for r in feedback.training_rows(labels, full).collect()}
    assert set(rows) == {"a", "gone"} and rows["a"].confidence == 0.8 and rows["gone"].confidence == 0.7


def test_incremental(spark):
    s = "path string, content string"
    base = incremental.manifest(spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1")], s))
    head = incremental.manifest(spark.createDataFrame([("a", "1"), ("b", "2"), ("new", "1")], s))
    staged = spark.createDataFrame([("a",), ("b",), ("absent",)], "path string")
    assert sorted(r.path for r in incremental.changed_files(base, head).collect()) == ["b", "new"]
    assert sorted(r.path for r in incremental.changed_files(base, head, staged).collect()) == ["a", "b", "new"]
    r = incremental.changed_stats(base, head).first()
    assert (r.files_changed, r.added, r.modified, r.deleted) == (2, 1, 1, 1)
    assert incremental.changed_stats(base, head, staged=staged).first().files_changed == 3
    assert incremental.changed_files(base, base).count() == 0


def test_views(spark):
    rows = [("CRITICAL", "a", False), ("LOW", "a", False), ("HIGH", "b", True)]
    df = spark.createDataFrame(rows, "severity string, scanner string, is_false_positive boolean")
    assert filters.view(df).count() == 1 and filters.view(df, show_fp=True).count() == 2
    assert filters.view(df, severities=[], show_fp=True).count() == 3 and filters.view(df, severities=[], scanners=["b"], show_fp=True).count() == 1


# ---------------------------------------------------------------- history and reports

SCANS = "scan_id long, target string, scan_ts timestamp, total_findings long, critical_count long, high_count long, validated_patches long"


def scans(spark, totals):
    rows = [(i, "t", f"2024-01-{i + 1:02d} 00:00:00", n, 1, 2, 1) for i, n in enumerate(totals)]
    df = spark.createDataFrame(rows, SCANS.replace("scan_ts timestamp", "scan_ts string"))
    return df.withColumn("scan_ts", F.col("scan_ts").cast("timestamp"))


@pytest.mark.parametrize("totals,word", [([10, 7], "improving"), ([10, 8], "stable"), ([10, 12], "stable"), ([10, 13], "worsening"), ([0, 1], "worsening"), ([0, 0], "stable"), ([], "no_data")])
def test_trend(spark, totals, word):
    r = trends.trend_summary(scans(spark, totals), "2024-01-10", 30).first()
    assert r.trend_direction == word and r.scans == len(totals)
    assert trends.trend_summary(scans(spark, totals), "2025-01-10", 30).first().trend_direction == "no_data"


def test_scan_numbers(spark):
    got = [r.seq for r in trends.scan_sequence(scans(spark, [1, 2, 3, 4])).orderBy("scan_ts").collect()]
    assert got == [1, 2, 3, 4]


FINDINGS = ("scan_id long, id string, severity string, scanner string, cwe_id string, rule_id string, rule_name string, message string, file_path string, line_start int, line_end int, "
            "column_start int, column_end int, code_snippet string, confidence double, ai_analysis string, ai_patch string, patch_validated boolean")


def found(spark, n=3):
    rows = [(1, f"id{i}", "CRITICAL" if i else "INFO", "s", "CWE-1" if i else "", "" if i == 0 else f"r{i}", "name", 'say "hi"\n', "a/b.py", i, i, 0, 0, "c", 0.5, "x" * 600, "p" if i else "", i == 2)
            for i in range(n)]
    return spark.createDataFrame(rows + rows[-1:], FINDINGS)  # one exact copy


def heads(spark):
    return spark.createDataFrame([(1, "t", "2024-01-01T00:00:00", 1.25, '{"total_findings": 4}'), (2, "u", "2024-01-02T00:00:00", 0.5, "{}")],
                                 "scan_id long, target_path string, scan_timestamp string, duration_seconds double, statistics string")


def document(pieces, scan_id):
    rows = pieces.filter(F.col("scan_id") == scan_id).orderBy("part", "ord").collect()
    return "".join(r.text for r in rows)


def test_json_document(spark):
    pieces = reports.report(found(spark), heads(spark), "json")
    doc = json.loads(document(pieces, 1))
    assert doc["target_path"] == "t" and doc["duration_seconds"] == 1.25 and doc["statistics"] == {"total_findings": 4}
    assert [f["id"] for f in doc["findings"]] == ["id0", "id1", "id2", "id2"] and doc["findings"][0]["message"] == 'say "hi"\n'
    assert json.loads(document(pieces, 2))["findings"] == []


def test_counts_of_scans_do_not_ask_for_weaknesses(spark):
    counts = stats.scan_counts(found(spark))
    grouped = [x for x in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(keys" in x]
    assert grouped and not any("cwe_id" in x for x in grouped)
    assert counts.first()["scanner_results"] == '{"s":4}' and counts.first()["total_findings"] == 4
    assert stats.scan_statistics(found(spark)).first()["top_cwes"] == "CWE-1=3"


def test_items_meet_without_their_texts(spark):
    plan = reports.report_json(found(spark), heads(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "any_value" not in plan and "Window" in plan  # texts are neither sorted before the shuffle nor sent


@pytest.mark.parametrize("n, scan_rows", [(1, 1), (1, 2), (3, 1), (3, 3), (3, 4)])
def test_large_scans_give_the_same_items(spark, monkeypatch, n, scan_rows):
    rows = found(spark, n).unionByName(found(spark, 2).withColumn("scan_id", F.lit(None).cast("long"))).unionByName(found(spark, 1).withColumn("scan_id", F.lit(2).cast("long")).limit(1))
    texts = lambda: sorted((str(r.scan_id), r.text) for r in reports.report_json(rows, heads(spark)).filter(F.col("part") == reports.ITEM).collect())
    want = texts()
    monkeypatch.setattr(reports, "SCAN_ROWS", scan_rows)
    assert texts() == want and sum(not t.startswith(", ") for _, t in want) == 3
    ids = [f["id"] for f in json.loads(document(reports.report_json(rows, heads(spark)), 1))["findings"]]
    assert ids == sorted(f"id{i}" for i in [*range(n), n - 1])


def test_sarif_document(spark):
    doc = json.loads(document(reports.report(found(spark), heads(spark), "SARIF"), 1))
    results = doc["runs"][0]["results"]
    assert doc["version"] == "2.1.0" and [r["level"] for r in results] == ["note", "critical", "critical", "critical"]
    assert results[0]["ruleId"] == "name" and results[1]["ruleId"] == "r1" and results[1]["properties"]["patchValidated"] is False
    standard = json.loads(document(reports.report_sarif(found(spark), heads(spark), levels="standard"), 1))
    assert [r["level"] for r in standard["runs"][0]["results"]] == ["note", "error", "error", "error"]


def test_markdown_document(spark):
    by_scan = stats.scan_statistics(found(spark)).join(heads(spark), "scan_id")
    text = document(reports.report_markdown(found(spark), by_scan), 1)
    assert "| **Duration** | 1.3s |" in text or "| **Duration** | 1.2s |" in text
    assert "| 🔴 CRITICAL | 3 |" in text and "**AI Analysis**: " + "x" * 500 + "..." in text and "- **CWE**: N/A" in text


def test_dispatch(spark):
    with pytest.raises(ValueError):
        reports.report(found(spark), heads(spark), "pdf")
    assert [reports.format_for(p) for p in ("a.html", "b.md", "c.sarif", "d.xyz", "dir.x/e")] == ["html", "markdown", "sarif", "json", "json"]


def test_written_report(spark, tmp_path):
    reports.write_report(reports.report_markdown(found(spark), stats.scan_statistics(found(spark)).join(heads(spark), "scan_id")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "scan_id=1").is_dir()


def test_history_tables(spark, tmp_path):
    root = str(tmp_path)
    h = heads(spark).withColumn("scan_timestamp", F.col("scan_timestamp").cast("timestamp")).drop("statistics")
    history.record_scan(found(spark), h, root)
    got = {r.scan_id: r for r in history.read_history(spark, root, "scans").collect()}
    assert (got[1].total_findings, got[1].critical_count, got[1].info_count, got[1].validated_patches, got[1].scanner_results) == (4, 3, 1, 2, '{"s":4}')
    assert (got[2].total_findings, got[2].scanner_results) == (0, "{}")
    rows = history.read_history(spark, root, "findings")
    assert sorted((r.patch_generated, r.patch_validated) for r in rows.collect()) == [(0, 0), (1, 0), (1, 1), (1, 1)]
    assert history.orphans(rows, history.read_history(spark, root, "scans").filter("scan_id = 2")).count() == 4
    top = trends.top_cwe(rows).collect()
    assert [(r.cwe_id, r["count"], r.severity) for r in top] == [("CWE-1", 3, "CRITICAL")]
    assert trends.top_cwe(rows.limit(0)).collect() == []
    history.record_feedback(found(spark), F.lit(True), root)
    assert feedback.feedback_stats(history.read_history(spark, root, "feedback")).first().true_positives == 4
    assert spark.range(1).select(history.scan_key(F.lit("t"), F.lit("now")).alias("k")).first().k > 0


def test_history_replays_broken_runs_and_compaction(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    h = heads(spark).withColumn("scan_timestamp", F.col("scan_timestamp").cast("timestamp")).drop("statistics")
    n = lambda table: history.read_history(spark, root, table).count()
    with pytest.raises(ValueError):
        n("scans")
    for run in ("a", "b", "c", "a"):
        history.record_scan(found(spark), h, root, run=run)
    assert (n("scans"), n("findings")) == (6, 12)

    scan_rows = history.finding_rows
    monkeypatch.setattr(history, "finding_rows", lambda f: scan_rows(f).withColumn("severity", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        history.record_scan(found(spark), h, root, run="b")  # scans are written, findings break off
    monkeypatch.undo()
    assert (n("scans"), n("findings")) == (6, 12)

    before = sorted(history.read_history(spark, root, "findings").drop("folder").collect(), key=str)
    assert history.compact_history(spark, root, below=100) == 3
    assert sorted(history.read_history(spark, root, "findings").drop("folder").collect(), key=str) == before
    assert history.compact_history(spark, root, below=100) == 0
    assert history.read_history(spark, root, "scans").select("folder").distinct().count() == 1

    history.record_scan(found(spark).limit(0), h.filter("scan_id = 1"), root, run="b")  # replaces one run of the compacted folder
    assert (n("scans"), n("findings")) == (5, 8)
    assert [r.total_findings for r in history.read_history(spark, root, "scans").filter("run = 'b'").collect()] == [0]
    assert history.compact_history(spark, root, below=100) == 2
    assert (n("scans"), n("findings")) == (5, 8)

    for _ in range(2):
        history.record_feedback(found(spark), F.lit(True), root, run="labels")
    assert n("feedback") == 4


def test_history_splits_a_busy_month_by_size(spark, tmp_path):
    root = str(tmp_path)
    many = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 50 == 0, 2 + F.col("id") % 9).otherwise(1).alias("scan_id"),
        *[F.sha2(F.concat(F.lit(c), F.col("id").cast("string")), 256).alias(c) for c in ("rule_name", "severity", "cwe_id", "file_path", "ai_patch")], F.lit(True).alias("patch_validated"), F.lit("s").alias("scanner"))
    scans = spark.range(1, 11).select(F.col("id").alias("scan_id"), F.lit("t").alias("target_path"), F.lit(1.0).alias("duration_seconds"),
                                      F.make_timestamp(F.lit(2024), F.col("id").cast("int"), F.lit(3), F.lit(0), F.lit(0), F.lit(0)).alias("scan_timestamp"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        history.record_scan(many, scans, root, run="one")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {}
    for f in (tmp_path / "findings").rglob("*.parquet"):
        files.setdefault(f.parent.name, []).append(f)
    assert len(files["scan_month=2024-01"]) > 3
    assert len(files) == 10
    assert history.read_history(spark, root, "findings").count() == 60000
    assert history.read_history(spark, root, "findings", "2024-02-01").count() == 1200 - many.filter("scan_id = 1 and id % 50 = 0").count()


def test_statistics(spark):
    r = stats.scan_statistics(found(spark), raw=found(spark)).first()
    assert (r.total_findings, r.critical_count, r.info_count, r.validated_patches, r.patch_success_rate) == (4, 3, 1, 2, 0.5)
    assert (r.scanner_distribution, r.top_cwes, r.raw_scanner_results) == ("s=4", "CWE-1=3", "s=4")
    g = stats.gate(found(spark)).first()
    assert g.critical_high == 3 and g.fails and not stats.gate(found(spark), fail_on_high=False).first().fails


def test_scalars(spark):
    assert one(spark, scalar.markdown_to_html(F.col("t")), t="## A\n### B\n**b** `c`") == "<h2>A</h2><br><h3>B</h3><br><strong>b</strong> <code>c</code>"
    assert one(spark, scalar.finding_id(F.col("p"), F.col("n"), F.col("r"), F.col("s")), p="a.py", n=10, r="r", s="x") == __import__("hashlib").sha256(b"a.py:10:r:x").hexdigest()[:16]
    assert one(spark, scalar.detect_language(F.col("p")), p="x/y.RS") == "Rust"
    assert one(spark, scalar.percent(F.col("c")), c=0.285) in ("28%", "29%")
    assert one(spark, collapse_spaces(F.col("t")), t=" A\t\n b  C ") == "a b c"
    assert one(spark, ratio_bound(F.col("a"), F.col("b")), a="ab", b="abcd") == pytest.approx(2 / 3)


def test_similarity_keeps_library_defaults(spark):
    a, b = "foo(bar) " * 29, "foo(baz) " * 29
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (a, b)], "a string, b string").select("a", text_similarity("a", "b").alias("r"))
    got = {r.a: r.r for r in df.collect()}
    assert got["tide"] == 0.25 and got["diet"] == 0.5 and got[a] < 0.1
