"""Files to statistics in one go, and the public names."""

import scanloom
from pyspark.sql import functions as F

from scanloom.operators.stats import scan_statistics
from scanloom.plans.full_scan import explain_and_patch, finish, full_scan, scan_and_fuse
from test_scanners import CLEAN, DOCKERFILE, POD, SAFE, VULNERABLE


def test_public_names_resolve():
    assert all(callable(getattr(scanloom, n)) for n in scanloom.__all__)


def test_scan_to_statistics(spark):
    files = spark.createDataFrame([("a/Dockerfile", DOCKERFILE), ("b/Dockerfile", CLEAN), ("pod.yaml", POD), ("v.py", VULNERABLE), ("s.py", SAFE)], "path string, content string")
    fused = scan_and_fuse(files, target="repo").cache()
    assert {r.file_path for r in fused.collect()} == {"a/Dockerfile", "pod.yaml", "v.py"}
    assert all(r.scanner.startswith("fusion(") for r in fused.collect())
    pod = fused.filter("file_path = 'pod.yaml'").orderBy("line_start").first()
    assert pod.line_start == 1 and pod.context_before == "" and pod.context_after.startswith("kind: Pod\n")
    kept = finish(fused)
    assert kept.filter(F.col("patch_validated")).count() == 0
    s = scan_statistics(kept, by=("target",)).first()
    assert s.total_findings == kept.count() > 0 and s.critical_count >= 1
    native = scan_and_fuse(files, target="repo", mode="location_cwe")
    assert native.count() >= fused.count()


def test_parsed_answers(spark):
    df = spark.createDataFrame([("m", "```\nx = 1\n```")], "message string, response string")
    r = scanloom.parse_responses(df).first()
    assert (r.patch, r.code, r.plan.root_cause) == ("x = 1", "x = 1", "m")


def test_explanations_and_patches(spark):
    """Equal prompts are asked once; a failing client leaves the fixed explanation and no patch."""
    base = ("f.py", 3, "HIGH", "sqli", "CWE-89", "A03", "SQL here", 0.9, "q(x)", "before", "", 4, "")
    names = "file_path string, line_start int, severity string, rule_name string, cwe_id string, owasp_category string, message string, confidence double, code_snippet string, context_before string, context_after string, line_end int, ai_patch string"
    df = spark.createDataFrame([base, base, ("g.py", *base[1:])], names)
    asked = spark.sparkContext.accumulator(0)

    def client(prompts):
        asked.add(len(prompts))
        return ["why" if "explain" in p.lower()[:400] else "```python\nsafe(x)\n```" for p in prompts]
    rows = explain_and_patch(df, client).collect()
    assert asked.value == 4 and len(rows) == 3
    assert all(r.ai_analysis and (r.ai_patch == "safe(x)" or r.ai_patch == "why") for r in rows)

    def broken(prompts):
        raise OSError("no model")
    rows = explain_and_patch(df, broken).collect()
    assert len(rows) == 3 and all(r.ai_patch == "" and "Recommended Action" in r.ai_analysis for r in rows)
    assert explain_and_patch(df.limit(0), client).count() == 0


def test_full_scan_with_and_without_a_client(spark):
    files = spark.createDataFrame([("a/Dockerfile", DOCKERFILE), ("v.py", VULNERABLE)], "path string, content string")
    plain = full_scan(files, target="repo")
    done = full_scan(files, target="repo", complete=lambda prompts: ["```\nx = 1\n```" for _ in prompts])
    assert plain.count() == done.count() > 0
    assert {r.ai_patch for r in done.collect()} == {"x = 1"} and done.filter("file_path = 'v.py' AND patch_validated").count() > 0
