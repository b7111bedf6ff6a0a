"""Rules as a table: literals must never hide a match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scanloom.operators import scan
from scanloom.operators.scan import scan_rule_table, scan_rules, secret_candidates, scan_secrets
from scanloom.rules import literals as lit
from scanloom.rules import secrets as sec
from scanloom.rules.catalogue import RULES, pattern_table
from scanloom.sources.files import source_lines

RULE = "rule_id string, family string, pattern string, absent boolean, message string, severity string, cwe_id string"


def rules(spark, *rows):
    return spark.createDataFrame([(i, f, p, a, "m", "LOW", "") for i, f, p, a in rows], RULE)


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


@pytest.mark.parametrize("pattern,want", [
    (r"privileged:\s*true", {"privileged:"}), (r"runAsNonRoot:\s*false|runAsUser:\s*0\b", {"runas"}),
    (r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", {"kia", "sia"}), (r"(?:abc)?x+", {"x"}), (r"(?:abc)*", None), (r"[ab]\d", {"a", "b"}), (r"\d+", None), (r"(?!secret)\w", None),
    (r"a|", None), (r"\p{L}foo", None), (r"curl\s+.*\|\s*(?:bash|sh)", {"curl"}), (r"[^a]bcd", {"bcd"})])
def test_required_literals(pattern, want):
    found = lit.required_literals(pattern)
    assert found == (None if want is None else frozenset(want))


@pytest.mark.parametrize("automaton", [True, False])
def test_no_match_without_its_literal(automaton, monkeypatch):
    if not automaton:
        monkeypatch.setattr(lit, "ahocorasick", None)
    patterns = [r.pattern for r in RULES if r.pattern] + [r.pattern for r in [*sec.SECRET_RULES, sec.ENTROPY_RULE]] + [r"\d{3}", r"(?:x|y)z?q"]
    rng = random.Random(1)
    bits = ["USER root", "ENV A_KEY = v", "curl x | SH", "privileged: True", "AKIA" + "A" * 16, "token: '" + "a" * 20 + "'", "ſecret: \"" + "b" * 20 + '"', "123", "xq", " ", "\n", "\r\n", " ", "é漢", "EXPOSE 80"]
    text = "".join(rng.choice(bits) for _ in range(400))
    found = {(n, line, p) for n, line, p in lit.LineMatcher(patterns).candidates(text)}
    lines = re.split(lit.LINE_BREAK, text)
    lines = lines[:-1] if lines[-1] == "" else lines
    for n, line in enumerate(lines, 1):
        for p, pattern in enumerate(patterns):
            if re.search(pattern, line, re.I):
                assert (n, line, p) in found
    assert len(found) < 0.3 * len(lines) * len(patterns)


def test_folding_keeps_lengths_and_meets_all_cases():
    text = "İıſKßΣς漢A"
    assert len(lit.fold(text)) == len(text) and lit.fold("SKſK") == "sksk" and lit.fold("İı") == "ii"
    assert lit.fold("AbC") == "abc"


def test_catalogue_as_a_table_equals_the_compiled_one(spark):
    texts = ["FROM a:latest\nUSER root\nENV API_TOKEN=1\nRUN curl http://x | bash", "USER app\r\nEXPOSE 80", "", "USER root"]
    df = files(spark, *[(f"d{i}/Dockerfile", t) for i, t in enumerate(texts)], ("p/pod.yaml", "privileged: true\nhostPID: true"), ("n/nginx.conf", "server_tokens on;\nx-frame-options"),
               ("m/main.tf", 'acl = "public-read"'), (".github/workflows/c.yml", "uses: a/b@main"), ("x.txt", "privileged: true"), ("q/nginx.conf", None))
    columns = ["rule_id", "file_path", "line_start", "message", "severity", "cwe_id", "code_snippet", "config_type", "confidence"]
    key = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    df = df.filter("content IS NOT NULL")
    assert key(scan_rule_table(df, pattern_table(spark))) == key(scan_rules(df)) != []


@pytest.mark.parametrize("a_pass", [20_000, 7])
def test_many_rules_in_several_passes(spark, monkeypatch, a_pass):
    monkeypatch.setattr(scan, "RULES_A_PASS", a_pass)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    table = [(f"w.{i}", rng.choice([None, "docker", "tf"]), rng.choice([r"\b{}\b", r"{}\d*", r"^\s*{}", r"(?:{}|zz)"]).format(w), False) for i, w in enumerate(words)]
    table += [("w.any", None, r"^\d+$", False), ("w.none", "tf", "MUST", True), ("w.all", None, "Never", True)]
    texts = [("\n".join(" ".join(rng.choice(words + ["12", "ZZ", "MUST"]) for _ in range(4)) for _ in range(12))) for _ in range(9)]
    rows = [(f"{i}/" + ["Dockerfile", "main.tf", "x.txt"][i % 3], t) for i, t in enumerate(texts)] + [("e/main.tf", ""), ("nothing", None)]
    want = []
    for path, text in rows:
        fam = {"Dockerfile": "docker", "main.tf": "tf"}.get(path.split("/")[-1])
        if text is None:
            continue
        for i, f, p, absent in table:
            if f is None or f == fam:
                hit = [(i, path, n) for n, line in enumerate(text.split("\n"), 1) if re.search(p, line, 0 if absent else re.I)]
                want += ([] if hit else [(i, path, 1)]) if absent else hit
    got = scan_rule_table(files(spark, *rows), rules(spark, *table)).select("rule_id", "file_path", "line_start")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_rules_no_files(spark):
    assert scan_rule_table(files(spark, ("Dockerfile", "x")), rules(spark)).count() == 0
    assert scan_rule_table(files(spark), pattern_table(spark)).count() == 0


def test_secrets_equal_all_patterns_on_all_lines(spark):
    rng = random.Random(3)
    tail = lambda n: "".join(rng.choice("ABCDEFabcdef0123456789") for _ in range(n))
    lines = ["key AKIA" + "A1" * 8, "ghp_" + tail(40), 'api_key = "' + tail(20) + '"', "DB_PASSWORD=hunter22", "https://u:p@h/x", "'" + tail(40) + "'", "plain", "ſecret = '" + tail(20) + "'", "PASſWORD: '" + tail(17) + "'"]
    df = files(spark, *[(f"f{i}", "\n".join(rng.sample(lines, 5))) for i in range(12)])
    every = secret_candidates(source_lines(df)).filter(~scan.allowed(F.col("value"))).select("path", "line_no", "kind", "value")
    some = scan_secrets(df).select("file_path", "line_start", "rule_name", "value")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect())) != []


def test_texts_are_not_shuffled(spark):
    plan = scan_secrets(files(spark, ("a", "b")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("pattern,want", [
    (r"(?iU)privileged:\s*true", {"privileged:"}), (r"(?iU)(?-U)(?:^|[^\p{Alnum}])needle(?:[^\p{Alnum}]|$)", {"needle"}), (r"\p{L}foo", {"foo"}),
    (r"(?x)a b c", None), (r"x[a&&[b]]cd", None), (r"[a[b]]cd", None), (r"\[a\[bcd", {"[a[bcd"}), (r"(?i)\Qab\E", None), (r"\pLfoo", {"foo"})])
def test_literals_of_patterns_with_flags_and_classes(pattern, want):
    assert lit.java_literals(pattern) == (frozenset(want) if want else None)


def test_every_rule_of_the_catalogue_and_watch_words_meet_few_lines():
    text = "\n".join(["nothing to see here"] * 50 + ["a needle, here"])
    watched = lit.LineMatcher([scan.cat.FLAGS + r"(?-U)(?:^|[^\p{Alnum}])" + w + r"(?:[^\p{Alnum}]|$)" for w in ("needle", "thread", "thimble")])
    assert watched.always == [] and watched.candidates(text) == [(51, "a needle, here", 0)]


def test_many_rules_on_one_line_keep_its_text_once_and_small_pieces_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(scan, "PIECE", 500)
    words = [f"needle{i:03d}" for i in range(60)]
    table = rules(spark, *[(f"r.{w}", None, w, False) for w in words], ("r.gone", None, "needle059", True))
    found = scan_rule_table(files(spark, *[(f"f{k}", "x\n" + " ".join(words[: k + 1])) for k in range(60)], ("none", None)), table).collect()
    assert {(r.file_path, r.rule_id, r.line_start) for r in found} == {(f"f{k}", f"r.{w}", 2) for k in range(60) for w in words[: k + 1]} | {(f"f{k}", "r.gone", 1) for k in range(59)}
    assert len(found) == 60 * 61 // 2 + 59
    lines = scan.pattern_candidates(files(spark, ("a", "x\n" + " ".join(words))), {None: [(w, w) for w in words]}).first().candidates
    assert [(x.line_no, len(x.rules)) for x in lines] == [(2, 60)]
