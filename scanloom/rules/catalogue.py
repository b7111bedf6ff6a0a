"""Configuration rules: the catalogue as data, and its compilation to column expressions.

Patterns are literals in the plan, so each is compiled once per task, not per row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.scalar import last_part, rule_family_of, rule_name_of


class Rule(NamedTuple):
    id: str
    pattern: str | None  # searched in every line, ignoring case
    absent: str | None   # or: the name of a file-level absence test
    message: str
    severity: str
    cwe: str


# The 24 configuration rules.
RULES = [
    Rule("docker.root_user", r"^USER\s+root\s*$", None,
         "Container runs as root user. Use a non-root USER instruction.", "HIGH", "CWE-250"),
    Rule("docker.no_user", None, "user_instruction",
         "No USER instruction found. Container will run as root by default.", "HIGH", "CWE-250"),
    Rule("docker.apt_no_clean", r"apt-get install(?!.*&&.*rm -rf /var/lib/apt)", None,
         "apt-get install without cleanup increases image size and attack surface.", "LOW", "CWE-1051"),
    Rule("docker.latest_tag", r"^FROM\s+\S+:latest", None,
         "Using :latest tag is non-deterministic and can introduce vulnerabilities.", "MEDIUM", "CWE-1104"),
    Rule("docker.exposed_secret", r"^(?:ENV|ARG)\s+\S*(?:PASSWORD|SECRET|KEY|TOKEN|CREDENTIAL)\s*=\s*\S+", None,
         "Secret/credential exposed as Docker ENV or ARG.", "CRITICAL", "CWE-798"),
    Rule("docker.curl_bash_pipe", r"curl\s+.*\|\s*(?:bash|sh)", None,
         "Pipe curl output directly into bash is a supply chain risk.", "HIGH", "CWE-829"),
    Rule("docker.privileged_port", r"^EXPOSE\s+([1-9]\d{0,3})\b", None,
         "Exposing privileged port (<1024) in container.", "LOW", "CWE-272"),
    Rule("k8s.privileged_container", r"privileged:\s*true", None,
         "Container is running in privileged mode. This grants host-level access.", "CRITICAL", "CWE-250"),
    Rule("k8s.allow_privilege_escalation", r"allowPrivilegeEscalation:\s*true", None,
         "Privilege escalation is allowed. Set to false.", "HIGH", "CWE-269"),
    Rule("k8s.run_as_root", r"runAsNonRoot:\s*false|runAsUser:\s*0\b", None,
         "Container configured to run as root user.", "HIGH", "CWE-250"),
    Rule("k8s.host_network", r"hostNetwork:\s*true", None,
         "Container uses host network namespace. Exposes all host ports.", "HIGH", "CWE-250"),
    Rule("k8s.host_pid", r"hostPID:\s*true", None,
         "Container shares host PID namespace.", "HIGH", "CWE-250"),
    Rule("k8s.no_resource_limits", None, "resources_block",
         "No resource limits defined. Container can exhaust host resources (DoS).", "MEDIUM", "CWE-400"),
    Rule("k8s.default_service_account", r"automountServiceAccountToken:\s*true", None,
         "Service account token auto-mounted. Reduce by setting to false if not needed.", "MEDIUM", "CWE-272"),
    Rule("tf.s3_public_acl", r'acl\s*=\s*"public-read|public-read-write"', None,
         "S3 bucket has public ACL. Data exposure risk.", "CRITICAL", "CWE-284"),
    Rule("tf.sg_open_ingress", r'cidr_blocks\s*=\s*\["0\.0\.0\.0/0"\]', None,
         "Security group allows ingress from all IPs (0.0.0.0/0).", "HIGH", "CWE-284"),
    Rule("tf.rds_public", r"publicly_accessible\s*=\s*true", None,
         "RDS instance is publicly accessible from the internet.", "CRITICAL", "CWE-668"),
    Rule("tf.unencrypted_storage", r"encrypted\s*=\s*false", None,
         "Storage resource with encryption disabled.", "HIGH", "CWE-311"),
    Rule("nginx.server_tokens", r"server_tokens\s+on", None,
         "server_tokens is on. Disable to hide nginx version.", "LOW", "CWE-200"),
    Rule("nginx.clickjacking", None, "frame_header",
         "Missing X-Frame-Options header. Clickjacking risk.", "MEDIUM", "CWE-1021"),
    Rule("nginx.ssl_weak_protocols", r"ssl_protocols.*(?:SSLv2|SSLv3|TLSv1\b|TLSv1\.1)", None,
         "Weak SSL/TLS protocols enabled (SSLv2/3, TLS 1.0/1.1).", "HIGH", "CWE-326"),
    Rule("gha.dangerous_pull_request_target", r"pull_request_target", None,
         "pull_request_target can allow attackers to run code with repo write permissions.", "HIGH", "CWE-78"),
    Rule("gha.secret_in_run", r"\$\{\{\s*(?:secrets|github\.token)\s*\}\}.*run:", None,
         "Secret directly passed to run command. Use env: block instead.", "HIGH", "CWE-532"),
    Rule("gha.third_party_unpinned", r"uses:\s+[^/]+/[^@]+@(?:main|master|latest)", None,
         "Third-party action pinned to mutable branch/tag. Pin to a commit SHA.", "MEDIUM", "CWE-829"),
]
CONFIG_CONFIDENCE = 0.9
CONFIG_OWASP = "A05:2021 – Security Misconfiguration"

# Optional stricter form of the TLS rule: versions 1.2 and 1.3 do not fire.
STRICT_TLS = r"ssl_protocols.*(?:SSLv2|SSLv3|TLSv1(?:\.1)?(?![.\d]))"

# Matching is Unicode-aware and ignores case.
FLAGS = "(?iU)"


def family_of(rule: Rule) -> str:
    return rule.id.split(".", 1)[0]


def families(rules: list[Rule]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(family_of(r), []).append(r)
    return out


def strict_tls(rules: list[Rule]) -> list[Rule]:
    return [r._replace(pattern=STRICT_TLS) if r.id == "nginx.ssl_weak_protocols" else r for r in rules]


def rules_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """The catalogue as a small dimension table."""
    df = spark.createDataFrame(
        [(r.id, r.pattern or "", r.absent or "", r.message, r.severity, r.cwe) for r in rules],
        "rule_id string, pattern string, absent string, message string, severity string, cwe_id string")
    return df.withColumns({"family": rule_family_of(F.col("rule_id")), "rule_name": rule_name_of(F.col("rule_id"))})


# What the absence tests look for, as patterns that some line must match.
ABSENT_PATTERNS = {"user_instruction": r"^USER\s+(?!root)", "resources_block": r"resources:", "frame_header": r"X-Frame-Options|x-frame-options"}


def pattern_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """The catalogue as a rule table: ``rule_id, family, pattern, absent, message, severity, cwe_id``."""
    return spark.createDataFrame(
        [(r.id, family_of(r), r.pattern or ABSENT_PATTERNS[r.absent], r.pattern is None, r.message, r.severity, r.cwe) for r in rules],
        "rule_id string, family string, pattern string, absent boolean, message string, severity string, cwe_id string")


def route_file(path: Column, content: Column) -> Column:
    """Rule family of a file by name, suffix and the head of the text; null for none.

    YAML is told apart by its first 200 characters, which is the rule itself, not a shortcut.
    """
    name = last_part(path, "/")
    yaml = name.rlike(r"[^.].*\.ya?ml$")
    actions = path.contains(".github/workflows") | F.substring(content, 1, 200).contains("uses:")
    return (F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "docker")
            .when(name.endswith(".tf"), "tf")
            .when(yaml, F.when(actions, "gha").otherwise("k8s"))
            .when(name.isin("nginx.conf", "default.conf") | path.contains(".nginx"), "nginx"))


def line_rules(family: Column, line: Column, rules: list[Rule]) -> Column:
    """Array of the ids of the pattern rules of ``family`` that hit ``line``.

    One CASE branch per family: a line only meets the patterns of its own family.
    """
    expr = F
    for fam, members in families(rules).items():
        hits = [F.when(line.rlike(FLAGS + r.pattern), F.lit(r.id)) for r in members if r.pattern]
        if hits:
            expr = expr.when(family == fam, F.array_compact(F.array(*hits)))
    return expr.otherwise(F.array().cast("array<string>")) if expr is not F else F.array().cast("array<string>")


def absent_tests(content: Column, lines: Column) -> dict[str, Column]:
    """File-level tests: true when what the file should contain is missing."""
    return {
        "user_instruction": ~F.exists(lines, lambda ln: ln.rlike(r"(?U)^USER\s+(?!root)")),
        "resources_block": ~content.contains("resources:"),
        "frame_header": ~(content.contains("X-Frame-Options") | content.contains("x-frame-options")),
    }


def file_rules(family: Column, content: Column, lines: Column, rules: list[Rule]) -> Column:
    """Array of the ids of the absence rules of ``family`` that hit the file."""
    tests = absent_tests(content, lines)
    hits = [F.when((family == family_of(r)) & tests[r.absent], F.lit(r.id)) for r in rules if r.absent]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def rule_attributes(rule_id: Column, rules: list[Rule]) -> dict[str, Column]:
    """Message, severity and CWE of a rule id, as constant map lookups (no join)."""
    def table(field: str) -> Column:
        return F.create_map(*[F.lit(x) for r in rules for x in (r.id, getattr(r, field))])[rule_id]
    return {"message": table("message"), "severity": table("severity"), "cwe_id": table("cwe")}
