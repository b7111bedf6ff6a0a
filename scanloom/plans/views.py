"""Test inputs: views over the given tables, one SQL text for both engines.

``{name}`` stands for a given table.  Views whose name starts with ``o_`` exist for the oracle only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "v_findings": """
SELECT l_orderkey AS scan_id,
  'repo' || CAST(l_partkey % 20 AS STRING) AS target,
  CASE l_linenumber % 4 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' WHEN 2 THEN 'secret_scanner' ELSE 'config_audit' END AS scanner,
  CASE CAST(round(l_discount * 100) AS INT) % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  CAST(CASE CAST(round(l_tax * 100) AS INT) % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 ELSE 0.3 END AS DOUBLE) AS confidence,
  CASE l_suppkey % 10 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-78' WHEN 3 THEN 'CWE-22' WHEN 4 THEN 'CWE-798' WHEN 5 THEN 'CWE-502' WHEN 6 THEN 'CWE-327' WHEN 7 THEN 'CWE-611' WHEN 8 THEN 'CWE-918' ELSE '' END AS cwe_id,
  'rule.' || CAST(l_suppkey AS STRING) AS rule_id,
  CASE l_suppkey % 7 WHEN 0 THEN 'eval_usage' WHEN 1 THEN 'exec_call' WHEN 2 THEN 'pickle_load' WHEN 3 THEN 'assert_used' WHEN 4 THEN 'sql_injection' WHEN 5 THEN 'xss_output' ELSE 'weak_hash' END AS rule_name,
  'found ' || p_name || ' with ' || p_type || ' ' || CAST(l_suppkey % 3 AS STRING) AS message,
  'repo' || CAST(l_partkey % 20 AS STRING) || '/src/f' || CAST(l_partkey AS STRING) || CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' ELSE '.tf' END AS file_path,
  CAST(l_quantity AS INT) AS line_start,
  CAST(l_quantity AS INT) + l_linenumber % 3 AS line_end,
  'exec("' || p_name || ' ' || p_type || CASE WHEN l_linestatus = 'O' THEN ' from request' ELSE '' END || '")' AS code_snippet,
  CASE WHEN l_returnflag <> 'N' THEN 'safe(' || p_name || ')' ELSE '' END AS ai_patch,
  (l_returnflag <> 'N' AND l_linestatus = 'F') AS patch_validated
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",

    "v_scans": """
SELECT o_orderkey AS scan_id, 'repo' || CAST(o_custkey % 50 AS STRING) AS target, o_orderdate AS scan_ts,
  COUNT(l_orderkey) AS total_findings,
  SUM(CASE WHEN CAST(round(l_discount * 100) AS INT) % 5 = 4 THEN 1 ELSE 0 END) AS critical_count,
  SUM(CASE WHEN CAST(round(l_discount * 100) AS INT) % 5 = 3 THEN 1 ELSE 0 END) AS high_count,
  SUM(CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS validated_patches,
  o_totalprice / 1000 AS duration_seconds
FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_custkey, o_orderdate, o_totalprice""",

    # Scans without counts: what is known before findings are joined.
    "v_scan_heads": """
SELECT o_orderkey AS scan_id, 'repo' || CAST(o_custkey % 50 AS STRING) AS target_path, o_orderdate AS scan_timestamp,
  o_totalprice / 1000 AS duration_seconds FROM {orders}""",

    "v_feedback": """
SELECT d.doc_id AS finding_id,
  CASE d.doc_id % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  d.text AS code_snippet, d.lang || ' ' || d.source AS message,
  CASE d.doc_id % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'bandit' ELSE 'fusion(bandit,semgrep)' END AS scanner,
  l.quality AS is_true_positive
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",

    "v_llm_calls": """
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response,
  CASE u.conv_id % 4 WHEN 0 THEN 'deepseek-coder' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'codellama:13b' ELSE 'unknown' END AS model,
  CAST(floor(length(u.text) / 4) AS BIGINT) AS tokens_prompt, CAST(floor(length(a.text) / 4) AS BIGINT) AS tokens_completion
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",

    # Model answers in all shapes a parser meets, around the given texts.
    "v_answers": """
SELECT conv_id, turn, prompt,
  CASE conv_id % 6
    WHEN 0 THEN 'Sure.' || chr(10) || '```python' || chr(10) || response || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN '```' || chr(10) || 'UNABLE_TO_FIX: ' || prompt || chr(10) || '```'
    WHEN 2 THEN 'Here is the fix' || chr(10) || response || chr(10) || '  Below is more' || chr(10) || 'end'
    WHEN 3 THEN '  UNABLE_TO_FIX ' || response
    WHEN 4 THEN '```' || chr(10) || ' one ' || chr(10) || '```' || chr(10) || 'text' || chr(10) || '```js' || chr(10) || response || chr(10) || '```'
    ELSE response END AS response,
  CASE conv_id % 3
    WHEN 0 THEN 'Plan: {"root_cause": "cause ' || CAST(conv_id AS STRING) || '", "fix_strategy": "escape", "steps": ["a", "b ' || CAST(turn AS STRING) || '"], "estimated_complexity": "low"} ok'
    WHEN 1 THEN 'no plan here ' || CAST(turn AS STRING)
    ELSE '{broken "root_cause" ' || CAST(turn AS STRING) || '}' END AS plan_text
FROM v_llm_calls""",

    "v_attempts": """
SELECT CAST(floor(event_id / 3) AS BIGINT) AS finding_id, CAST(event_id % 3 + 1 AS INT) AS attempt_num,
  event_type IN ('purchase', 'signup') AS validation_passed, props AS patch FROM {events}""",

    "v_provider_calls": """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS finding_id, CAST(event_id % 4 AS INT) AS chain_pos,
  event_type NOT IN ('error', 'click') AS ok, value AS latency_ms FROM {events}""",

    "v_docs": """
SELECT source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, text AS content FROM {documents}""",

    "v_base": """
SELECT source || '/' || CAST(doc_id AS STRING) || '.txt' AS path,
  CASE WHEN doc_id % 7 = 0 THEN text || ' old' ELSE text END AS content FROM {documents} WHERE doc_id % 10 <> 0""",

    "v_head": """
SELECT source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, text AS content FROM {documents} WHERE doc_id % 13 <> 0""",

    # Paths staged but not committed; some of them do not exist.
    "v_staged": """
SELECT source || '/' || CAST(doc_id AS STRING) || CASE WHEN n_chars % 3 = 0 THEN '.txt' ELSE '.bak' END AS path FROM {documents}""",

    "v_py_files": """
SELECT 'src/' || CAST(doc_id AS STRING) || '.py' AS path,
  '# ' || lang || chr(10) || 'import os' || chr(10) || 'from sys import path' || chr(10) || chr(10) ||
  'class C' || CAST(doc_id AS STRING) || ':' || chr(10) || '    def m(self):' || chr(10) || '        ' ||
  replace(text, chr(10), chr(10) || '        ') || chr(10) || 'x = ' || CAST(doc_id AS STRING) AS content
FROM {documents}""",

    # Findings that point into v_py_files, some past the end of the file or into missing files.
    "v_code_findings": """
SELECT l_orderkey AS scan_id, 'src/' || CAST(l_partkey AS STRING) || '.py' AS file_path,
  CAST(l_quantity AS INT) AS line_start, CAST(l_quantity AS INT) + l_linenumber % 3 AS line_end FROM {lineitem}""",

    "v_config_files": """
SELECT CASE doc_id % 6
    WHEN 0 THEN 'r' || CAST(doc_id AS STRING) || '/Dockerfile'
    WHEN 1 THEN 'r' || CAST(doc_id AS STRING) || '/pod.yaml'
    WHEN 2 THEN 'r' || CAST(doc_id AS STRING) || '/main.tf'
    WHEN 3 THEN 'r' || CAST(doc_id AS STRING) || '/nginx.conf'
    WHEN 4 THEN 'r' || CAST(doc_id AS STRING) || '/.github/workflows/ci.yml'
    ELSE 'r' || CAST(doc_id AS STRING) || '/notes.txt' END AS path,
  CASE doc_id % 6
    WHEN 0 THEN 'FROM base:' || CASE WHEN doc_id % 4 = 0 THEN 'latest' ELSE '1.2' END || chr(10) || 'RUN apt-get install -y x' || CASE WHEN doc_id % 9 = 0 THEN ' && rm -rf /var/lib/apt' ELSE '' END || chr(10) || 'ENV APP_TOKEN=abc' || chr(10) || 'RUN curl http://h/i | sh' || chr(10) || 'EXPOSE ' || CAST(80 + doc_id AS STRING) || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'USER root' WHEN doc_id % 5 = 1 THEN chr(10) || 'USER app' ELSE '' END
    WHEN 1 THEN 'apiVersion: v1' || chr(10) || 'kind: Pod' || chr(10) || 'privileged: true' || chr(10) || 'runAsUser: 0' || chr(10) || 'hostNetwork: true' || chr(10) || 'hostPID: ' || CASE WHEN doc_id % 4 = 1 THEN 'true' ELSE 'false' END || chr(10) || 'allowPrivilegeEscalation: true' || chr(10) || 'automountServiceAccountToken: true' || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'resources:' ELSE '' END
    WHEN 2 THEN 'acl = "public-read"' || chr(10) || 'cidr_blocks = ["0.0.0.0/0"]' || chr(10) || 'publicly_accessible = true' || chr(10) || 'encrypted = ' || CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'false' END
    WHEN 3 THEN 'server_tokens on;' || chr(10) || 'ssl_protocols TLSv1' || CASE WHEN doc_id % 4 = 1 THEN '.2' ELSE '' END || ';' || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'add_header X-Frame-Options DENY;' ELSE '' END
    WHEN 4 THEN 'on: pull_request_target' || chr(10) || 'steps:' || chr(10) || '- uses: a/b@' || CASE WHEN doc_id % 4 = 0 THEN 'main' ELSE 'v1' END || chr(10) || 'x: ${{ secrets }} run: y'
    ELSE text END AS content
FROM {documents}""",

    # The given texts, each with one more line so that every credential kind occurs.
    "v_secret_files": """
SELECT 'app/' || CAST(doc_id AS STRING) || '.env' AS path, text || chr(10) || CASE doc_id % 17
    WHEN 0 THEN 'key = AKIA' || upper(substr(md5(text), 1, 16))
    WHEN 1 THEN 'g = AIza' || md5(text) || 'abc'
    WHEN 2 THEN '{"type": "service_account", "n": ' || CAST(doc_id AS STRING) || '}'
    WHEN 3 THEN 'h = ghp_' || md5(text) || '0123'
    WHEN 4 THEN 'o = sk-proj-' || md5(text)
    WHEN 5 THEN 'a = sk-ant-' || md5(text)
    WHEN 6 THEN 's = xoxb-' || md5(text)
    WHEN 7 THEN 'l = glpat-' || md5(text)
    WHEN 8 THEN 'j = eyJ' || md5(text) || '.eyJ' || md5(text) || '.' || md5(text)
    WHEN 9 THEN '-----BEGIN RSA PRIVATE KEY-----'
    WHEN 10 THEN 'api_key = "' || md5(text) || '" and token: "' || md5(lang) || '"'
    WHEN 11 THEN 'DB_PASSWORD=' || substr(md5(text), 1, 12)
    WHEN 12 THEN 'DATABASE_URL=postgres://app:' || substr(md5(text), 1, 8) || '@db/x'
    WHEN 13 THEN 'curl https://bob:' || substr(md5(text), 1, 8) || '@host/x'
    WHEN 14 THEN 'password = "Example-' || md5(text) || '"'
    WHEN 15 THEN 'v = "' || md5(text) || translate(md5(lang || text), '0123456789abcdef', 'GHIJKLMNOPQRSTUV') || '"'
    ELSE 'nothing' END AS content
FROM {documents}""",

    "v_reports_in": """
SELECT event_id, ts, user_id,
  CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' ELSE 'INFO' END AS severity,
  'f' || CAST(user_id AS STRING) || ':' || event_type AS id
FROM {events}""",

    # ---- oracle only
    "o_doc_lines": """
SELECT path, generate_subscripts(s, 1) AS line_no, unnest(s) AS text FROM (
  SELECT path, CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS s FROM (
    SELECT path, string_split(content, chr(10)) AS s FROM v_docs))""",
    "o_py_lines": """
SELECT path, generate_subscripts(s, 1) AS line_no, unnest(s) AS text FROM (
  SELECT path, string_split(content, chr(10)) AS s FROM v_py_files)""",
    "o_config_routed": """
SELECT path, content, CASE WHEN path LIKE '%/Dockerfile' THEN 'docker' WHEN path LIKE '%.tf' THEN 'tf'
  WHEN path LIKE '%.yaml' OR path LIKE '%.yml' THEN CASE WHEN contains(path, '.github/workflows') OR contains(substr(content, 1, 200), 'uses:') THEN 'gha' ELSE 'k8s' END
  WHEN path LIKE '%/nginx.conf' THEN 'nginx' END AS family FROM v_config_files""",
    "o_config_lines": """
SELECT path, family, generate_subscripts(s, 1) AS line_no, unnest(s) AS text FROM (
  SELECT path, family, string_split(content, chr(10)) AS s FROM o_config_routed WHERE family IS NOT NULL)""",
    "o_secret_lines": """
SELECT path, generate_subscripts(s, 1) AS line_no, unnest(s) AS text FROM (
  SELECT path, CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS s FROM (
    SELECT path, string_split(content, chr(10)) AS s FROM v_secret_files))""",
}

_NAME = re.compile(r"\b[vo]_[a-z_]+\b")


def _needed(sql: str, extra: dict[str, str]) -> list[str]:
    """View names a statement needs, dependencies first."""
    known = {**VIEWS, **extra}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in known and name not in seen:
                seen.add(name)  # before descending: a recursive view names itself
                visit(known[name])
                order.append(name)

    visit(sql)
    return order


def oracle_text(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement with the views it needs as CTEs, for an engine where the given tables are views."""
    extra = extra or {}
    known = {**VIEWS, **extra}
    ctes = [f"{n} AS ({known[n].strip()})" for n in _needed(sql, extra)]
    text = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql.strip()
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


class Tables:
    """Given tables and derived views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A given table, read as it is stored."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        ctes = [n for n in _needed(VIEWS[name], {})]
        text = (f"WITH {', '.join(f'{n} AS ({VIEWS[n].strip()})' for n in ctes)} " if ctes else "") + VIEWS[name].strip()
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        text = text.replace("{", "{{").replace("}", "}}")  # braces inside the texts are not placeholders
        for t in used:
            text = text.replace("{{" + t + "}}", "{" + t + "}")
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if "v_" + name in VIEWS:
            return self.view("v_" + name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
