"""DuckDB building blocks for the oracle SQL (independent of the Spark code).

The oracle works line by line (``string_split`` on "\\n" + ``unnest``),
while the Spark operators work on whole files with offset folds; agreement of
the two is the correctness check. DuckDB regexes are RE2: no lookaround and
no backreferences, ASCII ``\\b``/``\\w``.
"""

from __future__ import annotations

from riskloom.sources.fixtures import duck_with


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


NOISE = sql_list([".git", "node_modules", "venv", ".venv", "__pycache__"])
SOURCE = sql_in([".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"])
JS = sql_in([".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"])
CONFIG_NAMES = sql_in(["settings.py", "next.config.js", "next.config.mjs", "dockerfile", "dockerfile.dev"])
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ELIGIBLE = f"""
eligible AS (
  SELECT repo_id, commit_sha, file_path, content, size_bytes, name,
         regexp_extract(name, '^.+(\\.[^.]*)$', 1) AS suffix,
         lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) AS suffix_l,
         lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) IN {SOURCE} AS is_source
  FROM (SELECT *, regexp_extract(file_path, '[^/]*$') AS name FROM code_files) f
  WHERE NOT list_has_any(string_split(file_path, '/'), {NOISE})
    AND size_bytes <= 1000000
    AND instr(substr(content, 1, 8192), chr(0)) = 0
)"""


def lines_of(source: str, where: str = "TRUE", extra: str = "") -> str:
    """One row per "\\n"-line: ltext, line_no (1-based), snip (stripped, 500 chars)."""
    return f"""(
  SELECT *, left(trim(ltext, {WS}), 500) AS snip FROM (
    SELECT s.*{extra}, unnest(string_split(content, chr(10))) AS ltext,
           generate_subscripts(string_split(content, chr(10)), 1) AS line_no
    FROM {source} s WHERE {where}) x)"""


def code_prefix(*more: str) -> str:
    """WITH code_files AS (...), eligible AS (...)[, more...]"""
    body = duck_with("code_files").rstrip()
    parts = [body + "," + ELIGIBLE]
    parts += list(more)
    return ",\n".join(parts) + "\n"


RULE_COLS = ("repo_id, commit_sha, file_path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, "
             "detector, category, severity, CAST(confidence AS DECIMAL(3,2)) AS confidence, title, code_snippet")


def rule_select(source: str, detector: str, category: str, severity: str, confidence: str, title: str,
                line: str = "line_no", snippet: str = "snip", line_end: str | None = None,
                where: str = "TRUE") -> str:
    t = title.replace("'", "''")
    return (f"SELECT repo_id, commit_sha, file_path, CAST({line} AS INTEGER) AS line_start, "
            f"CAST({line_end or line} AS INTEGER) AS line_end, '{detector}' AS detector, '{category}' AS category, "
            f"{severity} AS severity, CAST({confidence} AS DECIMAL(3,2)) AS confidence, '{t}' AS title, "
            f"{snippet} AS code_snippet FROM {source} WHERE {where}")
