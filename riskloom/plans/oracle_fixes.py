"""DuckDB SQL of fix proposals and their outcome over the merged findings.

Written line by line from the template rules: which line of which file a template changes, and in how many edits.
Every changed file of the fixture must stay valid, so a change is a valid change.
"""

from __future__ import annotations

from riskloom.operators.catalog import PRODUCT_NAME, RULES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# fixed values: categories of the tiers and guidance sentences
_TIER = """CASE WHEN category IN ('hardcoded_secret', 'insecure_config', 'typosquatted_dependency', 'committed_env_file') THEN 1
  WHEN category IN ('hardcoded_auth_bypass', 'auth_bypass', 'obfuscated_dynamic_execution', 'obfuscated_code', 'suspicious_dynamic_execution') THEN 2
  ELSE 3 END"""
_GUIDE = f"""CASE tier WHEN 1 THEN 'A deterministic patch can be prepared on an isolated {PRODUCT_NAME} branch.'
  WHEN 2 THEN 'This fix is proposed only and requires explicit human approval before verification or PR creation.'
  ELSE 'This finding is flagged-only because automated changes could disrupt valid business behavior.' END"""
_FIX_TEXTS = ", ".join(sorted({f"({_text(r[4])}, {_text(r[5])})" for r in RULES.values()}))

_SECRET_LINE = " OR ".join(f"regexp_matches(rtrim(line, chr(13)), {_text(f'^\\s*[A-Z][A-Z0-9_]*\\s*=\\s*{q}.*{q}\\s*(#.*)?$')})" for q in "\"'")
_DEPENDENCY = ("coalesce(nullif(lower(regexp_extract(code_snippet, '^\\s*([A-Za-z0-9_.-]+)', 1)), ''), "
               "regexp_extract(code_snippet, '\"([^\"]+)\"', 1))")
_EDITS = f"""CASE WHEN tier = 3 OR content IS NULL THEN 0
  WHEN category = 'hardcoded_secret' THEN CASE WHEN NOT ({_SECRET_LINE}) THEN 0
    WHEN regexp_matches(content, '(?m)^\\s*(import os|from os\\b)') THEN 1 ELSE 2 END
  WHEN category = 'insecure_config' THEN CAST(regexp_matches(line, '\\bDEBUG\\s*=\\s*True\\b')
    OR regexp_matches(line, 'allow_origins\\s*=\\s*\\[\\s*[''"]\\*[''"]\\s*\\]') AS INTEGER)
  WHEN category = 'typosquatted_dependency' THEN CAST(len(list_filter(lines, lambda l: starts_with(ltrim(l), {_DEPENDENCY})
    AND regexp_matches(substr(ltrim(l), length({_DEPENDENCY}) + 1), '^(\\s*(==|>=|<=|~=|@).*)?$'))) > 0 AS INTEGER)
  WHEN category = 'committed_env_file' THEN CASE WHEN list_contains(list_transform(lines, lambda l: trim(l)), '.env') THEN 0 ELSE 2 END
  WHEN category IN ('hardcoded_auth_bypass', 'auth_bypass') THEN
    CASE WHEN ends_with(file_path, '.py') THEN least(coalesce(line_end, line_start), len(lines)) - line_start + 1 ELSE 0 END
  ELSE 1 END"""


def proposals_sql(merged: str, code_files: str) -> str:
    """``merged`` ends in a CTE of that name; ``code_files`` is the fixture view."""
    return merged.rstrip() + f""",
files AS ({code_files}),
fix_texts(title, fix) AS (VALUES {_FIX_TEXTS}),
targets AS (SELECT *, {_TIER} AS tier, CASE WHEN category = 'committed_env_file' THEN '.gitignore' ELSE file_path END AS target_file FROM merged),
sourced AS (
  SELECT t.*, f.content, string_split(f.content, chr(10)) AS lines, string_split(f.content, chr(10))[t.line_start] AS line
  FROM targets t LEFT JOIN files f ON f.repo_id = t.repo_id AND f.commit_sha = t.commit_sha AND f.file_path = t.target_file),
edited AS (SELECT *, CAST({_EDITS} AS INTEGER) AS edits FROM sourced),
proposals AS (
  SELECT repo_id, commit_sha, file_path, line_start, category, title, tier, target_file, edits > 0 AS has_change, edits,
    CASE WHEN tier = 3 OR edits > 0 THEN {_GUIDE}
         WHEN content IS NULL AND category <> 'committed_env_file' THEN 'The flagged source file is unavailable in the repository snapshot.'
         ELSE 'No safe template matched this finding. Review manually.' END || ' AI fix context: ' || fix AS guidance
  FROM edited JOIN fix_texts USING (title)),
outcomes AS (
  SELECT repo_id, commit_sha, file_path, line_start, category, title, tier, has_change, CASE WHEN has_change THEN TRUE END AS valid,
    CASE tier WHEN 3 THEN 'rejected' WHEN 2 THEN 'pending_approval' ELSE CASE WHEN has_change THEN 'verifying' ELSE 'failed' END END AS status
  FROM proposals)
"""
