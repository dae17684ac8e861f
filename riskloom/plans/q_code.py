"""Corpus queries: sources, inventory and the detector rules over ``code_files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import config_rules as cr
from riskloom.operators.catalog import RULE_OUTPUT
from riskloom.plans import oracle_parts as op
from riskloom.plans.registry import register
from riskloom.sources import files as src
from riskloom.sources import fixtures as fx


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(code_files, eligible_files) for one scale-factor folder."""
    files = fx.code_files(spark, sf_dir)
    return files, src.eligible_files(files)


def rule_out(df: DataFrame) -> DataFrame:
    return df.select(*RULE_OUTPUT)


# ---------------------------------------------------------------- sources ---

@register("eligible_files", op.code_prefix() + """
SELECT repo_id, commit_sha, file_path, CAST(size_bytes AS BIGINT) AS size_bytes, suffix_l, is_source FROM eligible""")
def q_eligible_files(spark, sf_dir):
    _, el = corpus(spark, sf_dir)
    return el.select("repo_id", "commit_sha", "file_path", "size_bytes", "suffix_l", "is_source")


@register("manifest_files", op.code_prefix() + f"""
SELECT repo_id, commit_sha, file_path, regexp_extract(file_path, '[^/]*$') AS name, CAST(length(content) AS BIGINT) AS chars
FROM code_files
WHERE regexp_extract(file_path, '[^/]*$') IN ('package.json', 'requirements.txt', 'go.mod')
  AND NOT list_has_any(string_split(file_path, '/'), {op.NOISE}) AND length(content) > 0""")
def q_manifest_files(spark, sf_dir):
    files, _ = corpus(spark, sf_dir)
    return src.manifest_files(files).select("repo_id", "commit_sha", "file_path", "name",
                                            F.length("content").cast("bigint").alias("chars"))


@register("gitignore_patterns", op.code_prefix() + f"""
SELECT repo_id, commit_sha, CAST(pos - 1 AS INTEGER) AS pos, trim(raw, {op.WS}) AS pattern FROM (
  SELECT repo_id, commit_sha, unnest(string_split(content, chr(10))) AS raw,
         generate_subscripts(string_split(content, chr(10)), 1) AS pos
  FROM code_files WHERE file_path = '.gitignore') g
WHERE trim(raw, {op.WS}) <> '' AND NOT starts_with(ltrim(raw, {op.WS}), '#')""")
def q_gitignore_patterns(spark, sf_dir):
    files, _ = corpus(spark, sf_dir)
    return src.gitignore_patterns(files).select("repo_id", "commit_sha", F.col("pos").cast("int").alias("pos"), "pattern")


@register("repo_size", op.code_prefix() + f"""
SELECT repo_id, commit_sha, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, sum(size_bytes) > 524288000 AS over_limit
FROM code_files WHERE NOT list_has_any(string_split(file_path, '/'), {op.NOISE}) GROUP BY repo_id, commit_sha""")
def q_repo_size(spark, sf_dir):
    files, _ = corpus(spark, sf_dir)
    return src.repo_over_limit(files).select("repo_id", "commit_sha", "total_bytes", "over_limit")


@register("repo_inventory", op.code_prefix() + """
SELECT repo_id, commit_sha, count(*) AS files_scanned, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
FROM eligible GROUP BY repo_id, commit_sha""")
def q_repo_inventory(spark, sf_dir):
    _, el = corpus(spark, sf_dir)
    return src.repo_inventory(el).select("repo_id", "commit_sha", "files_scanned", "total_bytes")


_LANG_VALUES = ", ".join(f"('{s}', '{lang}')" for s, lang in src.LANGUAGES)


@register("language_counts", op.code_prefix(f"langs(suffix_l, language) AS (VALUES {_LANG_VALUES})") + """
SELECT repo_id, commit_sha, language, count(*) AS files FROM eligible JOIN langs USING (suffix_l) GROUP BY repo_id, commit_sha, language""")
def q_language_counts(spark, sf_dir):
    _, el = corpus(spark, sf_dir)
    return src.language_counts(el).select("repo_id", "commit_sha", "language", "files")


@register("language_histogram", op.code_prefix(f"langs(suffix_l, language) AS (VALUES {_LANG_VALUES})") + """
SELECT repo_id, commit_sha, '{' || string_agg('"' || language || '":' || n, ',' ORDER BY language) || '}' AS languages
FROM (SELECT repo_id, commit_sha, language, count(*) AS n FROM eligible JOIN langs USING (suffix_l) GROUP BY ALL) l GROUP BY ALL""")
def q_language_histogram(spark, sf_dir):
    """S11 as the snapshot's ``languages`` map per scan, as JSON text (keys sorted)."""
    _, el = corpus(spark, sf_dir)
    return src.language_histogram(el).select("repo_id", "commit_sha", F.to_json("languages").alias("languages"))


# ----------------------------------------------------------------- config ---

_CFG = (f"cfg AS (SELECT * FROM eligible WHERE lower(name) IN {op.CONFIG_NAMES} OR name = '.env' "
        f"OR starts_with(name, '.env.') OR suffix_l IN {op.SOURCE})")


def _regex_rule_oracle(source_cte: str, source: str, pattern: str, rule: tuple) -> str:
    hits = f"(SELECT l.*, unnest(regexp_extract_all(ltext, '{pattern}')) AS m FROM {op.lines_of(source)} l) h"
    return op.code_prefix(source_cte) + op.rule_select(hits, *rule)


@register("config_debug", _regex_rule_oracle(
    _CFG, "cfg", "(?i)\\bdebug\\s*(?:=|:)\\s*true\\b",
    ("config_audit", "insecure_config", "'high'", "0.90", "Debug mode enabled in configuration")))
def q_config_debug(spark, sf_dir):
    _, el = corpus(spark, sf_dir)
    return rule_out(cr.config_debug(el))


@register("config_cors", _regex_rule_oracle(
    _CFG, "cfg",
    "(?i)(?:allow_origins|cors[_-]?origins?|origins|alloworigin|allowedorigins|origin)\\s*[:=]\\s*\\[?\\s*[\"'']\\*[\"'']",
    ("config_audit", "insecure_config", "'high'", "0.92", "Wildcard CORS origin configured")))
def q_config_cors(spark, sf_dir):
    _, el = corpus(spark, sf_dir)
    return rule_out(cr.config_cors(el))


@register("env_committed", op.code_prefix(
    f"""gi AS (
  SELECT repo_id, commit_sha, pos, trim(raw, {op.WS}) AS pattern FROM (
    SELECT repo_id, commit_sha, unnest(string_split(content, chr(10))) AS raw,
           generate_subscripts(string_split(content, chr(10)), 1) AS pos
    FROM code_files WHERE file_path = '.gitignore') g
  WHERE trim(raw, {op.WS}) <> '' AND NOT starts_with(ltrim(raw, {op.WS}), '#'))""",
    "env AS (SELECT * FROM eligible WHERE name = '.env' OR starts_with(name, '.env.'))",
    """dec AS (
  SELECT env.repo_id, env.commit_sha, env.file_path, gi.pos, ltrim(gi.pattern, '/') AS cleaned
  FROM env JOIN gi ON env.repo_id = gi.repo_id AND env.commit_sha = gi.commit_sha
  WHERE ltrim(gi.pattern, '/') IN ('.env', '.env*', '.env.*') OR ltrim(gi.pattern, '/') = ltrim(env.file_path, '/'))""",
    "first_dec AS (SELECT repo_id, commit_sha, file_path, arg_min(cleaned, pos) AS cleaned FROM dec GROUP BY ALL)",
    """flagged AS (
  SELECT env.* FROM env LEFT JOIN first_dec USING (repo_id, commit_sha, file_path)
  WHERE NOT (CASE WHEN cleaned IS NULL THEN FALSE WHEN cleaned = '.env' THEN name = '.env'
                  WHEN cleaned IN ('.env*', '.env.*') THEN starts_with(name, '.env') ELSE TRUE END))""")
    + op.rule_select("flagged", "config_audit", "committed_env_file", "'high'", "0.88",
                     "Environment file is committed without .gitignore coverage", line="1",
                     snippet="'.env file is present and not ignored'"))
def q_env_committed(spark, sf_dir):
    files, el = corpus(spark, sf_dir)
    return rule_out(cr.env_committed(el, files))
