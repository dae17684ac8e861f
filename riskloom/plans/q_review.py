"""Review verdicts, remediation state, URL import and data-quality queries (E3, E4, M12, M16, R10, S14, T2 twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import enrich as en
from riskloom.operators import findings as fnd
from riskloom.operators import remediate as rem
from riskloom.plans.oracle_parts import WS
from riskloom.plans.registry import register
from riskloom.sources import fixtures as fx

RESP = fx.duck_with("findings_base").rstrip() + f""",
reasoning_responses AS ({fx.REASONING_RESPONSES_TEMPLATE.format(findings_base='findings_base')})
"""

_KEYS = "['confidence', 'explanation', 'exploitability_notes', 'fix_suggestion', 'severity']"


def _text_bad(field: str) -> str:
    return (f"json_type(output_text, '$.{field}') IS DISTINCT FROM 'VARCHAR' "
            f"OR trim(json_extract_string(output_text, '$.{field}'), {WS}) = ''")


VALIDATED = f"""validated AS (
  SELECT finding_id, output_text,
    CASE WHEN output_text IS NULL OR output_text = '' THEN 'missing_output'
         WHEN NOT json_valid(output_text) THEN 'not_json'
         WHEN json_type(output_text) <> 'OBJECT'
              OR list_sort(list_distinct(json_keys(output_text))) <> {_KEYS} THEN 'bad_keys'
         WHEN json_type(output_text, '$.severity') IS DISTINCT FROM 'VARCHAR'
              OR json_extract_string(output_text, '$.severity') NOT IN ('critical', 'high', 'medium', 'low')
              THEN 'bad_severity'
         WHEN json_type(output_text, '$.confidence') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'confidence_not_number'
         WHEN {_text_bad('explanation')} OR {_text_bad('fix_suggestion')} OR {_text_bad('exploitability_notes')}
              THEN 'empty_text'
         WHEN CAST(json_extract_string(output_text, '$.confidence') AS DECIMAL(38,18)) < 0
              OR CAST(json_extract_string(output_text, '$.confidence') AS DECIMAL(38,18)) > 1 THEN 'confidence_out_of_range'
    END AS reason
  FROM {{src}})"""


@register("reasoning_valid", RESP + ", " + VALIDATED.format(src="reasoning_responses") + """
SELECT finding_id, reason IS NULL AS valid, reason,
       CASE WHEN reason IS NULL THEN json_extract_string(output_text, '$.severity') END AS ai_severity,
       CASE WHEN reason IS NULL THEN CAST(round(CAST(json_extract_string(output_text, '$.confidence')
            AS DECIMAL(38,18)), 2) AS DECIMAL(3,2)) END AS ai_confidence
FROM validated""")
def q_reasoning_valid(spark, sf_dir):
    v = en.reasoning_valid(fx.reasoning_responses(spark, sf_dir))
    return v.select("finding_id", "valid", "reason", "ai_severity", "ai_confidence")


@register("enrich_findings", RESP + ", " + VALIDATED.format(src="reasoning_responses") + f""",
verdicts AS (
  SELECT finding_id, json_extract_string(output_text, '$.severity') AS ai_sev,
         CAST(round(CAST(json_extract_string(output_text, '$.confidence') AS DECIMAL(38,18)), 2) AS DECIMAL(3,2)) AS ai_conf,
         trim(json_extract_string(output_text, '$.explanation'), {WS}) AS expl,
         trim(json_extract_string(output_text, '$.fix_suggestion'), {WS}) AS fix,
         trim(json_extract_string(output_text, '$.exploitability_notes'), {WS}) AS notes
  FROM validated WHERE reason IS NULL),
ok AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY
    list_position(['critical', 'high', 'medium', 'low'], ai_sev), ai_conf DESC, expl, fix, notes) AS rn FROM verdicts) x WHERE rn = 1)
SELECT f.finding_id, f.scan_id, f.category, f.file_path, f.line_start, f.title, f.created_at,
       coalesce(ok.ai_sev, f.severity) AS severity,
       CASE WHEN ok.ai_sev IS NOT NULL AND abs(ok.ai_conf - f.confidence) >= 0.15 THEN ok.ai_conf
            ELSE f.confidence END AS confidence,
       CASE WHEN ok.ai_sev IS NOT NULL THEN ok.fix ELSE f.fix_suggestion END AS fix_suggestion,
       CASE WHEN ok.ai_sev IS NOT NULL THEN ok.expl || chr(10) || chr(10) || 'Exploitability notes: ' || ok.notes
       END AS ai_explanation
FROM findings_base f LEFT JOIN ok USING (finding_id)""")
def q_enrich_findings(spark, sf_dir):
    out = en.enrich_findings(fx.findings_base(spark, sf_dir), fx.reasoning_responses(spark, sf_dir))
    return out.select("finding_id", "scan_id", "category", "file_path", "line_start", "title", "created_at",
                      "severity", "confidence", "fix_suggestion", "ai_explanation")


EVENTS = fx.duck_with("remediation_events")
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in rem.ALLOWED_TRANSITIONS)


@register("invalid_transitions", EVENTS + f"""
SELECT remediation_id, event_id, prev_event_id, from_status, to_status, ts FROM (
  SELECT remediation_id, event_id, ts, status AS to_status,
         lag(status) OVER w AS from_status, lag(event_id) OVER w AS prev_event_id
  FROM remediation_events WINDOW w AS (PARTITION BY remediation_id ORDER BY ts, event_id)) p
WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN (SELECT * FROM (VALUES {_ALLOWED}) a(f, t))""")
def q_invalid_transitions(spark, sf_dir):
    return rem.invalid_transitions(fx.remediation_events(spark, sf_dir))


@register("remediation_status_current", EVENTS + """
SELECT remediation_id, status, updated_at, events FROM (
  SELECT remediation_id, status, max(ts) OVER (PARTITION BY remediation_id) AS updated_at,
         count(*) OVER (PARTITION BY remediation_id) AS events,
         row_number() OVER (PARTITION BY remediation_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM remediation_events) s WHERE rn = 1""")
def q_remediation_status_current(spark, sf_dir):
    return rem.current_status(fx.remediation_events(spark, sf_dir))


@register("recent_events", EVENTS + """
SELECT remediation_id, event_id, ts, status, rank_in_group FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY remediation_id ORDER BY ts DESC, event_id DESC) AS INTEGER)
         AS rank_in_group FROM remediation_events) r WHERE rank_in_group <= 6""")
def q_recent_events(spark, sf_dir):
    ev = fx.remediation_events(spark, sf_dir)
    top = fnd.top_k_per_group(ev, ["remediation_id"], [F.col("ts").desc(), F.col("event_id").desc()], 6,
                              tie_cols=["event_id"])
    return top.select("remediation_id", "event_id", "ts", "status", "rank_in_group")


_GH = "^https://github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\\.git)?/?\\z"


@register("project_import", f"""
SELECT page_id, url, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS name,
       CASE WHEN ok THEN 'https://github.com/' || owner || '/' || name END AS canonical_url, ok AS valid
FROM (
  SELECT page_id, url, owner, name,
         coalesce(regexp_matches(url, '{_GH}') AND owner NOT IN ('.', '..') AND name NOT IN ('.', '..'), FALSE) AS ok
  FROM (SELECT page_id, url, regexp_extract(url, '{_GH}', 1) AS owner, regexp_extract(url, '{_GH}', 2) AS name
        FROM pages) p) q""")
def q_project_import(spark, sf_dir):
    """Repository URL parsing over every page URL (valid ones become projects)."""
    from riskloom.sources import files as src
    pages = fx.read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = src.project_import(pages)
    return out.select("page_id", "url", "owner", "name", "canonical_url",
                      F.coalesce(F.col("valid"), F.lit(False)).alias("valid"))


# repository URLs of suppliers: valid ones in three spellings, and four kinds that are not valid
REPO_URLS = """SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'https://github.com/' || owner || '/' || name WHEN 1 THEN 'https://github.com/' || owner || '/' || name || '.git'
  WHEN 2 THEN 'https://github.com/' || owner || '/' || name || '/' WHEN 3 THEN 'http://github.com/' || owner || '/' || name
  WHEN 4 THEN 'https://github.com/' || owner || '/..' WHEN 5 THEN 'https://github.com/' || owner || '/' || name || '/tree/main'
  ELSE 'https://github.com/' || owner END AS url
FROM (SELECT s_suppkey, 'owner-' || CAST(s_nationkey AS STRING) AS owner, 'repo_' || CAST(s_suppkey AS STRING) || '.py' AS name FROM {supplier}) AS s"""


@register("project_import_repos", f"""
SELECT id, url, CASE WHEN ok THEN string_split(url, '/')[4] END AS owner, CASE WHEN ok THEN regexp_replace(string_split(url, '/')[5], '\\.git$', '') END AS name,
  CASE WHEN ok THEN 'https://github.com/' || string_split(url, '/')[4] || '/' || regexp_replace(string_split(url, '/')[5], '\\.git$', '') END AS canonical_url, ok AS valid
FROM (SELECT *, id % 7 < 3 AS ok FROM ({REPO_URLS.format(supplier='supplier')}) u) v""")
def q_project_import_repos(spark, sf_dir):
    """S14 over URLs of which three spellings are valid."""
    from riskloom.sources import files as src
    urls = spark.sql(REPO_URLS, supplier=fx.read_table(spark, sf_dir, "supplier"))
    return src.project_import(urls).select("id", "url", "owner", "name", "canonical_url", F.coalesce("valid", F.lit(False)).alias("valid"))


@register("dq_violations", RESP + """
SELECT finding_id, 'confidence_out_of_range' AS reason FROM findings_base WHERE confidence < 0 OR confidence > 1
UNION ALL
SELECT finding_id, 'unknown_severity' AS reason FROM findings_base
WHERE severity IS NULL OR severity NOT IN ('critical', 'high', 'medium', 'low', 'info')
UNION ALL
SELECT DISTINCT finding_id, 'invalid_review' AS reason FROM reasoning_responses
WHERE NOT json_valid(output_text) OR json_type(output_text) <> 'OBJECT'""")
def q_dq_violations(spark, sf_dir):
    """Rows that break the stored-table checks (plus unreadable review verdicts)."""
    base = rem.dq_violations(fx.findings_base(spark, sf_dir))
    resp = fx.reasoning_responses(spark, sf_dir)
    v = F.try_parse_json(F.col("output_text"))
    bad = resp.where(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")).select(
        "finding_id", F.lit("invalid_review").alias("reason")).distinct()
    return base.unionByName(bad)
