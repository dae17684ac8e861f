"""Finding-table queries over the ``findings_base`` view (600k rows at sf0.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import findings as fnd
from riskloom.operators import remediate as rem
from riskloom.operators import report as rpt
from riskloom.plans.registry import register
from riskloom.sources import fixtures as fx

SEV_RANK_SQL = ("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
                "WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END")
TIE_SQL = "finding_id, created_at, severity, fix_suggestion, detector"
WEIGHT_SQL = ("CASE severity WHEN 'critical' THEN 35 WHEN 'high' THEN 18 WHEN 'medium' THEN 8 "
              "WHEN 'low' THEN 3 ELSE 0 END")

BASE = fx.duck_with("findings_base")
DEDUP = BASE.rstrip() + f""",
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY scan_id, category, file_path, line_start, title
                                 ORDER BY confidence DESC, {TIE_SQL}) AS rn
    FROM findings_base) d WHERE rn = 1)
"""


def _dedup(spark, sf_dir):
    return fnd.dedupe_findings(fx.findings_base(spark, sf_dir))


@register("dedupe_findings", DEDUP + "SELECT * FROM dedup")
def q_dedupe(spark, sf_dir):
    return _dedup(spark, sf_dir)


@register("rank_findings", DEDUP + f"""
SELECT scan_id, finding_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {SEV_RANK_SQL},
       confidence DESC, file_path, {TIE_SQL}) AS BIGINT) AS position FROM dedup""")
def q_rank(spark, sf_dir):
    return fnd.rank_findings(_dedup(spark, sf_dir)).select("scan_id", "finding_id", "position")


@register("severity_counts", DEDUP + """
SELECT scan_id, CAST(count_if(severity = 'critical') AS BIGINT) AS critical,
       CAST(count_if(severity = 'high') AS BIGINT) AS high, CAST(count_if(severity = 'medium') AS BIGINT) AS medium,
       CAST(count_if(severity = 'low') AS BIGINT) AS low, CAST(count_if(severity = 'info') AS BIGINT) AS info,
       CAST(count(*) AS BIGINT) AS total
FROM dedup GROUP BY scan_id""")
def q_severity_counts(spark, sf_dir):
    return rpt.severity_counts(_dedup(spark, sf_dir))


@register("risk_score", DEDUP + f"""
SELECT scan_id, CAST(round(least(sum({WEIGHT_SQL} * confidence), 100), 1) AS DECIMAL(4,1)) AS overall_risk_score,
       CASE WHEN round(least(sum({WEIGHT_SQL} * confidence), 100), 1) >= 70 THEN 'high'
            WHEN round(least(sum({WEIGHT_SQL} * confidence), 100), 1) >= 40 THEN 'medium' ELSE 'low' END AS risk_band
FROM dedup GROUP BY scan_id""")
def q_risk_score(spark, sf_dir):
    s = rpt.risk_score(_dedup(spark, sf_dir))
    return s.select("scan_id", "overall_risk_score", rpt.risk_band(F.col("overall_risk_score")).alias("risk_band"))


@register("top_finding", DEDUP + f"""
SELECT scan_id, finding_id, severity, confidence, title, file_path, line_start FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {SEV_RANK_SQL}, confidence DESC, {TIE_SQL}) AS rn
  FROM dedup) t WHERE rn = 1""")
def q_top_finding(spark, sf_dir):
    return fnd.top_finding(_dedup(spark, sf_dir))


@register("recommendations", DEDUP + f"""
, r AS (
  SELECT scan_id, fix_suggestion, {SEV_RANK_SQL} AS sr, confidence, file_path, finding_id, created_at, severity,
         detector,
         row_number() OVER (PARTITION BY scan_id, fix_suggestion
                            ORDER BY {SEV_RANK_SQL}, confidence DESC, file_path, {TIE_SQL}) AS rn
  FROM dedup WHERE fix_suggestion IS NOT NULL AND fix_suggestion <> '')
SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY sr, confidence DESC, file_path, {TIE_SQL})
       AS INTEGER) AS rec_no, fix_suggestion
FROM r WHERE rn = 1""")
def q_recommendations(spark, sf_dir):
    return fnd.recommendations(_dedup(spark, sf_dir)).select("scan_id", F.col("rec_no").cast("int"),
                                                             "fix_suggestion")


@register("findings_by_severity", DEDUP + f"""
SELECT scan_id, CAST({SEV_RANK_SQL} AS INTEGER) AS group_order, severity, findings, lead_finding_id FROM (
  SELECT scan_id, severity, CAST(count(*) OVER (PARTITION BY scan_id, severity) AS BIGINT) AS findings, finding_id AS lead_finding_id,
         row_number() OVER (PARTITION BY scan_id, severity ORDER BY confidence DESC, file_path, {TIE_SQL}) AS rn
  FROM dedup) g WHERE rn = 1""")
def q_findings_by_severity(spark, sf_dir):
    return rpt.findings_by_severity(_dedup(spark, sf_dir))


_TIER_SQL = ("CASE WHEN category IN ('hardcoded_secret', 'insecure_config', 'typosquatted_dependency', "
             "'committed_env_file') THEN 1 WHEN category IN ('hardcoded_auth_bypass', 'auth_bypass', "
             "'obfuscated_dynamic_execution', 'obfuscated_code', 'suspicious_dynamic_execution') THEN 2 ELSE 3 END")


@register("remediation_tier", DEDUP + f"""
SELECT finding_id, category, CAST({_TIER_SQL} AS INTEGER) AS tier FROM dedup""")
def q_remediation_tier(spark, sf_dir):
    d = _dedup(spark, sf_dir)
    return rem.with_tier(d).select("finding_id", "category", F.col("tier").cast("int"))
