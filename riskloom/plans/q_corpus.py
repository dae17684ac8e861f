"""Whole-corpus queries: merged findings and per-repository reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import merge as mg
from riskloom.operators import report as rpt
from riskloom.operators.catalog import PRODUCT_NAME, RULE_OUTPUT
from riskloom.plans.q_code import corpus, rule_out
from riskloom.plans.registry import ORACLES, register
from riskloom.sources import files as src

STATIC_KEYS = ["secret_signatures", "secret_entropy", "config_debug", "config_cors", "env_committed", "typosquat",
               "obscure_dependency", "js_dynamic_exec", "js_auth_bypass", "raw_ip_url", "raw_ip_socket",
               "isolated_domain", "install_script", "js_prompt_injection"]
_DET_RANK_SQL = "CASE detector " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(mg.DETECTOR_ORDER)) + \
    f" ELSE {len(mg.DETECTOR_ORDER)} END"
_SEV_RANK_SQL = ("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
                 "WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END")
_WEIGHT_SQL = ("CASE severity WHEN 'critical' THEN 35 WHEN 'high' THEN 18 WHEN 'medium' THEN 8 "
               "WHEN 'low' THEN 3 ELSE 0 END")
CORPUS_TIE = ["file_path", "_det", "line_start", "title", "code_snippet"]


PYTHON_KEYS = ["py_dynamic_exec", "py_shell_exec", "py_auth_bypass", "model_pickle", "model_torch", "model_joblib",
               "py_prompt_injection"]


def _union_sql(keys: list[str]) -> str:
    cols = ", ".join(RULE_OUTPUT)
    return "\nUNION ALL\n".join(f"SELECT {cols} FROM ({ORACLES[k]}) q_{i}" for i, k in enumerate(keys))


def _merged_sql(keys: list[str] | None = None) -> str:
    return f"""WITH u AS ({_union_sql(keys or STATIC_KEYS)}),
merged AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, commit_sha, category, file_path, line_start, title
                                 ORDER BY confidence DESC, {_DET_RANK_SQL}, code_snippet) AS rn FROM u) x
  WHERE rn = 1)
"""


def _merged(spark, sf_dir, detectors=mg.static_findings):
    """(files, the index's eligible files, merged findings, rejected repositories)."""
    files, el = corpus(spark, sf_dir)
    index = mg.file_index(files)
    rejected = mg.rejected_repos(index)
    return files, index.where("eligible"), mg.merge_findings(detectors(files, el, rejected=rejected, index=index)), rejected


def _merged_all(spark, sf_dir):
    return _merged(spark, sf_dir, mg.all_findings)


def merged_oracle(keys: list[str] | None = None) -> str:
    return _merged_sql(keys) + "SELECT * FROM merged"


def scan_reports_oracle(keys: list[str] | None = None) -> str:
    from riskloom.plans import oracle_parts as op
    inv = op.code_prefix().rstrip() + "\nSELECT repo_id, commit_sha, count(*) AS files_scanned FROM eligible GROUP BY repo_id, commit_sha"
    return _merged_sql(keys) + f""",
inv AS ({inv}),
agg AS (
  SELECT repo_id, commit_sha, CAST(count_if(severity = 'critical') AS BIGINT) AS critical,
         CAST(count_if(severity = 'high') AS BIGINT) AS high, CAST(count_if(severity = 'medium') AS BIGINT) AS medium,
         CAST(count_if(severity = 'low') AS BIGINT) AS low, CAST(count_if(severity = 'info') AS BIGINT) AS info,
         CAST(count(*) AS BIGINT) AS total,
         CAST(round(least(sum({_WEIGHT_SQL} * confidence), 100), 1) AS DECIMAL(4,1)) AS score
  FROM merged GROUP BY repo_id, commit_sha),
top AS (
  SELECT repo_id, commit_sha, title AS top_title, file_path AS top_path, line_start AS top_line FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, commit_sha ORDER BY {_SEV_RANK_SQL}, confidence DESC, file_path,
                                 {_DET_RANK_SQL}, line_start NULLS FIRST, title, code_snippet) AS rn FROM merged) t
  WHERE rn = 1),
r AS (
  SELECT inv.repo_id, inv.commit_sha, CAST(inv.files_scanned AS BIGINT) AS files_scanned,
         coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
         coalesce(low, 0) AS low, coalesce(info, 0) AS info, coalesce(total, 0) AS total,
         coalesce(score, CAST(0 AS DECIMAL(4,1))) AS overall_risk_score, top_title, top_path, top_line
  FROM inv LEFT JOIN agg USING (repo_id, commit_sha) LEFT JOIN top USING (repo_id, commit_sha))
SELECT repo_id, commit_sha, files_scanned, overall_risk_score,
       CASE WHEN overall_risk_score >= 70 THEN 'high' WHEN overall_risk_score >= 40 THEN 'medium' ELSE 'low' END
         AS risk_band,
       critical, high, medium, low, info, total,
       '{PRODUCT_NAME} scanned ' || files_scanned || ' eligible files and recorded ' || total || ' security findings.'
       || CASE WHEN total > 0 THEN
            ' The overall risk score is ' || CAST(overall_risk_score AS VARCHAR) || '/100, with '
            || concat_ws(', ', CASE WHEN critical > 0 THEN critical || ' critical' END,
                               CASE WHEN high > 0 THEN high || ' high' END,
                               CASE WHEN medium > 0 THEN medium || ' medium' END,
                               CASE WHEN low > 0 THEN low || ' low' END,
                               CASE WHEN info > 0 THEN info || ' info' END) || ' findings.'
            || ' Prioritize ' || top_title || ' in ' || top_path
            || CASE WHEN top_line IS NOT NULL AND top_line <> 0 THEN ' line ' || top_line ELSE '' END
            || ', then review the linked remediation recommendations.'
          ELSE ' No static findings were persisted for this scan; continue normal secure-development review.'
          END AS summary
FROM r"""


def _reports(findings, el, rejected=None):
    inv = src.repo_inventory(el).select("repo_id", "commit_sha", "files_scanned")
    if rejected is not None:  # rejected (over-size) repositories get no report
        inv = mg.gate(inv, rejected=rejected)
    keyed = findings.withColumn("_det", mg.detector_rank(F.col("detector")))
    out = rpt.scan_reports(with_scan(keyed), with_scan(inv), scan_col="scan", tie=CORPUS_TIE)
    return split_scan(out).drop("finding_counts")


def with_scan(df):
    """The scan key as one column, for operators that group by a single key."""
    return df.withColumn("scan", F.struct("repo_id", "commit_sha"))


def split_scan(df):
    rest = [c for c in df.columns if c not in ("scan", "repo_id", "commit_sha")]
    return df.select("scan.repo_id", "scan.commit_sha", *rest)


FINDING_KEY = ["repo_id", "commit_sha", "file_path", "line_start", "title"]


def with_latest_remediation(findings, outcomes, key):
    """Findings with the status and tier of their latest remediation (left outer join, null keys match)."""
    rems = outcomes.select(*key, F.col("status"), F.col("tier"),
                           F.xxhash64(*key).alias("remediation_id"),
                           F.lit(None).cast("timestamp_ntz").alias("created_at"))
    latest = (rems.groupBy(*key)
              .agg(F.max_by(F.struct("status", "tier", "remediation_id"),
                            F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")),
                                     "remediation_id")).alias("r"))
              .select(*key, F.col("r.status").alias("remediation_status"),
                      F.col("r.tier").alias("remediation_tier")))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"m.{k}").eqNullSafe(F.col(f"l.{k}"))
    return findings.alias("m").join(latest.alias("l"), same, "left").select("m.*", "l.remediation_status", "l.remediation_tier")


def register_all() -> None:
    @register("static_findings", merged_oracle())
    def q_static_findings(spark, sf_dir):
        _, _, merged, _ = _merged(spark, sf_dir)
        return rule_out(merged)

    @register("scan_reports_static", scan_reports_oracle())
    def q_scan_reports_static(spark, sf_dir):
        files, el, merged, rejected = _merged(spark, sf_dir)
        return _reports(merged, el, rejected)

    @register("all_findings", merged_oracle(STATIC_KEYS + PYTHON_KEYS))
    def q_all_findings(spark, sf_dir):
        files, el = corpus(spark, sf_dir)
        return rule_out(mg.merge_findings(mg.all_findings(files, el)))

    @register("scan_reports", scan_reports_oracle(STATIC_KEYS + PYTHON_KEYS))
    def q_scan_reports(spark, sf_dir):
        files, el, merged, rejected = _merged_all(spark, sf_dir)
        return _reports(merged, el, rejected)


register_all()


def _outcomes_sql() -> str:
    from riskloom.plans.oracle_fixes import proposals_sql
    from riskloom.sources.fixtures import duck_view
    return proposals_sql(_merged_sql(STATIC_KEYS + PYTHON_KEYS), duck_view("code_files"))


def register_remediation() -> None:
    from riskloom.operators import fixes as fx_

    @register("fix_proposals", _outcomes_sql() + "SELECT * FROM proposals")
    def q_fix_proposals(spark, sf_dir):
        files, el, merged, _ = _merged_all(spark, sf_dir)
        p = fx_.fix_proposals(merged, files)
        return p.select("repo_id", "commit_sha", "file_path", "line_start", "category", "title", "tier", "target_file",
                        "has_change", F.size("edits").alias("edits"), "guidance")

    @register("remediation_outcome", _outcomes_sql() + "SELECT * FROM outcomes")
    def q_remediation_outcome(spark, sf_dir):
        files, el = corpus(spark, sf_dir)
        merged = mg.merge_findings(mg.all_findings(files, el))
        return fx_.remediation_outcomes(fx_.fix_proposals(merged, files), files)


register_remediation()


def register_context() -> None:
    from riskloom.operators import enrich as en
    from riskloom.plans import oracle_parts as op

    ctx_oracle = _merged_sql(STATIC_KEYS + PYTHON_KEYS).rstrip() + ",\n" + op.code_prefix().replace("WITH ", "", 1).rstrip() + f""",
fl AS (
  SELECT m.repo_id, m.commit_sha, m.file_path, m.line_start, m.line_end, m.title, m.detector,
         coalesce(m.line_start, 1) AS a0, x.line_no, x.ltext,
         max(x.line_no) OVER (PARTITION BY m.repo_id, m.commit_sha, m.file_path, m.line_start, m.title, m.detector) AS n
  FROM merged m JOIN (
    SELECT repo_id, commit_sha, file_path, unnest(string_split(content, chr(10))) AS ltext,
           generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM code_files) x
    ON x.repo_id = m.repo_id AND x.commit_sha = m.commit_sha AND x.file_path = m.file_path),
win AS (
  SELECT *, greatest(1, a0 - 12) AS s, least(n, least(greatest(coalesce(line_end, a0), a0), n) + 12) AS e FROM fl)
SELECT repo_id, commit_sha, file_path, line_start, title, detector, CAST(s AS INTEGER) AS context_start,
       CAST(e AS INTEGER) AS context_end,
       left(string_agg(printf('%5d: %s', line_no, ltext), chr(10) ORDER BY line_no), 12000) AS context
FROM win WHERE a0 BETWEEN 1 AND n AND line_no BETWEEN s AND e
GROUP BY repo_id, commit_sha, file_path, line_start, title, detector, s, e"""

    @register("code_context", ctx_oracle)
    def q_code_context(spark, sf_dir):
        files, el, merged, _ = _merged_all(spark, sf_dir)
        c = en.code_context(merged, files)
        return c.where(F.col("context").isNotNull()).select(
            "repo_id", "commit_sha", "file_path", "line_start", "title", "detector", F.col("context_start").cast("int"),
            F.col("context_end").cast("int"), "context")

    @register("reasoning_requests")
    def q_reasoning_requests(spark, sf_dir):
        files, el, merged, _ = _merged_all(spark, sf_dir)
        return en.reasoning_requests(en.code_context(merged, files))

    @register("report_markdown")
    def q_report_markdown(spark, sf_dir):
        from riskloom.operators import findings as fnd
        from riskloom.operators import fixes as fx_
        from riskloom.session import cut_lineage
        files, el, merged, rejected = _merged_all(spark, sf_dir)
        # merged findings and the per-scan report rows are read by many branches: materialise once
        merged = cut_lineage(merged)
        keyed = with_scan(merged.withColumn("_det", mg.detector_rank(F.col("detector"))))
        inv = with_scan(mg.gate(src.repo_inventory(el), rejected=rejected)).select("scan", "files_scanned")
        reports = cut_lineage(rpt.scan_reports(keyed, inv, scan_col="scan", tie=CORPUS_TIE))
        outcomes = fx_.remediation_outcomes(fx_.fix_proposals(merged, files), files)
        ranked = with_latest_remediation(keyed, outcomes, [*FINDING_KEY, "category"]).withColumn(
            "finding_id", F.xxhash64("file_path", "line_start", "title", "category"))
        ranked = fnd.row_number_skew_safe(
            ranked.withColumn("_sev", rpt.severity_rank(F.col("severity"))).withColumn("_nc", -F.col("confidence")),
            ["scan", "_sev"], ["_nc", "file_path", "_det", "line_start", "title"], out="sev_position")
        recs = fnd.recommendations(keyed.withColumn("finding_id", F.lit(0)), scan_col="scan",
                                   tie=["_det", "line_start", "title"])
        return split_scan(rpt.report_lines(reports, ranked, recs, scan_col="scan"))


register_context()


def register_remediation_views() -> None:
    from riskloom.operators import fixes as fx_
    from riskloom.operators import remediate as rem
    from riskloom.plans import oracle_parts as op
    from riskloom.session import cut_lineage

    def _outcomes(spark, sf_dir):
        files, el = corpus(spark, sf_dir)
        merged = cut_lineage(mg.merge_findings(mg.all_findings(files, el)))
        outcomes = fx_.remediation_outcomes(fx_.fix_proposals(merged, files), files)
        return merged, outcomes

    @register("report_findings")
    def q_report_findings(spark, sf_dir):
        """Every merged finding with its latest remediation (left outer join)."""
        merged, outcomes = _outcomes(spark, sf_dir)
        joined = with_latest_remediation(merged, outcomes, FINDING_KEY)
        return joined.select(*RULE_OUTPUT, "description", "fix_suggestion",
                                                       "remediation_status", "remediation_tier")

    @register("report_finding_status", _outcomes_sql() + f"""
SELECT {', '.join('m.' + c for c in RULE_OUTPUT)}, o.status AS remediation_status, o.tier AS remediation_tier
FROM merged m LEFT JOIN (SELECT repo_id, commit_sha, file_path, line_start, title, max(status) AS status, max(tier) AS tier FROM outcomes GROUP BY ALL) o
  ON o.repo_id = m.repo_id AND o.commit_sha = m.commit_sha AND o.file_path = m.file_path AND o.line_start IS NOT DISTINCT FROM m.line_start AND o.title = m.title""")
    def q_report_finding_status(spark, sf_dir):
        """Findings with status and tier of their latest remediation (report_findings without its prose columns)."""
        merged, outcomes = _outcomes(spark, sf_dir)
        return with_latest_remediation(merged, outcomes, FINDING_KEY).select(*RULE_OUTPUT, "remediation_status", "remediation_tier")

    # fixed values: categories whose fixes need approval
    tier_two = op.sql_in(["hardcoded_auth_bypass", "auth_bypass", "obfuscated_dynamic_execution", "obfuscated_code",
                          "suspicious_dynamic_execution"])

    @register("approvable", _merged_sql(STATIC_KEYS + PYTHON_KEYS) + f"""
SELECT repo_id, commit_sha, file_path, line_start, title, 2 AS tier, 'pending_approval' AS status,
       'riskloom/' || repo_id || '/' || md5(concat_ws('|', commit_sha, file_path, CAST(line_start AS VARCHAR), title)) AS branch
FROM merged WHERE category IN {tier_two}""")
    def q_approvable(spark, sf_dir):
        """Tier-2 proposals waiting for approval, with their branch name."""
        _, outcomes = _outcomes(spark, sf_dir)
        pending = rem.approvable(outcomes)
        return pending.select("repo_id", "commit_sha", "file_path", "line_start", "title", "tier", "status",
                              rem.branch_name("riskloom", F.col("repo_id"),
                                              F.md5(F.concat_ws("|", "commit_sha", "file_path", F.col("line_start").cast("string"), "title"))).alias("branch"))


register_remediation_views()
