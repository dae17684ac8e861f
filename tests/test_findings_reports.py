"""Finding-table transforms, reports, enrichment and remediation state."""

from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import enrich as en
from riskloom.operators import findings as fnd
from riskloom.operators import remediate as rem
from riskloom.operators import report as rpt
from riskloom.operators.catalog import PRODUCT_NAME

SCHEMA = ("finding_id BIGINT, scan_id BIGINT, detector STRING, category STRING, severity STRING, "
          "confidence DECIMAL(3,2), file_path STRING, line_start INT, title STRING, fix_suggestion STRING")


def findings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(fid, scan, sev, conf, path="app.py", line=7, title="t", cat="c", fix="fix"):
    return (fid, scan, "d", cat, sev, Decimal(conf), path, line, title, fix)


def test_risk_score_maths(spark):
    rows = [row(1, 1, "critical", "1.00")]
    rows += [row(10 + i, 2, "low", "1.00", title=f"l{i}") for i in range(5)]
    rows += [row(20, 3, "critical", "0.20")]
    rows += [row(30 + i, 4, "critical", "1.00", title=f"c{i}") for i in range(3)]
    got = {r.scan_id: r.overall_risk_score for r in rpt.risk_score(findings(spark, rows)).collect()}
    assert got == {1: Decimal("35.0"), 2: Decimal("15.0"), 3: Decimal("7.0"), 4: Decimal("100.0")}


def test_dedupe_keeps_max_confidence_first_on_tie_null_line_is_a_key(spark):
    rows = [row(1, 1, "high", "0.50"), row(2, 1, "high", "0.90"), row(3, 1, "high", "0.90"),
            row(4, 1, "low", "0.10", line=None), row(5, 1, "low", "0.20", line=None)]
    got = sorted((r.finding_id, r.confidence) for r in fnd.dedupe_findings(findings(spark, rows)).collect())
    assert got == [(2, Decimal("0.90")), (5, Decimal("0.20"))]


def test_skew_safe_row_number_equals_window(spark):
    # one scan holds most rows: it must span several range partitions
    rows = [row(i, 0 if i % 10 else i % 7 + 1, ["critical", "high", "low"][i % 3], f"0.{i % 90 + 10}",
                path=f"f{i % 13}.py", title=f"t{i}") for i in range(3000)]
    df = findings(spark, rows)
    ours = {(r.scan_id, r.finding_id): r.position for r in fnd.rank_findings(df).collect()}
    sev = rpt.severity_rank(F.col("severity")) if hasattr(rpt, "severity_rank") else None
    w = Window.partitionBy("scan_id").orderBy(sev, F.col("confidence").desc(), "file_path", "finding_id")
    ref = {(r.scan_id, r.finding_id): r.p for r in df.withColumn("p", F.row_number().over(w)).collect()}
    assert ours == ref


def test_top_k_and_recommendations(spark):
    rows = [row(i, 1, "high" if i < 3 else "low", "0.50", fix=f"fix-{i % 2}") for i in range(10)]
    df = findings(spark, rows)
    top = fnd.top_k_per_group(df, ["scan_id"], [F.col("finding_id").desc()], 3, tie_cols=["finding_id"])
    assert sorted(r.finding_id for r in top.collect()) == [7, 8, 9]
    recs = [(r.rec_no, r.fix_suggestion) for r in fnd.recommendations(df).orderBy("rec_no").collect()]
    assert recs == [(1, "fix-0"), (2, "fix-1")]


def test_reports_cover_scans_without_findings(spark):
    df = findings(spark, [row(1, 1, "critical", "1.00", path="a.py", line=3, title="Top")])
    scans = spark.createDataFrame([(1, 5), (2, 0)], "scan_id BIGINT, files_scanned BIGINT")
    reps = {r.scan_id: r for r in rpt.scan_reports(df, scans).collect()}
    assert reps[1].summary == (f"{PRODUCT_NAME} scanned 5 eligible files and recorded 1 security findings. "
                               "The overall risk score is 35.0/100, with 1 critical findings. "
                               "Prioritize Top in a.py line 3, then review the linked remediation recommendations.")
    assert reps[2].total == 0 and reps[2].overall_risk_score == Decimal("0.0") and reps[2].risk_band == "low"


def test_enrichment_delta_rule_and_row_count(spark):
    base = findings(spark, [row(1, 1, "high", "0.50"), row(2, 1, "high", "0.50"), row(3, 1, "low", "0.40"),
                            row(4, 1, "low", "0.40")])
    resp = spark.createDataFrame([
        (1, '{"severity":"critical","confidence":0.91,"explanation":"x","fix_suggestion":"f","exploitability_notes":"n"}'),
        (2, '{"severity":"high","confidence":0.60,"explanation":"x","fix_suggestion":"f","exploitability_notes":"n"}'),
        (3, '{"severity":"high","confidence":true,"explanation":"x","fix_suggestion":"f","exploitability_notes":"n"}'),
        (4, 'not json')], "finding_id BIGINT, output_text STRING")
    out = {r.finding_id: r for r in en.enrich_findings(base, resp).collect()}
    assert len(out) == 4
    assert (out[1].severity, out[1].confidence) == ("critical", Decimal("0.91"))
    assert (out[2].severity, out[2].confidence) == ("high", Decimal("0.50"))  # |0.60-0.50| < 0.15: kept
    assert out[2].ai_explanation == "x\n\nExploitability notes: n"
    assert (out[3].severity, out[3].confidence, out[3].ai_explanation) == ("low", Decimal("0.40"), None)
    reasons = {r.finding_id: r.reason for r in en.reasoning_valid(resp).collect()}
    assert reasons == {1: None, 2: None, 3: "confidence_not_number", 4: "not_json"}


def test_tiers_and_transitions(spark):
    cats = ["hardcoded_secret", "insecure_config", "typosquatted_dependency", "committed_env_file",
            "hardcoded_auth_bypass", "obfuscated_dynamic_execution", "suspicious_outbound_connection", "other"]
    df = spark.createDataFrame([(c,) for c in cats], "category string")
    assert [r.tier for r in rem.with_tier(df).collect()] == [1, 1, 1, 1, 2, 2, 3, 3]
    ev = spark.createDataFrame([
        (1, 10, "2024-01-01 00:00:00", "proposed"), (2, 10, "2024-01-01 00:01:00", "pending_approval"),
        (3, 10, "2024-01-01 00:02:00", "approved"), (4, 10, "2024-01-01 00:03:00", "verifying"),
        (5, 10, "2024-01-01 00:04:00", "pr_opened"), (6, 11, "2024-01-01 00:00:00", "proposed"),
        (7, 11, "2024-01-01 00:05:00", "pr_opened")],
        "event_id BIGINT, remediation_id BIGINT, ts STRING, status STRING").withColumn("ts", F.col("ts").cast("timestamp"))
    bad = [(r.remediation_id, r.from_status, r.to_status) for r in rem.invalid_transitions(ev).collect()]
    assert bad == [(11, "proposed", "pr_opened")]


def test_entry_contract(spark):
    import __spark_entry__ as entry
    qs, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(qs)
    df = entry.entry(spark)
    assert df.count() >= 0 and "summary" in df.columns


def test_library_views(spark):
    f = spark.createDataFrame([(1, 10, "2024-01-02"), (2, 10, "2024-01-01"), (3, 11, "2024-01-01")],
                              "finding_id BIGINT, scan_id BIGINT, created_at STRING")
    scans = spark.createDataFrame([(10, 100), (11, 101), (12, 100)], "scan_id BIGINT, project_id BIGINT")
    projects = spark.createDataFrame([(100, 7, "2024-01-01"), (101, 8, "2024-02-01"), (102, 7, "2024-03-01")],
                                     "project_id BIGINT, owner_id BIGINT, created_at STRING")
    assert [r.finding_id for r in fnd.list_findings(f, scans, projects, 7).collect()] == [2, 1]
    assert [r.project_id for r in fnd.list_projects(projects, 7).collect()] == [102, 100]
    marks = spark.createDataFrame([(2, True)], "finding_id BIGINT, is_false_positive BOOLEAN")
    assert {r.finding_id: r.is_false_positive for r in fnd.mark_false_positive(f, marks).collect()} == \
        {1: False, 2: True, 3: False}
    rems = spark.createDataFrame([(1, 50, "2024-01-01 00:00:00", "failed"), (1, 51, None, "proposed"),
                                  (1, 52, "2024-01-02 00:00:00", "pending_approval")],
                                 "finding_id BIGINT, remediation_id BIGINT, created_at STRING, status STRING") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    latest = rpt.latest_remediation(rems).collect()
    assert [(r.finding_id, r.remediation_id, r.status) for r in latest] == [(1, 52, "pending_approval")]
    rf = {r.finding_id: r.remediation_status for r in rpt.report_findings(f, rems).collect()}
    assert rf == {1: "pending_approval", 2: None, 3: None}
    reports = spark.createDataFrame([(10,)], "scan_id BIGINT")
    assert sorted(r.scan_id for r in rpt.pending_reports(scans, reports).collect()) == [11, 12]
    latest2 = spark.createDataFrame([(1, 2, "pending_approval"), (2, 1, "pending_approval"), (3, 2, "approved")],
                                    "id BIGINT, tier INT, status STRING")
    assert [r.id for r in rem.approvable(latest2).collect()] == [1]
    b = spark.range(1).select(rem.branch_name("riskloom", F.lit(5), F.lit(9)).alias("b")).first().b
    assert b == "riskloom/5/9"
    v = spark.createDataFrame([('{"notes": "  ", "error": "boom"}',)], "j string") \
        .select(rem.failure_reason(F.parse_json("j")).alias("r")).first().r
    assert v == "boom"
    assert spark.range(1).select(rpt.scan_progress(F.lit("static_scan")).alias("p")).first().p == 40


def test_stored_table_checks(spark):
    reports = spark.createDataFrame([(1, Decimal("100.0")), (2, Decimal("100.1")), (3, None)], "scan_id BIGINT, overall_risk_score DECIMAL(4,1)")
    rems = spark.createDataFrame([(1, 1, "approved"), (2, 4, "failed"), (3, 2, "lost")], "remediation_id BIGINT, tier INT, status STRING")
    scans = spark.createDataFrame([(1, "complete"), (2, "paused")], "scan_id BIGINT, status STRING")
    got = sorted((r.table, r.id, r.reason) for r in rem.dq_table_violations(reports, rems, scans).collect())
    assert got == [("remediations", "2", "unknown_tier"), ("remediations", "3", "unknown_status"), ("reports", "2", "score_out_of_range"),
                   ("reports", "3", "score_out_of_range"), ("scans", "2", "unknown_status")]


def test_two_commits_of_a_repository_are_two_scans(spark, make_files):
    from riskloom.operators import merge as mg
    from riskloom.plans.q_corpus import _reports
    from riskloom.sources.files import eligible_files
    one = make_files({"r": {"a.py": "DEBUG = True\n", "b.py": "x = 1\n"}})
    files = one.union(make_files({"r": {"a.py": "x = 1\n"}}).withColumn("commit_sha", F.lit("other")))
    el = eligible_files(files)
    rows = {(r.repo_id, r.commit_sha): (r.files_scanned, r.total) for r in _reports(mg.merge_findings(mg.static_findings(files, el)), el).collect()}
    assert rows == {("r", "sha-r"): (2, 1), ("r", "other"): (1, 0)}


def test_a_valid_verdict_wins_over_other_responses(spark):
    good = '{"severity":"high","confidence":0.9,"explanation":"e","fix_suggestion":"f","exploitability_notes":"n"}'
    worse = good.replace("high", "low")
    responses = spark.createDataFrame([(1, "Sorry, retry"), (1, worse), (1, good), (2, "no")], "finding_id BIGINT, output_text STRING")
    got = {r.finding_id: r.ai_severity for r in en.best_verdicts(responses).collect()}
    assert got == {1: "high"}


def test_last_address_of_a_line_stays(spark, make_files):
    from riskloom.operators import network_rules as net
    from riskloom.sources.files import eligible_files
    el = eligible_files(make_files({"r": {"a.py": "a('http://9.9.9.9/x'); b('http://10.0.0.1/y')\n"}}))
    got = net.backdoor_dedupe(net.raw_ip_url(el)).collect()
    assert len(got) == 1 and "10.0.0.1" in got[0].description
