"""Remediation tables: tiers, guidance, state audit, eligibility.

Fix templates (M3-M9) live in ``fixes.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import findings as fnd
from riskloom.operators.catalog import PRODUCT_NAME

# Category -> remediation tier.
TIER_ONE = ["hardcoded_secret", "insecure_config", "typosquatted_dependency", "committed_env_file"]
TIER_TWO = ["hardcoded_auth_bypass", "auth_bypass", "obfuscated_dynamic_execution", "obfuscated_code",
            "suspicious_dynamic_execution"]
TIER_THREE = ["suspicious_outbound_connection", "suspicious_install_script"]

# Tier guidance sentences.
TIER_GUIDANCE = {
    1: f"A deterministic patch can be prepared on an isolated {PRODUCT_NAME} branch.",
    2: "This fix is proposed only and requires explicit human approval before verification or PR creation.",
    3: "This finding is flagged-only because automated changes could disrupt valid business behavior.",
}

# Remediation statuses and allowed transitions.
REMEDIATION_STATUSES = ["proposed", "pending_approval", "approved", "verifying", "pr_opened", "rejected", "failed"]
ALLOWED_TRANSITIONS = [
    ("proposed", "pending_approval"), ("proposed", "verifying"), ("proposed", "rejected"), ("proposed", "failed"),
    ("pending_approval", "approved"), ("pending_approval", "rejected"),
    ("approved", "verifying"), ("approved", "failed"),
    ("verifying", "pr_opened"), ("verifying", "failed"),
]
SCAN_STATUSES = ["queued", "cloning", "static_scan", "ai_review", "merging", "complete", "failed"]


def tier(category: Column) -> Column:
    return (F.when(category.isin(TIER_ONE), F.lit(1))
             .when(category.isin(TIER_TWO), F.lit(2))
             .otherwise(F.lit(3)))


def with_tier(findings: DataFrame, existing_tier: str | None = None) -> DataFrame:
    """M1: tier from category; an existing remediation's tier wins when present."""
    t = tier(F.col("category"))
    if existing_tier:
        t = F.coalesce(F.col(existing_tier), t)
    return findings.withColumn("tier", t)


def tier_guidance(t: Column) -> Column:
    expr = F.lit(TIER_GUIDANCE[3])
    for k in (2, 1):
        expr = F.when(t == k, F.lit(TIER_GUIDANCE[k])).otherwise(expr)
    return expr


def transitions_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLOWED_TRANSITIONS, "from_status string, to_status string")


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Status changes not in the allowed edge set.

    The predecessor of each event is found by numbering events per
    remediation with the skew-safe row number and joining position n to n-1
    (an equi-join AQE can split), then anti-joining the small edge table.
    """
    spark = events.sparkSession
    numbered = fnd.row_number_skew_safe(events, ["remediation_id"], ["ts", "event_id"], out="seq")
    prev = numbered.select("remediation_id", (F.col("seq") + 1).alias("seq"),
                           F.col("status").alias("from_status"), F.col("event_id").alias("prev_event_id"))
    pairs = numbered.join(prev, ["remediation_id", "seq"]).withColumnRenamed("status", "to_status")
    bad = pairs.join(F.broadcast(transitions_frame(spark)), ["from_status", "to_status"], "left_anti")
    return bad.select("remediation_id", "event_id", "prev_event_id", "from_status", "to_status", "ts")


def current_status(events: DataFrame, key: str = "remediation_id") -> DataFrame:
    """Latest status per key (max_by over (ts, event_id)); an aggregation."""
    return (events.groupBy(key)
                  .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"),
                       F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("events")))


def approvable(latest: DataFrame) -> DataFrame:
    """Tier 2 remediations waiting for approval."""
    return latest.where((F.col("tier") == 2) & (F.col("status") == "pending_approval"))


def failure_reason(verification: Column) -> Column:
    """First non-blank of notes / error / message in the verification JSON."""
    def field(name):
        v = F.call_function("try_variant_get", verification, F.lit(f"$.{name}"), F.lit("string"))
        return F.nullif(F.trim(v), F.lit(""))
    return F.coalesce(field("notes"), field("error"), field("message"))


def branch_name(prefix: str, scan_id: Column, finding_id: Column) -> Column:
    """``<prefix>/<scan>/<finding>``."""
    return F.concat_ws("/", F.lit(prefix), scan_id.cast("string"), finding_id.cast("string"))


def remediation_outcome(proposals: DataFrame) -> DataFrame:
    """Tier 1 -> verified or failed; tier 2 -> pending_approval; tier 3 -> rejected."""
    status = (F.when(F.col("tier") == 3, F.lit("rejected"))
               .when(F.col("tier") == 2, F.lit("pending_approval"))
               .when(~F.col("has_change") | ~F.coalesce(F.col("valid"), F.lit(False)), F.lit("failed"))
               .otherwise(F.lit("verifying")))
    return proposals.withColumn("status", status)


def dq_table_violations(reports: DataFrame, remediations: DataFrame, scans: DataFrame) -> DataFrame:
    """M16, the other stored tables: (table, id, reason) of rows outside their allowed values."""
    def broken(df: DataFrame, table: str, key: str, reason: str, ok: Column) -> DataFrame:
        return df.where(~F.coalesce(ok, F.lit(False))).select(
            F.lit(table).alias("table"), F.col(key).cast("string").alias("id"), F.lit(reason).alias("reason"))

    return (broken(reports, "reports", "scan_id", "score_out_of_range", F.col("overall_risk_score").between(0, 100))
            .unionByName(broken(remediations, "remediations", "remediation_id", "unknown_tier", F.col("tier").isin(1, 2, 3)))
            .unionByName(broken(remediations, "remediations", "remediation_id", "unknown_status", F.col("status").isin(REMEDIATION_STATUSES)))
            .unionByName(broken(scans, "scans", "scan_id", "unknown_status", F.col("status").isin(SCAN_STATUSES))))


def dq_violations(findings: DataFrame) -> DataFrame:
    """Rows breaking the stored-table checks, with a reason."""
    from riskloom.operators.catalog import SEVERITIES
    checks = [
        ("confidence_out_of_range", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
        ("unknown_severity", ~F.col("severity").isin(SEVERITIES)),
    ]
    out = None
    for reason, cond in checks:
        part = findings.where(F.coalesce(cond, F.lit(True))).select("finding_id", F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out
