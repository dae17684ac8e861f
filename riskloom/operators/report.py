"""Per-scan aggregation and reporting.

All per-scan numbers are aggregations (partial aggregation before the
shuffle). The Markdown export is produced as rows ``(scan, line_no, text)``
so no scan's findings are ever collected into one value; the text sink
writes one file per scan from those rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import findings as fnd
from riskloom.operators.catalog import PRODUCT_NAME, SEVERITIES, severity_rank, severity_weight

SCORE = T.DecimalType(4, 1)


def severity_counts(findings: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """A1: five zero-filled severity counts per scan."""
    aggs = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy(scan_col).agg(*aggs, F.count(F.lit(1)).alias("total"))


def risk_score(findings: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """A2: ``min(100, sum(weight x confidence))`` rounded HALF_UP to 0.1, in DECIMAL."""
    points = severity_weight(F.col("severity")).cast(T.DecimalType(4, 0)) * F.col("confidence")
    total = F.sum(points)
    score = F.round(F.least(total, F.lit(Decimal("100")).cast(total_type())), 1)
    return findings.groupBy(scan_col).agg(score.cast(SCORE).alias("overall_risk_score"))


def total_type() -> T.DecimalType:
    return T.DecimalType(38, 2)


def risk_band(score: Column) -> Column:
    """>= 70 high, >= 40 medium, else low."""
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def _fmt_decimal(col: Column) -> Column:
    return col.cast("string")


def executive_summary(df: DataFrame) -> Column:
    """A3: two or three fixed sentences from counts, score and the top finding.

    ``df`` carries files_scanned, total, the five counts, overall_risk_score and
    top_title/top_path/top_line.
    """
    first = F.format_string(f"{PRODUCT_NAME} scanned %d eligible files and recorded %d security findings.",
                            F.coalesce(F.col("files_scanned"), F.lit(0)), F.col("total"))
    parts = F.filter(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(" " + s)))
                               for s in SEVERITIES]), lambda x: x.isNotNull())
    second = F.concat(F.lit("The overall risk score is "), _fmt_decimal(F.col("overall_risk_score")),
                      F.lit("/100, with "), F.array_join(parts, ", "), F.lit(" findings."))
    location = F.concat(F.lit(" in "), F.col("top_path"),
                        F.when(F.col("top_line").isNotNull() & (F.col("top_line") != 0),
                               F.concat(F.lit(" line "), F.col("top_line").cast("string"))).otherwise(F.lit("")))
    third = F.concat(F.lit("Prioritize "), F.col("top_title"), location,
                     F.lit(", then review the linked remediation recommendations."))
    empty = F.lit("No static findings were persisted for this scan; continue normal secure-development review.")
    return F.when(F.size(parts) > 0, F.concat_ws(" ", first, second, third)).otherwise(F.concat_ws(" ", first, empty))


def scan_reports(findings: DataFrame, scans: DataFrame, scan_col: str = "scan_id", tie=None) -> DataFrame:
    """A4: one report row per scan in ``scans`` (scan_col, files_scanned):
    zero-filled counts, score, band, summary. Scans without findings still
    get a report."""
    counts = severity_counts(findings, scan_col)
    scores = risk_score(findings, scan_col)
    top = fnd.top_finding(findings, scan_col, tie=tie).select(
        scan_col, F.col("title").alias("top_title"), F.col("file_path").alias("top_path"),
        F.col("line_start").alias("top_line"))
    df = scans.select(scan_col, "files_scanned").join(counts, scan_col, "left").join(scores, scan_col, "left") \
        .join(top, scan_col, "left")
    df = df.na.fill(0, [*SEVERITIES, "total"]).withColumn(
        "overall_risk_score", F.coalesce(F.col("overall_risk_score"), F.lit(Decimal("0.0")).cast(SCORE)))
    counts_map = F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.col(s))])
    return df.select(scan_col, "files_scanned", "overall_risk_score",
                     risk_band(F.col("overall_risk_score")).alias("risk_band"),
                     counts_map.alias("finding_counts"), *SEVERITIES, "total", executive_summary(df).alias("summary"))


def latest_remediation(remediations: DataFrame) -> DataFrame:
    """A5: newest remediation per finding; NULL created_at counts as oldest."""
    ts = F.coalesce(F.col("created_at"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    cols = [c for c in remediations.columns if c != "finding_id"]
    best = F.max_by(F.struct(*cols), F.struct(ts.alias("t"), F.col("remediation_id").alias("i")))
    return remediations.groupBy("finding_id").agg(best.alias("r")).select("finding_id", "r.*")


def report_findings(findings: DataFrame, remediations: DataFrame) -> DataFrame:
    """Findings with their latest remediation (nullable) - left outer join."""
    latest = latest_remediation(remediations)
    lat = latest.select("finding_id", *[F.col(c).alias("remediation_" + c) if not c.startswith("remediation")
                                        else F.col(c) for c in latest.columns if c != "finding_id"])
    return findings.join(lat, "finding_id", "left")


def pending_reports(scans: DataFrame, reports: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """Scans with no report yet (left anti join)."""
    return scans.join(reports.select(scan_col), scan_col, "left_anti")


def findings_by_severity(findings: DataFrame, scan_col: str = "scan_id", tie=None) -> DataFrame:
    """The non-empty severity groups of each scan, in severity order, with
    their size and leading finding (rows, not collected lists)."""
    key = F.struct((-F.col("confidence")).alias("c"), F.col("file_path").alias("p"),
                   *[F.col(c) for c in fnd._tie(findings, tie)])
    grouped = (findings.groupBy(scan_col, "severity")
               .agg(F.count(F.lit(1)).alias("findings"),
                    F.min_by("finding_id", key).alias("lead_finding_id")))
    return grouped.select(scan_col, severity_rank(F.col("severity")).alias("group_order"), "severity",
                          "findings", "lead_finding_id")


# Scan stages shown as progress (A10).
STAGES = ["queued", "cloning", "static_scan", "ai_review", "merging", "complete"]


def scan_progress(status: Column) -> Column:
    """A10: failed 100, queued 3, otherwise stage index / 5 as a percent."""
    expr = F.lit(0)
    for i, s in reversed(list(enumerate(STAGES))):
        expr = F.when(status == s, F.lit(round(i / (len(STAGES) - 1) * 100))).otherwise(expr)
    return F.when(status == "failed", 100).when(status == "queued", 3).otherwise(expr)


def report_lines(reports: DataFrame, ranked: DataFrame, recs: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """The Markdown report as ``(scan, line_no, text)`` rows.

    Findings keep their per-scan rank; a section's lines are numbered from
    offsets derived from the per-severity counts, so nothing is concatenated
    per scan. Snippets are never rendered.
    """
    sev_pos = {s: i for i, s in enumerate(SEVERITIES)}
    # header block (lines 0..13)
    header = reports.select(scan_col, F.posexplode(F.array(
        F.lit(f"# {PRODUCT_NAME} Security Report"), F.lit(""), F.lit("## Executive Summary"), F.lit(""),
        F.col("summary"), F.lit(""), F.lit("## Risk Score"), F.lit(""),
        F.concat(F.lit("**"), F.col("overall_risk_score").cast("string"), F.lit("/100**")), F.lit(""),
        F.lit("Formula: `min(100, Σ severity weight × confidence)` using critical=35, high=18, "
              "medium=8, low=3, info=0."),
        F.lit(""), F.lit("## Findings by Severity"), F.lit(""))).alias("n", "text"))
    header = header.select(scan_col, F.lit(0).alias("section"), F.lit(0).alias("sub"), F.col("n").cast("long"),
                           "text")
    # each severity section: heading (2 lines) + 4 lines per finding, or "None." + ""
    sec_rows = []
    for s in SEVERITIES:
        c = F.col(s)
        sec_rows.append(reports.select(
            scan_col, F.lit(1 + sev_pos[s]).alias("section"), F.lit(0).alias("sub"),
            F.posexplode(F.when(c > 0, F.array(F.concat(F.lit(f"### {s.title()} ("), c.cast("string"), F.lit(")")),
                                               F.lit("")))
                         .otherwise(F.array(F.concat(F.lit(f"### {s.title()} (0)")), F.lit(""), F.lit("None."),
                                            F.lit("")))).alias("n", "text")).select(
            scan_col, "section", "sub", F.col("n").cast("long"), "text"))
    # finding lines: position within severity = rank among same-severity rows
    loc = F.concat(F.col("file_path"), F.when(F.col("line_start").isNotNull() & (F.col("line_start") != 0),
                                              F.concat(F.lit(":"), F.col("line_start").cast("string")))
                   .otherwise(F.lit("")))
    body = F.array(
        F.concat(F.lit("- **"), F.col("title"), F.lit("** — `"), loc, F.lit("` (confidence: "),
                 F.col("confidence").cast("string"), F.lit(")")),
        F.concat(F.lit("  - "), F.coalesce(F.col("description"), F.lit(""))),
        F.concat(F.lit("  - Remediation status: "), F.coalesce(F.col("remediation_status"), F.lit("not proposed"))),
        F.lit(""))
    fl = ranked.select(scan_col, (F.lit(1) + severity_rank(F.col("severity"))).alias("section"),
                       F.col("sev_position").alias("pos"), F.posexplode(body).alias("k", "text"))
    fl = fl.select(scan_col, "section", F.lit(1).alias("sub"),
                   ((F.col("pos") - 1) * 4 + F.col("k")).cast("long").alias("n"), "text")
    rec_head = reports.select(scan_col, F.lit(6).alias("section"), F.lit(0).alias("sub"),
                              F.posexplode(F.array(F.lit("## Recommendations"), F.lit(""))).alias("n", "text"))
    rec_head = rec_head.select(scan_col, "section", "sub", F.col("n").cast("long"), "text")
    rec_body = recs.select(scan_col, F.lit(6).alias("section"), F.lit(1).alias("sub"),
                           (F.col("rec_no") + 1).cast("long").alias("n"),
                           F.concat(F.col("rec_no").cast("string"), F.lit(". "), F.col("fix_suggestion")).alias("text"))
    has_recs = recs.select(scan_col).distinct()
    no_recs = (reports.select(scan_col).join(has_recs, scan_col, "left_anti")
               .select(scan_col, F.lit(6).alias("section"), F.lit(1).alias("sub"), F.lit(2).cast("long").alias("n"),
                       F.lit("No remediation recommendations were generated for this scan.").alias("text")))
    tail = reports.select(scan_col, F.lit(7).alias("section"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("n"),
                          F.lit("").alias("text"))
    parts = [header, *sec_rows, fl.select(scan_col, "section", "sub", "n", "text"), rec_head, rec_body, no_recs, tail]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(scan_col, "section", "sub", "n", "text")


def write_markdown(lines: DataFrame, path: str, scan_col: str = "scan_id") -> None:
    """Report sink: lines in report order, range-partitioned, so a scan with very many findings spans many files
    and the number of files follows the data, not the number of scans."""
    order = [scan_col, "section", "sub", "n"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
