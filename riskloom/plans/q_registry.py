"""Rules inside a failure boundary, the findings sink, the mark log and the table checks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import dependency_rules as dep
from riskloom.operators import findings as fnd
from riskloom.operators import rules as rl
from riskloom.operators.catalog import CONFIDENCE
from riskloom.operators.quality import Quality
from riskloom.plans import oracle_parts as op
from riskloom.plans.q_code import corpus
from riskloom.plans.registry import register
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import fixtures as fx
from riskloom.sources import sinks


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _rows(df, line, snippet, title: str):
    """A registered rule's rows on the finding shape."""
    values = {"detector": "site_rules", "category": "site_policy", "severity": "low", "title": title, "description": title, "fix_suggestion": ""}
    return df.select("repo_id", "commit_sha", "file_path", line.cast("int").alias("line_start"), line.cast("int").alias("line_end"),
                     F.lit(0.5).cast(CONFIDENCE).alias("confidence"), snippet.alias("code_snippet"), *[F.lit(v).alias(k) for k, v in values.items()])


def long_notes(x: rl.ScanInputs):
    """A rule of a user: notes of over 2,000 characters."""
    notes = x.eligible.where(F.col("file_path").startswith("docs/note-") & (F.length("content") > 2000))
    return _rows(notes, F.lit(1), F.length("content").cast("string"), "Long note")


def pinned_numbers(x: rl.ScanInputs):
    """A rule of a user that raises on some scans: it cannot read package numbers that end in 07."""
    pins = x.special.where("file_path = 'requirements.txt'").withColumn("number", F.regexp_extract("content", "pkg([0-9]+)==", 1))
    number = F.when(F.col("number").endswith("07"), F.raise_error(F.concat(F.lit("cannot read pkg"), "number"))).otherwise(F.col("number"))
    return _rows(pins.withColumn("number", number), F.lit(4), F.col("number"), "Pinned number")


def no_such_column(x: rl.ScanInputs):
    """A rule of a user that cannot be planned."""
    return x.eligible.select("no_such_column")


def _registry():
    rules = rl.RuleSet({k: rl.BUILT_IN[k] for k in ("secret_scan", "model_security_rules")})
    for fn in (long_notes, pinned_numbers, no_such_column):
        rules.register_rule(fn.__name__, fn)
    return rules.rules


# stored tables with broken rows: source, columns (the same text in both engines), id
STORED = {
    "findings": ("lineitem", "l_orderkey * 10 + l_linenumber AS finding_id; CAST((35 + l_partkey % 66) / 100.0 AS DECIMAL(4,2)) + CAST(l_discount AS DECIMAL(4,2)) AS confidence; "
                 "CASE l_partkey % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' WHEN 5 THEN 'urgent' END AS severity", "finding_id"),
    "reports": ("orders", "o_orderkey AS scan_id; o_totalprice / 4000 AS overall_risk_score", "scan_id"),
    "remediations": ("events", "event_id AS remediation_id; event_id % 4 AS tier; CASE event_type WHEN 'signup' THEN 'proposed' WHEN 'view' THEN 'pending_approval' "
                     "WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'verifying' ELSE 'stalled' END AS status", "remediation_id"),
    "scans": ("orders", "o_orderkey AS scan_id; CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'static_scan' ELSE 'paused' END AS status", "scan_id"),
}


def cols_of(text: str) -> list[str]:
    return text.split("; ")


def _sql(table: str) -> str:
    return ", ".join(cols_of(STORED[table][1]))


def _counted(key: str, sql: str) -> str:
    return f"SELECT repo_id, commit_sha, '{key}' AS rule, 'finding' AS kind, count(*) AS n FROM ({sql}) x_{key} GROUP BY ALL"


def register_all() -> None:
    from riskloom.plans.registry import ORACLES

    pins = f"""SELECT repo_id, commit_sha, regexp_extract(content, 'pkg([0-9]+)==', 1) AS number FROM eligible WHERE file_path = 'requirements.txt'"""
    built_in = "\nUNION ALL\n".join(f"SELECT repo_id, commit_sha, detector FROM ({ORACLES[k]}) b_{k}" for k in (
        "secret_signatures", "secret_entropy", "model_pickle", "model_torch", "model_joblib"))

    @register("rule_registry", op.code_prefix(f"pins AS ({pins})", f"built_in AS ({built_in})") + f"""
SELECT repo_id, commit_sha, detector AS rule, 'finding' AS kind, count(*) AS n FROM built_in GROUP BY ALL
UNION ALL {_counted("long_notes", "SELECT * FROM eligible WHERE starts_with(file_path, 'docs/note-') AND length(content) > 2000")}
UNION ALL {_counted("pinned_numbers", "SELECT * FROM pins WHERE number NOT LIKE '%07'")}
UNION ALL SELECT repo_id, commit_sha, 'pinned_numbers', 'warning', 1 FROM pins WHERE number LIKE '%07'
UNION ALL SELECT DISTINCT repo_id, commit_sha, 'no_such_column', 'warning', 1 FROM code_files""")
    def q_rule_registry(spark, sf_dir):
        """Findings and warnings per scan and rule; of five rules one raises on some scans and one cannot be planned."""
        files, _ = corpus(spark, sf_dir)
        found, warned = rl.run_rules(rl.ScanInputs.of(files), _registry())
        name = F.when(F.col("detector") == "site_rules", F.when(F.col("title") == "Long note", "long_notes").otherwise("pinned_numbers")).otherwise(F.col("detector"))
        return found.groupBy("repo_id", "commit_sha", name.alias("rule")).agg(F.count(F.lit(1)).alias("n")).select(
            "repo_id", "commit_sha", "rule", F.lit("finding").alias("kind"), "n").unionByName(warned.select(
                "repo_id", "commit_sha", "rule", F.lit("warning").alias("kind"), F.lit(1).cast("long").alias("n")))

    base = fx.duck_with("findings_base")

    @register("findings_sink", base + """
SELECT scan_id, finding_id, severity, CAST(CASE WHEN again AND severity = 'critical' THEN 1 ELSE confidence END AS DECIMAL(3,2)) AS confidence FROM (
  SELECT scan_id, finding_id, severity, confidence, max(created_at) OVER (PARTITION BY scan_id) >= DATE '1998-11-15' AS again FROM findings_base) f
WHERE NOT again OR severity IN ('critical', 'high')""")
    def q_findings_sink(spark, sf_dir):
        """All findings by scan, then a second scan of every scan with recent findings, which now finds critical
        ones with full confidence and high ones; read back from the table."""
        rows = fx.findings_base(spark, sf_dir).select("scan_id", "finding_id", "severity", "confidence", "created_at")
        path, out = _folder(spark, "findings-sink"), ["scan_id", "finding_id", "severity", "confidence"]
        sinks.replace_rows(rows.select(*out), path, ["scan_id"], order=["finding_id"], buckets=16)
        recent = rows.groupBy("scan_id").agg(F.max("created_at").alias("last")).where("last >= DATE '1998-11-15'")
        again = rows.join(recent, "scan_id", "left_semi").where("severity IN ('critical', 'high')").withColumn(
            "confidence", F.when(F.col("severity") == "critical", F.lit(1)).otherwise(F.col("confidence")).cast(CONFIDENCE))
        sinks.replace_rows(again.select(*out), path, ["scan_id"], order=["finding_id"], buckets=16)
        return sinks.read_table(spark, path)

    @register("false_positive_marks", base + f""", marks AS (
  SELECT event_id % 3000 * 10 + 1 AS finding_id, ts, user_id, event_id, event_type IN ('click', 'view') AS fp FROM events),
last AS (SELECT finding_id, arg_max(fp, (ts, user_id, event_id)) AS fp FROM marks GROUP BY finding_id)
SELECT finding_id, scan_id, file_path, coalesce(fp, FALSE) AS is_false_positive FROM findings_base LEFT JOIN last USING (finding_id)""")
    def q_false_positive_marks(spark, sf_dir):
        """A log of marks written in two parts, the later half first; every finding has its last mark."""
        events = fx.read_table(spark, sf_dir, "events")
        marks = events.select((F.col("event_id") % 3000 * 10 + 1).alias("finding_id"), F.col("ts").alias("marked_at"), "user_id",
                              F.col("event_id").alias("mark_id"), F.col("event_type").isin("click", "view").alias("is_false_positive"))
        path, late = _folder(spark, "marks"), F.col("marked_at") >= F.lit("2024-01-16").cast("timestamp_ntz")
        fnd.record_marks(marks.where(late), path, buckets=8)
        fnd.record_marks(marks.where(~late), path, buckets=8)
        return fnd.mark_false_positive(fx.findings_base(spark, sf_dir), sinks.read_table(spark, path)).select(
            "finding_id", "scan_id", "file_path", "is_false_positive")

    # fixed values: allowed severities and statuses are typed here, not taken from the checks
    @register("quality_checks", f"""
WITH f AS (SELECT {_sql('findings')} FROM lineitem), r AS (SELECT {_sql('reports')} FROM orders),
m AS (SELECT {_sql('remediations')} FROM events), s AS (SELECT {_sql('scans')} FROM orders)
SELECT 'findings' AS "table", CAST(finding_id AS VARCHAR) AS id, 'confidence_range' AS reason FROM f WHERE confidence < 0 OR confidence > 1 OR confidence IS NULL
UNION ALL SELECT 'findings', CAST(finding_id AS VARCHAR), 'valid_severity' FROM f WHERE coalesce(severity NOT IN ('critical', 'high', 'medium', 'low', 'info'), TRUE)
UNION ALL SELECT 'reports', CAST(scan_id AS VARCHAR), 'risk_score_range' FROM r WHERE overall_risk_score < 0 OR overall_risk_score > 100
UNION ALL SELECT 'remediations', CAST(remediation_id AS VARCHAR), 'valid_tier' FROM m WHERE tier NOT IN (1, 2, 3)
UNION ALL SELECT 'remediations', CAST(remediation_id AS VARCHAR), 'valid_status' FROM m
  WHERE status NOT IN ('proposed', 'pending_approval', 'approved', 'verifying', 'pr_opened', 'rejected', 'failed')
UNION ALL SELECT 'scans', CAST(scan_id AS VARCHAR), 'valid_status' FROM s
  WHERE status NOT IN ('queued', 'cloning', 'static_scan', 'ai_review', 'merging', 'complete', 'failed')""")
    def q_quality_checks(spark, sf_dir):
        """Rows of the four stored tables that break a constraint."""
        tables = {}
        for name, (source, cols, key) in STORED.items():
            tables[name] = fx.read_table(spark, sf_dir, source).selectExpr(*cols_of(cols)), key
        return Quality(tables).violations

    words = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,12}')) AS w FROM"

    @register("close_names", f"""
WITH n AS ({words} documents), c AS ({words} benchmark),
d AS (SELECT n.w AS name, c.w AS popular, levenshtein(n.w, c.w) AS dist FROM n, c WHERE abs(length(n.w) - length(c.w)) <= 2)
SELECT name, arg_min(popular, (dist, popular)) AS popular, CAST(min(dist) AS INTEGER) AS dist FROM d
WHERE dist <= 2 AND name NOT IN (SELECT w FROM c) GROUP BY name""")
    def q_close_names(spark, sf_dir):
        """J5 with a catalogue from data: every word of the documents against the words of the benchmark."""
        def words_of(table):
            texts = fx.read_table(spark, sf_dir, table).select(F.lower("text").alias("t"))
            return texts.select(F.explode(F.regexp_extract_all("t", F.lit("([a-z]{5,12})"))).alias("w"))

        return dep.close_names(words_of("documents"), words_of("benchmark"))


register_all()
