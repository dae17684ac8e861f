"""What limits drop, and the smaller findings-table views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import findings as fnd
from riskloom.operators import merge as mg
from riskloom.operators import report as rpt
from riskloom.plans import oracle_parts as op
from riskloom.plans.q_code import corpus
from riskloom.plans.registry import register
from riskloom.sources import files as src
from riskloom.sources import fixtures as fx

BASE = fx.duck_with("findings_base")
EVENTS = fx.duck_with("remediation_events")
PROJECTS = "SELECT DISTINCT CAST(c_custkey % 50 AS BIGINT) AS project_id, CAST(c_custkey % 50 % 25 AS BIGINT) AS owner_id FROM {customer}"
SCANS = "SELECT DISTINCT scan_id, scan_id % 50 AS project_id FROM {findings_base}"
STAGE = ("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'cloning' WHEN 'click' THEN 'static_scan' "
         "WHEN 'purchase' THEN 'complete' ELSE 'failed' END")
REMEDIATIONS = ("SELECT remediation_id % 1000 AS finding_id, event_id AS remediation_id, status, "
                "CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS created_at FROM {remediation_events}")


@register("skipped_files", op.code_prefix() + f"""
SELECT repo_id, commit_sha, file_path, reason FROM (
  SELECT *, CASE WHEN list_has_any(string_split(file_path, '/'), {op.NOISE}) THEN 'noise_directory'
                 WHEN size_bytes > 1000000 THEN 'too_large' WHEN instr(substr(content, 1, 8192), chr(0)) > 0 THEN 'binary' END AS reason
  FROM code_files) s WHERE reason IS NOT NULL""")
def q_skipped_files(spark, sf_dir):
    """Files that no detector reads, and why."""
    return src.skipped_files(corpus(spark, sf_dir)[0])


@register("rejected_repos", op.code_prefix() + f"""
SELECT repo_id, commit_sha FROM code_files WHERE NOT list_has_any(string_split(file_path, '/'), {op.NOISE})
GROUP BY repo_id, commit_sha HAVING sum(size_bytes) > 524288000""")
def q_rejected_repos(spark, sf_dir):
    """Scans over the size limit: none of their findings or reports are kept."""
    return mg.rejected_repos(corpus(spark, sf_dir)[0])


@register("mark_false_positive", BASE + """
SELECT finding_id, scan_id, file_path, CASE WHEN finding_id % 7 = 0 THEN finding_id % 3 = 0 ELSE FALSE END AS is_false_positive
FROM findings_base""")
def q_mark_false_positive(spark, sf_dir):
    base = fx.findings_base(spark, sf_dir)
    marks = base.where("finding_id % 7 = 0").select("finding_id", (F.col("finding_id") % 3 == 0).alias("is_false_positive")).distinct()
    return fnd.mark_false_positive(base, marks).select("finding_id", "scan_id", "file_path", "is_false_positive")


@register("list_findings", BASE + f""", scans AS ({SCANS.format(findings_base="findings_base")}),
projects AS ({PROJECTS.format(customer="customer")})
SELECT finding_id, scan_id, severity, created_at FROM findings_base
WHERE scan_id IN (SELECT scan_id FROM scans JOIN projects USING (project_id) WHERE owner_id = 3)""")
def q_list_findings(spark, sf_dir):
    base = fx.findings_base(spark, sf_dir)
    customer = fx.read_table(spark, sf_dir, "customer")
    out = fnd.list_findings(base, spark.sql(SCANS, findings_base=base), spark.sql(PROJECTS, customer=customer), 3)
    return out.select("finding_id", "scan_id", "severity", "created_at")


@register("list_projects", "WITH projects AS (" + PROJECTS.format(customer="customer") + """)
SELECT project_id, owner_id FROM projects WHERE owner_id = 3""")
def q_list_projects(spark, sf_dir):
    projects = spark.sql(PROJECTS, customer=fx.read_table(spark, sf_dir, "customer"))
    return fnd.list_projects(projects.withColumn("created_at", F.col("project_id")), 3).select("project_id", "owner_id")


@register("pending_reports", BASE + f""", scans AS ({SCANS.format(findings_base="findings_base")})
SELECT scan_id, project_id FROM scans WHERE scan_id % 4 <> 0""")
def q_pending_reports(spark, sf_dir):
    scans = spark.sql(SCANS, findings_base=fx.findings_base(spark, sf_dir))
    return rpt.pending_reports(scans, scans.where("scan_id % 4 = 0"))


@register("scan_progress", f"""
SELECT event_id, CASE stage WHEN 'failed' THEN 100 WHEN 'queued' THEN 3 WHEN 'cloning' THEN 20 WHEN 'static_scan' THEN 40
       WHEN 'complete' THEN 100 END AS progress FROM (SELECT event_id, {STAGE} AS stage FROM events) e""")
def q_scan_progress(spark, sf_dir):
    stage = fx.read_table(spark, sf_dir, "events").select("event_id", F.expr(STAGE).alias("stage"))
    return stage.select("event_id", rpt.scan_progress(F.col("stage")).alias("progress"))


@register("latest_remediation", EVENTS + f""", r AS ({REMEDIATIONS.format(remediation_events="remediation_events")})
SELECT finding_id, remediation_id, status, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY coalesce(created_at, TIMESTAMP '0001-01-01') DESC, remediation_id DESC) AS rn
  FROM r) x WHERE rn = 1""")
def q_latest_remediation(spark, sf_dir):
    events = fx.remediation_events(spark, sf_dir)
    return rpt.latest_remediation(spark.sql(REMEDIATIONS, remediation_events=events)).select(
        "finding_id", "remediation_id", "status", "created_at")


# verification results as stored JSON, one per event; some without a reason
VERIFICATIONS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{{"notes":" note ' || event_id || ' ","error":"e"}}' WHEN 1 THEN '{{"notes":"","error":"error ' || event_id || '"}}'
  WHEN 2 THEN '{{"error":"  ","message":"message ' || event_id || '"}}' WHEN 3 THEN '{{"other":1}}' WHEN 4 THEN '{{"notes":null,"message":"' || event_type || '"}}' END AS verification
FROM {events}"""


@register("failure_reasons", f"""
WITH v AS ({VERIFICATIONS.format(events='events')}),
r AS (SELECT event_id, list_transform(['notes', 'error', 'message'], lambda k: nullif(trim(json_extract_string(verification, '$.' || k)), '')) AS c FROM v)
SELECT event_id, coalesce(c[1], c[2], c[3]) AS reason FROM r""")
def q_failure_reasons(spark, sf_dir):
    """Why a remediation failed, from its verification result."""
    from riskloom.operators.remediate import failure_reason
    rows = spark.sql(VERIFICATIONS, events=fx.read_table(spark, sf_dir, "events"))
    return rows.select("event_id", failure_reason(F.try_parse_json("verification")).alias("reason"))


@register("scan_times", f"""
WITH s AS (SELECT user_id % 50 AS scan, min(ts) FILTER (WHERE event_type <> 'error') AS started, max(ts) AS completed, count(*) AS n FROM events GROUP BY 1)
SELECT scan, CASE WHEN started IS NOT NULL THEN greatest(0, epoch_us(completed) - epoch_us(started)) // 1000 END AS duration_ms,
       left('RuntimeError' || ': ' || repeat('x', CAST(n AS INTEGER) * 7), 1000) AS error_text,
       left(concat_ws('; ', repeat('a', CAST(n AS INTEGER)), 'b', repeat('c', CAST(n AS INTEGER) * 4)), 900) AS warnings_text FROM s""")
def q_scan_times(spark, sf_dir):
    """durations and the cut texts of errors and warnings."""
    from riskloom.functions import text as tx
    events = fx.read_table(spark, sf_dir, "events")
    s = events.groupBy((F.col("user_id") % 50).alias("scan")).agg(
        F.min(F.when(F.col("event_type") != "error", F.col("ts"))).alias("started"), F.max("ts").alias("completed"), F.count(F.lit(1)).cast("int").alias("n"))
    stamp = lambda c: F.col(c).cast("timestamp")
    return s.select("scan", tx.duration_ms(stamp("started"), stamp("completed")).alias("duration_ms"),
                    tx.error_text(F.lit("RuntimeError"), F.repeat(F.lit("x"), F.col("n") * 7)).alias("error_text"),
                    tx.warnings_text(F.array(F.repeat(F.lit("a"), F.col("n")), F.lit("b"), F.repeat(F.lit("c"), F.col("n") * 4))).alias("warnings_text"))


_BYTES = f"""SELECT repo_id, commit_sha, file_path, size_bytes, content FROM ({fx.duck_view('code_files')}) c"""


@register("decoded_files", f"""
SELECT repo_id, commit_sha, 'pkg/' || file_path AS file_path, md5(replace(content, ' ', chr(65533))) AS text_md5, length(content) AS n
FROM ({_BYTES}) b WHERE NOT list_has_any(string_split(file_path, '/'), {op.NOISE}) AND NOT ends_with(file_path, 'go.mod') AND size_bytes <= 1000000""")
def q_decoded_files(spark, sf_dir):
    """Files as bytes below a root folder, every blank an invalid byte and every go.mod with a NUL byte: relative
    paths, binary files dropped, each invalid byte one replacement character."""
    files = fx.code_files(spark, sf_dir)
    one_per_byte = F.decode(F.encode("content", "utf-8"), "ISO-8859-1")  # a character per byte: blanks are bytes 20, \u00ff is byte FF
    data = F.encode(F.translate(one_per_byte, " ", "\u00ff"), "ISO-8859-1")
    data = F.when(F.col("file_path").endswith("go.mod"), F.concat(F.unhex(F.lit("00")), data)).otherwise(data)
    raw = files.select("repo_id", "commit_sha", F.concat(F.lit("file:/corpus/repo/pkg/"), "file_path").alias("path"), "size_bytes", data.alias("content"))
    raw = raw.withColumn("file_path", src.relative_path(F.col("path"), "/corpus/repo/"))
    return src.eligible_files(raw).select("repo_id", "commit_sha", "file_path", F.md5(F.encode("content", "utf-8")).alias("text_md5"),
                                          F.length("content").cast("long").alias("n"))
