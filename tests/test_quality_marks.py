"""Constraint checks in one pass, the mark log, look-alike names by signatures."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import dependency_rules as dep
from riskloom.operators import findings as fnd
from riskloom.operators.quality import Check, Quality
from riskloom.sources import sinks


def test_every_check_fires_once_and_is_counted(spark):
    findings = spark.createDataFrame([(1, 0.5, "high"), (2, 1.5, "high"), (3, -0.1, "urgent"), (4, None, None)], "finding_id int, confidence double, severity string")
    reports = spark.createDataFrame([(1, 100.0), (2, 100.1), (3, 0.0)], "scan_id int, overall_risk_score double")
    rems = spark.createDataFrame([(1, 1, "proposed"), (2, 4, "proposed"), (3, 3, "stalled")], "remediation_id int, tier int, status string")
    scans = spark.createDataFrame([(1, "complete"), (2, "paused")], "scan_id int, status string")
    q = Quality({"findings": (findings, "finding_id"), "reports": (reports, "scan_id"), "remediations": (rems, "remediation_id"), "scans": (scans, "scan_id")})
    got = sorted((r.table, r.id, r.reason) for r in q.violations.collect())
    assert got == sorted([("findings", "2", "confidence_range"), ("findings", "3", "confidence_range"), ("findings", "3", "valid_severity"),
                          ("findings", "4", "confidence_range"), ("findings", "4", "valid_severity"), ("reports", "2", "risk_score_range"),
                          ("remediations", "2", "valid_tier"), ("remediations", "3", "valid_status"), ("scans", "2", "valid_status")])
    assert q.counts() == {"findings": {"rows": 4, "confidence_range": 3, "valid_severity": 2}, "reports": {"rows": 3, "risk_score_range": 1},
                          "remediations": {"rows": 3, "valid_tier": 1, "valid_status": 1}, "scans": {"rows": 2, "valid_status": 1}}
    assert [r.finding_id for r in q.clean("findings").collect()] == [1] and q.clean("reports").count() == 2


def test_checks_of_unknown_tables_and_tables_without_checks(spark):
    rows = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        Quality({"t": (rows, "id")}, [Check("u", "x", "TRUE")])
    q = Quality({"t": (rows, "id")}, [])
    assert q.violations.count() == 0 and q.counts() == {"t": {"rows": 1}} and q.clean("t").count() == 1


MARK = "finding_id long, marked_at string, user_id int, mark_id int, is_false_positive boolean"


def test_last_mark_wins_whatever_the_order_of_writes(spark, tmp_path):
    path = str(tmp_path / "marks")

    def record(*rows):
        fnd.record_marks(spark.createDataFrame(rows, MARK).withColumn("marked_at", F.col("marked_at").cast("timestamp")), path, buckets=2)

    record((7, "2024-01-02", 1, 5, True), (7, "2024-01-03", 1, 6, False), (8, "2024-01-01", 2, 7, True), (None, "2024-01-01", 2, 8, True))
    record((7, "2024-01-01", 9, 1, True), (8, "2024-01-01", 3, 2, False), (9, "2024-01-01", 1, 3, True), (9, "2024-01-01", 1, 3, True))
    marks = sinks.read_table(spark, path)
    assert sorted((r.finding_id, r.is_false_positive) for r in marks.collect()) == [(7, False), (8, False), (9, True)]
    findings = spark.createDataFrame([(7, "a"), (8, "b"), (9, "c"), (10, "d")], "finding_id long, v string")
    got = {r.finding_id: r.is_false_positive for r in fnd.mark_false_positive(findings, marks).collect()}
    assert got == {7: False, 8: False, 9: True, 10: False}


def test_two_marks_of_a_finding_leave_one_row(spark):
    findings = spark.createDataFrame([(7, "a"), (7, "again")], "finding_id long, v string")
    both = spark.createDataFrame([(7, True), (7, False)], "finding_id long, is_false_positive boolean")
    assert sorted((r.v, r.is_false_positive) for r in fnd.mark_false_positive(findings, both).collect()) == [("a", True), ("again", True)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_close_names_equal_all_distances(spark):
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randint(lo, hi)))
    names = [word(0, 9) for _ in range(150)] + [None, "a" * 40]
    catalogue = [word(1, 8) for _ in range(60)] + [None, ""]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "anything string")
    got = sorted((r.name, r.popular, r.dist) for r in dep.close_names(frame(names), frame(catalogue)).collect())
    known, want = {c for c in catalogue if c}, []
    for n in {n for n in names if n} - known:
        d, c = min((distance(n, c), c) for c in known)
        if d <= 2:
            want.append((n, c, d))
    assert got == sorted(want)
    assert dep.close_names(frame(["abc"]), frame([])).count() == 0


def test_catalogue_of_100_000_names(spark):
    import duckdb
    catalogue = spark.range(100_000).select(F.concat(F.lit("n"), F.conv(F.col("id") * 7919, 10, 36)).alias("c"))
    names = spark.range(0, 100_000, 997).select(F.concat(F.lit("m"), F.lower(F.conv(F.col("id") * 7919, 10, 36)), F.lit("x")).alias("n"))
    catalogue, names = catalogue.select(F.lower("c").alias("c")), names.union(spark.createDataFrame([("zzzzzzzzzz",)], "n string"))
    got = sorted((r.name, r.popular, r.dist) for r in dep.close_names(names, catalogue).collect())
    c, n = catalogue.toPandas(), names.toPandas()  # noqa: F841
    want = duckdb.sql("""SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT n, c, levenshtein(n, c) AS d FROM n, c) WHERE d <= 2
                         GROUP BY n HAVING min(d) > 0""").fetchall()
    assert got == sorted(want) and len(got) > 50


def test_catalogue_typosquats(spark):
    manifest = ("r", "s", "requirements.txt", "reqeusts==1\nfine-name==2\nrequests==3\n", 40)
    manifests = spark.createDataFrame([manifest], "repo_id string, commit_sha string, file_path string, content string, size_bytes long").withColumn("name", F.lit("requirements.txt"))
    got = dep.catalogue_typosquats(manifests, spark.createDataFrame([("requests",), ("finenames",)], "c string")).collect()
    assert sorted((r.line, r.dep_name, r.popular, r.dist) for r in got) == [(1, "reqeusts", "requests", 2), (2, "fine-name", "finenames", 1)]
