"""Versioned tables: replacing by key, reading during writes, concurrent and killed writers."""

import pytest
from pyspark.sql import functions as F

from riskloom.sources import sinks
from riskloom.sources import snapshots as snap

SCHEMA = "repo_id string, commit_sha string, file_path string, line_start int"


def findings(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, path, version=None):
    return sorted(((str(r.scan_date), r.repo_id, r.commit_sha, r.line_start) for r in sinks.read_table(spark, path, version).collect()), key=str)


def test_scans_of_a_day_are_replaced(spark, tmp_path):
    out = str(tmp_path / "findings")
    assert sinks.read_table(spark, out) is None
    sinks.write_findings(findings(spark, ("a", "c1", "a.py", 1), ("a", "c1", "a.py", 2)), out, "2024-01-01", buckets=2)
    sinks.write_findings(findings(spark, ("b", "c1", "b.py", 1)), out, "2024-01-01", buckets=2)
    sinks.write_findings(findings(spark, ("a", "c1", "a.py", 1)), out, "2024-01-02", buckets=2)
    last = findings(spark, ("a", "c1", "a.py", 3), ("a", "c2", "a.py", 9))
    assert sinks.write_findings(last, out, "2024-01-01", buckets=2) == 4
    want = [("2024-01-01", "a", "c1", 3), ("2024-01-01", "a", "c2", 9), ("2024-01-01", "b", "c1", 1), ("2024-01-02", "a", "c1", 1)]
    assert stored(spark, out) == want
    # a repeated write changes nothing; null keys are keys; a key without new rows loses its old ones
    sinks.write_findings(last, out, "2024-01-01", buckets=2)
    assert stored(spark, out) == want
    sinks.write_findings(findings(spark, (None, "c", "n.py", 5)), out, "2024-01-02", buckets=2)
    sinks.write_findings(findings(spark, (None, "c", "n.py", 6)), out, "2024-01-02", buckets=2)
    gone = findings(spark, ("b", "c1", None, None)).withColumn("scan_date", F.lit("2024-01-01").cast("date"))
    sinks.write_findings(findings(spark).limit(0), out, "2024-01-01", buckets=2, keys=gone)
    assert sorted(stored(spark, out), key=str) == sorted([r for r in want if r[1] != "b"] + [("2024-01-02", None, "c", 6)], key=str)


def test_reader_keeps_its_version_during_a_write(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_findings(findings(spark, ("a", "c", "a.py", 1)), out, "2024-01-01")
    open_read = sinks.read_table(spark, out)
    during = []
    sinks.write_findings(findings(spark, ("a", "c", "a.py", 2), ("b", "c", "b.py", 3)), out, "2024-01-01",
                         between=lambda: during.append(stored(spark, out)))
    assert during == [[("2024-01-01", "a", "c", 1)]]
    assert [r.line_start for r in open_read.collect()] == [1]
    assert [r[3] for r in stored(spark, out)] == [2, 3] and [r[3] for r in stored(spark, out, 1)] == [1]


@pytest.mark.parametrize("other", ["a", "b", "c", "d", "e"])
def test_two_writers(spark, tmp_path, other):
    """A second writer publishes first, to the same parts or to others: both writes are kept."""
    out = str(tmp_path / "t")
    sinks.write_findings(findings(spark, ("a", "c", "a.py", 1), ("z", "c", "z.py", 1)), out, "2024-01-01", buckets=2)
    calls = []

    def intrude():
        if not calls:
            calls.append(sinks.write_findings(findings(spark, (other, "c", "x.py", 7)), out, "2024-01-01", buckets=2))

    version = sinks.write_findings(findings(spark, ("a", "c", "a.py", 2)), out, "2024-01-01", buckets=2, between=intrude)
    assert (calls, version) == ([2], 3)
    want = {("a", 2), ("z", 1)} | ({(other, 7)} if other != "a" else set())
    assert {(r[1], r[3]) for r in stored(spark, out)} == want


def test_killed_writer_leaves_the_table_as_it_was(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_findings(findings(spark, ("a", "c", "a.py", 1)), out, "2024-01-01")

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sinks.write_findings(findings(spark, ("a", "c", "a.py", 2)), out, "2024-01-01", between=die)
    assert [r[3] for r in stored(spark, out)] == [1]
    folders = {n for n in snap.Folder(spark, out).names() if n.startswith("data-")}
    assert len(folders) == 2
    assert snap.vacuum(spark, out) == []  # too young: it might be a write in progress
    gone = snap.vacuum(spark, out, older_than_s=0)
    assert len(gone) == 1 and gone[0] in folders and [r[3] for r in stored(spark, out)] == [1]


def test_vacuum_keeps_the_last_versions(spark, tmp_path):
    out = str(tmp_path / "t")
    for i in range(4):
        sinks.write_findings(findings(spark, ("a", "c", "a.py", i)), out, "2024-01-01")
    assert len(snap.vacuum(spark, out, keep=2, older_than_s=0)) == 2
    assert [r[3] for r in stored(spark, out)] == [3] and [r[3] for r in stored(spark, out, 3)] == [2]
    assert sinks.write_findings(findings(spark, ("b", "c", "b.py", 9)), out, "2024-01-01") == 5


def test_newest_row_wins_whatever_the_order_of_writes(spark, tmp_path):
    out = str(tmp_path / "t")

    def write(*rows):
        sinks.replace_rows(spark.createDataFrame(rows, "id int, at int, v string"), out, ["id"], newest=lambda: F.struct("at", "v"))

    write((1, 5, "b"), (1, 4, "a"), (2, 1, "x"))
    write((1, 3, "late"), (2, 2, "y"), (3, 1, None))
    got = sorted((r.id, r.at, r.v) for r in sinks.read_table(spark, out).collect())
    assert got == [(1, 5, "b"), (2, 2, "y"), (3, 1, None)]


def test_only_touched_parts_are_written(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_findings(findings(spark, *[(f"r{i}", "c", "a.py", i) for i in range(40)]), out, "2024-01-01", buckets=8)
    before = snap.current(spark, out).parts
    sinks.write_findings(findings(spark, ("r1", "c", "a.py", 100)), out, "2024-01-01", buckets=8)
    after = snap.current(spark, out).parts
    assert before.keys() == after.keys() and sum(before[p] != after[p] for p in before) == 1
    assert len(stored(spark, out)) == 40


def test_read_keys_reads_their_parts_only(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.replace_rows(findings(spark, *[(f"r{i}", "c", "a.py", i) for i in range(200)]), out, ["repo_id", "commit_sha", "file_path"], by=sinks.SCAN)
    keys = spark.createDataFrame([("r1", "c"), ("nowhere", "c")], "repo_id string, commit_sha string")
    part = sinks.read_keys(keys, out, sinks.SCAN)
    assert [r.line_start for r in part.collect()] == [1] and len(part.inputFiles()) <= 2
