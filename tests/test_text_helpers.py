"""Offsets, lines and snippets computed in Catalyst agree with Python's re/splitlines."""

import math
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from scan_probe import pattern_hits
from riskloom.operators.scan import check_pattern

CASES = [
    "DEBUG = True\nx = 1\n  debug: true  \n",
    "a\r\nDEBUG=true\r\nb",
    "first\rsecond debug=true\nthird",          # lone CR: splitlines and "\n" counts differ
    "x\x0cdebug = true\n",                       # form feed
    "debug =\n  true\n",                         # match crossing a line break
    "",
    "no match here",
    "debug=true debug=true\ndebug=true",
]
PY_PATTERN = r"(?i)\bdebug\s*(?:=|:)\s*true\b"
JAVA_PATTERN = "(?iU)\\bdebug\\s*(?:=|:)\\s*true\\b"


def py_line_at(contents, n):
    lines = contents.splitlines()
    return lines[n - 1].strip()[:500] if 1 <= n <= len(lines) else ""


@pytest.mark.parametrize("content", CASES)
def test_hits_match_python(spark, make_files, content):
    files = make_files({"r": {"a.py": content}})
    got = sorted((r.pos, r.line, r.snippet) for r in pattern_hits(files, JAVA_PATTERN).collect())
    want = []
    for m in re.finditer(PY_PATTERN, content):
        line = content.count("\n", 0, m.start()) + 1
        want.append((m.start(), line, py_line_at(content, line)))
    assert got == sorted(want)


def test_first_per_line(spark, make_files):
    files = make_files({"r": {"a.js": "eval(a); eval(b)\nnew  Function(c)\n"}})
    rows = pattern_hits(files, "(?U)\\b(eval|new\\s+Function)\\s*\\(", {"call": 1}, first_per_line=True).collect()
    assert [(r.line, r.call) for r in sorted(rows, key=lambda r: r.pos)] == [(1, "eval"), (2, "new  Function")]


def test_strip_and_splitlines(spark):
    df = spark.createDataFrame([(" \t a b \x1c　",)], "s string")
    assert df.select(tx.py_strip(F.col("s"))).first()[0] == " \t a b \x1c　".strip()
    df = spark.createDataFrame([("a\r\nb\rc\x0bd\n",)], "s string")
    assert df.select(tx.line_count(F.col("s"))).first()[0] == len("a\r\nb\rc\x0bd\n".splitlines())


def test_entropy_and_ipv4(spark):
    vals = ["aaaa", "abcd", "0123456789abcdef0123", ""]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tx.shannon_entropy(F.col("v"))).collect()]
    for v, g in zip(vals, got):
        want = 0.0 if not v else -sum((v.count(c) / len(v)) * math.log2(v.count(c) / len(v)) for c in set(v))
        assert abs(g - want) < 1e-9
    ips = ["10.0.0.1", "255.255.255.255", "256.1.1.1", "01.2.3.4", "999.1.1.1", "1.2.3"]
    df = spark.createDataFrame([(v,) for v in ips], "v string")
    assert [r[0] for r in df.select(tx.is_ipv4(F.col("v"))).collect()] == [True, True, False, False, False, False]


def test_zero_width_patterns_rejected():
    with pytest.raises(ValueError):
        check_pattern("a*")
    assert check_pattern("a+") == "a+"


def test_path_suffix(spark):
    paths = ["a/b.PY", ".env", "x/.env.local", "Dockerfile", "a.tar.gz"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(tx.path_suffix(F.col("p"))).collect()]
    assert got == [".PY", "", ".local", "", ".gz"]


def test_duration_and_error_text(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:00:01.5"), (None, "2024-01-01 00:00:00"),
                                ("2024-01-01 00:00:05", "2024-01-01 00:00:00")], "a string, b string")
    df = df.selectExpr("CAST(a AS TIMESTAMP) AS a", "CAST(b AS TIMESTAMP) AS b")
    assert [r[0] for r in df.select(tx.duration_ms(F.col("a"), F.col("b"))).collect()] == [1500, None, 0]
    e = spark.createDataFrame([("ValueError", "x" * 2000)], "k string, m string")
    assert len(e.select(tx.error_text(F.col("k"), F.col("m"))).first()[0]) == 1000


def test_cut_lineage_keeps_partitions_and_null_groups_are_numbered(spark):
    from riskloom.operators.findings import row_number_skew_safe
    from riskloom.session import cut_lineage
    assert cut_lineage(spark.range(0, 640, 1, 64)).rdd.getNumPartitions() == 64
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 1), ("a", 3)], "g string, v int")
    got = {(r.g, r.v): r.position for r in row_number_skew_safe(rows, ["g"], ["v"]).collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, (None, 1): 1, (None, 2): 2}


def test_repository_url_must_match_whole(spark):
    from riskloom.sources.files import project_import
    urls = ["https://github.com/a/b", "https://github.com/a/b.git", "https://github.com/a/b/", "https://github.com/a/b\n", "https://github.com/../b"]
    got = {r.url: r.valid for r in project_import(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert [got[u] for u in urls] == [True, True, True, False, False]


def test_snippets_are_linear_in_matches(spark, make_files):
    import statistics
    import time

    from riskloom.operators.textscan import text_hits
    from riskloom.sources.files import eligible_files

    def seconds(n):
        text = "".join(f"see https://host{i}.example.com/a/b/c\n" for i in range(n))
        el = eligible_files(make_files({"u": {"a.md": text}}))
        t0 = time.time()
        assert text_hits(el, ["url"]).agg(F.count("snippet")).collect()[0][0] == n
        return time.time() - t0

    def middle(n):
        return statistics.median(seconds(n) for _ in range(3))

    seconds(100)
    assert middle(16_000) < 12 * max(0.5, middle(2_000))


def test_redaction_reaches_the_cut(spark, make_files):
    from riskloom.operators.secret_rules import secret_signatures
    from riskloom.sources.files import eligible_files
    key, other = "AKIA" + "A" * 16, "AKIA" + "B" * 16
    line = "x" * 480 + f" {key} {other}"
    rows = secret_signatures(eligible_files(make_files({"r": {"k.txt": line}}))).collect()
    assert len(rows) == 2 and not any("AKIA" in r.code_snippet for r in rows)
