"""Joins of findings with a stored corpus leave file contents where they are."""

import re

import pytest

from riskloom.operators import enrich as en
from riskloom.operators import fixes as fx
from riskloom.sources.files import write_corpus

CONTENT = {"app/settings.py": "import os\nDEBUG = True\nx = 1\n", "web/a.js": "eval(a)\n", ".gitignore": "*.log\n"}


def shuffled_contents(df):
    """Exchange nodes of the plan that carry the content column or lines made of it."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = [b for b in re.split(r"\n\n+", text) if re.match(r"\(\d+\) (BroadcastExchange|Exchange)", b)]
    return [b for b in blocks if re.search(r"\b(content|lines)#", b)]


@pytest.fixture
def stored(spark, make_files, tmp_path):
    files = make_files({f"r{i}": CONTENT for i in range(12)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield files, write_corpus(files, "stored_corpus", 4, str(tmp_path / "corpus"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP TABLE stored_corpus")


def found(spark):
    rows = [(f"r{i}", f"sha-r{i}", "app/settings.py", 2, 2, "insecure_config", "Debug mode", "high", "0.90", "DEBUG = True", "d", "fix") for i in range(0, 12, 2)]
    return spark.createDataFrame(rows, "repo_id string, commit_sha string, file_path string, line_start int, line_end int, category string, title string, "
                                       "severity string, confidence string, code_snippet string, description string, fix_suggestion string")


def test_code_context_moves_no_contents(spark, stored):
    files, table = stored
    plain, kept = en.code_context(found(spark), files), en.code_context(found(spark), table)
    assert shuffled_contents(plain) and not shuffled_contents(kept)
    assert sorted(kept.collect(), key=str) == sorted(plain.collect(), key=str) and kept.count() == 6


def test_fix_proposals_move_no_contents(spark, stored):
    files, table = stored
    plain, kept = fx.fix_proposals(found(spark), files), fx.fix_proposals(found(spark), table)
    assert shuffled_contents(plain) and not shuffled_contents(kept)
    rows = kept.collect()
    assert sorted(rows, key=str) == sorted(plain.collect(), key=str) and all(r.has_change for r in rows) and len(rows) == 6
