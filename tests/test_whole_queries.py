"""Registered queries give the findings of every detector."""
import json
from collections import Counter

import pandas as pd
import pytest

from riskloom.operators import merge as mg
from riskloom.operators.catalog import RULE_OUTPUT
from riskloom.plans import registry
from riskloom.plans.q_code import corpus

TEXT = "Plain words of a document."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Enough documents for every file kind of the corpus fixture."""
    d = str(tmp_path_factory.mktemp("sf"))
    pd.DataFrame([(i, f"{TEXT} {i}", "en", "s", len(TEXT)) for i in range(240)],
                 columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(f"{d}/documents.parquet")
    registry.load_all()
    return d


def rows(df):
    return {tuple(r) for r in df.select(*RULE_OUTPUT).collect()}


def test_stream_findings_are_all_findings(spark, folder):
    got = rows(registry.QUERIES["stream_findings"](spark, folder))
    assert got == rows(mg.all_findings(*corpus(spark, folder)).distinct())
    assert {"ast_rules", "model_security_rules"} <= {r[RULE_OUTPUT.index("detector")] for r in got}


def test_report_shows_every_finding_with_its_remediation(spark, folder):
    shown = Counter(r.text.split(": ")[1] for r in registry.QUERIES["report_markdown"](spark, folder).collect()
                    if r.text.startswith("  - Remediation status: "))
    want = Counter(r.remediation_status or "not proposed" for r in registry.QUERIES["report_findings"](spark, folder).collect())
    assert shown == want and shown["pending_approval"]


def test_python_findings_get_proposals_and_context(spark, folder):
    proposed = registry.QUERIES["fix_proposals"](spark, folder).collect()
    assert any(r.has_change and r.file_path.endswith(".py") and "auth_bypass" in r.category for r in proposed)
    detectors = {"ast_rules", "model_security_rules"}
    assert detectors <= {r.detector for r in registry.QUERIES["code_context"](spark, folder).collect()}
    asked = registry.QUERIES["reasoning_requests"](spark, folder).collect()
    assert detectors <= {json.loads(r.finding_json)["detector"] for r in asked}
