"""Hardcoded secrets: signature families and high-entropy assignments.

The reference names the families (cloud keys, tokens, private keys, payment
keys, generic assignments with an entropy test) but its rule file is absent;
the patterns below are our own. All signatures are found in one projection
over the scan; a signature hit suppresses a generic hit on the same line.
Snippets are redacted: every secret of the line is replaced in the whole
line before it is cut, so none leaves the detector, not even in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.catalog import emit

# Our patterns (fixed values).
SIGNATURES = {
    "secret_aws": "(?U)\\bAKIA[0-9A-Z]{16}\\b",
    "secret_jwt": "(?U)\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+",
    "secret_private_key": "-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
    "secret_stripe": "(?U)\\bsk_(?:live|test|demo)_[A-Za-z0-9]{16,}",
}
_NAMED = "(?:api[_-]?key|secret|token|password)[\\w.-]*\\s*[:=]\\s*[\"']"
_ASSIGN = f"\\b[\\w.-]*{_NAMED}"
# part of every match of GENERIC, without its costly start
GENERIC_NEEDED = f"(?iU){_NAMED}"
GENERIC = f"(?iU){_ASSIGN}([^\"'\\s]{{16,}})[\"']"
GENERIC_VALUE = f"(?iU)({_ASSIGN})([^\"'\\s]{{16,}})([\"'])"
MIN_ENTROPY = 3.5

DESCRIPTION = {
    "secret_aws": "An AWS access key ID is committed in source.",
    "secret_jwt": "A JSON Web Token is committed in source.",
    "secret_private_key": "A private key block is committed in source.",
    "secret_stripe": "A live-format payment API secret key is committed in source.",
    "secret_entropy": "A high-entropy value is assigned to a secret-like name in source.",
}


def _signature_hits(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, list(SIGNATURES)) if hits is None else hits
    return hits.where(F.col("rule").isin(list(SIGNATURES))).select(
        "repo_id", "commit_sha", "file_path", "line", "pos", "whole", "rule")


def _generic_hits(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    from riskloom.operators.textscan import text_hits
    hits = text_hits(eligible, ["secret_generic"]) if hits is None else hits
    h = hits.where(F.col("rule") == "secret_generic").withColumn("entropy", tx.shannon_entropy(F.col("g1")))
    return h.where(F.col("entropy") >= MIN_ENTROPY).select(
        "repo_id", "commit_sha", "file_path", "line", "pos", "whole",
        F.lit("secret_entropy").alias("rule"))


def secret_signatures(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One row per signature match (AWS key id, JWT, private key, payment key)."""
    return _emit(_signature_hits(eligible, hits))


def secret_entropy(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Generic secret assignments whose value passes the entropy test,
    on lines without a signature hit (left anti join on the line key)."""
    if hits is None:
        from riskloom.operators.textscan import text_hits
        hits = text_hits(eligible, [*SIGNATURES, "secret_generic"])
    sig_lines = _signature_hits(eligible, hits).select("repo_id", "commit_sha", "file_path", "line").distinct()
    gen = _generic_hits(eligible, hits).join(sig_lines, ["repo_id", "commit_sha", "file_path", "line"], "left_anti")
    return _emit(gen)


def _emit(hits: DataFrame) -> DataFrame:
    desc = F.lit(None).cast("string")
    for rule, text in DESCRIPTION.items():
        desc = F.when(F.col("rule") == rule, F.lit(text)).otherwise(desc)
    redacted = tx.redact(F.col("whole"), [*((p, "[redacted]") for p in SIGNATURES.values()), (GENERIC_VALUE, "$1[redacted]$3")])
    return emit(hits, F.col("rule"), line_start=F.col("line"), snippet=redacted, description=desc)


def secret_findings(eligible: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    return secret_signatures(eligible, hits).unionByName(secret_entropy(eligible, hits))
