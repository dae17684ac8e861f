"""Union of detectors over one corpus scan, per-repository merge.

A scan is one repository snapshot ``(repo_id, commit_sha)``. All detectors
read the same ``eligible`` frame; identical sub-plans (the scan and its
repartition) are reused by Spark's exchange reuse, so the corpus is read once
per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import config_rules as cr
from riskloom.operators import dependency_rules as dep
from riskloom.operators import js_rules as js
from riskloom.operators import network_rules as net
from riskloom.operators import prompt_rules as pr
from riskloom.operators import pyfacts as pf
from riskloom.operators import pyrules as prl
from riskloom.operators import secret_rules as sec
from riskloom.operators.textscan import text_hits
from riskloom.session import cut_lineage
from riskloom.sources import files as src

# Fixed value: detector order of the reference's registry ("first" on ties).
DETECTOR_ORDER = ["secret_scan", "config_audit", "dependency_audit", "ast_rules", "js_pattern_rules",
                  "backdoor_heuristics", "prompt_injection_rules", "model_security_rules"]
SCAN_KEY = ["repo_id", "commit_sha"]


def detector_rank(col):
    expr = F.lit(len(DETECTOR_ORDER))
    for i, d in reversed(list(enumerate(DETECTOR_ORDER))):
        expr = F.when(col == d, F.lit(i)).otherwise(expr)
    return expr


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_index(files: DataFrame) -> DataFrame:
    """``src.file_index``, checkpointed: sizes, eligibility and special files come from one pass over the corpus."""
    return cut_lineage(src.file_index(files))


def scan_tables(files: DataFrame, eligible: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regex hits, files read whole, URL references): what the text rules read instead of the corpus.

    The content of the corpus is scanned once for the hit table, which is checkpointed; manifests, .gitignore,
    env files and package.json are one small checkpointed extract (of the ``index``, if the caller has one).
    """
    hits = cut_lineage(text_hits(eligible))
    special = cut_lineage(src.special_files(files)) if index is None else src.special_of(index)
    return hits, special, net.url_refs(eligible, hits)


def local_findings(eligible: DataFrame, hits: DataFrame, special: DataFrame, refs: DataFrame) -> DataFrame:
    """Text rules that look at one file only."""
    special_el = special.where("eligible")
    manifests = src.manifest_files(special.drop("eligible", "name", "suffix", "suffix_l", "is_source"))
    backdoor = net.backdoor_dedupe(_union([
        net.raw_ip_url(eligible, refs), net.raw_ip_socket(eligible, hits), net.install_script(special_el)]))
    return _union([
        sec.secret_findings(eligible, hits), cr.config_debug(eligible, hits), cr.config_cors(eligible, hits),
        dep.dependency_findings(manifests), js.js_dynamic_exec(eligible, hits), js.js_auth_bypass(eligible, hits),
        backdoor, pr.js_prompt_injection(eligible, hits)])


def cross_file_findings(special: DataFrame, refs: DataFrame) -> DataFrame:
    """Rules that look at a whole scan: env files against .gitignore, hosts that occur once. (Their local merge
    has keys of its own: titles differ from those of the other network rules.)"""
    return cr.env_committed(special.where("eligible"), special).unionByName(net.backdoor_dedupe(net.isolated_domain(refs, refs)))


def static_findings(files: DataFrame, eligible: DataFrame, hits: DataFrame | None = None,
                    rejected: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Regex/JSON/text detectors (everything except the Python AST rules)."""
    index = file_index(files) if index is None else index
    if hits is None:
        hits, special, refs = scan_tables(files, eligible, index)
    else:
        special, refs = src.special_of(index), net.url_refs(eligible, hits)
    if rejected is None:
        rejected = rejected_repos(index)
    return gate(local_findings(eligible, hits, special, refs).unionByName(cross_file_findings(special, refs)), rejected=rejected)


def all_findings(files: DataFrame, eligible: DataFrame, rejected: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Every detector, including the Python AST rules."""
    index = file_index(files) if index is None else index
    rejected = rejected_repos(index) if rejected is None else rejected
    facts = cut_lineage(pf.py_facts(eligible))  # read by seven rules: materialise once
    return (static_findings(files, eligible, rejected=rejected, index=index)
            .unionByName(gate(prl.python_findings(facts), rejected=rejected)))


def over_limit_repos(files: DataFrame) -> DataFrame:
    """S9 gate: repositories whose non-noise files exceed the size cap (an
    aggregation over sizes only)."""
    return src.repo_over_limit(files).where("over_limit").select(*SCAN_KEY)


def rejected_repos(files: DataFrame) -> DataFrame:
    """The over-limit set of files or a ``file_index``, built once per query and shared by every gate (identical
    sub-plans, so Spark reuses one exchange; it reads only sizes on a stored corpus)."""
    return over_limit_repos(files)


def gate(df: DataFrame, files: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Drop rows of rejected repositories; the anti join moves only the small side."""
    rejected = over_limit_repos(files) if rejected is None else rejected
    return df.join(rejected, SCAN_KEY, "left_anti")


def merge_findings(findings: DataFrame) -> DataFrame:
    """R1 on corpus findings: per (repo, commit, category, path, line, title)
    keep the highest confidence; ties go to the earlier detector, then the
    snippet and description (a total order). An aggregation, so duplicates
    are merged map-side."""
    keys = [*SCAN_KEY, "category", "file_path", "line_start", "title"]
    order = F.struct((-F.col("confidence")).alias("c"), detector_rank(F.col("detector")).alias("d"),
                     F.col("code_snippet").alias("s"), F.col("description").alias("x"))
    return (findings.groupBy(*keys).agg(F.min_by(F.struct(*findings.columns), order).alias("f")).select("f.*"))
