"""Streaming queries, drained with ``availableNow`` so they return whole results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators.catalog import RULE_OUTPUT
from riskloom.plans import oracle_parts as op
from riskloom.plans.q_code import corpus
from riskloom.plans.q_corpus import PYTHON_KEYS
from riskloom.plans.registry import ORACLES, register
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import files as src
from riskloom.sources import fixtures as fx
from riskloom.streaming import incremental as inc

# network rules are merged by their detector before they are stored (D15), the others are stored as found
NETWORK_KEYS = ["raw_ip_url", "raw_ip_socket", "isolated_domain", "install_script"]
STREAM_KEYS = ["config_debug", "config_cors", "js_dynamic_exec", "js_auth_bypass", "secret_signatures", "secret_entropy",
               "js_prompt_injection", "env_committed", "typosquat", "obscure_dependency", *PYTHON_KEYS]
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _union_all(keys: list[str]) -> str:
    cols = ", ".join(RULE_OUTPUT)
    return "\nUNION ALL\n".join(f"SELECT {cols} FROM ({ORACLES[k]}) s_{i}" for i, k in enumerate(keys))


def _work_dir(spark, name: str) -> str:
    """A folder of this run in the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _code_files_stream(spark):
    def build(docs_stream):
        return spark.sql(fx.CODE_FILES_TEMPLATE, documents=docs_stream.select("doc_id", "text"))
    return build


def _events_stream(spark, sf_dir):
    return inc.table_stream(spark, sf_dir, "events.parquet", EVENTS_SCHEMA)


SCAN_STATUS_SQL = op.code_prefix(f"scan_events AS ({fx.duck_view('scan_events')})") + f""",
inv AS (SELECT repo_id, commit_sha, count(*) AS files_scanned FROM eligible GROUP BY ALL),
st AS (SELECT repo_id, commit_sha, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at,
              bool_or(status IN {op.sql_in(inc.INVENTORIED)}) AS inventoried FROM scan_events GROUP BY ALL)
SELECT repo_id, commit_sha, status, CASE WHEN inventoried THEN coalesce(files_scanned, 0) ELSE 0 END AS files_scanned, updated_at
FROM st LEFT JOIN inv USING (repo_id, commit_sha)"""


def register_all() -> None:
    @register("stream_findings", f"{_union_all(STREAM_KEYS)}\nUNION ALL\nSELECT DISTINCT * FROM ({_union_all(NETWORK_KEYS)}) n")
    def q_stream_findings(spark, sf_dir):
        """Every stored row, with its multiplicity."""
        return inc.stream_findings(spark, sf_dir, _code_files_stream(spark), _work_dir(spark, "findings")).select(*RULE_OUTPUT)

    @register("scan_status_current", SCAN_STATUS_SQL)
    def q_scan_status_current(spark, sf_dir):
        """The batch twin of T2."""
        _, el = corpus(spark, sf_dir)
        return inc.scan_status(inc.scan_state(fx.scan_events(spark, sf_dir)), src.repo_inventory(el))

    @register("stream_scan_status", SCAN_STATUS_SQL)
    def q_stream_scan_status(spark, sf_dir):
        """Status and files scanned per scan, from the event stream and the current file inventory."""
        def inventory(scans):
            files, _ = corpus(spark, sf_dir)
            return src.repo_inventory(src.eligible_files(files.join(scans, inc.SCAN, "left_semi")))

        events = fx.scan_events(spark, sf_dir, _events_stream(spark, sf_dir))
        return inc.stream_scan_status(spark, events, inventory, _work_dir(spark, "scans"))

    @register("stream_remediation_status", ORACLES["remediation_status_current"])
    def q_stream_remediation_status(spark, sf_dir):
        stream = spark.sql(fx.REMEDIATION_EVENTS_TEMPLATE, events=_events_stream(spark, sf_dir))
        out = inc.stream_status(spark, stream, "remediation_id", _work_dir(spark, "status"))
        return out.select("remediation_id", "status", "updated_at", F.col("events"))


register_all()
