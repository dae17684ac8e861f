"""Rule catalogue and the common finding shape.

Every detector emits rows of ``FINDING_COLUMNS``; the fixed per-rule values
(detector, category, severity, confidence, title, fix text) come from
``RULES``. Titles are part of the dedupe key, so they must be exact.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIDENCE = T.DecimalType(3, 2)

FINDING_COLUMNS = [
    "repo_id", "commit_sha", "detector", "category", "severity", "confidence", "file_path",
    "line_start", "line_end", "code_snippet", "title", "description", "fix_suggestion",
]

# Projection used by per-rule queries and their SQL oracles.
RULE_OUTPUT = ["repo_id", "commit_sha", "file_path", "line_start", "line_end", "detector", "category",
               "severity", "confidence", "title", "code_snippet"]

# ---------------------------------------------------------------------------
# Severities, weights, ranks.
# ---------------------------------------------------------------------------
SEVERITIES = ["critical", "high", "medium", "low", "info"]

# Product name printed in summaries, report titles, guidance and generated
# patches. A parameter: set it to the name your users should see.
PRODUCT_NAME = "riskloom"
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
UNKNOWN_SEVERITY_RANK = 99
RISK_WEIGHTS = {"critical": 35, "high": 18, "medium": 8, "low": 3, "info": 0}

# ---------------------------------------------------------------------------
# Rule constants (detector, category, severity, confidence,
# title, fix suggestion). Variants with another severity/confidence share the
# title and fix text of their base rule.
# ---------------------------------------------------------------------------
_FIX_DEBUG = "Disable debug mode outside local development."
_FIX_CORS = "Replace '*' with the explicit production frontend origins."
_FIX_ENV = "Remove secrets from the file, rotate exposed values, and add .env to .gitignore."
_FIX_JS_EXEC = "Remove eval/new Function and replace it with explicit, validated logic."
_FIX_JS_AUTH = "Use verified identity checks and securely managed credentials instead."
_FIX_RAW_IP = "Verify the destination is expected and move approved service endpoints into configuration."
_FIX_DOMAIN = "Confirm the destination belongs to an expected integration and document it in configuration."
_FIX_INSTALL = "Remove or rewrite the script, then verify the package provenance before installation."
_FIX_TYPO = "Verify the package name, publisher, and intended version before installation."
_FIX_OBSCURE = "Confirm the package source and ownership before depending on it."
_FIX_PY_EXEC = "Remove dynamic execution or replace it with explicit, validated logic."
_FIX_SHELL = "Remove shell execution or use a fixed command with validated arguments."
_FIX_PY_AUTH = "Use a verified identity provider or securely stored, rotated credentials."
_FIX_PICKLE = ("Use safetensors or another non-executable model format where possible; otherwise only load "
               "artifacts from a verified source with integrity validation.")
_FIX_TORCH = ("Prefer safetensors; when torch.load is required, use torch.load(..., weights_only=True) and "
              "verify the artifact source.")
_FIX_JOBLIB = ("Use safetensors where supported, or validate the model artifact source and integrity before "
               "loading it.")
_FIX_PROMPT = ("Keep system instructions fixed; pass validated, length-bounded user data in a separate structured "
               "message or clearly delimited data field, and do not let it control instructions or tool permissions.")
# Our own text: the secret rules' source is not available, only their family.
_FIX_SECRET = "Move the secret to a secret manager or environment variable and rotate the exposed value."

RULES: dict[str, tuple[str, str, str, str, str, str]] = {
    "config_debug": ("config_audit", "insecure_config", "high", "0.90",
                     "Debug mode enabled in configuration", _FIX_DEBUG),
    "config_cors": ("config_audit", "insecure_config", "high", "0.92",
                    "Wildcard CORS origin configured", _FIX_CORS),
    "env_committed": ("config_audit", "committed_env_file", "high", "0.88",
                      "Environment file is committed without .gitignore coverage", _FIX_ENV),
    "js_exec_decoded": ("js_pattern_rules", "obfuscated_dynamic_execution", "critical", "0.88",
                        "JavaScript dynamic execution pattern", _FIX_JS_EXEC),
    "js_exec_other": ("js_pattern_rules", "obfuscated_dynamic_execution", "high", "0.70",
                      "JavaScript dynamic execution pattern", _FIX_JS_EXEC),
    "js_auth_bypass": ("js_pattern_rules", "hardcoded_auth_bypass", "high", "0.78",
                       "Hardcoded value used in JavaScript authentication conditional", _FIX_JS_AUTH),
    "raw_ip": ("backdoor_heuristics", "suspicious_outbound_connection", "medium", "0.68",
               "Hardcoded IP address used for outbound connection", _FIX_RAW_IP),
    "isolated_domain": ("backdoor_heuristics", "suspicious_outbound_connection", "low", "0.42",
                        "Isolated hardcoded outbound domain", _FIX_DOMAIN),
    "install_script": ("backdoor_heuristics", "suspicious_install_script", "high", "0.86",
                       "Suspicious package install lifecycle script", _FIX_INSTALL),
    "typosquat": ("dependency_audit", "typosquatted_dependency", "high", "0.86",
                  "Dependency name resembles a popular package", _FIX_TYPO),
    "obscure_dependency": ("dependency_audit", "unrecognized_dependency", "low", "0.35",
                           "Dependency name has a low-recognizability pattern", _FIX_OBSCURE),
    "py_exec_decoded": ("ast_rules", "obfuscated_dynamic_execution", "critical", "0.93",
                        "Dynamic execution fed by decoded or concatenated data", _FIX_PY_EXEC),
    "py_exec_concat": ("ast_rules", "obfuscated_dynamic_execution", "high", "0.82",
                       "Dynamic execution fed by decoded or concatenated data", _FIX_PY_EXEC),
    "py_shell_decoded": ("ast_rules", "obfuscated_dynamic_execution", "critical", "0.95",
                         "Shell command execution fed by decoded or external data", _FIX_SHELL),
    "py_shell_external": ("ast_rules", "obfuscated_dynamic_execution", "high", "0.85",
                          "Shell command execution fed by decoded or external data", _FIX_SHELL),
    "py_auth_bypass": ("ast_rules", "hardcoded_auth_bypass", "high", "0.84",
                       "Hardcoded value used in authentication conditional", _FIX_PY_AUTH),
    "model_pickle": ("model_security_rules", "unsafe_model_deserialization", "high", "0.94",
                     "Unsafe pickle deserialization", _FIX_PICKLE),
    "model_torch": ("model_security_rules", "unsafe_model_deserialization", "medium", "0.67",
                    "PyTorch model load does not enable weights_only", _FIX_TORCH),
    "model_joblib": ("model_security_rules", "unsafe_model_deserialization", "medium", "0.72",
                     "Potentially unsafe joblib model deserialization", _FIX_JOBLIB),
    "js_prompt_injection": ("prompt_injection_rules", "prompt_injection_risk", "medium", "0.55",
                            "Untrusted input appears in an LLM prompt", _FIX_PROMPT),
    "py_prompt_injection": ("prompt_injection_rules", "prompt_injection_risk", "medium", "0.62",
                            "Untrusted input appears in an LLM prompt", _FIX_PROMPT),
    # Secret rules (our catalogue: families named by the reference, patterns our own).
    "secret_aws": ("secret_scan", "hardcoded_secret", "critical", "0.95", "AWS access key ID committed", _FIX_SECRET),
    "secret_jwt": ("secret_scan", "hardcoded_secret", "high", "0.85", "JSON Web Token committed", _FIX_SECRET),
    "secret_private_key": ("secret_scan", "hardcoded_secret", "critical", "0.97", "Private key committed",
                           _FIX_SECRET),
    "secret_stripe": ("secret_scan", "hardcoded_secret", "critical", "0.98", "Payment API secret key committed",
                      _FIX_SECRET),
    "secret_entropy": ("secret_scan", "hardcoded_secret", "high", "0.80",
                       "High-entropy secret assigned in source", _FIX_SECRET),
}


def emit(df: DataFrame, rule_id: str | Column, *, line_start: Column, line_end: Column | None = None,
         snippet: Column, description: Column, confidence: Column | None = None,
         order: Column | None = None) -> DataFrame:
    """Project detector rows (with repo_id, commit_sha, file_path) onto the finding shape.

    ``order`` (optional) is carried along as ``_order``: the place of the row among its detector's rows.
    ``rule_id`` may be a column naming a rule per row (variants of one rule).
    The catalogue values are spliced in as SQL text (one parse on the JVM
    side instead of one driver round trip per expression node).
    """
    line_end = line_start if line_end is None else line_end
    staged = df.select("repo_id", "commit_sha", "file_path",
                       (rule_id if not isinstance(rule_id, str) else F.lit(rule_id)).alias("_rule"),
                       line_start.cast("int").alias("line_start"), line_end.cast("int").alias("line_end"),
                       snippet.alias("code_snippet"), description.alias("description"),
                       (confidence if confidence is not None else F.lit(None)).cast(CONFIDENCE).alias("_conf"),
                       *([order.cast("long").alias("_order")] if order is not None else []))
    fields = ["detector", "category", "severity", "confidence", "title", "fix_suggestion"]

    def value(i: int) -> str:
        if isinstance(rule_id, str):
            v = RULES[rule_id][i]
            return f"CAST({v} AS DECIMAL(3,2))" if fields[i] == "confidence" else _q(v)
        branches = " ".join(
            f"WHEN {_q(rid)} THEN " + (f"CAST({spec[i]} AS DECIMAL(3,2))" if fields[i] == "confidence" else _q(spec[i]))
            for rid, spec in RULES.items())
        return f"CASE _rule {branches} END"

    conf = f"coalesce(_conf, {value(3)})"
    return staged.selectExpr(
        "repo_id", "commit_sha", f"{value(0)} AS detector", f"{value(1)} AS category", f"{value(2)} AS severity",
        f"{conf} AS confidence", "file_path", "line_start", "line_end", "code_snippet", f"{value(4)} AS title",
        "description", f"{value(5)} AS fix_suggestion", *(["_order"] if order is not None else []))


def _q(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def severity_rank(col: Column) -> Column:
    expr = F.lit(UNKNOWN_SEVERITY_RANK)
    for sev in reversed(SEVERITIES):
        expr = F.when(col == sev, F.lit(SEVERITY_RANK[sev])).otherwise(expr)
    return expr


def severity_weight(col: Column) -> Column:
    expr = F.lit(0)
    for sev in reversed(SEVERITIES):
        expr = F.when(col == sev, F.lit(RISK_WEIGHTS[sev])).otherwise(expr)
    return expr
