"""Python-AST rule queries.

A parser is not expressible in SQL. The oracles write out what must be found: the lines of the corpus fixture
that each rule flags, picked by their text (all other lines of these files are comments), with values typed
here and not taken from the rule catalogue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import pyfacts as pf
from riskloom.operators import pyrules as prl
from riskloom.plans import oracle_parts as op
from riskloom.plans.q_code import corpus, rule_out
from riskloom.plans.registry import register


def _facts(spark, sf_dir):
    _, el = corpus(spark, sf_dir)
    return pf.py_facts(el)


def _lines_oracle(path: str, line: str, *values: str, line_end: str | None = None) -> str:
    """Rows for the lines of ``path`` that satisfy ``line`` (SQL over ltext and content)."""
    return op.code_prefix() + op.rule_select(f"{op.lines_of('eligible')} l", *values, line_end=line_end,
                                             where=f"file_path = '{path}' AND {line}")


_EXEC = ("ast_rules", "obfuscated_dynamic_execution")
_SHELL = "Shell command execution fed by decoded or external data"
_MODEL = ("model_security_rules", "unsafe_model_deserialization")


@register("py_facts")
def q_py_facts(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return facts.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("facts"))


@register("py_dynamic_exec", _lines_oracle(
    "app/main.py", "ltext = 'eval(\"a\" + \"b\")'", *_EXEC, "'high'", "0.82", "Dynamic execution fed by decoded or concatenated data"))
def q_py_dynamic_exec(spark, sf_dir):
    return rule_out(prl.py_dynamic_exec(_facts(spark, sf_dir)))


@register("py_shell_exec", _lines_oracle(
    "app/main.py", "ltext IN ('subprocess.run(cmd, shell=True)', 'os.system(ext)')", *_EXEC,
    "CASE WHEN ltext = 'os.system(ext)' THEN 'high' ELSE 'critical' END", "CASE WHEN ltext = 'os.system(ext)' THEN 0.85 ELSE 0.95 END", _SHELL))
def q_py_shell_exec(spark, sf_dir):
    return rule_out(prl.py_shell_exec(_facts(spark, sf_dir)))


@register("py_auth_bypass", _lines_oracle(
    "app/main.py", "starts_with(ltext, 'if token_')", "ast_rules", "hardcoded_auth_bypass", "'high'", "0.84",
    "Hardcoded value used in authentication conditional", line_end="line_no + 1"))
def q_py_auth_bypass(spark, sf_dir):
    return rule_out(prl.py_auth_bypass(_facts(spark, sf_dir)))


@register("model_pickle", _lines_oracle(
    "app/models.py", "ltext = '    pickle.loads(payload)'", *_MODEL, "'high'", "0.94", "Unsafe pickle deserialization"))
def q_model_pickle(spark, sf_dir):
    return rule_out(prl.model_pickle(_facts(spark, sf_dir)))


@register("model_torch", _lines_oracle(
    "app/models.py", "ltext = '    torch.load(p, weights_only=False)'", *_MODEL, "'medium'", "0.67",
    "PyTorch model load does not enable weights_only"))
def q_model_torch(spark, sf_dir):
    return rule_out(prl.model_torch(_facts(spark, sf_dir)))


@register("model_joblib", _lines_oracle(
    "app/models.py", "ltext = '    joblib.load(\"m.joblib\")'", *_MODEL, "'medium'", "0.72",
    "Potentially unsafe joblib model deserialization"))
def q_model_joblib(spark, sf_dir):
    return rule_out(prl.model_joblib(_facts(spark, sf_dir)))


@register("py_prompt_injection", _lines_oracle(
    "app/llm.py", "starts_with(ltext, '    return client.chat') AND NOT contains(content, 'prompt = sanitize(prompt)')",
    "prompt_injection_rules", "prompt_injection_risk", "'medium'", "0.62", "Untrusted input appears in an LLM prompt"))
def q_py_prompt_injection(spark, sf_dir):
    return rule_out(prl.py_prompt_injection(_facts(spark, sf_dir)))


@register("scan_warnings", op.code_prefix() + """
SELECT repo_id, commit_sha, 'python_ast' AS detector, count(*) AS files, min(file_path) AS first_file
FROM eligible WHERE file_path = 'app/broken.py' GROUP BY ALL""")
def q_scan_warnings(spark, sf_dir):
    """Per repository and detector, files the detector could not read."""
    files, el = corpus(spark, sf_dir)
    return prl.detector_warnings(files, pf.py_facts(el))
