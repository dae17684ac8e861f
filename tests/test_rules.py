"""Rules behind a failure boundary; taint carried through scopes in one pass."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.operators import rules as rl
from riskloom.operators.pyrules import carry_taint

FINDING = {"detector": "d", "category": "c", "severity": "low", "title": "t", "description": "x", "fix_suggestion": ""}


def rows(x, snippet=None):
    return x.eligible.select("repo_id", "commit_sha", "file_path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
                             F.lit("0.50").cast("decimal(3,2)").alias("confidence"),
                             (F.col("content") if snippet is None else snippet).alias("code_snippet"), *[F.lit(v).alias(k) for k, v in FINDING.items()])


def inputs(spark, n=40):
    files = spark.createDataFrame([(f"r{i}", "s", "a.py", f"text {i}") for i in range(n)], "repo_id string, commit_sha string, file_path string, content string")
    return rl.ScanInputs(*[files.repartition(3)] * 6)


def test_failing_rules_lose_only_what_they_cannot_read(spark):
    @F.udf("string")
    def picky(text):
        if text in ("text 7", "text 23"):
            raise ValueError("cannot read " + text)
        return text

    rules = rl.RuleSet({})
    rules.register_rule("plain", rows)
    rules.register_rule("picky", lambda x: rows(x, picky("content")))
    rules.register_rule("unplanned", lambda x: x.eligible.select("nothing"))
    rules.register_rule("shape", lambda x: rows(x).withColumn("line_start", F.lit("1")))
    rules.register_rule("python_error", lambda x: 1 / 0)
    found, warned = rl.run_rules(inputs(spark), rules.rules)
    per_scan = {r.repo_id: r["count"] for r in found.groupBy("repo_id").count().collect()}
    assert per_scan == {f"r{i}": 1 if i in (7, 23) else 2 for i in range(40)}
    warnings = {}
    for r in warned.collect():
        warnings.setdefault(r.rule, {})[r.repo_id] = r.warning
    assert {k: len(v) for k, v in warnings.items()} == {"picky": 2, "unplanned": 40, "shape": 40, "python_error": 40}
    assert set(warnings["picky"]) == {"r7", "r23"} and all(w.startswith("picky failed: ") for w in warnings["picky"].values())
    assert "line_start int" in warnings["shape"]["r1"] and "ZeroDivisionError" in warnings["python_error"]["r1"]


def test_runs_of_a_failing_rule_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rl, "MOST_RUNS", 20)
    broken = lambda x: rows(x, F.raise_error(F.lit("always")).cast("string"))
    found, warned = rl.run_rules(inputs(spark, 60), {"plain": rows, "broken": broken})
    assert found.count() == 60 and sorted(r.repo_id for r in warned.collect()) == sorted(f"r{i}" for i in range(60))


def picky_rule(bad):
    """A rule that raises on some texts."""
    return lambda x: rows(x, F.when(F.col("content").isin(bad), F.raise_error(F.concat(F.lit("cannot read "), "content"))).otherwise(F.col("content")))


def test_no_scan_loses_its_findings_to_the_number_of_runs(spark, monkeypatch):
    monkeypatch.setattr(rl, "MOST_RUNS", 20)
    bad = {f"r{i}" for i in range(0, 60, 5)}
    found, warned = rl.run_rules(inputs(spark, 60), {"picky": picky_rule([f"text {r[1:]}" for r in bad])})
    warnings = {r.repo_id: r.warning for r in warned.collect()}
    assert sorted(r.repo_id for r in found.collect()) == sorted({f"r{i}" for i in range(60)} - bad)
    assert set(warnings) == bad and warned.count() == len(bad)
    assert all(f"cannot read text {r[1:]}" in w for r, w in warnings.items())


def test_scans_of_one_hash_are_run_by_their_keys(spark):
    """The hash leaves nulls out: these two keys have the same one."""
    keys = [(None, "x", 0), ("x", None, 1), ("y", "z", 2), (None, None, 3)]
    files = spark.createDataFrame([(r, c, "a.py", f"text {i}") for r, c, i in keys], "repo_id string, commit_sha string, file_path string, content string")
    found, warned = rl.run_rules(rl.ScanInputs(*[files] * 6), {"picky": picky_rule(["text 1", "text 3"])})
    assert {(r.repo_id, r.commit_sha) for r in found.collect()} == {(None, "x"), ("y", "z")} and found.count() == 2
    assert sorted((r.repo_id or "", r.commit_sha or "", r.rule) for r in warned.collect()) == [("", "", "picky"), ("x", "", "picky")]


def test_rows_that_cannot_be_read_cost_their_own_scans(spark):
    x = inputs(spark, 60)
    broken = x.eligible.withColumn("content", F.when(F.col("repo_id").isin("r7", "r11"), F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    found, warned = rl.run_rules(rl.ScanInputs(x.files, broken, x.hits, x.special, x.refs, x.facts), {"plain": rows, "other": lambda i: rows(i).select("*")})
    per_scan = {r.repo_id: r["count"] for r in found.groupBy("repo_id").count().collect()}
    assert per_scan == {f"r{i}": 2 for i in range(60) if i not in (7, 11)}
    assert sorted((r.repo_id, r.rule) for r in warned.collect()) == [(r, k) for r in ("r11", "r7") for k in ("other", "plain")]


def test_a_run_reads_the_rows_of_its_scans(spark):
    """Below the first cut a run takes its rows from a table that lies apart by group, not from the input."""
    read = []

    def rule(x):
        read.append(x.eligible.inputFiles())
        return picky_rule(["text 3"])(x)

    found, warned = rl.run_rules(inputs(spark, 100), {"picky": rule})
    assert found.count() == 99 and warned.count() == 1
    below = [r for r in read if r]
    assert below and all("/rows/" in f and "_scan_group=" in f for r in below for f in r)


def test_registering(spark):
    rules = rl.RuleSet()
    assert list(rules.rules) == ["secret_scan", "config_audit", "dependency_audit", "ast_rules", "js_pattern_rules", "backdoor_heuristics",
                                 "prompt_injection_rules", "model_security_rules"]
    with pytest.raises(ValueError):
        rules.register_rule("ast_rules", rows)
    with pytest.raises(TypeError):
        rules.register_rule("new", "not a function")
    found, warned = rl.run_rules(inputs(spark, 2), {})
    assert found.count() == warned.count() == 0 and found.columns == rl.FINDING_COLUMNS


def event(scope, seq, is_call=False, name="", deps=(), source=False, line=None):
    return {"repo_id": "r", "commit_sha": "s", "file_path": "a.py", "scope": scope, "seq": seq, "is_call": is_call, "name": name,
            "deps": list(deps), "source": source, "line": line, "snippet": f"line {line}"}


def calls(events, size):
    out = carry_taint(pa.RecordBatch.from_pylist(events[i:i + size]) for i in range(0, len(events), size))
    return [(r["file_path"], r["line"]) for b in out for r in b.to_pylist()]


def test_taint_equals_definitions_looked_up_one_by_one():
    """Every use looks up its last definition and follows it back, instead of carrying a set forward."""
    rng = random.Random(2)
    for _ in range(60):
        events, want = [], []
        for scope in range(3):
            body = [event(scope, -1, name=p, source=True) for p in rng.sample("ab", rng.randint(0, 2))]
            for i in range(rng.randint(1, 30)):
                deps = rng.sample("abcde", rng.randint(0, 2))
                source = rng.random() < 0.1
                body.append(event(scope, i, True, "llm", deps, source, line=1000 * scope + i) if rng.random() < 0.3 else
                            event(scope, i, name=rng.choice("abcde"), deps=deps, source=source))

            def tainted(at):
                e = body[at]
                defs = [max((j for j in range(at) if not body[j]["is_call"] and body[j]["name"] == d), default=None) for d in e["deps"]]
                return e["source"] or any(j is not None and tainted(j) for j in defs)

            want += [("a.py", e["line"]) for i, e in enumerate(body) if e["is_call"] and tainted(i)]
            events += body
        assert calls(events, rng.choice([1, 7, 1000])) == want


def test_taint_is_linear_in_events():
    def seconds(n):
        chain = [event(0, -1, name="x0", source=True)] + [event(0, i, name=f"x{i}", deps=[f"x{i - 1}"]) for i in range(1, n)]
        chain += [event(0, n + i, True, "llm", [f"x{n - 1}"], line=i) for i in range(n)]
        t = time.perf_counter()
        assert len(calls(chain, 1000)) == n
        return time.perf_counter() - t

    small = min(seconds(5_000) for _ in range(3))
    assert min(seconds(50_000) for _ in range(2)) < 30 * small
