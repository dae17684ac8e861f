"""Rules by name over one shared scan, each inside a failure boundary.

A rule is a function of ``ScanInputs`` (files, eligible files, regex hits, files read whole, URL references,
Python facts) that returns rows of the finding shape. ``run_rules`` runs all rules in one job. Only if that fails
are they run one by one, and a rule that still fails is run on ever smaller groups of scans, until the scans on
which it raises are alone: those get a warning row, its findings on all other scans stay, and so do the findings of
all other rules. There is no limit to these runs: a scan on which the rule does not raise never loses its findings.
A rule that cannot be planned, or whose rows have another shape, gives a warning for every scan.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import config_rules as cr
from riskloom.operators import dependency_rules as dep
from riskloom.operators import js_rules as js
from riskloom.operators import merge as mg
from riskloom.operators import network_rules as net
from riskloom.operators import prompt_rules as pr
from riskloom.operators import pyfacts as pf
from riskloom.operators import pyrules as prl
from riskloom.operators import secret_rules as sec
from riskloom.operators.catalog import FINDING_COLUMNS
from riskloom.session import cut_lineage, ensure_checkpoint_dir, free_plans
from riskloom.sources import files as src
from riskloom.sources.snapshots import Folder

SCAN = mg.SCAN_KEY
WARNING = "repo_id string, commit_sha string, rule string, warning string"
TYPES = {c: "string" for c in FINDING_COLUMNS} | {"confidence": "decimal(3,2)", "line_start": "int", "line_end": "int"}
FINDING = ", ".join(f"{c} {t}" for c, t in TYPES.items())
# a failing group of scans is cut into 2 ** SPLIT_BITS groups by the next bits of its scans' hashes
SPLIT_BITS = 3
HASH_BITS = 63
# runs of one round, some of them side by side, and how many are held before their findings are written; a rule gets as
# many rounds as it takes to have its failing scans alone
MOST_RUNS = 256
RUNS_AT_ONCE = 2
RUNS_KEPT = 64
GROUP = "_scan_group"
MESSAGE = 900


@dataclass(frozen=True)
class ScanInputs:
    """What rules read; every table has the scan key."""

    files: DataFrame
    eligible: DataFrame
    hits: DataFrame
    special: DataFrame
    refs: DataFrame
    facts: DataFrame

    @classmethod
    def of(cls, files: DataFrame) -> "ScanInputs":
        el = src.eligible_files(files)
        return cls(files, el, *mg.scan_tables(files, el), cut_lineage(pf.py_facts(el)))

    def where(self, condition) -> "ScanInputs":
        return ScanInputs(*[getattr(self, f.name).where(condition) for f in fields(self)])

    @property
    def manifests(self) -> DataFrame:
        return src.manifest_files(self.special.drop("eligible", "name", "suffix", "suffix_l", "is_source"))


Rule = Callable[[ScanInputs], DataFrame]


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _backdoor(x: ScanInputs) -> DataFrame:
    return net.backdoor_dedupe(_union(net.raw_ip_url(x.eligible, x.refs), net.raw_ip_socket(x.eligible, x.hits),
                                      net.isolated_domain(x.eligible, x.refs), net.install_script(x.special.where("eligible"))))


BUILT_IN: dict[str, Rule] = {
    "secret_scan": lambda x: sec.secret_findings(x.eligible, x.hits),
    "config_audit": lambda x: _union(cr.config_debug(x.eligible, x.hits), cr.config_cors(x.eligible, x.hits),
                                     cr.env_committed(x.special.where("eligible"), x.special)),
    "dependency_audit": lambda x: dep.dependency_findings(x.manifests),
    "ast_rules": lambda x: _union(prl.py_dynamic_exec(x.facts), prl.py_shell_exec(x.facts), prl.py_auth_bypass(x.facts)),
    "js_pattern_rules": lambda x: _union(js.js_dynamic_exec(x.eligible, x.hits), js.js_auth_bypass(x.eligible, x.hits)),
    "backdoor_heuristics": _backdoor,
    "prompt_injection_rules": lambda x: _union(pr.js_prompt_injection(x.eligible, x.hits), prl.py_prompt_injection(x.facts)),
    "model_security_rules": lambda x: _union(prl.model_pickle(x.facts), prl.model_torch(x.facts), prl.model_joblib(x.facts)),
}


class RuleSet:
    """Rules in the order they were registered; the order decides ties of merged findings."""

    def __init__(self, rules: dict[str, Rule] | None = None):
        self.rules = dict(BUILT_IN if rules is None else rules)

    def register_rule(self, name: str, fn: Rule) -> None:
        if not name or name in self.rules:
            raise ValueError(f"a rule needs a name of its own: {name!r}")
        if not callable(fn):
            raise TypeError(f"{name}: a rule is a function of ScanInputs")
        self.rules[name] = fn


def shaped(rows: DataFrame) -> DataFrame:
    """Rows on the finding shape; an error names the columns that are missing or of another type."""
    have = dict(rows.dtypes)
    wrong = [f"{c} {t}" for c, t in TYPES.items() if have.get(c) != t]
    if wrong:
        raise TypeError(f"not the finding shape, expected {', '.join(wrong)}")
    return rows.select(*FINDING_COLUMNS)


def message(name: str, error: Exception) -> str:
    """The first line of an error, as a warning of the rule."""
    text = str(error.java_exception.getMessage()) if isinstance(error, Py4JJavaError) else str(error)
    return f"{name} failed: {type(error).__name__}: {text.strip().splitlines()[0] if text.strip() else ''}"[:MESSAGE]


_FAILS = (PySparkException, Py4JJavaError)


def run_rules(inputs: ScanInputs, rules: dict[str, Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, warnings) of all rules; warnings are (repo_id, commit_sha, rule, warning)."""
    rules = BUILT_IN if rules is None else rules
    spark = inputs.files.sparkSession
    plans, warnings = {}, []
    every = inputs.files.select(*SCAN).distinct()
    for name, fn in rules.items():
        try:
            plans[name] = shaped(fn(inputs))
        except Exception as error:  # a rule is foreign code: whatever it raises is its own failure
            warnings.append(every.select(*SCAN, F.lit(name).alias("rule"), F.lit(message(name, error)).alias("warning")))
    found = []
    if plans:
        try:
            found.append(cut_lineage(_union(*plans.values())))
        except _FAILS:
            scans = cut_lineage(every.withColumn("h", F.xxhash64(*SCAN)))
            for name, plan in plans.items():
                rows, warned = _apart(name, plan, rules[name], inputs, scans)
                found += rows
                warnings += warned
    none = spark.createDataFrame([], FINDING)
    return _union(none, *found), _union(spark.createDataFrame([], WARNING), *warnings)


def _apart(name: str, plan: DataFrame, fn: Rule, inputs: ScanInputs, scans: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """A rule on its own: its findings on the scans it can read and warnings for the others."""
    try:
        return [cut_lineage(plan)], []
    except _FAILS as error:
        runs = _Runs(name, fn, inputs, scans)
        runs.split({f.name: getattr(inputs, f.name) for f in fields(inputs)}, 0, {0: message(name, error)})
        return [runs.kept("found", FINDING)], [runs.kept("warned", WARNING)]


class _Runs:
    """The runs of a rule that raises; what they give is kept in a folder below the checkpoint folder.

    A group is what shares the first bits of the scans' hashes. The tables that the rule takes are written once per
    round with a folder for each group, so a run reads the rows of its own scans and not the corpus.
    """

    def __init__(self, name: str, fn: Rule, inputs: ScanInputs, scans: DataFrame):
        self.name, self.fn, self.scans, self.spark = name, fn, scans, scans.sparkSession
        self.taken = _taken(fn, inputs)
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/rule-{uuid.uuid4().hex}"
        self.number = itertools.count()
        self._keep("found", self.spark.createDataFrame([], FINDING))
        self._keep("warned", self.spark.createDataFrame([], WARNING))

    def _keep(self, what: str, rows: DataFrame) -> None:
        rows.hint("rebalance").write.parquet(f"{self.path}/{what}/{next(self.number)}")

    def kept(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{what}")

    def split(self, tables: dict[str, DataFrame], bits: int, failing: dict[int, str]) -> None:
        """Runs on the parts of failing groups (first ``bits`` of the hash -> error), down to single scans."""
        more = bits + SPLIT_BITS
        for some in _batches(sorted(failing), max(1, MOST_RUNS >> SPLIT_BITS)):
            if more > HASH_BITS:
                self._one_by_one(tables, bits, some)
                continue
            sizes = {r.p: r.n for r in _group(self.scans, bits, some).groupBy(_prefix(more).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
            parts = Counter(p >> SPLIT_BITS for p in sizes)
            left = {p: failing[p >> SPLIT_BITS] for p in sizes if parts[p >> SPLIT_BITS] == 1}  # the same scans, not run again
            cut = sorted(sizes.keys() - left.keys())
            rows, folder = self._by_group(tables, bits, some, more) if bits and cut else (_groups(tables, bits, some), None)
            errors = self._run([_later(rows, lambda t, p=p: _group(t, more, [p])) for p in cut])
            left |= {p: error for p, error in zip(cut, errors, strict=True) if error is not None}
            self._warn([(p, error) for p, error in left.items() if sizes[p] == 1], more)
            self.split(rows, more, {p: error for p, error in left.items() if sizes[p] > 1})
            if folder is not None:
                Folder(self.spark, self.path).delete(folder)

    def _by_group(self, tables: dict[str, DataFrame], bits: int, some: list[int], more: int) -> tuple[dict[str, DataFrame], str]:
        """The rows of some groups, those of tables that the rule takes written apart by the next bits."""
        rows, folder = _groups(tables, bits, some), f"rows/{next(self.number)}"
        for k in self.taken:
            with suppress(*_FAILS):  # rows that cannot be read: the runs find out for which scans
                one = rows[k].withColumn(GROUP, _prefix(more))
                one.hint("rebalance", GROUP).write.partitionBy(GROUP).parquet(f"{self.path}/{folder}/{k}")
                rows[k] = self.spark.read.schema(one.schema).parquet(f"{self.path}/{folder}/{k}")
        return rows, folder

    def _one_by_one(self, tables: dict[str, DataFrame], bits: int, some: list[int]) -> None:
        """Scans whose hashes are the same: each is found by its key."""
        keys = _group(self.scans, bits, some).select(*SCAN).collect()
        repo, commit = SCAN
        errors = self._run([_later(_groups(tables, bits, some), lambda t, key=key: t.where(
            F.col(repo).eqNullSafe(F.lit(key[repo])) & F.col(commit).eqNullSafe(F.lit(key[commit])))) for key in keys])
        warned = [(*key, self.name, error) for key, error in zip(keys, errors, strict=True) if error is not None]
        if warned:
            self._keep("warned", self.spark.createDataFrame(warned, WARNING))

    def _warn(self, alone: list[tuple[int, str]], bits: int) -> None:
        if alone:
            errors = self.spark.createDataFrame(alone, "p long, warning string")
            self._keep("warned", self.scans.withColumn("p", _prefix(bits)).join(F.broadcast(errors), "p").select(
                *SCAN, F.lit(self.name).alias("rule"), "warning"))

    def _run(self, groups: list[ScanInputs]) -> list[str | None]:
        """The rule on each group: its findings are kept, its errors returned."""
        def one(group: ScanInputs) -> DataFrame | str:
            try:
                return cut_lineage(shaped(self.fn(group)))
            except _FAILS as error:
                return message(self.name, error)

        errors = []
        for some in _batches(groups, RUNS_KEPT):
            with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:
                runs = [pool.submit(inheritable_thread_target(self.spark)(one), g) for g in some]
                done = [r.result() for r in runs]
            errors += [d if isinstance(d, str) else None for d in done]
            found = [d for d in done if isinstance(d, DataFrame)]
            if found:
                self._keep("found", _union(*found))
            del found, done, runs
            free_plans(self.spark)
        return errors


class _Later(ScanInputs):
    """Inputs whose tables are made when a rule takes them."""

    def __getattribute__(self, name):
        value = super().__getattribute__(name)
        return value() if name in ScanInputs.__dataclass_fields__ and not isinstance(value, DataFrame) else value


def _later(tables: dict[str, DataFrame], of: Callable[[DataFrame], DataFrame]) -> ScanInputs:
    return _Later(**{k: lambda t=t: of(t) for k, t in tables.items()})


def _taken(fn: Rule, inputs: ScanInputs) -> list[str]:
    """The tables of its inputs that a rule takes."""
    tables, taken = {f.name: getattr(inputs, f.name) for f in fields(inputs)}, set()

    def take(k: str) -> DataFrame:
        taken.add(k)
        return tables[k]

    with suppress(Exception):  # an error now is none of the runs' errors
        fn(_Later(**{k: lambda k=k: take(k) for k in tables}))
    return [k for k in tables if k in taken]


def _batches(items: list, size: int) -> Iterable[list]:
    return (items[i:i + size] for i in range(0, len(items), size))


def _prefix(bits: int):
    """The first ``bits`` of the scan's hash."""
    return F.shiftrightunsigned(F.xxhash64(*SCAN), 64 - bits) if bits else F.lit(0).cast("long")


def _group(rows: DataFrame, bits: int, some: list[int]) -> DataFrame:
    """The rows of some groups; rows that lie apart by group are read from the folders of these."""
    return rows.where(F.col(GROUP).isin(some)).drop(GROUP) if GROUP in rows.columns else rows.where(_prefix(bits).isin(some))


def _groups(tables: dict[str, DataFrame], bits: int, some: list[int]) -> dict[str, DataFrame]:
    return {k: _group(t, bits, some) for k, t in tables.items()}
