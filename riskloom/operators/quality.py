"""Constraints on stored tables: one pass a table gives broken rows, clean rows and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.operators.catalog import SEVERITIES
from riskloom.operators.remediate import REMEDIATION_STATUSES, SCAN_STATUSES


@dataclass(frozen=True)
class Check:
    """A row of ``table`` is broken for ``reason`` unless ``ok`` (SQL over its columns) is true; null is not true."""

    table: str
    reason: str
    ok: str


def one_of(column: str, values: list) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


STORED_CHECKS = [
    Check("findings", "confidence_range", "confidence BETWEEN 0 AND 1"),
    Check("findings", "valid_severity", one_of("severity", SEVERITIES)),
    Check("reports", "risk_score_range", "overall_risk_score BETWEEN 0 AND 100"),
    Check("remediations", "valid_tier", one_of("tier", [1, 2, 3])),
    Check("remediations", "valid_status", one_of("status", REMEDIATION_STATUSES)),
    Check("scans", "valid_status", one_of("status", SCAN_STATUSES)),
]


def broken(checks: list[Check]) -> Column:
    """The reasons for which a row is broken, in order of the checks."""
    if not checks:
        return F.array().cast("array<string>")
    reasons = [F.when(~F.coalesce(F.expr(c.ok), F.lit(False)), F.lit(c.reason)) for c in checks]
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


class Quality:
    """Checks over tables (name -> (rows, id column)). ``violations`` reads every table once; the same pass counts
    rows and broken rows per check, which ``counts`` returns when an action on ``violations`` has ended."""

    def __init__(self, tables: dict[str, tuple[DataFrame, str]], checks: list[Check] | None = None):
        checks = STORED_CHECKS if checks is None else checks
        unknown = {c.table for c in checks} - set(tables)
        if unknown:
            raise ValueError(f"checks of tables that are not given: {sorted(unknown)}")
        self.tables, self.of = tables, {t: [c for c in checks if c.table == t] for t in tables}
        self.seen = {t: Observation(f"quality-{t}") for t in tables}
        self.violations = self._violations()

    def _violations(self) -> DataFrame:
        out = None
        for name, (rows, key) in self.tables.items():
            marked = rows.select(F.col(key).cast("string").alias("id"), broken(self.of[name]).alias("reasons"))
            counts = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.array_contains("reasons", c.reason)).alias(c.reason) for c in self.of[name]]
            part = marked.observe(self.seen[name], *counts).select(F.lit(name).alias("table"), "id", F.explode("reasons").alias("reason"))
            out = part if out is None else out.unionByName(part)
        return out

    def clean(self, name: str) -> DataFrame:
        """Rows of a table that break no check."""
        return self.tables[name][0].where(F.size(broken(self.of[name])) == 0)

    def counts(self) -> dict[str, dict[str, int]]:
        return {name: dict(o.get) for name, o in self.seen.items()}
