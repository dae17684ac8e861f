"""Sinks: tables whose rows are replaced by key, written as versions (S12, streaming state, mark log)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import cut_lineage
from riskloom.sources import snapshots as snap

SCAN = ["repo_id", "commit_sha"]
BUCKETS = 64
ATTEMPTS = 8


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest version of the table at ``path`` (or a given one); None before the first write."""
    return snap.read(spark, path, snap.current(spark, path, version))


def read_keys(keys: DataFrame, path: str, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of the table whose ``by`` columns are among ``keys``; only the parts of those keys are read."""
    spark = keys.sparkSession
    wanted = keys.select(*by).distinct()
    names = [f"part={r[0]}" for r in wanted.select(_part(by, [], buckets)).distinct().collect()]
    out = snap.read(spark, path, snap.current(spark, path), names)
    if out is None:
        raise FileNotFoundError(f"nothing has been written to {path}")
    return out.join(wanted, by, "left_semi")


def _part(by: list[str], days: list[str], buckets: int) -> Column:
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("string")
    return F.concat_ws("_", *[F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("none")) for d in days], bucket)


def replace_rows(rows: DataFrame, path: str, key: list[str], days: list[str] | None = None, order: list[str] | None = None,
                 buckets: int = BUCKETS, by: list[str] | None = None, keys: DataFrame | None = None,
                 newest: Callable[[], Column] | None = None, between: Callable[[], None] | None = None) -> int:
    """Write ``rows`` as the next version; every key among ``keys`` (default: those of ``rows``) loses its
    earlier rows, all others keep theirs. Returns the version.

    Parts are ``days`` (date columns) and a hash bucket of ``by`` (default: the key): days times ``buckets`` folders,
    so a table of many days takes few buckets. Only touched parts are written again, the version names the others where they lie. Rows are range-partitioned,
    so one key with very many rows is written by many tasks. Repeating a write changes nothing.

    ``newest``: instead of replacing, each key keeps the row for which this order is largest, old or new.

    A concurrent writer is detected when the version is published. If it touched other parts, this write goes on
    top of it as it is; if it touched one of the same parts, those are carried over again from its version.
    ``between`` is called before each attempt to publish (tests).
    """
    days, by = list(days or []), list(by or key)
    spark = rows.sparkSession
    part = _part(by, days, buckets)
    new = cut_lineage(rows.withColumn("part", part))
    gone = new.select("part", *days, *key).distinct() if keys is None else cut_lineage(
        keys.select(part.alias("part"), *days, *key).distinct())
    touched = {f"part={r[0]}" for r in gone.select("part").distinct().collect()}
    base, folder, schema = None, "", new.drop("part").schema
    for _ in range(ATTEMPTS):
        now = snap.current(spark, path)
        if base is None or any(now.parts.get(p) != base.parts.get(p) for p in touched):
            folder = f"data-{uuid.uuid4().hex}"
            _write_parts(new, gone, snap.read(spark, path, now, sorted(touched)), f"{path}/{folder}", part, [*days, *key], order or [], newest)
        base = now
        written = {n: folder for n in snap.Folder(spark, f"{path}/{folder}").names() if n.startswith("part=")}
        parts = {n: d for n, d in now.parts.items() if n not in touched} | written
        if between is not None:
            between()
        if snap.commit(spark, path, now, parts, schema):
            return now.version + 1
    raise RuntimeError(f"{path}: other writers were first {ATTEMPTS} times")


def _write_parts(new, gone, old, target, part, key, order, newest) -> None:
    if old is not None:
        old = old.withColumn("part", part)
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ["part", *key]]
        if newest is None:
            new = new.unionByName(old.alias("o").join(gone.alias("g"), same, "left_anti").select(*new.columns))
        else:
            new = new.unionByName(old.select(*new.columns))
    if newest is not None:
        new = new.groupBy("part", *key).agg(F.max_by(F.struct(*new.columns), newest()).alias("r")).select("r.*")
    cols = [c for c in dict.fromkeys(["part", *key, *order])]
    (new.repartitionByRange(*cols).sortWithinPartitions(*cols).write.partitionBy("part").parquet(target))


def write_findings(findings: DataFrame, path: str, scan_date=None, buckets: int = BUCKETS, **options) -> int:
    """Replace the given scans' findings of a day; other scans and days stay."""
    date = F.current_date() if scan_date is None else F.lit(scan_date).cast("date")
    return replace_rows(findings.withColumn("scan_date", date), path, SCAN, ["scan_date"], ["file_path", "line_start"], buckets, **options)
