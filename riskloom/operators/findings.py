"""Finding-table transforms: merge, rank, top-k, recommendations.

Per-scan operations must survive a scan holding a third of all rows, so:
merging is an aggregation (map-side combine before the shuffle), per-group
top-k is two-phase (salted, then exact), and ranking inside a scan uses a
range-partitioned sort plus per-partition offsets instead of one window
partition per scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.catalog import severity_rank
from riskloom.session import cut_lineage

DEDUPE_KEY = ["category", "file_path", "line_start", "title"]
# Total order after the semantic keys ("first on tie" needs a unique order;
# ids in the fixture are not unique).
FINDING_TIE = ["finding_id", "created_at", "severity", "fix_suggestion", "detector"]


def _tie(df: DataFrame, tie) -> list[str]:
    return [c for c in (tie or FINDING_TIE) if c in df.columns]


def dedupe_findings(findings: DataFrame, scan_cols: Sequence[str] = ("scan_id",),
                    tie: Sequence[str] | None = None) -> DataFrame:
    """One row per (scan, category, path, line, title); highest confidence
    wins, the lowest ``ordinal`` on ties. NULL line is a key value.

    Written as ``groupBy + min_by`` so each task pre-merges duplicates before
    the shuffle (partial aggregation), instead of shuffling every row into a
    window.
    """
    cols = findings.columns
    keys = [*scan_cols, *DEDUPE_KEY]
    order = F.struct((-F.col("confidence")).alias("neg_conf"), *[F.col(c) for c in _tie(findings, tie)])
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), order)
    return findings.groupBy(*keys).agg(best.alias("w")).select("w.*")


def row_number_skew_safe(df: DataFrame, group: Sequence[str], order: Sequence[str],
                         out: str = "position", num_partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() OVER (PARTITION BY group ORDER BY order ASC)`` that
    does not put a whole group into one task (``order`` names columns, all
    ascending; negate a column for descending).

    1. Range-partition on (group, order): a hot group spans many partitions.
    2. Sort inside partitions; ``monotonically_increasing_id`` then numbers
       rows in order within each partition.
    3. Count rows per (partition, group) - at most #partitions + #groups rows -
       and turn the counts into starting offsets with a window over that small
       table.
    4. Join the offsets back on (partition, group).

    The numbered rows are checkpointed (reliable checkpoint in the shared
    folder) because they are read twice and the range sampler is not
    guaranteed to choose the same bounds on a second evaluation.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    ranged = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid", *group).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *group, "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    # null-safe on the group: rows of a null group are numbered like any other group
    same = F.col("r._pid") == F.col("o._pid")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = ranged.alias("r").join(offsets.alias("o"), same).select("r.*", "o._first", "o._before")
    result = joined.withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
    return result.drop("_pid", "_mid", "_first", "_before")


def rank_findings(findings: DataFrame, scan_col: str = "scan_id", tie: Sequence[str] | None = None) -> DataFrame:
    """R2: position of each finding inside its scan (1 = most urgent)."""
    sev = severity_rank(F.col("severity"))
    keyed = findings.withColumn("_sev", sev).withColumn("_negconf", -F.col("confidence"))
    ranked = row_number_skew_safe(keyed, [scan_col], ["_sev", "_negconf", "file_path", *_tie(findings, tie)],
                                  out="position")
    return ranked.drop("_sev", "_negconf")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    salt_buckets: int = 32, tie_cols: Sequence[str] = ()) -> DataFrame:
    """Exact top-k rows per group in two phases.

    Phase 1 keeps the top k inside (group, salt) - a hot group is spread over
    ``salt_buckets`` tasks; phase 2 ranks the at most k x buckets survivors.
    """
    salt_src = [F.col(c) for c in (tie_cols or df.columns)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    phase1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return phase1.withColumn("rank_in_group", F.row_number().over(w2)).where(F.col("rank_in_group") <= k)


def top_finding(findings: DataFrame, scan_col: str = "scan_id", tie: Sequence[str] | None = None) -> DataFrame:
    """The most urgent finding per scan (severity rank, confidence desc; first on tie).

    ``min_by`` is an aggregate, so it combines map-side: no hot-scan task.
    """
    key = F.struct(severity_rank(F.col("severity")).alias("r"), (-F.col("confidence")).alias("c"),
                   *[F.col(c) for c in _tie(findings, tie)])
    out_cols = [c for c in ["finding_id", "severity", "confidence", "title", "file_path", "line_start"]
                if c in findings.columns]
    best = F.min_by(F.struct(*out_cols), key)
    return findings.groupBy(scan_col).agg(best.alias("t")).select(scan_col, "t.*")


def recommendations(findings: DataFrame, scan_col: str = "scan_id", tie: Sequence[str] | None = None) -> DataFrame:
    """Distinct fix texts per scan in severity order, first seen wins.

    One row per (scan, fix) first (aggregation), then numbering over those few
    rows per scan (bounded by the rule catalogue).
    """
    tie_cols = _tie(findings, tie)
    key = F.struct(severity_rank(F.col("severity")).alias("r"), (-F.col("confidence")).alias("c"),
                   F.col("file_path").alias("p"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_cols)])
    firsts = (findings.where(F.col("fix_suggestion").isNotNull() & (F.col("fix_suggestion") != ""))
              .groupBy(scan_col, "fix_suggestion").agg(F.min(key).alias("k")))
    # reviewer-written fix texts make the distinct fixes of a scan unbounded: number them skew-safely
    order = ["r", "c", "p", *[f"t{i}" for i in range(len(tie_cols))]]
    flat = firsts.select(scan_col, "fix_suggestion", *[F.col(f"k.{o}").alias(f"_{o}") for o in order])
    numbered = row_number_skew_safe(flat, [scan_col], [f"_{o}" for o in order], out="rec_no")
    return numbered.select(scan_col, F.col("rec_no").cast("int").alias("rec_no"), "fix_suggestion")


MARK_ORDER = ["marked_at", "user_id", "mark_id"]


def latest_marks(marks: DataFrame) -> DataFrame:
    """One mark per finding, the last one written: by time, then user, then mark (those of the columns that there
    are); marks that cannot be told apart count as set if any of them is. An aggregation, combined per task."""
    order = F.struct(*[c for c in MARK_ORDER if c in marks.columns], "is_false_positive")
    return marks.where(F.col("finding_id").isNotNull()).groupBy("finding_id").agg(F.max_by("is_false_positive", order).alias("is_false_positive"))


def record_marks(marks: DataFrame, path: str, buckets: int = 64) -> int:
    """Append marks (finding_id, marked_at, user_id, mark_id, is_false_positive) to the mark table at ``path``, compacted:
    each finding keeps its last mark, whatever order the writes come in."""
    from riskloom.sources.sinks import replace_rows
    rows = marks.where(F.col("finding_id").isNotNull()).select("finding_id", *MARK_ORDER, "is_false_positive")
    return replace_rows(rows, path, ["finding_id"], buckets=buckets, newest=lambda: F.struct(*MARK_ORDER, "is_false_positive"))


def mark_false_positive(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Apply (finding_id, is_false_positive) marks, the last one of each finding; unmarked rows keep their flag."""
    base = findings if "is_false_positive" in findings.columns else \
        findings.withColumn("is_false_positive", F.lit(False))
    m = latest_marks(marks).withColumnRenamed("is_false_positive", "_fp")
    return (base.join(m, "finding_id", "left")
                .withColumn("is_false_positive", F.coalesce("_fp", "is_false_positive")).drop("_fp"))


def list_findings(findings: DataFrame, scans: DataFrame, projects: DataFrame, user_id) -> DataFrame:
    """Findings of scans owned by ``user_id``, oldest first."""
    owned = (scans.join(projects.where(F.col("owner_id") == F.lit(user_id)).select("project_id"), "project_id")
                  .select("scan_id"))
    return findings.join(owned, "scan_id", "left_semi").orderBy("scan_id", "created_at", "finding_id")


def list_projects(projects: DataFrame, user_id) -> DataFrame:
    """A user's projects, newest first."""
    return projects.where(F.col("owner_id") == F.lit(user_id)).orderBy(F.col("created_at").desc(), "project_id")
