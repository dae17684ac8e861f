"""Structured Streaming: findings of arriving files, current status of scans and remediations.

Sinks are versioned tables keyed by what a micro-batch replaces (a file, a
scan, a remediation), so a retried batch repeats its own result. Output and
checkpoint folders come from the caller; on a cluster they are shared folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import merge as mg
from riskloom.operators import network_rules as net
from riskloom.operators import pyfacts as pf
from riskloom.operators import pyrules as prl
from riskloom.operators.catalog import FINDING_COLUMNS
from riskloom.session import cut_lineage
from riskloom.sources import files as src
from riskloom.sources.sinks import SCAN, read_keys, read_table, replace_rows

FILE = [*SCAN, "file_path"]
# a repeat of a file that arrives this long after the first one is looked at again (its rows replace the same rows)
REPEATS_WITHIN = "1 day"


def table_stream(spark: SparkSession, folder: str, table: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A stream of the parquet table ``table`` (a name or glob) in ``folder``, be it one file or a folder of files.

    The path is always a glob (its last letter as a class): a stream over a plain path takes it for a folder.
    """
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    name = f"{table[:-1]}[{table[-1]}]" if table[-1].isalnum() else table
    return reader.load(f"{folder.rstrip('/')}/{name}")


def fresh_files(stream: DataFrame, seen_at: str, within: str = REPEATS_WITHIN) -> DataFrame:
    """Files of a stream without repeats: path and content are kept as state until the watermark has passed them."""
    return (stream.withColumn("content_key", F.xxhash64("content", "size_bytes")).withWatermark(seen_at, within)
            .dropDuplicatesWithinWatermark([*FILE, "content_key"]))


def last_contents(batch: DataFrame, seen_at: str) -> DataFrame:
    """One row per file of a micro-batch: the content seen last (decided on keys; contents stay where they are)."""
    order = F.struct(seen_at, "content_key")
    ranked = batch.groupBy(*FILE).agg(F.max_by("content_key", order).alias("content_key"), F.countDistinct("content_key").alias("n"))
    older = ranked.filter("n > 1").withColumnRenamed("content_key", "last")
    if older.isEmpty():
        return batch
    return batch.join(older, FILE, "left").filter("last IS NULL OR last = content_key").drop("last", "n")


def file_facts(files: DataFrame, eligible: DataFrame, special: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per file with what the cross-file rules read of it: size, text of env and .gitignore files, hosts."""
    env = special.where((F.col("file_path") == ".gitignore") | ~F.col("name").isin(src.MANIFEST_NAMES)).select(
        *FILE, "eligible", "name", F.col("content").alias("rules_text"))
    hosts = refs.where(~F.col("is_ip")).groupBy(*FILE).agg(
        F.collect_list(F.struct("is_source", "pos", "line", "snippet", "host", "is_ip")).alias("hosts"))
    return files.select(*FILE, "size_bytes").join(env, FILE, "left").join(hosts, FILE, "left")


def cross_file(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings of the cross-file rules, scans over the size limit) from file facts of whole scans."""
    special = facts.where(F.col("rules_text").isNotNull()).select(*FILE, "size_bytes", "eligible", "name", F.col("rules_text").alias("content"))
    refs = facts.select(*FILE, F.explode("hosts").alias("h")).select(*FILE, "h.*")
    return mg.cross_file_findings(special, refs), mg.over_limit_repos(facts)


def start_findings_stream(stream: DataFrame, out_dir: str, checkpoint: str, seen_at: str = "seen_at", python: bool = True,
                          trigger: dict | None = None, within: str = REPEATS_WITHIN):
    """Keep ``out_dir`` equal to the findings of all files seen.

    ``stream`` has the columns of ``code_files`` and an arrival time. A micro-batch reads its own new files only:
    the rules of one file run on them and their findings replace those of the same files. What the cross-file
    rules need of each file (size, env and .gitignore text, hosts) goes into a table of facts; those rules run on
    the facts of the scans the batch touches, so a late .gitignore removes findings and no content is read twice.
    Repeated files are dropped while the watermark remembers them; later repeats replace the same rows.
    """
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        held = batch.persist(StorageLevel.DISK_ONLY)  # rebuilt from the source if its executor is lost
        try:
            files = last_contents(held, seen_at).drop(seen_at, "content_key")
            keys = cut_lineage(files.select(*FILE).distinct())
            if keys.isEmpty():
                return
            el = src.eligible_files(files)
            hits, special, refs = mg.scan_tables(files, el)
            found = mg.local_findings(el, hits, special, refs)
            if python:
                found = found.unionByName(prl.python_findings(cut_lineage(pf.py_facts(el))))
            replace_rows(found.select(*FINDING_COLUMNS), f"{out_dir}/local", FILE, by=SCAN, keys=keys, order=["line_start"])
            replace_rows(file_facts(files, el, special, refs), f"{out_dir}/facts", FILE, by=SCAN)
            touched = keys.select(*SCAN).distinct()
            cross, rejected = cross_file(cut_lineage(read_keys(touched, f"{out_dir}/facts", SCAN)))
            replace_rows(cross.select(*FINDING_COLUMNS), f"{out_dir}/cross", SCAN, keys=touched, order=["file_path", "line_start"])
            replace_rows(rejected, f"{out_dir}/rejected", SCAN, keys=touched)
        finally:
            held.unpersist()

    writer = fresh_files(stream, seen_at, within).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_stream_output(spark: SparkSession, out_dir: str) -> DataFrame:
    """Findings written by the stream, without those of scans over the size limit."""
    local, cross, rejected = (read_table(spark, f"{out_dir}/{t}") for t in ("local", "cross", "rejected"))
    if rejected is None:
        raise FileNotFoundError(f"no batch has been written to {out_dir}")
    return mg.gate(local.unionByName(cross), rejected=rejected).select(*FINDING_COLUMNS)


def stream_findings(spark: SparkSession, docs_dir: str, files_builder: Callable[[DataFrame], DataFrame], work_dir: str,
                    docs_glob: str = "documents.parquet",
                    docs_schema: str = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
                    max_files: int | None = None, python: bool = True) -> DataFrame:
    """T1 end to end on a folder: stream, drain (availableNow), return the sink.

    ``files_builder`` turns the document stream into ``code_files`` rows; their arrival is the time of the
    micro-batch. ``work_dir`` holds the output and the stream's checkpoint: a second call with the same folder
    goes on where the first one stopped.
    """
    docs = table_stream(spark, docs_dir, docs_glob, docs_schema, max_files)
    stream = files_builder(docs).withColumn("seen_at", F.current_timestamp())
    q = start_findings_stream(stream, f"{work_dir}/out", f"{work_dir}/ckpt", python=python)
    q.awaitTermination()
    return read_stream_output(spark, f"{work_dir}/out")


def latest_status(events: DataFrame, key: str) -> DataFrame:
    return (events.groupBy(key)
                  .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"),
                       F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("events")))


def stream_status(spark: SparkSession, events_stream: DataFrame, key: str, work_dir: str) -> DataFrame:
    """A stateful aggregation of status events; every micro-batch merges only its changed keys by key."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        replace_rows(batch, f"{work_dir}/out", [key])

    q = (latest_status(events_stream, key).writeStream.outputMode("update")
         .foreachBatch(write_batch).option("checkpointLocation", f"{work_dir}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_table(spark, f"{work_dir}/out")


# Statuses a scan reaches only after its file inventory.
INVENTORIED = ["static_scan", "ai_review", "merging", "complete"]


def scan_state(events: DataFrame) -> DataFrame:
    """Per scan the last event by (time, id) and whether its inventory is done; late and repeated events change
    nothing that a newer event has decided. As streaming state: one small row per scan, combined per task first."""
    return events.groupBy(*SCAN).agg(F.max(F.struct("ts", "event_id", "status")).alias("last"),
                                     F.max(F.col("status").isin(INVENTORIED)).alias("inventoried"))


def scan_status(state: DataFrame, inventory: DataFrame) -> DataFrame:
    """T2 rows: status, files_scanned (0 until the inventory is done) and time of the last event, per scan."""
    return state.join(inventory.select(*SCAN, "files_scanned"), SCAN, "left").select(
        *SCAN, F.col("last.status").alias("status"),
        F.when(F.col("inventoried"), F.coalesce("files_scanned", F.lit(0))).otherwise(0).cast("long").alias("files_scanned"),
        F.col("last.ts").alias("updated_at"))


def stream_scan_status(spark: SparkSession, events_stream: DataFrame, inventory: Callable[[DataFrame], DataFrame], work_dir: str,
                       trigger: dict | None = None) -> DataFrame:
    """Current status of every scan from a stream of (scan, ts, event_id, status) events.

    State is kept per scan; a micro-batch hands on the scans it changed, which meet ``inventory(scans)`` (file
    counts of those scans, read anew by each batch) and replace their rows in the status table.
    """
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        changed = cut_lineage(batch)
        replace_rows(scan_status(changed, inventory(changed.select(*SCAN))), f"{work_dir}/out", SCAN)

    q = (scan_state(events_stream).writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", f"{work_dir}/ckpt").trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    return read_table(spark, f"{work_dir}/out")
