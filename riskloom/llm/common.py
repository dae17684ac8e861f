"""Shared plumbing of the llm operators: session settings, table access, durable cuts."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir, ship_package_code

ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Ship this package by value, bound Arrow batches (rows are whole texts), find the shared folder."""
    ship_package_code()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    n = int(spark.conf.get(key, "10000"))
    if n <= 0 or n > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and go on from the files.

    Later passes read what was written, so a lost executor never changes task-numbered rows. Spark removes
    shuffle files and earlier cuts once the driver's JVM has collected their plans; operators of many steps
    ask for that at each cut instead of holding all steps' files until the JVM happens to.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


TASK_ROWS = 1 << 16


def sized(df: DataFrame, n: int | None = None, small: bool = True) -> DataFrame:
    """A cut of ``n`` narrow rows, read by one task per ``TASK_ROWS`` rows however many wrote it; ``small``: joins may
    send one of a single task's rows to the tasks of the other side.

    Links and components are few beside the texts. Dealt over all partitions, the rounds that join and group
    them were most of a run's tasks, and the driver holds and logs every task.
    """
    n = df.count() if n is None else n
    out = df.coalesce(max(1, -(-n // TASK_ROWS)))
    return F.broadcast(out) if small and n <= TASK_ROWS else out


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads; other columns of the input are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def held_out(col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


BITMAP_BITS = 25


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS):
    """A fixed-size bit set (4 MB) of a column of longs, built by aggregation.

    A filter only: it may let more through, never less, so it thins rows before an exact join. Its
    size does not grow with the data; when it fills up it merely stops helping. Its words (up to half a
    million) come to the driver as Arrow columns: row objects would take many times their bytes there.
    """
    import numpy as np
    h = hashes.select(F.col(hashes.columns[0]).alias("h"))
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = h.select((slot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, CAST(h & 63 AS INT))").alias("b")).groupBy("w").agg(
        F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits_set, h):
    """Mask of uint64 hashes that may be in the set."""
    import numpy as np
    slot = h & np.uint64(len(bits_set) * 64 - 1)
    return (bits_set[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


# the first eight bytes of a text key as a long
TEXT_HASH = "CAST(conv(hex(substring(text_key, 1, 8)), 16, -10) AS LONG)"


def split_by_text(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is surely not among ``wanted`` (text_key), the other rows with their ``text_key``).

    Only the second part has to meet ``wanted`` in a join; the first never moves.
    """
    import numpy as np

    from riskloom.llm import textvec as tv
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.expr(TEXT_HASH))))

    def part(hit: bool):
        def run(batches):
            for pdf in batches:
                keys = [tv.digest16(tv.to_bytes(t)) for t in pdf["text"].tolist()]
                ok = in_bitmap(held.value, np.array([int.from_bytes(x[:8], "big") for x in keys], np.uint64)) if keys else np.zeros(0, bool)
                yield pdf.assign(text_key=keys)[ok] if hit else pdf[~ok]
        return run

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInPandas(part(False), schema), docs.mapInPandas(part(True), schema + ", text_key binary")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an edge list (u, v): alternating large-star and small-star rounds.

    Every round is a grouped minimum and an equi-join; only edges move and each round is cut into the
    shared folder. Its rows are made in place, without unions, so edges that one task holds are not dealt out.
    Stops when a round changes nothing; an error if ``max_rounds`` do not get there.
    """
    def rows(e: DataFrame, *pairs: tuple[str, str], names: tuple[str, str] = ("u", "v")) -> DataFrame:
        return e.select(F.inline(F.array(*[F.struct(*[F.col(c).alias(x) for c, x in zip(p, names)]) for p in pairs])))

    def star(e: DataFrame, large: bool, few: bool) -> DataFrame:
        # edges go from the larger node u to the smaller v
        near = rows(e, ("u", "v"), ("v", "u")) if large else rows(e, ("u", "v"), ("u", "u"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(F.broadcast(low) if few else low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("by"))
        return (out.filter("u > by") if large else out).select("u", "v")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        return r["n"], r["s"]

    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        few, now = seen[0] <= TASK_ROWS, sized(now, seen[0], small=False)
        now = cut(star(star(now, True, few), False, few).filter("u <> v").distinct())
        then, seen = seen, state(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components: the edges still change after {max_rounds} rounds")
    now = sized(now, seen[0], small=False)
    return rows(now, ("u", "v"), ("v", "v"), names=("node", "component")).groupBy("node").agg(F.min("component").alias("component"))
