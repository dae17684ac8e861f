"""Importance resampling towards a target distribution (operator 12).

Features are all runs of 1 to ``longest`` consecutive words (A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``),
joined by one space, each hashed into a bucket by crc32. One pass over the documents and one over the target
texts count features per bucket (an array per task, then an aggregation over at most ``buckets`` keys); the
gains of the buckets are one array, and a second pass adds them up per document, adds the Gumbel noise of its
id and gives the score.

Ranks come from parallel sorting by regular sampling. Every partition is sorted into a run and written to the
shared folder, where each row has its place (run, index). Places at a regular step through the runs are the
samples (``SAMPLES`` a range, at most ``RANGES * SAMPLES`` rows on the driver); every ``SAMPLES``-th of the
sorted samples is a splitter. Runs are cut at the splitters by binary search, the segments are counted, and
prefix counts give each range its first rank. Only ranges that begin within the draw are exchanged: their
segments meet in one task each, merge there and are numbered. The order ends in the row's place, so equal rows,
however many, fall to different ranges too. Rows that cannot be drawn never move.

A null text has no words: no features, weight 0. A null doc_id enters the noise as the empty text and comes
last among equal scores. Rows that repeat are drawn each. Without documents there are no rows; without target
texts all target counts are 0. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import cut, id_text, prepare
from riskloom.llm.wordcrc import crc32_ranges

BUCKETS = 10_000
RANGE_ROWS = 4096
RANGES = 4096
SAMPLES = 32


def _order() -> list:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]


def features(texts: list, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of every feature, its text's index, words per text) of a few texts."""
    parts = [tv.to_bytes(x) for x in texts]
    buf = b" ".join(parts) + b" "
    raw = tv.LOWER[np.frombuffer(buf, np.uint8)]
    inside = np.concatenate([[False], ~tv.ALNUM_SEP[raw], [False]]).view(np.int8)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]]) if parts else np.zeros(0, np.int64)
    doc = np.searchsorted(first, start, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    crc = crc32_ranges(raw, start, end)
    out, owner = [crc], [doc]
    space = np.array([0x20], np.uint8)
    for k in range(1, longest):
        # one word more: the run so far, a space, the next word
        ok = doc[k:] == doc[:len(doc) - k] if len(doc) > k else np.zeros(0, bool)
        if not ok.any():
            break
        zero = np.zeros(len(crc), np.int64)
        spaced = crc32_ranges(space, zero, zero + 1, crc)
        crc = crc32_ranges(raw, start[k:], end[k:], spaced[:len(start) - k])
        out.append(crc[ok])
        owner.append(doc[:len(doc) - k][ok])
    return np.concatenate(out), np.concatenate(owner), words


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list]]:
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    for lo, hi in tv.slices([len(x or "") for x in texts]):
        yield lo, hi, texts[lo:hi]


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of ``texts`` (a column ``text``)."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, part in _batches(batch):
                crc, _, _ = features(part, longest)
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed source share, per bucket."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, part in _batches(batch):
                crc, owner, words = features(part, longest)
                order = np.argsort(owner, kind="stable")
                end = np.searchsorted(owner[order], np.arange(len(part)), "right")
                sums = np.concatenate([[0], np.cumsum(gain[crc[order] % np.uint32(len(gain))])])
                begin = np.concatenate([[0], end[:-1]])
                weight = sums[end] - sums[begin]
                score = weight + np.array([noise(d, seed) for d in ids[lo:hi].to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *(pa.array(x.astype(np.int64)) for x in (words, end - begin, weight, score))], names)

    return id_text(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """Sort keys as the splitters have them."""
    col = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("score", "doc_id", "n_features", "seq")}
    return [(-s, d is None, d or 0, n, q) for s, d, n, q in zip(*col.values())]


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... of the drawn rows, best score first; null for the others."""
    spark = scored.sparkSession
    prepare(spark)
    can = F.col("n_words") >= least_words
    runs = cut(scored.withColumn("can", can).sortWithinPartitions(F.desc("can"), *_order()).withColumn("seq", F.monotonically_increasing_id()))
    n = runs.filter("can").count()
    ranges = min(RANGES, -(-n // RANGE_ROWS)) or 1
    step = max(1, -(-n // (ranges * SAMPLES)))
    # each run starts its steps at another offset, so runs shorter than a step are sampled in their share too
    phase = F.expr(f"pmod(xxhash64(shiftright(seq, 33)), {step})")
    picked = runs.filter("can").filter((F.expr("seq & 8589934591") + phase) % step == 0).select("score", "doc_id", "n_features", "seq").collect()
    samples = sorted((-r.score, r.doc_id is None, r.doc_id or 0, r.n_features, r.seq) for r in picked)
    splitters = [samples[i * len(samples) // ranges] for i in range(1, ranges)] if len(samples) >= ranges else []
    last = len(splitters)
    schema = ", ".join(f"`{c}` {t}" for c, t in runs.dtypes) + ", piece int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            able = np.array(batch.column(batch.schema.get_field_index("can")).to_pylist(), bool)
            m = int(able.sum())
            piece = np.full(len(keys), last + 1, np.int32)
            # a run is in order: its places between two splitters are one segment
            at, k = 0, bisect.bisect_right(splitters, keys[0]) if m else 0
            while at < m:
                to = bisect.bisect_left(keys, splitters[k], at, m) if k < last else m
                piece[at:to] = k
                at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], [*batch.schema.names, "piece"])

    cutup = runs.mapInArrow(run, schema)
    counts = {r.piece: r["count"] for r in cutup.groupBy("piece").count().collect()}
    take = percent * n // 100
    offsets, before = [], 0
    for k in range(last + 1):
        if before < take:
            offsets.append((k, before))
        before += counts.get(k, 0)
    reach = len(offsets)
    begin = F.broadcast(spark.createDataFrame(offsets, "piece int, begin long"))
    place = F.col("begin") + F.row_number().over(Window.partitionBy("piece").orderBy(*_order(), "seq"))
    top = cutup.filter(F.col("piece") < reach).join(begin, "piece").withColumn("place", place)
    keep = [F.col(c) for c in scored.columns]
    return top.select(*keep, F.when(F.col("place") <= take, F.col("place")).alias("rank")).union(
        cutup.filter(F.col("piece") >= reach).select(*keep, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Every document with its features, weight, score and, if drawn, rank."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return draw(weigh(docs, gain, longest, seed), percent, least_words)
