"""Benchmark decontamination by winnowing (operator 5).

A fingerprint is the smallest word 5-gram hash in each run of six consecutive 5-grams, i.e. of each
10-word window; two texts that share a 10-word window share the fingerprint chosen in it, so joining
fingerprints misses no shared window. A joined fingerprint is then extended to both sides, word by
word, as far as a 10-word window can reach, and the windows that agree in full are the hits. Items of
fewer than 10 words are one fingerprint of their own length.

The text is read once: the pass counts words and emits fingerprints with the words around them; all
later steps move only these. If the benchmark has at most ``FILTER_FINGERPRINTS`` fingerprints (8 bytes
each) the pass leaves out document fingerprints that no item has; a larger benchmark is joined without
that filter, with the same result.

Null text has no words; null item ids count as the empty string; rows that repeat (doc_id, text) each
get the same result; items with the same id count once; empty tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import cut, id_text, prepare

WINDOW = 10
GRAM = 5
FILTER_FINGERPRINTS = 4_000_000
PRINT_SCHEMA = "fp array<long>, pos array<int>, size array<int>, ctx array<array<long>>"


def fingerprints(h: np.ndarray, window: int, gram: int, pad: int, short: list[int] | None = None):
    """(hash, position, size, surrounding word hashes) of a text's fingerprints.

    ``short``: lengths below the window whose every n-gram is a fingerprint too (the document side);
    None for an item, which is one fingerprint itself when it is shorter than the window.
    """
    n, out = len(h), []
    if n >= window:
        v = tv.grams(h, gram)
        at = tv.window_min_positions(v, window - gram + 1)
        side = window - gram
        wide = np.concatenate([np.full(side, pad, np.uint64), h, np.full(side, pad, np.uint64)])
        out.append((v[at], at, np.full(len(at), window), lambda i: wide[i:i + gram + 2 * side]))
    elif n and short is None:
        out.append((tv.grams(h, n), np.zeros(1, np.int64), np.array([n]), lambda i: h[i:i + n]))
    for m in short or ():
        v = tv.grams(h, m)
        out.append((v, np.arange(len(v)), np.full(len(v), m), lambda i, m=m: h[i:i + m]))
    return out


def _collect(parts, keep: np.ndarray | None):
    fp, pos, size, ctx = [], [], [], []
    for v, at, m, around in parts:
        if keep is not None:
            ok = np.isin(v, keep, kind="sort") if len(v) else np.zeros(0, bool)
            v, at, m = v[ok], at[ok], m[ok]
        fp.extend(tv.signed(v).tolist())
        pos.extend(at.tolist())
        size.extend(m.tolist())
        ctx.extend(tv.signed(around(i)).tolist() for i in at.tolist())
    return fp, pos, size, ctx


def item_fingerprints(items: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = tv.batch_words([tv.to_bytes(t) for t in pdf["text"].tolist()], tv.ALNUM_SEP)
            rows = [_collect(fingerprints(h, window, gram, pad=1), None) for h, _, _ in words]
            yield pd.DataFrame({"item_id": pdf["item_id"].tolist()} | {
                c: [r[i] for r in rows] for i, c in enumerate(("fp", "pos", "size", "ctx"))})

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                         F.col("text").cast("string").alias("text"))
    prints = named.mapInPandas(run, "item_id string, " + PRINT_SCHEMA)
    return prints.select("item_id", F.explode(F.arrays_zip("fp", "size", "ctx")).alias("x")).select(
        "item_id", "x.fp", "x.size", "x.ctx").distinct()


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words, n_hit, items (sorted string ids), spans (merged word ranges)."""
    spark = docs.sparkSession
    prepare(spark)
    tests = cut(item_fingerprints(items, window, gram))
    short = sorted(r["size"] for r in tests.filter(F.col("size") < window).select("size").distinct().collect())
    # size check of what every task would hold: 8 bytes a fingerprint
    keep = None
    if tests.select("fp").distinct().count() <= FILTER_FINGERPRINTS:
        keep = np.sort(np.array([r["fp"] for r in tests.select("fp").distinct().toLocalIterator()], np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [tv.to_bytes(t) for t in pdf["text"].tolist()]
            words = tv.batch_words(texts, tv.ALNUM_SEP)
            rows = [_collect(fingerprints(h, window, gram, pad=2, short=short), held.value) for h, _, _ in words]
            ids = pdf["doc_id"].tolist()
            yield pdf[["doc_id"]].assign(
                row=[tv.row_key(d, t) for d, t in zip(ids, texts)], text_key=[tv.digest16(t) for t in texts], n_words=[len(h) for h, _, _ in words],
                **{c: [r[i] for r in rows] for i, c in enumerate(("fp", "pos", "size", "ctx"))})

    seen = cut(id_text(docs).mapInPandas(run, "doc_id long, row binary, text_key binary, n_words long, " + PRINT_SCHEMA))
    found = seen.filter(F.size("fp") > 0).select("row", F.explode(F.arrays_zip("fp", "pos", "size", "ctx")).alias("x")).select(
        "row", "x.fp", "x.pos", "x.size", "x.ctx")
    same = found.alias("d").join(tests.alias("t"), (F.col("d.fp") == F.col("t.fp")) & (F.col("d.size") == F.col("t.size")))
    reach = window - gram
    # starts of whole windows around the fingerprint on which both sides agree
    agree = F.when(F.col("d.size") == window, F.expr(
        f"filter(sequence(0, {reach}), s -> slice(d.ctx, s + 1, {window}) = slice(t.ctx, s + 1, {window}))")).otherwise(
        F.expr("CASE WHEN d.ctx = t.ctx THEN array(0) ELSE array() END"))
    spans = same.select("row", "t.item_id", F.col("d.size").alias("size"), F.col("pos"), agree.alias("s")).filter(F.size("s") > 0).select(
        "row", "item_id", (F.col("pos") + F.array_min("s") - F.when(F.col("size") == window, reach).otherwise(0)).alias("lo"),
        (F.col("pos") + F.array_max("s") + F.col("size") - F.when(F.col("size") == window, reach).otherwise(0)).alias("hi"))
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"),
                                       F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("raw"))
    per_row = per_row.select("row", "items", F.expr("""
        aggregate(raw, CAST(array() AS array<struct<lo: int, hi: int>>), (acc, x) ->
          CASE WHEN size(acc) > 0 AND x.lo <= element_at(acc, -1).hi
               THEN concat(slice(acc, 1, size(acc) - 1),
                           array(named_struct('lo', element_at(acc, -1).lo, 'hi', greatest(element_at(acc, -1).hi, x.hi))))
               ELSE concat(acc, array(named_struct('lo', x.lo, 'hi', x.hi))) END)""").alias("spans"))
    return seen.drop("fp", "pos", "size", "ctx").join(per_row, "row", "left").select(
        "doc_id", "text_key", "n_words",
        F.expr("CAST(coalesce(aggregate(spans, 0, (a, x) -> a + x.hi - x.lo), 0) AS LONG)").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<lo: int, hi: int>>")).alias("spans"))
