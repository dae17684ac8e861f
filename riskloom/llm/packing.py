"""Best-fit packing of tokenised documents into fixed-length sequences (operator 1).

Method: large-item matching. Only the *counts* of piece lengths matter for the plan, and there are
at most ``capacity`` different lengths, so the plan is made exactly from the whole corpus' length
histogram (``capacity`` rows on the driver, whatever the corpus size):

1. a document of more than ``capacity`` tokens is cut; full pieces are sequences of their own and
   the shorter first piece takes part in the packing;
2. lengths above a third of the capacity meet at most twice in a sequence: longest first, each is
   matched greedily with the longest partner that still fits;
3. lengths up to a third go, longest first, into the smallest remaining gap that takes them.

The plan is a list of patterns (a sequence's lengths) with repeat counts. A step either uses up a
length or a class of equal gaps, so there are at most about four classes per length: the plan is
bounded by the capacity, not by the data. Pieces learn their rank among equal lengths (task counts,
then an offset join) and look up rank -> sequence and offset.

Inputs: null text is empty (just the end id); null or repeated doc_ids are rows like others; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut, id_text, prepare
from riskloom.llm.tokens import default_path, encoder

CAPACITY = 1024
END_ID = 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``task``/``nth`` number the pieces of a length within their task."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for d, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids = np.array(enc.ids(text if isinstance(text, str) else None) + [end_id], "<u4")
                at, n = 0, len(ids) % capacity or capacity
                k = 0
                while at < len(ids):
                    doc.append(d), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[at:at + n].tobytes()))
                    nth.append(seen[n])
                    seen[n] += 1
                    at, n, k = at + n, capacity, k + 1
            yield pd.DataFrame({"doc_id": pd.array(doc, dtype="Int64") if doc else pd.Series([], dtype="Int64"),
                                "piece": piece, "start": start, "length": length, "ids_crc32": crc, "task": task, "nth": nth})

    return id_text(docs).mapInPandas(run, PIECE_SCHEMA)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, in order) with the number of sequences of each."""
    left = {s: c for s, c in counts.items() if c > 0}
    gaps: dict[int, list[list]] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        if n:
            gaps.setdefault(capacity - sum(pattern), []).append([pattern, n])

    # lengths above a third: two per sequence at most
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        for t in large:
            if left[s] == 0:
                break
            if t > s or t + s > capacity or left[t] == 0:
                continue
            n = min(left[s], left[t]) if t != s else left[s] // 2
            if n:
                left[s] -= n
                left[t] -= n
                put((s, t), n)
        put((s,), left[s])
        left[s] = 0
    # the rest: smallest gap that takes them
    for s in sorted((s for s in left if 3 * s <= capacity and left[s]), reverse=True):
        need = left[s]
        for g in sorted(g for g in gaps if g >= s):
            fit = g // s
            while need and gaps[g]:
                pattern, n = gaps[g].pop()
                full = min(n, need // fit)
                put(pattern + (s,) * fit, full)
                need -= full * fit
                if full < n:
                    if need:
                        put(pattern + (s,) * need, 1)
                        n, need = n - 1, 0
                    put(pattern, n - full)
            if not need:
                break
        if need:
            fit = capacity // s
            put((s,) * fit, need // fit)
            if need % fit:
                put((s,) * (need % fit), 1)
    return [(p, n) for g in sorted(gaps) for p, n in gaps[g]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Plan as lookup rows: pieces of ``length`` with rank in [rank0, rank0+n) go to sequence0 + (rank-rank0) at offset."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, n in patterns:
        at = 0
        for s in pattern:
            r = used.get(s, 0)
            rows.append((s, r, seq, at))
            used[s] = r + n
            at += s
        seq += n
    out = pd.DataFrame(rows, columns=["length", "rank0", "sequence0", "offset"])
    return out.sort_values(["length", "rank0"], ignore_index=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; the sequences hold every piece of every document once."""
    prepare(docs.sparkSession)
    made = cut(pieces(docs, capacity, vocabulary, end_id))
    per_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    # at most `capacity` rows reach the driver: the exact length histogram
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan_rows = slots(plan(counts, capacity))
    before = per_task.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = made.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    length0, rank0 = plan_rows["length"].to_numpy(np.int64), plan_rows["rank0"].to_numpy(np.int64)
    seq0, offset0 = plan_rows["sequence0"].to_numpy(np.int64), plan_rows["offset"].to_numpy(np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = length0 << 48 | rank0
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            i = np.searchsorted(key, pdf["length"].to_numpy(np.int64) << 48 | rank, side="right") - 1
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=seq0[i] + rank - rank0[i], offset=offset0[i])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
