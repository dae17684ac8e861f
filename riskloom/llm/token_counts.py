"""Exact length histogram of encoded documents (operator 3).

One pass encodes each text and keeps its length; the histogram is an aggregation on that length, so a
hot length is combined before the shuffle. Suffix sums over the histogram answer, for every context
limit, how many documents exceed it, how many tokens are kept when they are truncated to it and which
share of documents fits. Only distinct lengths are ordered, in blocks of ``BLOCK`` lengths: block totals
first, then sums within a block, so no task orders the whole histogram.

Null or empty texts have length 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import id_text, prepare
from riskloom.llm.tokens import default_path, encoder

BLOCK = 1024


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""
    prepare(docs.sparkSession)
    path = vocabulary or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": [
                len(enc.ids(t if isinstance(t, str) else None)) for t in pdf["text"].tolist()]})

    return id_text(docs).mapInPandas(run, "doc_id long, n_tokens long")


def histogram(lens: DataFrame) -> DataFrame:
    """Exact histogram with prefix and suffix sums; one row per encoded length (= context limit).

    ``docs_over``/``tokens_over`` are the documents longer than the limit and their tokens; between two
    lengths L1 < L < L2 the kept tokens are those of L1 plus (L - L1) * docs_over(L1) (see ``at_limits``).
    """
    hist = lens.groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count("*").alias("n_docs"))
    hist = hist.withColumn("n_tokens", F.col("context_limit") * F.col("n_docs")).withColumn(
        "block", F.floor(F.col("context_limit") / BLOCK))
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt")).select(
        "block", F.coalesce(F.sum("bd").over(up), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(up), F.lit(0)).alias("t0"),
        F.sum("bd").over(every).alias("docs_total"), F.sum("bt").over(every).alias("tokens_total"))
    here = Window.partitionBy("block").orderBy("context_limit").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").withColumn("docs_fit", F.col("d0") + F.sum("n_docs").over(here)).withColumn(
        "tokens_fit", F.col("t0") + F.sum("n_tokens").over(here))
    return out.select(
        "context_limit", "n_docs", "n_tokens", "docs_fit", (F.col("docs_total") - F.col("docs_fit")).alias("docs_over"),
        (F.col("tokens_total") - F.col("tokens_fit")).alias("tokens_over"),
        (F.col("tokens_fit") + F.col("context_limit") * (F.col("docs_total") - F.col("docs_fit"))).alias("tokens_kept"),
        "tokens_total", (F.col("docs_fit") / F.col("docs_total")).alias("quantile"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals for any context limits, from the histogram alone (equi-aggregation, no text)."""
    ask = [F.struct(F.lit(int(x)).cast("long").alias("limit")) for x in limits]
    rows = hist.select("context_limit", "n_docs", F.explode(F.array(*ask)).alias("a"))
    over = F.col("context_limit") > F.col("a.limit")
    return rows.groupBy(F.col("a.limit").alias("limit")).agg(
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("context_limit", F.col("a.limit")) * F.col("n_docs")).alias("tokens_kept"))


def quantile_length(hist: DataFrame, q: float) -> DataFrame:
    """Smallest length L such that at least a share ``q`` of the documents has at most L tokens."""
    return hist.filter(F.col("quantile") >= q).agg(F.min("context_limit").alias("length"))
