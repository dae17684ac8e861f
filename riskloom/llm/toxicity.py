"""Toxicity scores from a factorization machine over hashed terms (operator 4).

Terms are the lower-cased words of a text and the first 4 and 6 bytes of each word, hashed into
``BUCKETS`` buckets. Over the labelled training rows Spark counts, per bucket, the toxic and the other
documents that have it. Features are the ``TERMS`` buckets with the clearest difference, and buckets that say
nothing alone but do in pairs: among the ``PAIR_TERMS`` buckets that split the documents most evenly, those of
every pair whose interaction (the log odds ratio of having both, toxic against other documents) is ``PAIR_CLEAR``
standard errors from none. The machine score is ``w0 + sum(w) + 1/2 * sum_f((sum v_f)^2 - sum v_f^2)`` over the features a text has, so
besides single terms it learns pairs (an insult beside a group) that add up to more than their parts.

Fitting uses a sample of about ``FIT_ROWS`` labelled rows, chosen by a hash of the id (a documented
bound; fewer rows are used whole). Every text is scored whole. Labels, lang, source and doc_id are never
inputs of a score. Rows whose label is null, whose id is null or held out are never learned from.

Null and empty texts get the score of a text without features; repeated rows are scored alike (in
fitting, repeated labels count as given); with no labels of both kinds every score is the base rate
(0.0 without any label); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import cut, held_out, id_text, prepare

BUCKETS = 1 << 18
TERMS = 4096
PAIR_TERMS = 512
PAIR_CLEAR = 7.0
FACTORS = 4
FIT_ROWS = 20_000
EPOCHS = 12
HEADS = (4, 6)
THRESHOLD = 0.3


def doc_terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) pairs, each once, of a batch of texts."""
    docs, buckets = [], []
    data = [tv.to_bytes(t) for t in texts]
    for lo, hi in tv.slices([len(t) for t in data]):
        h, start, _, *heads = tv.word_hashes(b" ".join(data[lo:hi]), tv.ALNUM_SEP, HEADS)
        begin = np.cumsum([0] + [len(t) + 1 for t in data[lo:hi]])
        which = np.searchsorted(begin, start, side="right") - 1 + lo
        for x in (h, *heads):
            docs.append(which)
            buckets.append((x & tv.U(BUCKETS - 1)).astype(np.int64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(docs) * BUCKETS + np.concatenate(buckets))
    return pair // BUCKETS, pair % BUCKETS


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, other): documents of each label that have the bucket. Combined in the task first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            doc, bucket = doc_terms(pdf["text"].tolist())
            y = pdf["toxic"].to_numpy(np.int64)[doc]
            n += np.bincount(y * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        at = np.flatnonzero(n.sum(axis=0))
        yield pd.DataFrame({"bucket": at, "toxic": n[1][at], "other": n[0][at]})

    return rows.mapInPandas(run, "bucket long, toxic long, other long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def machine(w0: float, w: np.ndarray, v: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int):
    """Linear part plus pairwise part, and the factor sums, of ``n`` texts given as (doc, term) pairs sorted by doc."""
    linear = np.bincount(doc, w[term], n) + w0
    sums = np.stack([np.bincount(doc, v[term, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(doc, (v[term] ** 2).sum(axis=1), n)
    return linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(doc: np.ndarray, term: np.ndarray, y: np.ndarray, n_terms: int, factors: int = FACTORS, epochs: int = EPOCHS,
                rate: float = 0.1, l2: float = 1e-4, batch: int = 256, seed: int = 7):
    """Adaptive gradient descent on the logistic loss over the bounded sample."""
    rng = np.random.default_rng(seed)
    rate0 = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w0, w, v = float(np.log(rate0 / (1 - rate0))), np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, factors))
    gw, gv, g0 = np.full(n_terms, 1e-3), np.full((n_terms, factors), 1e-3), 1e-3
    begin = np.searchsorted(doc, np.arange(len(y) + 1, dtype=doc.dtype))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            sizes = begin[part + 1] - begin[part]
            local = np.repeat(np.arange(len(part)), sizes)
            at = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            t = term[at]
            z, sums = machine(w0, w, v, local, t, len(part))
            err = sigmoid(z) - y[part]
            used, slot = np.unique(t, return_inverse=True)
            e = err[local]
            dw = np.bincount(slot, e, len(used)) / len(part) + l2 * w[used]
            each = e[:, None] * (sums[local] - v[t])
            dv = np.stack([np.bincount(slot, each[:, f], len(used)) for f in range(factors)], axis=1) / len(part) + l2 * v[used]
            d0 = err.mean()
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            g0 += d0 ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
            w0 -= rate * d0 / np.sqrt(g0)
    return w0, w, v


def pair_terms(doc: np.ndarray, term: np.ndarray, y: np.ndarray, n_terms: int) -> np.ndarray:
    """Terms of the pairs that interact: having both is more or less usual among toxic documents than the two
    terms alone make it. Counts of both, one and none per class come from products of the incidence matrix."""
    z = np.zeros((n_terms, n_terms))
    error = np.zeros((n_terms, n_terms))
    for label, sign in ((1, 1.0), (0, -1.0)):
        rows = np.flatnonzero(y == label)
        place = np.full(len(y), -1)
        place[rows] = np.arange(len(rows))
        mine = place[doc] >= 0
        m = np.zeros((len(rows), n_terms), np.float32)
        m[place[doc[mine]], term[mine]] = 1
        both, one = (m.T @ m).astype(float), m.sum(axis=0, dtype=float)
        cells = both, one[:, None] - both, one[None, :] - both, len(rows) - one[:, None] - one[None, :] + both
        logs = [np.log(x + 0.5) for x in cells]
        z += sign * (logs[0] - logs[1] - logs[2] + logs[3])
        error += sum(1 / (x + 0.5) for x in cells)
    z = np.abs(z) / np.sqrt(error)
    np.fill_diagonal(z, 0)
    return np.flatnonzero((z > PAIR_CLEAR).any(axis=1)) if n_terms else np.zeros(0, np.int64)


def sample_terms(rows: DataFrame, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term number) pairs and labels of the bounded sample. Its order is fixed: by label, then by the
    terms as text. It comes to the driver as Arrow columns and stays flat there: lists of numbers would take many
    times their bytes."""
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, bucket = doc_terms(pdf["text"].tolist())
            ok = number[bucket] >= 0
            doc, term = doc[ok], number[bucket[ok]]
            at = np.searchsorted(doc, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"toxic": pdf["toxic"], "terms": [np.sort(term[a:b]) for a, b in zip(at, at[1:])]})

    got = rows.mapInPandas(features, "toxic int, terms array<int>").toArrow()
    y, lists = got["toxic"].to_numpy(), got["terms"].combine_chunks()
    flat = lists.flatten().to_numpy()
    end = np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
    begin = np.append(0, end)[:-1]
    # big-endian places of the numbers as text: their bytes compare as the comma-joined numbers do
    place = np.empty(int(number.max()) + 1, ">u2")
    place[np.argsort(np.arange(len(place)).astype(str))] = np.arange(len(place))
    key = place[flat].tobytes()
    order = np.array(sorted(range(len(y)), key=lambda i: (y[i], key[2 * begin[i]:2 * end[i]])), np.int64)
    term = np.concatenate([flat[begin[i]:end[i]] for i in order]) if len(order) else np.zeros(0, np.int32)
    return np.repeat(np.arange(len(order), dtype=np.int32), (end - begin)[order]), term, y[order].astype(float)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Model parameters (at most TERMS * (FACTORS + 1) numbers) learned from rows that are not held out."""
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out())
    n = toxic.count()
    if not n:
        return {"n": 0}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, fit_rows / n) * (1 << 20))
    rows = cut(id_text(docs).join(toxic.filter(share), "doc_id").select("text", "toxic"))
    counts = bucket_counts(rows)
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return {"n": n1 + n0, "rate": 1.0 if n1 else 0.0}
    p1, p0 = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("other") + 0.5) / (n0 + 1)
    clear = F.abs(F.log(p1 / p0)) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    best = counts.select("bucket", clear.alias("clear")).filter("clear > 2").orderBy(F.desc("clear"), "bucket").limit(TERMS)
    alone = np.array([r["bucket"] for r in best.collect()], np.int64)
    share_of = (F.col("toxic") + F.col("other")) / (n1 + n0)
    even = counts.select("bucket", (share_of * (1 - share_of)).alias("even")).filter("even > 0.01").orderBy(F.desc("even"), "bucket").limit(PAIR_TERMS)
    paired = np.setdiff1d(np.array([r["bucket"] for r in even.collect()], np.int64), alone)
    # numbers: first the terms that say something alone, then those looked at in pairs
    number = np.full(BUCKETS, -1, np.int32)
    number[np.concatenate([alone, paired])] = np.arange(len(alone) + len(paired))

    doc, term, y = sample_terms(rows, number)
    near = term >= len(alone)
    together = pair_terms(doc[near], term[near] - len(alone), y, len(paired)) + len(alone)
    renumber = np.full(len(alone) + len(paired) + 1, -1, np.int32)
    renumber[np.concatenate([np.arange(len(alone)), together]).astype(np.int64)] = np.arange(len(alone) + len(together))
    number, term = renumber[number], renumber[term]
    doc, term = doc[term >= 0], term[term >= 0]
    w0, w, v = fit_machine(doc, term, y, max(1, len(alone) + len(together)))
    return {"n": n1 + n0, "number": number, "w0": w0, "w": w, "v": v}


def score(docs: DataFrame, labels: DataFrame, more: list[str] | None = None, fit_rows: int = FIT_ROWS,
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, *more, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    prepare(spark)
    more = list(more or [])
    model = fit(docs, labels, fit_rows)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            if "w" not in m:
                yield pdf.drop(columns="__text").assign(score=m.get("rate", 0.0))
                continue
            doc, bucket = doc_terms(pdf["__text"].tolist())
            term = m["number"][bucket]
            ok = term >= 0
            z, _ = machine(m["w0"], m["w"], m["v"], doc[ok], term[ok], len(pdf))
            yield pdf.drop(columns="__text").assign(score=sigmoid(z))

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text"),
                       held_out().alias("held_out"), *more)
    carried = "".join(f", `{c}` {t}" for c, t in docs.select(*more).dtypes) if more else ""
    scored = kept.mapInPandas(run, f"doc_id long, held_out boolean{carried}, score double")
    return scored.select("doc_id", *more, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
