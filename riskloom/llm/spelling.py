"""Spelling variants grouped through a variable-length gram index (operator 13).

Words are runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased; one run in ``drop_every`` (by crc32 of document and run)
loses a letter. Counts are kept per task before they are shuffled. Two words are near if they differ by exactly
one inserted, deleted or replaced letter.

The gram dictionary starts from all grams of ``SHORTEST`` letters of the words with a mark at both ends. A gram
that occurs more than a bound is extended by its next letter, up to ``LONGEST``; rarer ones are not, so the
dictionary is pruned by frequency. The bound grows with the words (one in ``FREQUENT`` places at most belongs to
each frequent gram), so the frequent grams of one length, which are broadcast, number at most ``FREQUENT``.

A word is decomposed into the gram that starts at each of its places: the shortest one that is not frequent. A
gram depends on its own letters alone, so an edit spoils no gram but those that cover it, and the most grams that
cover one letter are the word's bound of affected grams. In any global order of grams the rarest unspoilt gram
of two near words is therefore among the first ``bound + 1`` of both; only those lists are merged. Rarity is read
from an array of ``SKETCH`` hashed counters (any order is right, a rare-first one gives short lists). The edit
lies on one side of that gram, so the letters from the gram to the word's other end are equal: lists are kept by
(head or tail, length), and a word meets the lists of its own length and of one letter more. What meets is
verified by edit distance. Lists hold one row per word and gram; a list of many words is split by the join.

``form`` is the most frequent near word (ties: smallest in code-point order) that is at least ``ratio`` times as
frequent; roots follow forms by doubling, a logarithm of a logarithm of the largest count in rounds.

A null text has no words; a null doc_id enters the crc32 as the empty text. Rows that repeat count each. An
empty table gives no rows. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import cut, id_text, prepare
from riskloom.llm.wordcrc import crc32_ranges

SHORTEST, LONGEST = 2, 5
FREQUENT = 100_000
RARE = 16
SKETCH = 1 << 16
HELD_WORDS = 200_000

_ASCII = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_WIDE = 0xC3  # first byte of U+00C0 to U+00FF


def letter_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, letters) of the runs in UTF-8 bytes."""
    wide = raw == _WIDE
    inside = _ASCII[raw] | wide
    inside[1:] |= wide[:-1]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    twice = np.concatenate([[0], np.cumsum(wide)])
    return start, end, end - start - (twice[end] - twice[start])


def word_counts(docs: DataFrame, least: int = 6, drop_every: int = 199) -> DataFrame:
    """(word, n) of all words of at least ``least`` letters."""
    prepare(docs.sparkSession)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = [tv.to_bytes(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for lo, hi in tv.slices([len(x) for x in texts]):
                buf = b" ".join(texts[lo:hi])
                raw = tv.LOWER[np.frombuffer(buf, np.uint8)]
                start, end, size = letter_runs(raw)
                start, end, size = (x[size >= least] for x in (start, end, size))
                first = np.cumsum([0] + [len(x) + 1 for x in texts[lo:hi - 1]])
                doc = np.searchsorted(first, start, "right") - 1
                before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[lo:hi]], np.uint32)
                h = crc32_ranges(raw, start, end, before[doc])
                text = raw.tobytes()
                loses = h % np.uint32(drop_every) == 0
                held.update([text[a:b] for a, b in zip(start[~loses].tolist(), end[~loses].tolist())])
                for i in np.flatnonzero(loses & (size > least)).tolist():
                    word, at = text[start[i]:end[i]].decode(), int(h[i]) % int(size[i])
                    held[(word[:at] + word[at + 1:]).encode()] += 1
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return id_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, longest: int) -> set[str]:
    """Grams below the longest length that occur more often than the bound; at most ``FREQUENT`` of each length."""
    places = words.agg(F.sum(F.length("word") + 3 - SHORTEST)).collect()[0][0] or 0
    bound = max(RARE, places // FREQUENT)
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    some = words.select(marked.alias("m")).select(F.explode(F.expr(
        f"flatten(transform(sequence({SHORTEST}, {longest - 1}), q -> transform(sequence(1, length(m) + 1 - q), i -> substring(m, i, q))))")).alias("gram"))
    kept = some.groupBy("gram").count().filter(F.col("count") > bound).select("gram").collect() if longest > SHORTEST else []
    return {r.gram for r in kept}


def decompose(word: str, frequent: set[str], longest: int) -> tuple[list[str], int]:
    """(gram that starts at each place of the marked word, most grams that cover one letter)."""
    m = f"^{word}$"
    out = []
    cover = np.zeros(len(m) + 1, np.int64)
    for i in range(len(m) - SHORTEST + 1):
        q = SHORTEST
        while q < longest and i + q < len(m) and m[i:i + q] in frequent:
            q += 1
        out.append(m[i:i + q])
        cover[i] += 1
        cover[i + q] -= 1
    return out, int(np.cumsum(cover)[1:-2].max())


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SKETCH


def near_words(words: DataFrame, least: int = 6) -> DataFrame:
    """(word, n, other, other_n), both ways round, of all words (word, n) that differ by one edit."""
    spark = words.sparkSession
    prepare(spark)
    # the shortest word keeps one gram at least whatever letter is edited
    longest = min(LONGEST, least + 2 - SHORTEST)
    if longest < SHORTEST:
        raise ValueError("words are too short for the gram index")
    frequent = spark.sparkContext.broadcast(frequent_grams(words, longest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for g in decompose(w, frequent.value, longest)[0]:
                    total[_slot(g)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])

    counted = words.select("word").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    array = np.zeros(SKETCH, np.int64)
    array[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    rarity = spark.sparkContext.broadcast(array)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, key, size = [], [], [], []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, spoilt = decompose(w, frequent.value, longest)
                first = sorted(range(len(grams)), key=lambda i: (rarity.value[_slot(grams[i])], grams[i], i))[:spoilt + 1]
                m = f"^{w}$"
                # the edit follows the gram (heads are equal) or precedes it (tails are equal)
                parts = {m[:i + len(grams[i])] for i in first if i + len(grams[i]) < len(m)} | {m[i:] for i in first if i > 0}
                word += [w] * len(parts)
                n += [c] * len(parts)
                size += [len(w)] * len(parts)
                key += [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "little", signed=True) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(size, pa.int32())],
                                             ["word", "n", "key", "size"])

    index = cut(words.select("word", "n").mapInArrow(lists, "word string, n long, key long, size int"))
    ask = index.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "key", F.explode(F.array("size", F.col("size") + 1)).alias("size"),
                       F.col("size").alias("own"))
    meet = index.join(ask, ["key", "size"]).filter("own < size OR other < word").filter(F.levenshtein("word", "other", 1) == 1)
    pairs = meet.select("word", "n", "other", "other_n").dropDuplicates(["word", "other"])
    return pairs.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = 6, least_n: int = 5, ratio: int = 5, drop_every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least`` letters and ``least_n`` occurrences."""
    words = cut(word_counts(docs, least, drop_every).filter(F.col("n") >= least_n))
    best = cut(near_words(words, least).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("top")))
    chosen = best.select("word", "n_near", F.when(-F.col("top.less") >= F.col("n") * ratio, F.col("top")).alias("top")).select(
        "word", "n_near", F.col("top.other").alias("form"), (-F.col("top.less")).alias("form_n"))
    ends = roots(chosen.filter("form IS NOT NULL"))
    return words.join(chosen, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
