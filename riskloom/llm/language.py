"""Language spans of mixed texts (operator 6).

Letters are grouped into words; a word's script (Unicode ranges) narrows the languages it can be: those
that showed the script in training. Each candidate scores the word by its letter trigrams, word ends included
(log probabilities over ``BUCKETS`` hashed trigrams). Viterbi over the words, with a penalty for every
change of language, gives the spans; the language with the most letters is the text's.

A text in which no run of words could pay for a switch is settled without the recursion: let G be the best
sum, over all other languages and runs of words, of (that language - leading language). A path of m + 1
spans gains at most G in each span and pays m penalties, so with 2 G < penalty the constant path is best
(and a constant path of another language is worse by the choice of the leading one). An exact test.

Learned from the text and lang of about ``FIT_ROWS`` rows (hash of the id; a documented bound) that are
not held out. lang, source and doc_id are never inputs of a prediction. Null texts and texts without a
letter are ``und`` with score 0; so is every text if nothing was learned; a script that no language
showed leaves all languages as candidates. Repeated rows are treated alike; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import held_out, prepare

BUCKETS = 1 << 16
FIT_ROWS = 20_000
PENALTY = 20.0
LEAST_SHARE = 0.005

# fixed values: first and last code points of scripts
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
NAMES = ["none", "other"] + sorted({s for s, _, _ in SCRIPTS})
_table: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Script number of each code point; 0 is no letter, 1 a letter of a script not listed."""
    if not _table:
        t = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.int8, 0x110000)
        for name, lo, hi in SCRIPTS:
            part = t[lo:hi + 1]
            part[part > 0] = NAMES.index(name)
        _table.append(t)
    return _table[0]


def letter_words(texts: list) -> tuple[np.ndarray, ...]:
    """Of a batch: trigram bucket per letter, word starts (in letters), the word's text, script and size."""
    low = [t.lower() if isinstance(t, str) else "" for t in texts]
    code = np.frombuffer("\x00".join(low + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_table()[code]
    at = np.flatnonzero(script)
    c = np.where(script > 0, code, np.uint32(0))
    h = c * np.uint32(0x9E3779B1)
    h[1:] ^= c[:-1] * np.uint32(0x85EBCA77)
    h[:-1] ^= c[1:] * np.uint32(0xC2B2AE3D)
    h = h[at]
    h ^= h >> np.uint32(15)
    three = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    # a word ends where letters end or their script changes (kana and han are written together; letters of no
    # listed script go with those before them)
    shown = np.where(script[at] == NAMES.index("kana"), NAMES.index("han"), script[at])
    turn = np.zeros(len(at), bool)
    turn[1:] = (shown[1:] != shown[:-1]) & (shown[1:] > 1) & (shown[:-1] > 1)
    first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | turn)
    begin = np.cumsum([0] + [len(t) + 1 for t in low])
    which = np.searchsorted(begin, at[first], side="right") - 1
    sizes = np.diff(np.append(first, len(at)))
    return three, first, which, script[at[first]], sizes


def batches_of(texts: list) -> Iterator[tuple[int, int]]:
    return tv.slices([len(t) if isinstance(t, str) else 0 for t in texts], 1 << 20)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Per language: log probability of each n-gram bucket and the scripts it showed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    n = docs.filter("lang IS NOT NULL").count()
    if not n:
        return {"langs": []}
    share = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 20)) < int(min(1.0, fit_rows / n) * (1 << 20))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                total = found.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                texts = part["text"].tolist()
                for lo, hi in batches_of(texts):
                    three, _, _, script, sizes = letter_words(texts[lo:hi])
                    total[:BUCKETS] += np.bincount(three, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script, sizes, len(NAMES)).astype(np.int64)
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "slot": at, "n": total[at]})

    # languages * (BUCKETS + scripts) rows at most, whatever the corpus size
    got = rows.filter(share).select("text", "lang").mapInPandas(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    count = np.zeros((BUCKETS + len(NAMES), len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    count[got["slot"].to_numpy(), got["lang"].map(number).to_numpy(np.int64)] = got["n"].to_numpy()
    three, script = count[:BUCKETS], count[BUCKETS:]
    logs = np.log((three + 0.3) / (three.sum(axis=0) + 0.3 * BUCKETS)) if langs else three
    shown = script / np.maximum(1, script.sum(axis=0)) >= LEAST_SHARE
    shown[~shown.any(axis=1)] = True
    return {"langs": langs, "three": np.ascontiguousarray(logs.T, np.float32), "shown": shown}


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word of one text (rows of ``s``) under a penalty per change."""
    n, k = s.shape
    lead = int(s.sum(axis=0).argmax())
    run = np.zeros((n + 1, k))
    np.cumsum(s - s[:, lead:lead + 1], axis=0, out=run[1:])
    if 2 * (run[1:] - np.minimum.accumulate(run[:-1], axis=0)).max() < penalty:
        return np.full(n, lead)
    back = np.empty((n, k), np.int16)
    stay = np.arange(k)
    best = s[0].astype(float)
    for t in range(1, n):
        top = int(best.argmax())
        jump = best[top] - penalty
        moved = best < jump
        back[t] = np.where(moved, top, stay)
        best = np.where(moved, jump, best) + s[t]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def spans(docs: DataFrame, model: dict, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its share of the letters) and the spans (lang, first word, end word)."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        langs = m["langs"]
        for pdf in batches:
            texts = pdf["text"].tolist()
            pred, score, part = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for lo, hi in batches_of(texts) if langs else ():
                three, first, which, script, sizes = letter_words(texts[lo:hi])
                if not len(first):
                    continue
                s = np.stack([np.add.reduceat(log[three], first) for log in m["three"]], axis=1).astype(float)
                s = np.where(m["shown"][script], s, -1e6)
                at = np.searchsorted(which, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    a, b = at[i], at[i + 1]
                    if a == b:
                        continue
                    path = viterbi(s[a:b], penalty)
                    letters = np.bincount(path, sizes[a:b], len(langs))
                    top = int(letters.argmax())
                    pred[lo + i], score[lo + i] = langs[top], float(letters[top] / letters.sum())
                    new = np.flatnonzero(np.diff(path, prepend=-1))
                    part[lo + i] = [{"lang": langs[path[x]], "first": int(x), "end": int(y)}
                                    for x, y in zip(new, np.append(new[1:], b - a))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": pred,
                                "score": score, "spans": part})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held_out().alias("held_out")).mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,first:int,end:int>>")


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> DataFrame:
    prepare(docs.sparkSession)
    return spans(docs, fit(docs, fit_rows), penalty)
