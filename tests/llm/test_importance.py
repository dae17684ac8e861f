"""Importance resampling against plain Python: counts, gains, scores and every rank."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import importance
from riskloom.llm.wordcrc import crc32_ranges

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)


def plain(docs, target, longest, buckets, least_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    feats = [runs(t, longest) for _, t in docs]
    s, t = Counter(bucket(f) for fs, _ in feats for f in fs), Counter(bucket(f) for x in target for f in runs(x, longest)[0])
    n_s, n_t = s.total(), t.total()
    rows = []
    for (d, _), (fs, n) in zip(docs, feats):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    can = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = can[:percent * len(can) // 100]
    return Counter(tuple(r[:4]) + (None,) for r in rows) - Counter(tuple(r[:4]) + (None,) for r in drawn) + Counter(
        tuple(r[:4]) + (i + 1,) for i, r in enumerate(drawn))


def got(frame):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect())


def test_crc_of_ranges():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 400)
    end = start + rng.integers(0, 140, 400)
    before = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    want = [zlib.crc32(raw[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before)]
    assert crc32_ranges(raw, start, end, before).tolist() == want
    assert crc32_ranges(raw, start, end).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end)]
    assert len(crc32_ranges(raw, start[:0], end[:0])) == 0


@pytest.mark.parametrize("longest,range_rows", [(1, 4096), (3, 7)])
def test_equals_plain(spark, make_docs, monkeypatch, longest, range_rows):
    monkeypatch.setattr(importance, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(importance, "SAMPLES", 4)
    rng = random.Random(4)
    words = "The of and Über naïve x1 漢字 don't é, Data MODEL test-case".split(" ")
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 19, 20, 40, 90]))) for i in range(150)]
    docs += [(500, None), (501, ""), (None, text(30)), (None, text(30)), (7, docs[7][1]), (502, text(20_000)), (503, "z" * 5000)]
    docs += [(600, docs[5][1] or "a")] * 40 + [(None, text(25))] * 30
    target = [text(30) for _ in range(12)] + [None, "Data model data"]
    want = plain(docs, target, longest, 50, 20, 30)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert got(importance.resample(make_docs(docs), frame, longest=longest, buckets=50, percent=30)) == want


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(make_docs([]), none).count() == 0
    rows = importance.resample(make_docs([(1, "a b")]), none, least_words=1, percent=100).collect()
    assert [(r.n_features, r["rank"]) for r in rows] == [(2, 1)]
