"""Spelling variants against plain Python; the gram index against comparing all words."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, letters):
    """Every word one edit away."""
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def plain(docs, least, least_n, ratio, drop_every):
    n = Counter()
    for d, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_n}
    letters = {c for w in n for c in w}
    near = {w: [x for x in (edits(w, letters) if len(w) < 200 else n) if x in n and x != w and (len(w) < 200 or x in edits(w, letters))] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
    rows = set()
    for w in n:
        end = w
        while form[end] is not None:
            end = form[end]
        rows.add((w, form[w], end, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def got(frame):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_letter_runs():
    text = "Ab×ÿ ā漢字é1é'Ý÷z"
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end, size = spelling.letter_runs(raw)
    want = RUN.findall(text)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end)] == want and size.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("rare", [1, 4, 10**6])
def test_index_finds_every_near_pair(spark, monkeypatch, rare):
    monkeypatch.setattr(spelling, "RARE", rare)
    rng = random.Random(rare)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(700)}
    words |= {"a" * k for k in range(6, 30)} | {"ab" * k for k in range(3, 12)} | {"x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149}
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    found = [(r.word, r.other) for r in spelling.near_words(frame).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(w, x) for w in words for x in edits(w, "abéxy") & words}


def test_variants_equal_plain(spark, make_docs):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeÉéÿ") for _ in range(rng.randint(5, 11))) for _ in range(25)]
    def text(k):
        out = []
        for _ in range(k):
            w = base[min(int(rng.expovariate(0.3)), 24)]
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                w = rng.choice(sorted(edits(w, "ab")))
            out.append(w.upper() if rng.random() < 0.1 else w)
        return rng.choice([" ", "-", "1", "漢"]).join(out)
    docs = [(i, text(120)) for i in range(60)] + [(100, None), (101, ""), (None, text(50)), (3, text(50)), (102, text(20_000)), (103, "y" * 40_000)]
    docs += [(200, "repeat variant")] * 30
    for args in ((6, 5, 5, 199), (4, 2, 2, 7)):
        assert got(spelling.variants(make_docs(docs), *args)) == plain(docs, *args)


def test_chain_of_forms(spark, make_docs):
    counts = {"aaaaaa": 1, "aaaaab": 2, "aaaabb": 4, "aaabbb": 8, "aabbbb": 16, "abbbbb": 32, "bbbbbb": 64}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    rows = got(spelling.variants(make_docs(docs), 6, 1, 2, 10**9))
    assert {r[2] for r in rows} == {"bbbbbb"} and rows == plain(docs, 6, 1, 2, 10**9)


def test_empty(spark, make_docs):
    assert spelling.variants(make_docs([])).count() == 0
    assert spelling.variants(make_docs([(1, None), (2, "short")])).count() == 0
