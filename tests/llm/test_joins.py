"""Similarity join, substring removal and decontamination against brute force on small, awkward tables."""
import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import common, decontaminate, ngram_join, substrings
from riskloom.llm.suffix import common_prefixes, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    k = min(3, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in sets}


def corpus(rng, n=260):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    common = " ".join(word() for _ in range(14))
    passage = " ".join(word() for _ in range(90))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 20, 60, 150, 400]))) for _ in range(40)]
    rows = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = word()
        t = " ".join(t)
        if rng.random() < 0.4:
            t = common + "\n" + t
        if rng.random() < 0.2:
            t = t + " " + passage
        rows.append((i, t.upper() if rng.random() < 0.05 else t))
    return rows


@pytest.mark.parametrize("seed,cell", [(1, 1024), (2, 4)])
def test_ngram_join(spark, make_docs, seed, cell):
    rows = corpus(random.Random(seed)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two")]
    got = ngram_join.join(make_docs(rows), cell=cell).collect()
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_chain_across_hubs(spark, make_docs):
    """A chain in which only neighbours are similar is one component."""
    rng = random.Random(8)
    t = [f"w{rng.random()}" for _ in range(120)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(t)))
        t[i * 9] = f"n{rng.random()}"
    sets = {i: shingles(x) for i, x in rows}
    want = components(sets)
    assert {r.doc_id: r.component_id for r in ngram_join.join(make_docs(rows)).collect()} == want


def test_ngram_join_repeats_and_null_ids(spark, make_docs):
    t = "a b c d e f g"
    got = ngram_join.join(make_docs([(5, t), (5, t), (None, t), (None, "x y z"), (3, "q")])).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(5, 5): 2, (None, 5): 1, (None, None): 1, (3, 3): 1})
    assert ngram_join.join(make_docs([])).count() == 0


def near_copies(rng, n, words=200):
    """Copies with two words changed, which only link with those of one changed word (each fifth)."""
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        t = list(base)
        for at in rng.sample(range(words), 2 if i % 5 else 1):
            t[at] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [1024, 40])
def test_ngram_join_proposes_few_pairs_of_near_copies(spark, make_docs, monkeypatch, cell):
    """A group of near copies of each other gives pairs in proportion to its nodes, not to their square."""
    rows = near_copies(random.Random(1), 240)
    proposed, old = [], ngram_join.intersect_orders
    monkeypatch.setattr(ngram_join, "intersect_orders", lambda pairs, *a: proposed.append(pairs.count()) or old(pairs, *a))
    got = {r.doc_id: r.component_id for r in ngram_join.join(make_docs(rows), cell=cell).collect()}
    want = components({i: shingles(t) for i, t in rows})
    assert got == want
    assert sum(proposed) < 20 * len(rows), proposed


def test_parity_sketches_reject_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 64, 65, 300, 2000):
        for percent in (50, 80, 90):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            for drop in (0, n // 30, n // 8, n // 4):
                y = np.unique(np.append(x[drop:], rng.integers(0, 1 << 63, drop // 2).astype(np.uint64)))
                p, q = ngram_join.parity(np.unique(x)), ngram_join.parity(y)
                size = min(len(p), len(q))
                differ = int(ngram_join._sketch_distances(np.array([p, q], object))[0, 1])
                assert differ == sum(bin(a ^ b).count("1") for a, b in zip(ngram_join.folded(p, size), ngram_join.folded(q, size)))
                both = len(np.intersect1d(x, y))
                assert differ <= len(x) + len(y) - 2 * both
                assert ngram_join.reach(len(x), len(y), differ, percent) or 100 * both < percent * (len(x) + len(y) - both)
    assert len(ngram_join.parity(x)) * 8 < 2 * len(x)


def test_forest_joins_what_its_pairs_join():
    rng = random.Random(2)
    for _ in range(50):
        m = rng.randint(2, 12)
        comp = np.array([rng.randrange(m) for _ in range(m)])
        pairs = [(i, j) for i in range(m) for j in range(i + 1, m) if comp[i] != comp[j] and rng.random() < 0.3]
        a, b = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [])))
        ones, twos = ngram_join._forest(a, b, np.array([rng.randrange(4) for _ in pairs], np.int64), comp)

        def groups(edges):
            at = list(comp)
            for i, j in edges:
                at = [at[i] if x == at[j] else x for x in at]
            return {tuple(x == y for y in at) for x in at}

        edges = list(zip(ones.tolist(), twos.tolist()))
        assert set(map(frozenset, edges)) <= set(map(frozenset, pairs)) and groups(edges) == groups(pairs)
        assert len(edges) <= len(set(comp.tolist())) - 1


def cut_brute(rows, span):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + span] for _, b in data for p in range(len(b) - span + 1))
    out = []
    for i, b in data:
        m = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - span + 1):
            if seen[b[p:p + span]] > 1:
                m[p + 1:p + span + 1] = 1
        kept = bytes(c for c, x in zip(b, m[1:-1]) if not x)
        out.append((i, len(b), int(m.sum()), int((np.diff(m) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed,crowd,shard", [(1, 8192, 1 << 20), (2, 1, 1 << 20), (3, 8192, 500)])
def test_substrings(spark, make_docs, seed, crowd, shard):
    rng = random.Random(seed)
    rows = corpus(rng, 120) + [(9000, None), (9001, ""), (9002, "ab" * 300), (9003, "x" * 700), (9004, "x" * 39), (9005, "x" * 40),
                               (None, "null id " * 20), (7, "same id, other text " * 9)]
    got = substrings.remove(make_docs(rows), span=40, gram=16, shard_bytes=shard, group_contexts=crowd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == cut_brute(rows, 40)


def test_substrings_very_long_and_empty(spark, make_docs):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long + "Z" + long[1000:60_000]), (2, "short")]
    got = {r.doc_id: r for r in substrings.remove(make_docs(rows)).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (118_000, 2, 0)
    assert substrings.remove(make_docs([])).count() == 0


def test_kept_text_has_whole_characters(spark, make_docs):
    rows = [(1, "é" * 30 + "head one"), (2, "tail è" + "é" * 30)]
    got = {r.doc_id: r.kept_text for r in substrings.remove(make_docs(rows), span=40, gram=16, with_text=True).collect()}
    assert all(t is not None and "�" not in t for t in got.values())


def test_suffix_array_small_alphabets():
    rng = np.random.default_rng(0)
    for _ in range(300):
        k = int(rng.integers(1, 4))
        t = np.append(rng.integers(1, k + 1, rng.integers(1, 60)), 0)
        sa = suffix_array(t, k + 1)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_common_prefixes():
    raw = np.frombuffer(b"banana bandana banana bandana!", np.uint8)
    sa = suffix_array(np.append(raw.astype(int) + 1, 0), 257)[1:]
    rest = len(raw) - np.arange(len(raw))
    got = common_prefixes(raw, sa, rest, 8)
    for a, b in zip(sa, sa[1:]):
        if rest[a] >= 8 and rest[b] >= 8:
            n = 0
            while n < 8 and raw[a + n] == raw[b + n]:
                n += 1
            assert got[b] == n


def leaks_brute(docs, items, w=10):
    wins = {}
    for i, t in items:
        x = alnum(t)
        k = min(w, len(x))
        for s in range(len(x) - k + 1) if x else ():
            wins.setdefault(tuple(x[s:s + k]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        x, hit, ids = alnum(t), set(), set()
        for k in {len(g) for g in wins}:
            for s in range(len(x) - k + 1):
                if (g := tuple(x[s:s + k])) in wins:
                    hit |= set(range(s, s + k))
                    ids |= wins[g]
        out.append((d, len(x), len(hit), tuple(sorted(ids))))
    return Counter(out)


@pytest.mark.parametrize("bound", [decontaminate.FILTER_FINGERPRINTS, 0])
def test_decontaminate(spark, make_docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "FILTER_FINGERPRINTS", bound)
    rng = random.Random(6)
    word = lambda: rng.choice(["ab", "Cd", "e1", "ñu", "x"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(100, None), (101, "..."), (None, " ".join(["zz"] * 14)), (3, " ".join(["yy"] * 12)), (11, items[0][1])]
    docs = []
    for i in range(80):
        t = [word() for _ in range(rng.choice([0, 2, 9, 30, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            x = rng.choice(items)[1] or ""
            t += x.split(" ")[rng.choice([0, 1]):] + ["stop"]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(t)))
    docs += [(500, None), (501, "zz " * 50), (None, "yy " * 13), (500, "zz-" * 11)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(make_docs(docs), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == leaks_brute(docs, items)
    assert decontaminate.hits(make_docs([]), bench).count() == 0
    none = decontaminate.hits(make_docs(docs), bench.filter("false")).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 for r in none)


def repeated_passages(rows, words):
    """(runs, bytes) of passages of ``words`` words that stand anywhere else, per row."""
    import re
    split = [[(m.group().lower(), m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    count = Counter(tuple(w for w, _, _ in s[i:i + words]) for s in split for i in range(len(s) - words + 1))
    out = []
    for s in split:
        merged = []
        for i in range(len(s) - words + 1):
            if count[tuple(w for w, _, _ in s[i:i + words])] > 1:
                if merged and i <= merged[-1][1]:  # passages that touch are one run
                    merged[-1][1] = i + words
                else:
                    merged.append([i, i + words])
        out.append((len(merged), sum(s[j - 1][2] - s[i][1] for i, j in merged)))
    return out


@pytest.mark.parametrize("crowd", [2, 8192])
def test_passages(spark, make_docs, crowd):
    rng = random.Random(crowd)
    word = lambda: rng.choice(["a", "Bee", "cé", "dddd", "漢字", "f,"]) + str(rng.randrange(30))
    shared = [[word() for _ in range(rng.choice([4, 5, 6, 9, 20]))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.choice([0, 3, 30]))]
        for _ in range(rng.choice([0, 1, 2])):
            text += rng.choice(shared) + [word() for _ in range(rng.choice([0, 7]))]
        rows.append((i, (" " if i % 2 else "\n ").join(text if i % 3 else [w.upper() for w in text])))
    rows += [(100, None), (101, ""), (None, rows[5][1]), (102, rows[6][1]), (103, "q " * 3000), (104, " ".join(f"w{i % 700}" for i in range(20_000)))]
    got = substrings.remove(make_docs(rows), span=40, gram=16, words=5, group_contexts=crowd).collect()
    plain = substrings.remove(make_docs(rows), span=40, gram=16, group_contexts=crowd).collect()
    want = Counter((d, n, b) for (d, _), (n, b) in zip(rows, repeated_passages(rows, 5)))
    assert Counter((r.doc_id, r.n_passages, r.n_passage_bytes) for r in got) == want
    contract = lambda rs: Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rs)
    assert contract(got) == contract(plain)


def test_bitmap_needs_little_memory_on_the_driver(spark):
    key = "spark.sql.execution.arrow.pyspark.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "false")  # Spark's own setting; the tests' session has it on
    tracemalloc.start()
    bits = common.bitmap(spark.range(1 << 19).select(F.expr("xxhash64(id)").alias("h")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spark.conf.set(key, held)
    hashes = np.array([r.h for r in spark.range(0, 1 << 19, 97).select(F.expr("xxhash64(id)").alias("h")).collect()], np.int64).view(np.uint64)
    assert common.in_bitmap(bits, hashes).all()
    assert 0 < np.bitwise_count(bits).sum() <= 1 << 19
    assert peak < 32 << 20, peak
    assert not common.bitmap(spark.range(0).select(F.col("id").alias("h"))).any()
