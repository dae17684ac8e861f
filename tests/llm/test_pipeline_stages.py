"""Rows of pipeline stages against plain Python versions, each stage on its own input."""
import random
import re
from collections import Counter

import corpus_pipeline as cp

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def some_text(rng, n, most=4):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, most))) for _ in range(n))


def cut_repeats_brute(rows):
    """Texts (ASCII) without 51-word passages and 400-byte strings that occur more than once."""
    spots = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    seen = Counter(tuple(words(t)[p:p + 51]) for _, t in rows for p in range(len(words(t)) - 50))
    bytes_ = Counter(t[p:p + 400] for _, t in rows if t for p in range(len(t) - 399))
    out = []
    for (i, t), at in zip(rows, spots):
        w, gone = words(t), [False] * len(t or "")
        spans = [(at[p][0], at[p + 50][1]) for p in range(len(w) - 50) if seen[tuple(w[p:p + 51])] > 1]
        spans += [(p, p + 400) for p in range(len(t or "") - 399) if bytes_[t[p:p + 400]] > 1]
        for a, b in spans:
            gone[a:b] = [True] * (b - a)
        out.append((i, t if t is None else "".join(c for c, x in zip(t, gone) if not x)))
    return Counter(out)


def test_cut_repeats_against_brute_force(spark, make_docs):
    """Passages of 51 to 60 short words go (under 400 bytes), those of 50 stay, also two of 30 in a row; long words go by bytes."""
    rng = random.Random(3)
    rows, shared = [], {}
    for n in (49, 50, 51, 52, 54, 57, 60):
        shared[n] = some_text(rng, n)
        rows += [(len(rows) + j, f"{some_text(rng, 40)} {shared[n]} {some_text(rng, 30)}") for j in range(2)]
    a, b = some_text(rng, 30), some_text(rng, 30)
    rows += [(100, f"{some_text(rng, 9)} {a} {b} {some_text(rng, 9)}"), (101, f"{a} {some_text(rng, 20)}"), (102, f"{some_text(rng, 20)} {b}")]
    wide = " ".join("".join(rng.choice("klmnop") for _ in range(20)) for _ in range(25))
    rows += [(110, f"{some_text(rng, 9)} {wide}"), (111, f"{wide} {some_text(rng, 12)}")]
    again = some_text(rng, 55)
    rows += [(120, f"{again} {some_text(rng, 5)}"), (121, f"{some_text(rng, 5)}\n{again.replace(' ', chr(10)).upper()}")]
    rows += [(130, " ".join(["so"] * 51)), (131, " ".join(["no"] * 52)), (132, None), (133, ""), (134, shared[51])]
    got = cp.cut_repeats(spark, make_docs(rows), None).select("doc_id", "text", "n_chars").collect()
    want = cut_repeats_brute(rows)
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text or "") for r in got)
    left = {r.doc_id: r.text for r in got}
    assert len(shared[60]) < 400 and shared[60] not in left[12] and shared[50] in left[2] and left[134] == "" and left[131] == ""


def near_copies_brute(rows):
    """doc_ids that stay: the least of each component of five-word Jaccard similarity from 0.8 (ids are distinct)."""
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if w else set()
    stands_for = {i: i for i in sets}

    def find(i):
        while stands_for[i] != i:
            i = stands_for[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                stands_for[y] = x
    return Counter(i for i in sets if find(i) == i)


def test_drop_near_copies_against_brute_force(spark, make_docs):
    """Near copies of 0.7 to 1.0: replaced words, added blocks, chains."""
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE")]
    for base in range(40):
        t = some_text(rng, rng.choice([30, 100, 250]), 7).split(" ")
        rows.append((len(rows) + 1, " ".join(t)))
        for _ in range(3):
            u = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                u[rng.randrange(len(u))] = some_text(rng, 1, 9)
            if base % 2:
                u += some_text(rng, round(len(t) * rng.uniform(0.05, 0.3)), 7).split(" ")
            rows.append((len(rows) + 1, " ".join(u)))
    rng.shuffle(rows)
    got = cp.drop_near_copies(spark, make_docs(rows), None).select("doc_id").collect()
    want = near_copies_brute(rows)
    assert Counter(r.doc_id for r in got) == want
    assert 60 < sum(want.values()) < len(rows) - 30
