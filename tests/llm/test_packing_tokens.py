"""Packing and token counts against the tokenizer applied one text at a time."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import packing, token_counts
from riskloom.llm.tokens import Encoder, default_path

random.seed(3)
WORDS = "the of andar über cióndo x1 naïve 漢字 don't  \n\n a,b;c ... 1234567 \t".split(" ")


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_path())


def test_encoder_equals_tokenizers(slow):
    enc = Encoder(default_path())
    odd = ["", " ", "\n \n", "a<|endoftext|>b", "\u0000", "é́", "𝒳 math", "x" * 3000, " " * 500, "'s 're don't I'LL"]
    for t in odd + [text(random.randint(1, 80)) for _ in range(200)]:
        assert enc.ids(t) == slow.encode(t, add_special_tokens=False).ids


def test_pack(spark, make_docs, slow):
    rows = [(i, text(random.choice([1, 5, 40, 300, 900]))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (7, rows[7][1]), (1002, text(9000))]
    out = packing.pack(make_docs(rows), capacity=256).toPandas()
    want = Counter()
    for d, t in rows:
        ids = (slow.encode(t, add_special_tokens=False).ids if t else []) + [2]
        cut, at, piece = len(ids) % 256 or 256, 0, 0
        while at < len(ids):
            want[(d, piece, at, cut, zlib.crc32(np.array(ids[at:at + cut], "<u4").tobytes()))] += 1
            at, cut, piece = at + cut, 256, piece + 1
    got = Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in
                  out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert got == want
    seqs = defaultdict(list)
    for s, o, n in zip(out.sequence_id, out.offset, out.length):
        seqs[s].append((o, n))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= -(-out.length.sum() // 256) * 1.03 + 1


def test_plan_places_every_length():
    rng = random.Random(5)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 30))}
        patterns = packing.plan(counts, 64)
        assert all(sum(p) <= 64 and sum(3 * s > 64 for s in p) <= 2 for p, _ in patterns)
        used = Counter()
        for p, n in patterns:
            for s in p:
                used[s] += n
        assert used == Counter(counts)


def test_pack_empty(spark, make_docs):
    assert packing.pack(make_docs([])).count() == 0


def test_histogram(spark, make_docs, slow):
    rows = [(i, text(random.randint(0, 30))) for i in range(120)] + [(500, None), (501, text(5000))]
    hist = token_counts.histogram(token_counts.lengths(make_docs(rows)))
    ns = [len(slow.encode(t, add_special_tokens=False).ids) if t else 0 for _, t in rows]
    got = {r.context_limit: r for r in hist.collect()}
    assert set(got) == set(ns)
    for limit, r in got.items():
        assert r.n_docs == ns.count(limit) and r.docs_over == sum(n > limit for n in ns)
        assert r.tokens_over == sum(n for n in ns if n > limit)
        assert r.tokens_kept == sum(min(n, limit) for n in ns) and r.tokens_total == sum(ns)
        assert abs(r.quantile - sum(n <= limit for n in ns) / len(ns)) < 1e-12
    some = {r.limit: r for r in token_counts.at_limits(hist, [0, 17, 10**6]).collect()}
    assert all(r.tokens_kept == sum(min(n, x) for n in ns) for x, r in some.items())
    assert token_counts.quantile_length(hist, 0.5).collect()[0].length == sorted(ns)[(len(ns) + 1) // 2 - 1]
    assert token_counts.histogram(token_counts.lengths(make_docs([]))).count() == 0
