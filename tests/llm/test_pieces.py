"""SentencePiece ids and texts against the library, merge rounds against merging one place after the other."""
import hashlib
import random

import numpy as np
import pytest

from riskloom.llm import pieces as P

ALPHABET = "aab the of in ▁  \n\t=-_.,é漢字𝒳ßÆ01234 5xyz\x00​�<s>"


@pytest.fixture(scope="module")
def model():
    return P.load(P.default_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=P.default_path())


def texts():
    rng = random.Random(1)
    odd = ["", " ", "  ", None, "▁", "▁▁ a", "a" * 50, "=" * 100, " " * 37, "a" + " " * 37 + "b", "\x00", "a b ", "the  the   the",
           "<s></s><unk><0x41>", "�", " x" * 900, "é" * 3000]
    return odd + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_ids_and_texts_equal_the_library(model, library, most):
    rows = texts()
    ids, off = P.encode_texts(model, rows, most)
    want = [library.encode(x or "", add_bos=True, add_eos=True) for x in rows]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    assert P.decode_ids(model, ids.astype(np.int64), off) == [library.decode(w) for w in want]


def test_decoding_any_ids(model, library):
    rng = random.Random(2)
    rows = [[rng.choice([0, 1, 2, 3 + rng.randrange(256), 3 + rng.randrange(256), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))] for _ in range(5000)]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = P.decode_ids(model, np.array([x for r in rows for x in r], np.int64), off)
    assert got == [library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        P.decode_ids(model, np.array([32000]), np.array([0, 1]))


def one_by_one(scores, word):
    parts = list(word)
    while True:
        best = min(((-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores), default=None)
        if best is None:
            return parts
        parts[best[1]:best[1] + 2] = ["".join(parts[best[1]:best[1] + 2])]


def test_rounds_equal_single_merges():
    """Vocabularies whose longer pieces may come before the shorter ones they are made of, and with equal scores."""
    rng = random.Random(3)
    for _ in range(150):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 14))}
        ties = rng.choice([1000, 4])
        scores = {p: -float(rng.randint(1, ties)) for p in sorted(words)}
        vocabulary = [(c, 0.0, P.NORMAL) for c in "abc"] + [(p, s, P.NORMAL) for p, s in scores.items()]
        t = P.tables(vocabulary)
        sample = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(30)]
        sym = np.array([t["char"][ord(c)] for w in sample for c in w], np.int64)
        word = np.repeat(np.arange(len(sample)), [len(w) for w in sample])
        out, owner = P.merge(t, sym, word)
        got = [[vocabulary[i][0] for i in out[owner == k].tolist()] for k in range(len(sample))]
        assert got == [one_by_one(scores, w) for w in sample], scores


def test_runs_of_equal_scores_take_few_rounds(model, monkeypatch):
    calls = []
    find = P._find
    monkeypatch.setattr(P, "_find", lambda *a: calls.append(1) or find(*a))
    P.encode_texts(model, ["x" + " " * 200_000 + "y", "=" * 100_000])
    assert len(calls) < 60


def test_query_columns(spark, make_docs, library):
    rows = [(1, "the cat  sat"), (2, None), (3, ""), (None, "no id ▁ x"), (4, "漢字 𝒳"), (4, "漢字 𝒳"), (5, "long " * 60_000), (6, "y" * 70_000)]
    docs = make_docs(rows).withColumnRenamed("row", "ids")
    out = P.digests(P.decode(P.encode(docs))).collect()
    want = []
    for d, x in rows:
        ids = library.encode(x or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)
    assert P.digests(P.decode(P.encode(make_docs([])))).count() == 0
    got = P.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, ""), (2, "")]
