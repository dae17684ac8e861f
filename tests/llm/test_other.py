"""Classifiers, search, archives and license scans: exact checks where possible, held-out quality otherwise."""
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, language, licenses, toxicity, warc


def test_toxicity_learns_pairs(spark, make_docs):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(3000):
        t = [rng.choice(plain) for _ in range(15)]
        a, b = rng.random() < 0.4, rng.random() < 0.4
        t += ["insult"] * a + ["group"] * b
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, 0, int(a and b)))
    rows += [(9000, None), (9001, ""), (None, "insult group")]
    labels += [(1, 0, None), (None, 0, 1), (77777, 0, 1)]
    got = toxicity.score(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    truth = {i: y for i, _, y in labels[:3000]}
    test = got[got.held_out & got.doc_id.isin(truth)]
    assert (test.predicted == test.doc_id.map(truth)).mean() > 0.97
    crc = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    assert all(h == crc[i] for i, h in zip(got.doc_id, got.held_out) if i in crc)
    assert (got.predicted == (got.score >= 0.3)).all()


def area(score, y):
    """Area under the curve of true against false positives."""
    rank = pd.Series(np.asarray(score)).rank().to_numpy()
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize("same", [True, False])
def test_toxicity_learns_pairs_that_say_nothing_alone(spark, make_docs, same):
    """Toxic if and only if two terms are both there or both missing (or the reverse): additive weights cannot tell."""
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(60)]
    rows, truth = [], {}
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t = [rng.choice(plain) for _ in range(15)] + ["insult"] * a + ["group"] * b
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        truth[i] = int((a == b) is same)
    got = toxicity.score(make_docs(rows), spark.createDataFrame([(i, 0, y) for i, y in truth.items()], "doc_id long, quality int, toxic int")).toPandas()
    test = got[got.held_out]
    assert area(test.score, test.doc_id.map(truth)) >= 0.9
    # additive weights (log odds of every term) stay near chance
    doc, bucket = toxicity.doc_terms([t for _, t in rows])
    y = np.array(list(truth.values()), float)
    n1, n0 = (np.bincount(bucket[(doc < 3000) & (y[doc] == k)], minlength=toxicity.BUCKETS) + 0.5 for k in (1, 0))
    additive = np.bincount(doc[doc >= 3000] - 3000, np.log(n1 / n0)[bucket[doc >= 3000]], 1000)
    assert abs(area(additive, y[3000:]) - 0.5) < 0.1


def test_toxicity_without_labels(spark, make_docs):
    rows = [(1, "a b"), (2, None)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(make_docs(rows), none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(make_docs(rows), one).collect()} <= {0.0, 1.0}
    assert toxicity.score(make_docs([]), none).count() == 0


def test_toxicity_sample_is_flat_and_in_its_order(spark):
    rng = random.Random(5)
    rows = [(" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 2, 300, 300]))), rng.randrange(2)) for _ in range(3000)] * 2
    table = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    doc, bucket = toxicity.doc_terms([t for t, _ in rows])
    number = np.full(toxicity.BUCKETS, -1, np.int32)
    used = np.unique(bucket)[::2]
    number[used] = np.random.default_rng(1).permutation(len(used))
    tracemalloc.start()
    got_doc, got_term, y = toxicity.sample_terms(table, number)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    begin = np.searchsorted(doc, np.arange(len(rows) + 1))
    lists = [np.sort(number[bucket[a:b]]) for a, b in zip(begin, begin[1:])]
    want = sorted(((y, ",".join(map(str, t[t >= 0]))) for t, (_, y) in zip(lists, rows)))
    at = np.searchsorted(got_doc, np.arange(len(y) + 1))
    assert [(int(k), ",".join(map(str, got_term[a:b]))) for k, a, b in zip(y, at, at[1:])] == want
    # flat columns need a few bytes a term; the fixed part is the way of the lookup table to the tasks
    assert len(got_term) > 600_000 and peak < 16 * len(got_term) + (20 << 20), (peak, len(got_term))


def test_language_words_end_where_the_script_changes(spark, make_docs):
    rng = random.Random(9)
    parts = {"en": ["the", "and", "ing", "er"], "ru": ["при", "вет", "мир"], "zh": list("漢字文中国人大学生")}
    say = lambda lang, n: "".join(rng.choice(parts[lang]) for _ in range(n))
    rows = [(i, " ".join(say(lang, rng.randint(2, 5)) for _ in range(20)), lang) for i in range(600) for lang in [rng.choice(list(parts))]]
    rows += [(7000, "the" + say("zh", 18), None), (7001, "привет" + "мир" + say("zh", 30), None)]
    got = {r.doc_id: r for r in language.identify(make_docs(rows)).collect()}
    assert [s.lang for s in got[7000].spans] == ["en", "zh"] and got[7000].lang_pred == "zh"
    assert [s.lang for s in got[7001].spans] == ["ru", "zh"] and got[7001].lang_pred == "zh" and got[7001].score < 1


def test_language_spans(spark, make_docs):
    rng = random.Random(2)
    parts = {"xx": ["ba", "do", "gu"], "yy": ["ski", "tro", "vle"], "ru": ["при", "вет", "мир"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(lang, rng.choice([8, 30])), lang) for i in range(900) for lang in [rng.choice(list(parts))]]
    rows += [(5000, None, "xx"), (5001, "", "xx"), (5002, "123 ...", "yy"), (5003, say("xx", 60) + " " + say("ru", 30) + " " + say("yy", 10), None)]
    out = language.identify(make_docs(rows))
    got = {r.doc_id: r for r in out.collect()}
    truth = {i: lang for i, _, lang in rows[:900]}
    test = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in test]) > 0.98
    assert [got[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3
    mixed = got[5003]
    assert mixed.lang_pred == "xx" and [s.lang for s in mixed.spans] == ["xx", "ru", "yy"]
    assert language.identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in language.identify(make_docs([(1, "abc", None)])).collect()} == {"und"}


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(3)

    def slow(s, pen):
        import itertools
        return max(sum(s[t, x] for t, x in enumerate(p)) - pen * sum(a != b for a, b in zip(p, p[1:]))
                   for p in itertools.product(range(s.shape[1]), repeat=len(s)))
    for _ in range(200):
        s = rng.normal(size=(int(rng.integers(1, 7)), 3))
        pen = float(rng.uniform(0.1, 4))
        p = language.viterbi(s, pen)
        value = sum(s[t, x] for t, x in enumerate(p)) - pen * sum(a != b for a, b in zip(p, p[1:]))
        assert value == pytest.approx(slow(s, pen))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:900] = x[100] * 4  # one long vector for a quarter of the rows
    rows = [(i, x[i].tolist(), 0) for i in range(len(x))]
    bad = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] + [1.0] * 15, 0), (5060, [None] + [1.0] * 15, 0),
           (5080, [float("inf")] * 16, 0), (5100, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    got = ann.search(vectors(spark, rows + bad + rows[:50]), "vec_id % 20 = 0", fit_rows=1500).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20))
    d = x.astype(float)
    found = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part.vec_id)
        exact = (d[part.vec_id] * d[q]).sum(axis=1)
        assert np.allclose(exact, part.score, rtol=0, atol=1e-12)
        assert part[["score", "vec_id"]].apply(lambda r: (-r.score, r.vec_id), axis=1).is_monotonic_increasing
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        kth = np.sort(s)[-20]
        found += int((part.score >= kth - 1e-12).sum())
        if 100 <= q < 900:  # ties among the copies go to the smaller ids
            assert part.vec_id.tolist() == [i for i in range(100, 122) if i != q][:20]
    assert found / len(got) >= 0.9


def test_tree_travels_as_plain_data():
    """Workers without an importable copy of the package can read what is broadcast."""
    import pickle
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = ann.Tree(x)
    data = pickle.dumps(tree.state())
    assert b"riskloom" not in data
    again = ann.Tree.of(pickle.loads(data))
    assert (again.assign(x) == tree.assign(x)).all() and again.visits(x[:5], 3) == tree.visits(x[:5], 3)


def test_ann_lonely_queries_find_k(spark, monkeypatch):
    """Dense groups of copies and a few far points: every query gets its k; blocks of few queries change nothing."""
    rng = np.random.default_rng(3)
    dense = [(i, (np.eye(8)[i % 8] * 5).tolist(), 0) for i in range(1600)]
    far = [(2000 + 20 * i, (rng.normal(size=8) * 3).tolist(), 0) for i in range(30)]
    table = vectors(spark, dense + far)
    got = ann.search(table, "vec_id % 20 = 0").toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 110
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    again = ann.search(table, "vec_id % 20 = 0").toPandas()
    key = ["query_id", "rank"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_ann_small_tables(spark):
    assert ann.search(vectors(spark, []), "vec_id % 20 = 0").count() == 0
    assert ann.search(vectors(spark, [(0, [1.0, 2.0], 0)]), "vec_id % 20 = 0").count() == 0
    got = ann.search(vectors(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [2.0, 0.0], 0)]), "vec_id % 20 = 0").collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2, 2.0), (2, 1, 1.0)]


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    rows = [(i, f"http://Host{i % 3}.example.com/p/{i % 7}?q=1", f"<html>{i}" + "y" * (i * 10)) for i in range(120)]
    rows += [(200, "https://a.b.c/", big), (201, "https://a.b.c/", big), (202, None, big), (203, "http://x/\r\nevil: 1", "r\r\n\r\nn\u0000"),
             (204, "not a url", None), (None, "http://n/", big), (205, "", ""), (206, "http://same/", "s" * 10), (207, "http://other/", "s" * 10),
             (201, "https://a.b.c/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    captures, top, folder = warc.archive(pages, file_bytes=20_000, block=8)
    got = warc.read(warc.lookup(pages, top, folder), folder).collect()
    want = Counter()
    for p, u, h in rows:
        b = (h or "").encode()
        revisit = h == big and p != 202
        want[(p, u or "", len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 202 if revisit else None)] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    payload = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(payload[p] == (h or "").encode() for p, _, h in rows if p in payload)
    one = warc.read(warc.lookup(pages.filter("page_id = 200").select("url"), top, folder), folder).collect()
    assert Counter(r.page_id for r in one) == Counter([200, 201, 201])
    assert warc.lookup(spark.createDataFrame([("http://absent/",)], "url string"), top, folder).count() == 0


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    _, top, folder = warc.archive(pages)
    assert warc.lookup(pages, top, folder).count() == 0


def test_surt():
    assert warc.surt("http://www.News.example.com:8080/a?b=c") == "com,example,news:8080)/a?b=c"
    assert warc.surt("https://example.com") == "com,example)/" and warc.surt(None) == "" and warc.surt("http://[bad") == "http://[bad"


def test_licenses(spark, make_docs):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 60)
    words = mit.split(" ")
    dropped = " ".join(words[:9] + words[10:])
    rows = [(1, f"intro words {mit.capitalize()}. Tail"), (2, f"x {dropped} y"), (3, "All  Rights-Reserved. cc by; CC BY-NC 4.0 general public LICENSE"),
            (4, "permission is hereby something else entirely"), (5, None), (6, ""), (None, "all rights reserved"), (7, "all rights"),
            (3, "All  Rights-Reserved. cc by; CC BY-NC 4.0 general public LICENSE")]
    got = licenses.scan(make_docs(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].labels == by[2].labels == "mit" and by[1].score == 1.0 and 0.8 < by[2].score < 1 and by[1].n_base == 0
    assert (by[3].n_words, by[3].n_base, by[3].first_word, by[3].last_word, by[3].base_labels) == (13, 4, 0, 10, "cc-by,gpl,reserved")
    assert set(by[3].base_labels.split(",")) <= set(by[3].labels.split(","))
    assert by[4].labels == "" and by[4].score < licenses.COVERAGE and by[4].first_word is None
    assert (by[5].n_words, by[5].labels, by[5].score) == (0, "", 0.0) and by[None].base_labels == "reserved" and by[7].n_base == 0
    assert by[1].spans[0].first == 2 and by[1].spans[0].end == 2 + len(words)
    assert licenses.scan(make_docs([])).count() == 0


def test_base_places_brute_force(spark, make_docs):
    rng = random.Random(9)
    vocab = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "x"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    for i, t in rows:
        w = t.split(" ") if t else []
        places = [(s, label) for p, label in licenses.BASE.items() for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
        r = got[i]
        assert r.n_base == len(places) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
