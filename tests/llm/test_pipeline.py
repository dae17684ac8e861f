"""Each pipeline stage on its own awkward input, and the whole run on a small corpus."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(120), text(20)
    rows, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.3
        t = text(rng.choice([20, 80])).split(" ")
        if toxic:
            t[rng.randrange(len(t))] = "scumword"
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, text(60), "en", "s", 0)]
    rows += [(1003, rows[-1][1], "de", "s", 0), (1002, rows[-1][1], "en", "s", 0)]       # copies, one with a repeated id
    rows += [(1010, text(60) + " " + passage, "en", "s", 0), (1011, passage + " " + text(70), "en", "s", 0)]
    rows += [(1020, text(30) + " " + item + " " + text(5), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "score", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, dict((i, y) for i, _, y in labels), passage


def test_stages(spark, folder, tmp_path):
    d, rows, toxic, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = []
    for name, stage in cp.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(docs.collect())
    assert all(list(s[0].asDict()) == cp.COLUMNS for s in steps[:4])
    ids = [Counter(r.doc_id for r in s) for s in steps]
    assert not any(toxic.get(i) for i in ids[0])
    assert sum(ids[0].values()) >= 0.95 * sum(1 for r in rows if not toxic.get(r[0]))  # 300 training rows
    assert ids[0][1002] == 2 and ids[0][1000] == ids[0][1001] == 1
    assert ids[1][1002] == 1 and 1003 not in ids[1] and ids[1][1000] == ids[1][1001] == 1
    assert set(ids[2]) == set(ids[1])
    left = {r.doc_id: r for r in steps[2]}
    assert all(passage not in (left[i].text or "") and left[i].n_chars == len(left[i].text) for i in (1010, 1011))
    assert 1020 in ids[2] and 1020 not in ids[3] and sum(ids[3].values()) == sum(ids[2].values()) - 1
    assert set(r.doc_id for r in steps[4]) == set(ids[3])


def test_empty_tables(spark, folder):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_run(spark, folder):
    assert cp.run(spark, folder[0]).count() > 100
