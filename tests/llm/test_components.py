"""Connected components are whole or an error."""
import random

import pytest

from riskloom.llm.common import components, prepare


def test_rounds_that_run_out_are_an_error(spark):
    prepare(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="rounds"):
        components(chain, max_rounds=1).collect()
    assert {(r.node, r.component) for r in components(chain).collect()} == {(i, 0) for i in range(41)}


def test_few_edges_are_not_dealt_over_all_partitions(spark):
    prepare(spark)
    sc = spark.sparkContext
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in keys}
    rng = random.Random(3)
    edges = [(a, rng.randrange(a)) for a in range(1, 400) if a % 7] + [(5, 5), (3, 1), (1, 3)]
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "few edges")
        got = [tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).select("node", "component").collect()]
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    low = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in edges:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert sorted(got) == sorted(low.items())
    assert tasks < 400, tasks
