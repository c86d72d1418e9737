"""The join on prefixes of shingle sets: it loses no similar pair, and what it shuffles is pairs and not prefixes."""

import random

import numpy as np
import pytest

from siltstone.llm.simhash import prefix, prefix_pairs

NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def near_sets(rng, n, size, changed):
    base = [rng.getrandbits(64) for _ in range(size)]
    sets = []
    for _ in range(n):
        share = rng.uniform(*changed)
        own = [rng.getrandbits(64) if rng.random() < share else x for x in base]
        sets.append(np.unique(np.array(own[rng.randrange(size // 8) :], np.uint64)))
    return sets


@pytest.mark.parametrize("size", [3, 9, 40, 300])
def test_no_similar_pair_is_left_out(spark, size):
    rng = random.Random(size)
    sets = near_sets(rng, 50, max(8, size), (0, 0.2)) + [np.array([rng.getrandbits(64)], np.uint64)] * 3
    group = {k: k - k % 2 if k < 20 else k for k in range(len(sets))}
    rows = [(k, len(x), prefix(x, 0.8, NONE).view(np.int64).tolist()) for k, x in enumerate(sets)]
    got = [tuple(r) for r in prefix_pairs(spark.createDataFrame(rows, "node long, n long, head array<long>"), spark.createDataFrame(list(group.items()), "node long, group long"), 0.8).collect()]
    shared = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for b in range(len(sets)) for a in range(b) if group[a] != group[b] and shared(a, b) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b]))}
    assert want <= set(got) and len(got) == len(set(got)) and len(want) > 20
    assert all(a < b and group[a] != group[b] for a, b in got)


def test_prefixes_are_shuffled_once(spark):
    """Long sets of which many pairs meet and few are similar: a pair takes no prefix with it."""
    rng = random.Random(2)
    sets = near_sets(rng, 60, 4000, (0.07, 0.12))
    rows = [(k, len(x), prefix(x, 0.8, NONE).view(np.int64).tolist()) for k, x in enumerate(sets)]
    heads, groups = spark.createDataFrame(rows, "node long, n long, head array<long>"), spark.range(60).selectExpr("id AS node", "id AS group")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sc = spark.sparkContext._jsc.sc()
    written = lambda: (sc.listenerBus().waitUntilEmpty(), sc.statusStore().executorSummary("driver").totalShuffleWrite())[1]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = written()
        prefix_pairs(heads, groups, 0.8).collect()
        took = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert took < 6 * sum(len(r[2]) * 8 for r in rows)
