"""What the driver does and holds, which doesn't follow the number of partitions or of words."""

import collections
import itertools
import random
import tracemalloc

import numpy as np
import pytest

from siltstone.llm import components as C
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.language_id import train


@pytest.fixture
def jobs(spark):
    """Runs something as a group of jobs; gives its result and the number of jobs."""
    numbers = itertools.count()

    def run(make):
        sc, group = spark.sparkContext, f"driver-{next(numbers)}"
        sc.setJobGroup(group, group)
        try:
            return make(), len(sc.statusTracker().getJobIdsForGroup(group))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    return run


def smallest(links):
    parent = {x: x for pair in links for x in pair}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return {k: v for k, v in parent.items() if any(k in p and p[0] != p[1] for p in links)}


@pytest.mark.parametrize("links", [[(1, 0), (2, 0), (7, 5)], [(k, k + 1) for k in range(12)], [(9, 2), (9, 4), (4, 1), (9, 2), (2, 9), (3, 3)], [(k, 50) for k in range(40)], [(1, 1)], []])
def test_components_reach_the_smallest(spark, links):
    found = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(smallest(links).items())


def test_random_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    found = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(smallest(links).items())


def test_stars_take_no_step(spark, monkeypatch):
    cuts, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, tag: cuts.append(tag) or cut(df, tag))
    C.components(spark.createDataFrame([(k, k % 3) for k in range(3, 60)], "a long, b long"))
    assert len(cuts) == 1


def test_few_items_come_in_one_job(spark, jobs):
    words = lambda k: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(12))
    items = spark.createDataFrame([(k, words(k)) for k in range(200)], "item_id long, text string").repartition(8)
    docs = spark.createDataFrame([(1, words(3)), (2, "nothing of it")], "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found, n = jobs(lambda: contaminated(docs, items))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 3)}
    assert n < 40


def test_many_items_stream_alike(spark, monkeypatch):
    from siltstone.llm import decontaminate

    items = spark.createDataFrame([(k, " ".join(f"{chr(97 + k)}{chr(97 + j)}" for j in range(12))) for k in range(9)], "item_id long, text string")
    docs = items.selectExpr("item_id AS doc_id", "text").where("doc_id > 2")
    once = sorted(map(tuple, contaminated(docs, items, block_passages=3).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontaminate, "FEW_CHARS", 0)
    assert once == sorted(map(tuple, contaminated(docs, items, block_passages=3).select("doc_id", "item_id").collect())) == [(k, k) for k in range(3, 9)]


def test_fit_holds_features_of_some_words():
    rng = np.random.default_rng(1)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 9)))
    texts = [(lang, [word() for _ in range(200)]) for lang in ("a", "b", "c", "d") for _ in range(100)]
    tracemalloc.start()
    try:
        train(texts, rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120e6
