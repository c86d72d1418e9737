import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import retrieve as R


def chunk_rows(seed, n=30):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "include", "router", "the", "über", "x1"]
    return [(i, f"src{i % 3}/{i}.py", rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), "python", "code") for i in range(n)]


CHUNKS = "chunk_id long, path string, symbol string, content string, language string, stratum string"


def test_query_terms(spark):
    one = lambda q: spark.createDataFrame([(q,)], "q string").select(X.query_terms(F.col("q"))).first()[0]
    assert one("How does include_router use APIRouter?") == ["include router", "include", "router", "APIRouter"]
    assert one("getUser a the") == ["getUser", "get User"]
    assert one("") == []


def fuse_loop(lists, weights, k):
    score, ranks = {}, {}
    for name, ids in lists.items():
        for rank, i in enumerate(ids, 1):
            if name not in ranks.setdefault(i, {}):
                ranks[i][name] = rank
                score[i] = score.get(i, 0.0) + weights[name] / (k + rank)
    return sorted(((round(s, 12), -min(ranks[i].values()), -i) for i, s in score.items()), reverse=True)


@pytest.mark.parametrize("seed", range(3))
def test_fusion_and_cap_equal_loops(spark, seed):
    rng = random.Random(seed)
    weights = {"semantic": 1.0, "lexical": 2.0}
    lists = {n: rng.sample(range(30), 15) for n in weights}
    rows = [(1, n, i, r) for n, ids in lists.items() for r, i in enumerate(ids, 1)]
    fused = R.fuse(spark.createDataFrame(rows, "question_id long, list string, chunk_id long, rank int"), weights)
    got = fused.orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [-x[2] for x in fuse_loop(lists, weights, 60)]
    kept, per = [], {}
    for r in got:
        path = r["chunk_id"] % 4
        if len(kept) < 6 and per.get(path, 0) < 2:
            per[path] = per.get(path, 0) + 1
            kept.append(r["chunk_id"])
    own = R.assemble(fused.withColumn("path", F.col("chunk_id") % 4), 6, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in own] == kept


def test_semantic_list_equals_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, "ab"[i % 2], [float(rng.randint(0, 3)) for _ in range(8)]) for i in range(60)]
    queries = [(q, [float(rng.randint(0, 3)) for _ in range(8)]) for q in range(5)]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))), 9)
    got = R.semantic_list(spark.createDataFrame(vectors, "chunk_id long, stratum string, vector array<double>").repartition(4), spark.createDataFrame(queries, "question_id long, vector array<double>"), 4).collect()
    for q, v in queries:
        for s in "ab":
            want = sorted((-cos(v, x), i) for i, t, x in vectors if t == s and any(x))[:4]
            assert [(-r["score"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"]) if (r["question_id"], r["stratum"]) == (q, s)] == want


def test_filter_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame(chunk_rows(2), CHUNKS).write.parquet(str(tmp_path / "c"))
    plan = spark.read.parquet(str(tmp_path / "c")).where("language IN ('python', 'go')").select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(language" in plan and "content" not in plan.split("ReadSchema")[1]


def test_semantic_list_holds_few_cells_at_a_time(spark, monkeypatch):
    """A batch of 3,000 vectors and 1,000 questions goes through first_of_each in pieces of at most CELLS, with the same result."""
    import numpy as np

    x = np.random.default_rng(2).integers(0, 3, (3000, 4)).astype(float) + 1
    rows = spark.createDataFrame([(k, "ab"[k % 2], v) for k, v in enumerate(x.tolist())], "chunk_id long, stratum string, vector array<double>").coalesce(1)
    own = R.first_of_each

    def bounded(k, before, like, chunk):
        assert like.size <= 1_000_000
        return own(k, before, like, chunk)

    monkeypatch.setattr(R, "first_of_each", bounded)
    table = rows.select("chunk_id", "stratum", "vector").toArrow().to_batches()
    queries = rows.where("chunk_id < 1000").select(F.col("chunk_id").alias("question_id"), "vector")
    held = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, schema: held.setdefault("run", run) and df.select("chunk_id", "stratum", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("question_id")))
    R.semantic_list(rows, queries, 5)
    got = {}
    for b in held["run"](iter(table)):
        for r in b.to_pylist():
            got.setdefault((r["question_id"], r["stratum"]), []).append((-r["score"], r["chunk_id"]))
    norm = np.sqrt((x * x).sum(axis=1))
    for q in (0, 7, 999):
        like = np.round(x @ x[q] / (norm * norm[q]), 9)
        for s in (0, 1):
            want = sorted((-float(like[k]), k) for k in range(s, 3000, 2))[:5]
            assert [c for _, c in sorted(got[q, "ab"[s]])] == [c for _, c in want]


def test_pooled_lists_are_the_best_of_all_strata(spark):
    """A search by stratum holds the pooled search: the first rows of all strata together."""
    rng = random.Random(9)
    vectors = spark.createDataFrame([(i, rng.choice(["code", "prose"]), [float(rng.randint(0, 2)) for _ in range(4)]) for i in range(200)], "chunk_id long, stratum string, vector array<double>")
    queries = spark.createDataFrame([(q, [float(rng.randint(0, 3)) for _ in range(4)]) for q in range(6)], "question_id long, vector array<double>")
    by_stratum = R.semantic_list(vectors, queries, 12).withColumn("list", F.concat(F.lit("semantic_"), "stratum"))
    got = R.pooled(by_stratum, 12).collect()
    want = R.semantic_list(vectors.withColumn("stratum", F.lit("all")), queries, 12).collect()
    assert {(r["question_id"], r["list"], r["chunk_id"], r["rank"], r["score"]) for r in got} == {(r["question_id"], "semantic", r["chunk_id"], r["rank"], r["score"]) for r in want} and len(got) == len(want)


def test_code_floor_searches_once(spark, monkeypatch):
    """Both kinds of lists come from one search of each index; before, each index was searched by stratum and once more over all."""
    from siltstone.plans import search as P

    asked, own = [], R.semantic_list
    monkeypatch.setattr(R, "semantic_list", lambda *a, **b: asked.append(a) or own(*a, **b))
    assert P.hybrid_code_floor(spark, "/root/testdata/sf0.001").count() and len(asked) == 1
