"""The stored indexes: posting blocks against FTS5 and loops, cells against exact search."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import values as V
from siltstone.operators import index as I
from siltstone.operators import retrieve as R
from siltstone.operators.cells import CellIndex
from siltstone.operators.lexicon import Lexicon, Scorer, bucket_of
from siltstone.operators.varint import decode, differences, encode, running

CHUNKS = "chunk_id long, path string, symbol string, content string, language string, stratum string"
WORDS = ["alpha", "beta", "gamma", "delta", "include", "router", "the", "über", "x1"]


def chunk_rows(seed, n=60, words=WORDS):
    rng = random.Random(seed)
    return [(i * 7 - 50, f"src{i % 3}/{i}.py", rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), "python", rng.choice(["code", "prose"])) for i in range(n)]


def built(spark, rows, path, **options):
    return Lexicon.build(I.tokenized(spark.createDataFrame(rows, CHUNKS)), str(path), **options)


def test_varints_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 500):
        values = (rng.integers(0, 1 << 62, n) >> rng.integers(0, 62, n)).astype(np.uint64)
        cuts = np.sort(np.append(rng.integers(0, n + 1, 3), [0, n]))
        data, at = encode(values, cuts)
        for a, b, x, y in zip(cuts, cuts[1:], at, at[1:]):
            assert decode(data[x:y].tobytes()).tolist() == values[a:b].astype(np.int64).tolist()
    lengths = np.array([0, 3, 0, 2, 0, 1])
    values = np.array([5, 6, 9, 1, 4, 8])
    assert running(differences(values, np.array([0, 3, 5])), lengths).tolist() == values.tolist()


@pytest.mark.parametrize("options", [{}, {"slab_tokens": 40, "buckets": 5}])
def test_bm25_equals_fts5(spark, tmp_path, options):
    rows = chunk_rows(1) + [(9000, None, None, None, None, None)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE c USING fts5(id UNINDEXED, path, symbol, content)")
    db.executemany("INSERT INTO c VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    asked = [(1, "alpha gamma"), (2, "include_router"), (3, "fooBar delta"), (4, "alpha_beta_gamma"), (5, "nothing_known"), (6, "")]
    terms = R.search_terms(spark.createDataFrame(asked, "question_id long, question string"))
    lexicon = built(spark, rows, tmp_path, **options)
    got = {(r["question_id"], r["chunk_id"]): r["score"] for r in lexicon.search(terms).collect()}
    assert {q for q, _ in got} == {1, 2, 3, 4}
    for number, match in ((1, "alpha OR gamma"), (2, '"include router" OR include OR router'), (3, 'fooBar OR "foo Bar" OR delta'), (4, '"alpha beta gamma" OR alpha OR beta OR gamma')):
        want = dict(db.execute("SELECT id, -bm25(c, 0.0, 2.0, 5.0, 1.0) FROM c WHERE c MATCH ?", (match,)).fetchall())
        own = {c: s for (q, c), s in got.items() if q == number}
        assert own.keys() == want.keys()
        assert all(math.isclose(own[c], want[c], rel_tol=1e-6, abs_tol=1e-6) for c in want)
    for k in (1, 4):
        for strata in (False, True):
            by = {r[0]: r[5] for r in rows}
            ranked = R.lexical_list(lexicon, spark.createDataFrame(asked, "question_id long, question string"), k, strata).collect()
            groups = {}
            for (q, c), s in got.items():
                groups.setdefault((q, by[c] if strata else None), []).append((-s, c))
            want = {(q, s, c, rank) for (q, s), own in groups.items() for rank, (_, c) in enumerate(sorted(own)[:k], 1)}
            assert {(r["question_id"], r["stratum"] if strata else None, r["chunk_id"], r["rank"]) for r in ranked} == want


def test_postings_read_back(spark, tmp_path):
    rows = chunk_rows(2) + [(7777, "a/b", "x", "word " * 3000, "python", None)]
    lexicon = built(spark, rows, tmp_path, slab_tokens=100)
    tokens = I.tokenized(spark.createDataFrame(rows, CHUNKS))
    want = [(t, r["chunk_id"], f, k) for r in tokens.collect() for f in V.FIELD_WEIGHTS for k, t in enumerate(r[f"{f}_tokens"])]
    assert sorted(map(tuple, lexicon.postings().select("token", "chunk_id", "field", "pos").collect())) == sorted(want)
    assert lexicon.n_docs == len(rows) and math.isclose(lexicon.mean, len(want) / len(rows))
    assert built(spark, [], tmp_path / "none").search(R.search_terms(spark.createDataFrame([(1, "alpha")], "question_id long, question string"))).count() == 0


def test_a_search_reads_the_partitions_of_its_terms_only(spark, tmp_path):
    lexicon = built(spark, chunk_rows(3), tmp_path, buckets=16)
    plan = lexicon.of_tokens(["alpha", "router"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan
    own = {bucket_of(t, 16) for t in ("alpha", "router")}
    files = lexicon.of_tokens(["alpha", "router"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("bucket=")[1].split("/")[0]) for r in files} == own
    assert {r["token"] for r in lexicon.of_tokens(["alpha", "router"]).collect()} == {"alpha", "router"}


def test_slabs_under_the_kth_score_are_skipped(spark, tmp_path):
    rows = chunk_rows(4, 400, [*WORDS, *[f"w{k}" for k in range(50)]])
    rows[7] = (*rows[7][:3], "router router router", *rows[7][4:])
    lexicon = built(spark, rows, tmp_path, slab_tokens=200)
    held = {}
    for r in lexicon.of_tokens(["router", "alpha"]).collect():
        held.setdefault(r["slab"], []).append(r.asDict())
    n = {t: sum(r["n"] for own in held.values() for r in own if r["token"] == t) for t in ("router", "alpha")}
    rarity = {(t,): math.log((len(rows) - n[t] + 0.5) / (n[t] + 0.5)) for t in n}
    best = {}
    for k in (3, None):
        scorer = Scorer({1: [("router",), ("alpha",)]}, rarity, lexicon.mean, k, None)
        for slab in sorted(held):
            scorer.slab(held[slab])
        ids, score, _ = scorer.best[0, None]
        best[k] = sorted(zip((-score.round(9)).tolist(), ids.tolist()))[:3]
        assert scorer.scored + scorer.skipped == len(held) and (scorer.skipped > len(held) // 4) == (k == 3)
    assert best[3] == best[None]


def test_cells_find_nine_in_ten_and_compare_a_tenth(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) + rng.normal(size=(12, 24))[rng.integers(0, 12, 1500)]
    x[100:600] = x[99]  # a third of the rows alike
    rows = [(int(k), "s", v.tolist()) for k, v in enumerate(x)] + [(5000, None, [0.0] * 24), (5001, "s", None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, stratum string, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(int(k), x[k].tolist()) for k in range(0, 1500, 50)], "question_id long, vector array<double>")
    index = CellIndex.build(vectors, str(tmp_path / "c"))
    assert index.rows.count() == 1501
    k, rerank = 10, 60
    probes = -(-len(index.centres) // 2)
    exact = {(r["question_id"], r["chunk_id"]) for r in R.semantic_list(vectors.where("vector IS NOT NULL").withColumn("stratum", F.lit("all")), queries, k, digits=8).collect()}
    found = index.search(queries, k, probes, rerank).collect()
    assert len({(r["question_id"], r["chunk_id"]) for r in found} & exact) >= 0.9 * len(exact)
    asked = np.array([x[q] for q in range(0, 1500, 50)])
    chosen = index.candidates(np.arange(0, 1500, 50), asked, probes, rerank)
    assert chosen.count() <= 30 * 1501 / 10  # pairs whose vectors are compared
    sizes = {r["cell"]: r["count"] for r in index.rows.groupBy("cell").count().collect()}
    near = index.near_cells(asked, 2)
    assert sum(sizes.get(c, 0) for own in near.tolist() for c in own) < 30 * 1501  # cells hold parts of the table
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan and "vector" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert index.search(queries.limit(0), k, probes, rerank).count() == 0


def test_recall_on_the_embeddings_table(spark):
    from siltstone.plans import search as P

    sf = "/root/testdata/sf0.1"
    vectors, queries = P._given(spark, sf)
    exact = {(r["question_id"], r["chunk_id"]) for r in P.semantic_topk(spark, sf).collect()}
    found = P.ann_cells(spark, sf).collect()
    assert len({(r["question_id"], r["chunk_id"]) for r in found} & exact) >= 0.9 * len(exact)
    assert 50 * queries.count() <= vectors.count() * queries.count() / 10  # rerank = 50 vectors a question


def test_codes_tell_the_nearest_apart_in_a_crowd(spark, tmp_path):
    """20,000 vectors without any cells of their own: the fifty best codes hold nine in ten of the ten nearest."""
    x = np.random.default_rng(4).normal(size=(20_000, 64))
    vectors = spark.createDataFrame([(k, "s", v) for k, v in enumerate(x.tolist())], "chunk_id long, stratum string, vector array<double>")
    index = CellIndex.build(vectors, str(tmp_path / "c"), cells=4, rounds=1)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    asked = range(0, 20_000, 1000)
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in asked], "question_id long, vector array<double>")
    found = {(r["question_id"], r["chunk_id"]) for r in index.search(queries, 10, 4, 50).collect()}
    exact = {(k, int(c)) for k in asked for c in np.argsort(-(unit @ unit[k]), kind="stable")[:10]}
    assert len(found & exact) >= 0.9 * len(exact)


def test_matrices_of_a_task_are_bounded():
    import tracemalloc

    from siltstone.operators.cells import nearest

    x, centres = np.random.default_rng(1).normal(size=(4096, 8)), np.random.default_rng(2).normal(size=(6000, 8))
    want = (x[:50] @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
    tracemalloc.start()
    got = nearest(x, centres)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:50].tolist() == want.tolist() and most < 50_000_000


def test_tokens_are_not_shuffled_into_slabs_and_counts_equal_postings(spark, tmp_path):
    """Slabs are made where rows are read, bounded by tokens; counts come from blocks without a row per posting, repeated ids too."""
    from siltstone.operators.lexicon import FIELDS, Lexicon, _blocks, _slabs

    rows = [(k // 2 if k < 20 else k, "s", ["p"], ["s", "s"], [f"w{(k * j) % 7}" for j in range(k % 9)]) for k in range(300)]
    tokens = spark.createDataFrame(rows, f"chunk_id long, stratum string, {', '.join(f'{f}_tokens array<string>' for f in FIELDS)}")
    tokens = tokens.withColumn("length", F.expr(" + ".join(f"size({f}_tokens)" for f in FIELDS)).cast("long")).coalesce(1)
    own = tokens.mapInArrow(_slabs(_blocks(5.0, 16, ["s"]), 50), "bucket int, token string, slab int, n long, bound double, ids binary, lengths binary, kinds binary, counts binary, positions binary")
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert own.select("slab").distinct().count() >= tokens.agg(F.sum("length")).first()[0] // 50
    lexicon = Lexicon.build(tokens, str(tmp_path / "l"))
    want = lexicon.postings().groupBy("token", "field").agg(F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("occurrences"), F.sum("pos").alias("pos_sum"))
    assert sorted(map(tuple, lexicon.counts().collect())) == sorted(map(tuple, want.collect()))


def test_lexical_searches_make_no_vectors(spark, tmp_path):
    """Vectors are made at their first use, and then once."""
    index = I.SearchIndex.build(spark.createDataFrame(chunk_rows(3), CHUNKS), str(tmp_path))
    asked = spark.createDataFrame([(1, ["alpha", "beta"])], "question_id long, phrase array<string>")
    assert index.lexicon.search(asked, 10).count() and not (tmp_path / "vectors").exists()
    assert index.vectors.count() == 60 and index.vectors is index.vectors
