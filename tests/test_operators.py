import hashlib
import math
import random
from collections import deque

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.functions import text as X
from siltstone.operators import chunk as C
from siltstone.operators import evaluate as E
from siltstone.operators import verify as V
from siltstone.sources import walk as W
from siltstone.streaming import limits as L


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    assert one(spark, X.markers(F.col("a")), a="see [2], [1], [2] and [100] [0]") == [2, 1, 0]
    assert one(spark, X.slug(F.col("a"), F.lit("ast")), a="My Repo!!") == "repo_my_repo__ast"
    assert one(spark, X.looks_dependent(F.col("a")), a="what about the other function in here") is True
    assert one(spark, X.looks_dependent(F.col("a")), a="how are requests validated by a model") is False
    assert one(spark, X.location(F.col("a"), F.col("b"), F.lit(None).cast("int")), a="p.py", b=3) == "p.py:3"
    assert one(spark, X.language_of(F.col("a")), a="Makefile") == "unknown"
    assert one(spark, X.refused(F.col("a")), a="insufficient_context: nothing") is True


def test_skip_cascade(spark):
    rows = [("src/a.py", 5, b"x = 1"), ("src/b.min.js", 5, b"x"), ("src/c.unknown", 5, b"x"), ("src/d.py", 0, b""), ("src/e.py", 2_000_000, b"x"), ("src/f.py", 5, b"a\0b"), ("src/g.py", 5, b"\xff\xfe"), ("node_modules/h.py", 5, b"x"), ("x.egg-info/i.py", 5, b"x"), ("src/yarn.lock", 1, b"x"), ("docs/j.md", 2, b"ok")]
    got = {r["path"]: r["skip_reason"] for r in W.load(spark.createDataFrame(rows, "path string, size_bytes long, content binary"), exclude=["docs"]).collect()}
    assert got == {"src/a.py": None, "src/b.min.js": "ignored extension", "src/c.unknown": "unknown extension", "src/d.py": "empty file", "src/e.py": "too large", "src/f.py": "binary", "src/g.py": "decode error", "src/yarn.lock": "ignored filename", "docs/j.md": "user excluded"}


def test_spans(spark):
    files = spark.createDataFrame([("a/x.py", "one\ntwo\nthree\n")], "path string, content string")
    spans = [(1, None, 1, 2, "", 0), (2, "a/", 1, 1, "", 0), (3, "b/", 1, 1, "", 0), (4, "a/y.py", 1, 1, "", 0), (5, "a/x.py", None, None, "", 0), (6, "a/x.py", 0, 2, "", 0), (7, "a/x.py", 2, 4, "", 0), (8, "a/x.py", 1, 2, "head\ntwo", 1)]
    got = {r["span_id"]: r for r in V.verify_spans(spark.createDataFrame(spans, "span_id long, path string, start_line int, end_line int, content string, header_lines int"), files).collect()}
    assert [got[k]["problem"] for k in range(1, 9)] == ["no path in metadata", None, "directory not found", "file not found", None, "start_line 0 outside file (3 lines)", "end_line 4 outside file (3 lines)", None]
    assert got[8]["content_matches"] is True and got[5]["span_valid"] is True


def test_limiter_equals_loop(spark):
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 3), float(rng.randint(0, 400))) for _ in range(300))
    log = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "event_id long, key long, at double").repartition(3)
    want, held = {}, {}
    for i, (k, t) in enumerate(rows):
        h = held.setdefault(k, deque())
        while h and t - h[0] > 60:
            h.popleft()
        want[i] = len(h) < 20
        if want[i]:
            h.append(t)
    assert {r["event_id"]: r["allowed"] for r in L.limit_batch(log).collect()} == want


def test_limiter_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 2), float(i * 2)) for i in range(120)]
    schema = "event_id long, key long, at double"
    for n in range(3):
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = L.limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), limit=5)
    q = stream.writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()}
    want = {r["event_id"]: r["allowed"] for r in L.limit_batch(spark.createDataFrame(rows, schema), limit=5).collect()}
    assert len(got) == 120 and got == want


def test_limiter_stream_lets_old_state_go(spark, tmp_path):
    schema = "event_id long, key long, at double"
    for n, rows in enumerate([[(i, i, float(i)) for i in range(20)], [(100, 99, 5000.0)], [(101, 99, 5001.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = L.limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), limit=1, late="1 minute")
    q = stream.writeStream.outputMode("append").format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = {r["event_id"]: r["allowed"] for r in spark.table("expiring").collect()}
    assert got == {**{i: True for i in range(20)}, 100: True, 101: False} and kept == 1


def test_limiter_stream_with_a_ceiling_equals_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 0, 1, 2]), float(i // 2)) for i in range(160)]
    schema = "event_id long, key long, at double"
    limited = lambda: L.limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), limit=4, seconds=6.0, ceiling=90)
    got = {}
    for run in range(2):  # a restart from the checkpoint between the second and the third micro-batch
        for n in (2 * run, 2 * run + 1):
            lot = rows[n * 40 : n * 40 + 40]
            rng.shuffle(lot)
            spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = limited().writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["event_id"]: r["allowed"] for r in L.limit_batch(spark.createDataFrame(rows, schema), 4, 6.0, 90).collect()}
    assert len(got) == 160 and got == want and 0 < sum(want.values()) < 90


def test_metrics_stream_counts_by_window(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "/a", 200, 10.0), ("2024-01-01 00:50:00", "/a", 500, 20.0), ("2024-01-01 00:20:00", "/b", 200, 5.0), ("2024-01-01 01:05:00", "/a", 200, 7.0)]
    log = spark.createDataFrame(rows, "t string, path string, status int, ms double").select(F.to_timestamp("t").alias("ts"), "path", "status", "ms")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    log.where("path = '/z'").unionByName(spark.sql("SELECT timestamp'2024-01-01 05:00:00' AS ts, '/late' AS path, 200 AS status, 1.0D AS ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = L.metrics_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("request_windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r["start"]), r["path"], r["requests"], r["mean_ms"]) for r in spark.table("request_windows").collect()} == {("2024-01-01 00:00:00", "/a", 2, 15.0), ("2024-01-01 00:00:00", "/b", 1, 5.0), ("2024-01-01 01:00:00", "/a", 1, 7.0)}


def test_ordinals_run_over_paths_in_order(spark):
    rows = [(f"p{i % 37}/{'x' * (i % 5)}", i, i + 1, None if i % 2 else i) for i in range(300)]
    got = C.with_ids(spark.createDataFrame(rows, "path string, start_line int, end_line int, part int")).collect()
    want = {r: n for n, r in enumerate(sorted(rows, key=lambda r: r[:2]))}
    assert {(r["path"], r["start_line"], r["end_line"], r["part"]): r["ordinal"] for r in got} == want
    assert C.with_ids(spark.createDataFrame([], "path string, start_line int, end_line int, part int")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(5, 30))
def test_line_windows_cover_every_line(sizes, budget):
    text = "\n".join("x" * n for n in sizes)
    spans = C.line_windows(text, budget)
    seen = {k for a, z, _ in spans for k in range(a, z + 1)}
    assert all(k in seen for k, n in enumerate(sizes, 1) if n)
    for a, z, _ in spans:
        assert a == z or sum(C.count_tokens("x" * n) + 1 for n in sizes[a - 1 : z]) <= budget


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_character_pieces_are_bounded_and_cover(text, size):
    pieces = C.split_characters(text, size, size // 4)
    assert all(len(p) <= size for p in pieces)
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))


def test_windowed_budget(spark):
    rng = random.Random(8)
    texts = ["\n".join("y" * rng.randint(0, 90) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    units = spark.createDataFrame([(str(i), t, 1, "class A:") for i, t in enumerate(texts)], "path string, text string, start_line int, header string")
    got = C.emit_windowed(units, 40).collect()
    for i, t in enumerate(texts):
        lines = t[:-1].split("\n") if t.endswith("\n") else t.split("\n")
        parts = sorted((r for r in got if r["path"] == str(i)), key=lambda r: r["start_line"])
        assert [k for r in parts for k in range(r["start_line"], r["end_line"] + 1)] == list(range(1, len(lines) + 1))
        if len(parts) > 1:
            for r in parts:
                cost = sum(max(1, len(x) // 4) + 1 for x in lines[r["start_line"] - 1 : r["end_line"]])
                assert r["start_line"] == r["end_line"] or cost <= 38


def slow_windows(costs, budget, overlap):
    out, at = [], 0
    while at < len(costs):
        z = at + 1
        while z < len(costs) and sum(costs[at : z + 1]) <= budget:
            z += 1
        out.append((at, z))
        if z == len(costs):
            break
        at = max(z - overlap, at + 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(1, 60), st.integers(0, 4))
def test_spans_equal_a_loop(costs, budget, overlap):
    assert list(C.spans(costs, budget, overlap)) == slow_windows(costs, budget, overlap)


def test_no_chunk_over_budget_and_no_file_lost(spark):
    long = "import os\n\n\nclass Big(Base):\n    def run(self):\n        \"\"\"Runs it. All.\"\"\"\n" + "".join(f"        x{k} = some_call({k}, {k})\n" for k in range(900))
    js = "class A {\n  go() {\n" + "".join(f"    call({k});\n" for k in range(1500)) + "  }\n}\n"
    rows = [("a.py", "python", long), ("deep.py", "python", "-" * 20000 + "1"), ("b.js", "javascript", js), ("c.js", "javascript", "// only words"), ("d.rb", "ruby", "def a\n  1\nend"), ("e.md", "markdown", "word " * 30 + "\n" + "x" * 9000), ("f.txt", None, "plain"), ("g.py", "python", "")]
    docs = spark.createDataFrame(rows, "path string, language string, content string")
    got = C.in_batches(docs).collect()
    assert {r["path"] for r in got} == {p for p, _, t in rows if t}
    for r in got:
        budget = 1200 if r["language"] in ("python", "javascript", "ruby") else 400
        assert C.count_tokens(r["text"]) <= budget or "\n" not in r["text"]
    source = long.splitlines()
    parts = sorted((r for r in got if r["path"] == "a.py" and r["symbol"] == "run"), key=lambda r: r["start_line"])
    assert len(parts) > 4 and parts[0]["start_line"] == 5 and parts[-1]["end_line"] == 906 and parts[0]["header_lines"] == 1
    for a, b in zip(parts, parts[1:]):
        assert b["start_line"] == a["end_line"] + 1 and b["text"].startswith('def run(self):\n    """Runs it. All."""\n')
    for r in parts:
        assert r["text"].splitlines()[r["header_lines"] :] == source[r["start_line"] - 1 : r["end_line"]]


def test_strategies(spark):
    docs = spark.createDataFrame([("a.py", "python", "def f():\n    pass\n"), ("b.md", "markdown", "# T\n\nwords"), ("c", None, "words")], "path string, language string, content string")
    kinds = lambda s: {(r["path"], r["kind"]) for r in C.by_strategy(docs, s).collect()}
    assert kinds("text") == {("a.py", None), ("b.md", None), ("c", None)}
    assert kinds("ast") == {("a.py", "function"), ("b.md", "text"), ("c", "text")}
    assert kinds("ast-code") == {("a.py", "function"), ("b.md", None), ("c", None)}


def test_ceiling_comes_first(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 4), float(rng.randint(0, 50))) for i in range(300)]
    got = {r["event_id"]: r["allowed"] for r in L.limit_batch(spark.createDataFrame(rows, "event_id long, key long, at double"), 3, 5.0, 120).collect()}
    want, held = {}, {}
    for n, (i, k, t) in enumerate(sorted(rows, key=lambda r: (r[2], r[0]))):
        own = [x for x in held.get(k, []) if t - x <= 5.0]
        want[i] = n < 120 and len(own) < 3
        held[k] = own + [t] * want[i]
    assert got == want


def test_python_units():
    units = C.python_units("import os\n\n@d\ndef f():\n    pass\n\nclass A(B):\n    def g(self):\n        return 1\nX = 1\n")
    assert [tuple(u[:5]) for u in units] == [("module", None, None, 1, 1), ("function", "f", None, 3, 5), ("class_skeleton", "A", None, 7, 7), ("function", "g", "A", 8, 9), ("module", None, None, 10, 10)]
    assert C.python_units("def broken(:") is None
    assert [u for u in units if u[1] == "g"][0][5].startswith("class A(B):")


def test_hit_ranks_by_file_and_directory(spark):
    results = spark.createDataFrame([(1, 1, "a/"), (1, 2, "a/b/x.py"), (1, 3, "ab/"), (2, 1, "c.py")], "question_id long, rank int, path string")
    golden = spark.createDataFrame([(1, ["a/b/x.py"]), (2, [])], "question_id long, expected_files array<string>")
    assert sorted(r["rank"] for r in E.hit_ranks(results, golden).collect()) == [1, 2]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_noise_floor_equals_a_numpy_bootstrap(spark):
    rng = random.Random(9)
    kinds = ["x", "x", "x", "y"]
    runs = [[(q, kinds[q % 4], *(rng.random() < p for _ in range(3)), rng.random() * p) for q in range(60)] for p in (0.4, 0.8)]
    schema = "question_id long, type string, hit_at_1 boolean, hit_at_5 boolean, hit_at_10 boolean, reciprocal_rank double"
    got = {(r["segment"], r["metric"]): r for r in E.noise_floor(*(spark.createDataFrame(r, schema) for r in runs), rounds=200).collect()}
    assert len(got) == 12
    u = np.array([[int(hashlib.md5(f"{q}:{r}".encode()).hexdigest()[:8], 16) / 2**32 for q in range(60)] for r in range(1, 201)])
    w = sum((u >= x).astype(int) for x in E.POISSON)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    for segment in ("overall", "x", "y"):
        own = np.array([segment in ("overall", kinds[q % 4]) for q in range(60)])
        for k, metric in enumerate(E.METRICS):
            diff = np.array([float(b[2 + k]) - float(a[2 + k]) for a, b in zip(*runs)])
            draws = np.sort((w[:, own] * diff[own]).sum(axis=1) / w[:, own].sum(axis=1))
            r = got[segment, metric]
            assert r["questions"] == own.sum() and math.isclose(r["delta"], diff[own].mean(), abs_tol=1e-9)
            assert math.isclose(r["low"], draws[5], abs_tol=1e-8) and math.isclose(r["high"], draws[194], abs_tol=1e-8) and r["real"] == (r["low"] > 0 or r["high"] < 0)
    same = E.noise_floor(*[spark.createDataFrame(runs[0], schema)] * 2, rounds=20).collect()
    assert all(r["delta"] == r["low"] == r["high"] == 0 and not r["real"] for r in same)


def test_chunks_are_handed_on_before_a_batch_is_done():
    import pyarrow as pa

    from siltstone.operators.chunk import handed_on

    taken = []

    def rows():
        for k in range(50):
            taken.append(k)
            yield k, "x" * 100_000

    fields = [pa.field("k", pa.int32()), pa.field("text", pa.string())]
    made = handed_on(rows(), fields)
    first = next(made)
    assert len(taken) == len(first) <= 11
    assert sum((b.column(0).to_pylist() for b in made), first.column(0).to_pylist()) == list(range(50))
    assert [len(b) for b in handed_on(iter([]), fields)] == [0]
