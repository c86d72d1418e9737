"""Index jobs as a stream: states, replays, failures, progress."""

import time

from siltstone.streaming import jobs as J

REPOS = [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d")]


def states(spark, table):
    return {r["repo_id"]: (r["status"], r["stage"], r["error"], r["chunks"]) for r in table.current(spark).collect()}


def test_batches_replays_and_failures(spark, tmp_path):
    table, asked, replay = J.StateTable(str(tmp_path / "state")), [], []
    repos = spark.createDataFrame(REPOS, "repo_id long, collection string")
    assert states(spark, table) == {}

    def index(collection, stage):
        asked.append(collection)
        stage("chunking")
        if collection == "a" and not replay:
            assert states(spark, table)[1] == states(spark, table)[2] == (J.INDEXING, "chunking", None, None)  # pollers see stages
        if collection == "b":
            raise J.JobError("No indexable files")
        if collection == "c":
            raise KeyError("x")
        return {"files_indexed": 3, "chunks": 10}

    rows = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), (None,)], "collection string")
    J.run_batch(rows, 0, repos, table, index)
    want = {1: (J.READY, None, None, 10), 2: (J.READY, None, None, 10), 3: (J.FAILED, None, "No indexable files", None), 4: (J.FAILED, None, "KeyError: 'x'", None)}
    assert states(spark, table) == want and asked == ["a", "b", "c"]
    replay.append(True)
    J.run_batch(rows, 0, repos, table, index)  # the batch is run again
    assert states(spark, table) == want and table.current(spark).count() == 4
    J.run_batch(spark.createDataFrame([("b",), ("d",)], "collection string"), 1, repos, table, lambda c, stage: {"files_indexed": 1, "chunks": 7})
    assert states(spark, table) == want | {3: (J.READY, None, None, 7), 5: (J.READY, None, None, 7)}
    J.run_batch(rows.limit(0), 2, repos, table, index)
    assert states(spark, table)[1] == want[1]


def test_stream_with_progress(spark, tmp_path):
    table, progress = J.StateTable(str(tmp_path / "state")), J.Progress()
    repos = spark.createDataFrame(REPOS, "repo_id long, collection string")
    for lot in (["a", "b", "a"], ["d"]):
        spark.createDataFrame([(c,) for c in lot], "collection string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema("collection string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = J.start_jobs(stream, lambda: repos, table, lambda c, stage: {"files_indexed": 1, "chunks": 5}, str(tmp_path / "ck"), {"availableNow": True})
        q.awaitTermination(120)
        for _ in range(100):
            if progress.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert {k: v[0] for k, v in states(spark, table).items()} == {1: J.READY, 2: J.READY, 3: J.READY, 5: J.READY}
    assert (progress.batches, progress.requests, sorted(progress.collections.values()), progress.error) == (2, 4, [1, 2], None)
