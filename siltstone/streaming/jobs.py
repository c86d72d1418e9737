"""Index jobs as a stream: requests come in, a state table holds what became of them, a listener tells how far they are.

A micro-batch's rows go to a folder of its own number, written anew if the batch is run again, so a replay changes nothing.
The newest row of a repository is its state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

QUEUED, INDEXING, READY, FAILED = "queued", "indexing", "ready", "failed"
STATE = "repo_id long, collection string, status string, stage string, error string, files_indexed long, chunks long"
OBSERVED = "index_jobs"


class JobError(Exception):
    """A failure whose message is for the user, without the kind of exception."""


@dataclass
class StateTable:
    """Rows of STATE under path, in folders batch=<number>; within a batch `step` orders them."""

    path: str

    def write(self, rows: DataFrame, batch: int, step: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}/step={step}")

    def current(self, spark: SparkSession) -> DataFrame:
        """The newest row of each repository, with its batch; a maximum by key, so no window sorts a hot one."""
        try:
            rows = spark.read.schema(f"{STATE}, batch long, step int").parquet(self.path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], f"{STATE}, batch long, step int")
        columns = [f.split()[0] for f in STATE.split(", ")][1:]
        return rows.groupBy("repo_id").agg(F.max_by(F.struct(*columns, "batch"), F.struct("batch", "step")).alias("row")).select("repo_id", "row.*")


def run_batch(requests: DataFrame, batch: int, repos: DataFrame, table: StateTable, index: Callable[[str, Callable[[str], None]], dict[str, int]]) -> None:
    """Runs the jobs of a micro-batch and writes what became of them.

    requests (collection): each collection is indexed once, however many ask for it. index (collection, report of a
    stage) gives files_indexed and chunks; what it raises makes the collection's state `failed`. A result goes to all
    repositories (repos: repo_id, collection) of the collection, not only to those that asked. A batch is a few jobs, each of which Spark runs itself.
    """
    spark = requests.sparkSession
    asked = sorted(r[0] for r in requests.where("collection IS NOT NULL").select("collection").distinct().collect())
    owners = repos.select("repo_id", "collection")

    def put(step: int, rows: list[tuple]) -> None:
        news = spark.createDataFrame(rows, STATE.removeprefix("repo_id long, "))
        table.write(owners.join(F.broadcast(news), "collection").select(*[f.split()[0] for f in STATE.split(", ")]), batch, step)

    results: dict[str, tuple] = {}
    for n, collection in enumerate(asked):
        now = lambda stage, own=collection, step=n: put(step, [*results.values(), (own, INDEXING, stage, None, None, None)])
        try:
            now("starting")
            stats = index(collection, now)
            results[collection] = (collection, READY, None, None, stats["files_indexed"], stats["chunks"])
        except JobError as e:
            results[collection] = (collection, FAILED, None, str(e), None, None)
        except Exception as e:  # a job that dies silently would look like one that still runs
            results[collection] = (collection, FAILED, None, f"{type(e).__name__}: {e}", None, None)
    put(len(asked), list(results.values()))


def start_jobs(requests: DataFrame, repos: Callable[[], DataFrame], table: StateTable, index: Callable[[str, Callable[[str], None]], dict[str, int]], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs the requests (a stream with `collection`) batch by batch. repos gives the repositories as they are when a batch starts.
    Counts of requests and collections are observed for Progress."""
    seen = requests.observe(OBSERVED, F.count("*").alias("requests"), F.approx_count_distinct("collection").alias("collections"))
    out = seen.writeStream.foreachBatch(lambda rows, batch: run_batch(rows, batch, repos(), table, index)).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


@dataclass
class Progress(StreamingQueryListener):
    """What a polling client is shown: batches done, requests and collections seen, the error that ended the stream."""

    batches: int = 0
    requests: int = 0
    collections: dict[int, int] = field(default_factory=dict)
    error: str | None = None
    ended: bool = False

    def onQueryStarted(self, event) -> None:
        self.ended, self.error = False, None

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(OBSERVED)
        if row is not None and row["requests"]:
            self.batches += 1
            self.requests += row["requests"]
            self.collections[event.progress.batchId] = row["collections"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended, self.error = True, event.exception
