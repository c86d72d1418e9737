"""Registry tables as latest-wins data: sessions, repositories, collections, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_users(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Users of sessions that haven't expired. sessions (token, user_id, expires_at)."""
    return sessions.where(F.col("expires_at") > now).join(users, "user_id")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: a maximum by order, so no window sorts a hot key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def collections_in_use(repos: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(repos.select("collection").distinct(), "collection", "left_semi")


def orphan_collections(repos: DataFrame, deleted: DataFrame) -> DataFrame:
    """Collections of deleted rows that no other row uses."""
    rest = repos.join(deleted.select("repo_id"), "repo_id", "left_anti").select("collection").distinct()
    return repos.join(deleted.select("repo_id"), "repo_id", "left_semi").select("collection").distinct().join(rest, "collection", "left_anti")


def upsert(repos: DataFrame, news: DataFrame, key: list[str]) -> DataFrame:
    """Rows of news replace those of the same key; the others stay."""
    return repos.join(news.select(*key), key, "left_anti").unionByName(news)


def propagate(repos: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of a collection go to every owner's row; rows without any keep their own."""
    joined = repos.join(stats.select("collection", F.col("chunks").alias("new_chunks")), "collection", "left")
    return joined.withColumn("chunks", F.coalesce("new_chunks", "chunks")).drop("new_chunks")


def attach_decision(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """requests (user_id, collection) -> mine (a row in any state), attach (ready elsewhere) or create."""
    mine = repos.groupBy("user_id", "collection").agg(F.min("repo_id").alias("own"))
    ready = repos.where("status = 'ready'").groupBy("collection").agg(F.min("repo_id").alias("other"))
    joined = requests.join(mine, ["user_id", "collection"], "left").join(ready, "collection", "left")
    return joined.select("user_id", "collection", F.when(F.col("own").isNotNull(), "mine").when(F.col("other").isNotNull(), "attach").otherwise("create").alias("decision"), F.coalesce("own", "other").alias("repo_id"))


def import_manifests(repos: DataFrame, manifests: DataFrame) -> DataFrame:
    return manifests.join(repos.select("collection").distinct(), "collection", "left_anti")


def resolve_root(repos: DataFrame, manifests: DataFrame) -> DataFrame:
    """A repository's root: the recorded path, else the first manifest's, else the conventional place."""
    first = manifests.where("repo_path IS NOT NULL").groupBy("repo").agg(F.min_by("repo_path", "collection").alias("found"))
    joined = repos.join(first, repos["name"] == first["repo"], "left")
    return joined.select("repo_id", F.coalesce("repo_path", "found", F.concat(F.lit("data/repos/"), "name")).alias("root"))


def config_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose values differ between two configurations (key, value), missing ones included."""
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "key", "full")
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))


def request_metrics(log: DataFrame) -> DataFrame:
    """log (path, status, ms) -> metric, key, value: totals, counts by status and path, the mean duration."""
    by = lambda name, c: log.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "key", "value")
    whole = log.agg(F.count("*").cast("double").alias("n"), F.round(F.sum("ms") / F.greatest(F.count("*"), F.lit(1)), 6).alias("mean"))
    totals = whole.select(F.explode(F.array(F.struct(F.lit("requests_total").alias("metric"), F.lit("").alias("key"), F.col("n").alias("value")), F.struct(F.lit("mean_request_ms").alias("metric"), F.lit("").alias("key"), F.coalesce("mean", F.lit(0.0)).alias("value")))).alias("r")).select("r.*")
    return totals.union(by("requests_by_status", "status")).union(by("requests_by_path", "path"))


def window_counts(log: DataFrame, seconds: int) -> DataFrame:
    """Requests of the key in the last `seconds`, the row's own included. log (event_id, key, at: epoch seconds)."""
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-seconds, 0)
    return log.withColumn("recent", F.count("*").over(w))
