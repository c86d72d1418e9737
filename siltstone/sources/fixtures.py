"""The driver's tables in the shape that the operators take: documents stand for source files, benchmark items for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.index import SearchIndex, light, spread

from .store import fingerprint, fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, package, language, content, size_bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("source").alias("package"), F.col("lang").alias("language"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document: chunk_id, path, package, symbol, content, language, stratum."""
    symbol = F.array_join(F.slice(X.tokens(F.substring_index("content", "\n", 1)), 1, 3), " ")
    return files(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "path", "package", symbol.alias("symbol"), "content", "language", F.when(F.col("language") == "en", "prose").otherwise("code").alias("stratum"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question: a benchmark item, its words with one space between them."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array_join(X.words(F.col("text")), " ").alias("question"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, doc_id, language: documents that hold a benchmark item whole.

    Documents meet items on the item's first six words, so only those few pairs are searched for the whole text.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("passage"))
    items = items.withColumn("anchor", F.xxhash64(F.slice(X.words(F.col("passage")), 1, 6)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # explode() of the one array keeps its words from being split again at every place
    split = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(F.array(X.words(F.col("text")))).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - 5, F.lit(1)))
    places = split.select("doc_id", F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, 6)))).alias("anchor"))
    near = places.join(light(items.select("question_id", "anchor"), F.lit(16)), "anchor").distinct().join(items.drop("anchor"), "question_id").join(docs, "doc_id").where(F.col("text").contains(F.col("passage")))
    return near.select("question_id", "doc_id", F.col("lang").alias("language")).distinct()


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, type (language of the first expected file, else unanswerable), expected_files, in order."""
    hits = expected(spark, sf_dir).join(files(spark, sf_dir).select("doc_id", "path"), "doc_id")
    own = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "path", "language"))).alias("hits"))
    joined = questions(spark, sf_dir).join(own, "question_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("question_id", "question", F.when(F.col("hits").isNull(), "unanswerable").otherwise(F.element_at("hits", 1)["language"]).alias("type"), F.coalesce(F.transform("hits", lambda h: h["path"]), none).alias("expected_files"))


_indexes: dict[tuple[str, str], tuple[tuple, SearchIndex]] = {}


def search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The stored indexes over chunks(); built at a session's first search, and again once the table's files have changed."""
    key, now = (spark.sparkContext.applicationId, sf_dir), fingerprint(spark, f"{sf_dir}/documents.parquet")
    if key not in _indexes or _indexes[key][0] != now:
        _indexes[key] = now, SearchIndex.build(chunks(spark, sf_dir), fresh_path(spark, "search-index"))
    return _indexes[key][1]
