"""The two indexes as tables: postings with corpus statistics, and vectors with their squared norms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import values as V

from .lexicon import Lexicon

DIMENSIONS = 64
#: The most that the small side of a join may hold to be sent to every executor, in bytes.
LIGHT = 32_000_000


def light(rows: DataFrame, width: Column) -> DataFrame:
    """rows, to be broadcast if they hold at most LIGHT bytes by `width`, a column with the bytes of a row; else joined by a shuffle."""
    return F.broadcast(rows) if (rows.agg(F.sum(width)).first()[0] or 0) <= LIGHT else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores where their scan makes fewer partitions than there are cores; untouched otherwise, and
    where they have been dealt out before, so that a large table is never shuffled. No files are listed here."""
    cores, run = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():
        return rows
    return rows.repartition(cores) if 0 < run.toRdd().getNumPartitions() < cores else rows


def tokenized(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, path, symbol, content, language, ...) with the tokens of each field and their number."""
    out = chunks
    for field in V.FIELD_WEIGHTS:
        out = out.withColumn(f"{field}_tokens", X.tokens(F.coalesce(F.col(field), F.lit(""))))
    return out.withColumn("length", F.expr(" + ".join(f"size({f}_tokens)" for f in V.FIELD_WEIGHTS)).cast("long"))


def bucket(token: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.sha1(token), 1, 7), 16, 10).cast("long"), F.lit(DIMENSIONS)).cast("int")


def hashed_vector(tokens: Column) -> Column:
    """Offline stand-in for an embedding: token counts in hashed dimensions."""
    buckets = F.transform(tokens, bucket)
    return F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda b: F.size(F.filter(buckets, lambda x: x == b)).cast("double"))


def _count_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        coded = lists.flatten().dictionary_encode()
        own = np.array([int(sha1(t.encode()).hexdigest()[:7], 16) % DIMENSIONS for t in coded.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        cells = np.bincount(row * DIMENSIONS + own[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(batch) * DIMENSIONS).astype(np.float64)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * DIMENSIONS, pa.int32()), pa.array(cells))
        yield pa.RecordBatch.from_arrays([batch.column(0), vectors, *batch.columns[2:]], [batch.schema.names[0], "vector", *batch.schema.names[2:]])


def token_vectors(rows: DataFrame, key: str, tokens: str, *carry: str) -> DataFrame:
    """hashed_vector of each row's tokens: key, vector, carried columns. Each distinct token of a batch is hashed once."""
    rows = rows.select(key, tokens, *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != tokens else "vector array<double>" for f in rows.schema)
    return rows.mapInArrow(_count_hashed, schema)


def hashed_vectors(items: DataFrame, key: str, text: str) -> DataFrame:
    """items -> key, vector: token counts of each text in hashed dimensions; zeros for a text without tokens or a null."""
    return token_vectors(spread(items.select(key, text)).select(key, X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")), key, "tokens")


@dataclass
class SearchIndex:
    """Both stored indexes of a collection under one path: the lexical one, and vectors (chunk_id, stratum, vector), which are made
    at their first use, since lexical searches need none."""

    lexicon: Lexicon
    path: str

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> SearchIndex:
        """chunks (chunk_id, stratum, path, symbol, content) -> the indexes under `path`; texts are cut into tokens once."""
        spark = chunks.sparkSession
        own = tokenized(spread(chunks.select("chunk_id", "stratum", *V.FIELD_WEIGHTS))).drop(*V.FIELD_WEIGHTS)
        own.write.mode("overwrite").parquet(f"{path}/tokens")
        return cls(Lexicon.build(spark.read.schema(own.schema).parquet(f"{path}/tokens"), f"{path}/lexicon"), path)

    @cached_property
    def vectors(self) -> DataFrame:
        spark = self.lexicon.spark
        own = spark.read.schema("chunk_id long, stratum string, content_tokens array<string>").parquet(f"{self.path}/tokens")
        token_vectors(own, "chunk_id", "content_tokens", "stratum").write.mode("overwrite").parquet(f"{self.path}/vectors")
        return spark.read.schema("chunk_id long, vector array<double>, stratum string").parquet(f"{self.path}/vectors")
