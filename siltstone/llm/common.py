"""Shared pieces of the training-data operators: the shared work folder, cut lineage, column checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_held: dict = {}


def worker_cache(key: tuple, make):
    """What a Python worker keeps from task to task: one value at a time, so operators don't add up in its memory."""
    if key not in _held:
        drop_cache()
        _held[key] = make()
    return _held[key]


def drop_cache() -> None:
    """For tasks that keep nothing: let go of what an operator before them kept in this worker."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


BATCH_ROWS = 1000


def whole_texts(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_ROWS rows: documents are long, and a task holds whole batches.

    Spark reads this setting when a query runs, so it stays for the session's later queries; their results don't change.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one on a local master
    and an error on a cluster, whose executors couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("siltstone.local.dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="siltstone-")
            spark.conf.set("siltstone.local.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that later stages, retries included, start from stored rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that cut() makes inside are deleted at the end, but for those taken out of the list that this gives."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        for df in _scratch.pop():
            forget(df)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    try:
        files = df.inputFiles()
    except AnalysisException:  # deleted already
        return
    for path in {re.sub(r"/part-[^/]*$", "", f) for f in files}:
        if path.startswith(("file:", "hdfs:", "s3", "/")) or "://" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(name: str, taken) -> str:
    """name, with underscores until no column of `taken` is called so, in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def placed(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """docs with the file and row where each row is stored, and the names of these two columns, which are like no other's;
    a table that isn't read from files is stored first."""
    names = free_name("stored_file", docs.columns), free_name("stored_row", docs.columns)
    place = [F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    try:
        return docs.select("*", *place), names
    except AnalysisException:
        return cut(docs, "documents").select("*", *place), names


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
