"""Token counts by a separator scan over flat token files.

A flat file is one stream of fixed-width ids without an index; only an end-of-document id tells documents apart. It is
read as blocks of bytes. A task searches a block for the id with one vectorised comparison; a prefix scan over the few
numbers of each block (tokens, ends, last end) then stitches documents that run across blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, whole_texts
from .tokens import END_OF_TEXT, tokenizer, vocabulary_path
from .words import text_slices


def flat_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_OF_TEXT, block_tokens: int = 524_288) -> DataFrame:
    """Flat token streams of docs, one per input partition, as rows (file, block, payload, names).

    payload is the stream's next block_tokens little-endian two-byte ids, wherever documents end; names are the ids of
    documents that came since the block before, in stream order, and say nothing about their places. Strings of special
    tokens are ordinary text here, so no text yields end_id.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, file = tokenizer(path, special=False), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list = []
        size = block = 0
        end = np.array([end_id], "<u2")

        def out(raw: bytes) -> pa.RecordBatch:
            nonlocal block, names
            row = pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([raw], pa.binary()), pa.array([names], pa.list_(pa.int64()))], ["file", "block", "payload", "names"])
            block, names = block + 1, []
            return row

        for b in batches:
            ids = b.column(0).to_pylist()
            for a, z, texts in text_slices(b.column(1)):
                for name, found in zip(ids[a:z], words.encode(texts)):
                    held += [found, end]
                    names.append(name)
                    size += len(found) + 1
                if size >= block_tokens:
                    stream = np.concatenate(held)
                    full = size - size % block_tokens
                    for k in range(0, full, block_tokens):
                        yield out(stream[k : k + block_tokens].tobytes())
                    held, size = [stream[full:]], size - full
        if size or names:
            yield out(np.concatenate(held).tobytes())

    return whole_texts(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "file long, block long, payload binary, names array<long>")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, start, length) -> the bytes."""
    from pyarrow import fs

    for b in batches:
        for file, block, start, length in zip(*(c.to_pylist() for c in b.columns)):
            store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
            with store.open_input_file(path) as f:
                payload = f.read_at(length, start)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])


def read_flat(spark: SparkSession, path: str, block_bytes: int = 1 << 20, width: int = 2, whole_bytes: int = 1 << 28) -> DataFrame:
    """Raw flat files of any size as rows (file, block, payload).

    Files up to whole_bytes go through Spark's binary file source, which takes a file as one value (2 GB at most); larger
    ones are read by byte ranges, one block each, so no task holds more than a block; pyarrow must know their store.
    """
    step = block_bytes - block_bytes % width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / step) - 1, F.lit(0)))).alias("block")
    small = files.where(F.col("length") <= whole_bytes).select(F.col("path").alias("file"), "content", block)
    small = small.select("file", "block", F.expr(f"substring(content, int(block * {step} + 1), {step})").alias("payload"))
    large = files.where(F.col("length") > whole_bytes).select(F.col("path").alias("file"), "length", block)
    large = large.select("file", "block", (F.col("block") * step).alias("start"), F.least(F.lit(step), F.col("length") - F.col("block") * step).alias("size"))
    return small.union(large.repartition("file", "block").mapInArrow(_ranges, "file string, block long, payload binary"))


def count_tokens(blocks: DataFrame, end_id: int = END_OF_TEXT, width: int = 2) -> DataFrame:
    """blocks (file, block, payload) -> one row per document: file, ordinal, start, n_tokens, closed.

    n_tokens leaves the end id out. Tokens after a file's last end are a document that isn't closed. Empty documents
    (two ends in a row) count; a null or empty payload holds nothing; a payload must hold whole ids. The places of the
    ends are stored by block; the prefix scan sees three numbers of each block, and its sums are joined back to the places.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends = [], []
            for raw in b.column(2).to_pylist():
                ids = np.frombuffer(raw or b"", kind)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ("file", "block"))
    found = cut(blocks.select("file", "block", "payload").mapInArrow(scan, f"{kinds}, n long, ends array<long>"), "ends")
    narrow = found.select("file", "block", "n", F.size("ends").alias("size"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = narrow.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    reach = F.col("base") + F.col("last") + 1
    stitched = base.withColumn("open", F.coalesce(F.max(reach).over(before), F.lit(0))).withColumn("next", F.lead("block").over(Window.partitionBy("file").orderBy("block")))
    stitched = cut(stitched, "stitched")
    placed = found.select("file", "block", "ends").join(stitched.select("file", "block", "base", "first", "open"), ["file", "block"])
    span = F.transform("ends", lambda e, i: F.struct(F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.element_at("ends", F.greatest(i, F.lit(1))) + 1).alias("start"), (F.col("base") + e).alias("end")))
    ended = placed.select("file", "first", F.posexplode(span).alias("k", "span"))
    closed = ended.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "span.start", (F.col("span.end") - F.col("span.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    begin = F.coalesce(reach, F.col("open"))
    tail = stitched.where(F.col("next").isNull()).select("file", (F.col("first") + F.col("size")).alias("ordinal"), begin.alias("start"), (F.col("base") + F.col("n") - begin).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.union(tail)


def name_counts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Document ids for counts of flat_blocks(): the k-th name of a file belongs to its k-th document. The names
    themselves stay out of the prefix scan."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("file", "block", F.size("names").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    named = blocks.select("file", "block", "names").join(first, ["file", "block"]).select("file", "first", F.posexplode("names").alias("k", "doc_id"))
    return named.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
