"""Exact dedup: a minimal perfect hash over historical distinct digests.

The rows are dealt into history and arrivals. Distinct history digests are dealt by hash into shards of about
rows_per_shard, and at least as many shards as the session shuffles to; each shard gets a minimal perfect hash whose slots hold the full 32-byte digest and the locator
(doc_id, row tag) of the winner. Each distinct arriving digest is looked up and compared byte by byte: members are
repeats of history, nonmembers form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_cache


class PerfectHash:
    """Levels of bit arrays: a key that is alone at its position of a level stays there, the others go on to the next.

    A key's slot is the number of set bits before its own, over all levels: n keys fill slots 0..n-1.
    """

    GAMMA = 1.6

    def __init__(self, words: np.ndarray):
        """words: distinct keys, an (n, 4) uint64 view of their digests."""
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        left, used = words, 0
        while len(left):
            size = max(8, int(len(left) * self.GAMMA) | 1)
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            self.before.append(used + np.cumsum(alone) - 1)
            used += int(alone.sum())
            left = left[~alone[at]]
        self.n = used

    @staticmethod
    def _at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = words[:, 1] + np.uint64(level + 1) * (words[:, 2] | np.uint64(1)) + np.uint64(level * level) * words[:, 3]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x9E3779B97F4A7C15)
            return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or the slot of another key, for a key that isn't in the set."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = self._at(words[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _long(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, and where there are any."""
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False).astype(bool)


def _resolve(history: pa.Table, arrivals: pa.Table) -> pa.Table:
    """Look the shard's arrivals up in its history; one row per distinct digest of either."""
    drop_cache()
    if not history.num_columns:  # a side without rows comes without columns
        history = arrivals.schema.empty_table()
    if not arrivals.num_columns:
        arrivals = history.schema.empty_table()
    index = PerfectHash(old := _words(history["digest"]))
    place = index.slots(old)
    new = _words(arrivals["digest"])
    stored = np.zeros((index.n, 4), np.uint64)
    stored[place] = old
    (h_id, h_ok), (h_tag, _), (h_size, _) = (_long(history[c]) for c in ("top_id", "top_tag", "size"))
    (a_id, a_ok), (a_tag, _), (a_size, _) = (_long(arrivals[c]) for c in ("top_id", "top_tag", "size"))
    row_of = np.empty(index.n, np.int64)
    row_of[place] = np.arange(index.n)
    slot = index.slots(new)
    member = slot >= 0
    member[member] = (stored[slot[member]] == new[member]).all(axis=1)  # the full digest, byte by byte
    old_row, new_row = row_of[slot[member]], np.flatnonzero(member)
    wins = a_ok[new_row] & (~h_ok[old_row] | (a_id[new_row] >= h_id[old_row]))
    o, n = old_row[wins], new_row[wins]
    h_id[o], h_tag[o], h_ok[o] = a_id[n], a_tag[n], True
    h_size[old_row] += a_size[new_row]
    alone = np.flatnonzero(~member)
    digests = pa.concat_arrays([x.cast(pa.binary()) for x in (*history["digest"].chunks, *arrivals["digest"].take(pa.array(alone)).chunks)]) if history.num_rows + len(alone) else pa.array([], pa.binary())
    ok = np.concatenate([h_ok, a_ok[alone]])
    return pa.table({
        "digest": digests,
        "keep_id": pa.array(np.concatenate([h_id, a_id[alone]]), pa.int64(), mask=~ok),
        "keep_tag": pa.array(np.concatenate([h_tag, a_tag[alone]]), pa.int64()),
        "group_size": pa.array(np.concatenate([h_size, a_size[alone]]), pa.int64()),
    })


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_until: int | None = None, rows_per_shard: int = 8192, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the carried columns.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest id stays; a null id is below all others; of rows alike in id too exactly one stays. Rows with an id up to
    history_until are history, the rest arrivals (default: the middle of the ids); where the line is changes no result.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("digest"), F.monotonically_increasing_id().alias("tag"), *[F.col(c).alias(f"carry_{c}") for c in carry]), "digests")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    line = history_until if history_until is not None else ((low or 0) + (high or 0)) // 2
    shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // (2 * rows_per_shard)))
    seen = F.coalesce(F.col("doc_id") <= line, F.lit(False))

    def distinct(part: DataFrame) -> DataFrame:
        # aliases give each side columns of its own; a cogroup of two sides of one table confuses them otherwise
        part = part.select(F.col("digest").alias("digest"), F.col("doc_id").alias("doc_id"), F.col("tag").alias("tag"))
        groups = part.groupBy("digest").agg(F.max("doc_id").alias("top_id"), F.coalesce(F.max_by("tag", "doc_id"), F.max("tag")).alias("top_tag"), F.count("*").alias("size"))
        return groups.withColumn("shard", F.pmod(F.hash("digest"), F.lit(shards)))

    history, arrivals = distinct(rows.where(seen)), distinct(rows.where(~seen))
    groups = history.groupBy("shard").cogroup(arrivals.groupBy("shard")).applyInArrow(_resolve, "digest binary, keep_id long, keep_tag long, group_size long")
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *[F.col(f"carry_{c}").alias(c) for c in carry])
