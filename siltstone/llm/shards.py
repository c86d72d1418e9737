"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a ring of 64-bit positions; a document's position is the hash of its text, so equal
texts are neighbours, and it belongs to the next point clockwise. A shard's bound is exact (row counts differ by one at
most). The documents of an arc, in ring order, fill its own shard first; what is over the bound continues clockwise to
the next point whose shard has room. Only arc totals (shards x vnodes numbers) reach the driver; positions within arcs
come from one range shuffle of narrow rows and a prefix sum over its partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes as signed longs, and the shard of each."""
    at = np.array([xxhash.xxh64_intdigest(f"shard {s} point {v}") for s in range(shards) for v in range(vnodes)], np.uint64).view(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(np.arange(shards), vnodes)[order]


def bounded_fill(sizes: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, first rank in the arc, shard, first slot there), by arc and rank; sizes: documents of each arc."""
    total = int(sizes.sum())
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    slot = np.zeros(shards, np.int64)
    pieces, over = [], []
    for arc, (n, s) in enumerate(zip(sizes.tolist(), owner.tolist())):
        take = min(n, int(room[s]))
        if take:
            pieces.append((arc, 0, s, int(slot[s])))
            room[s] -= take
            slot[s] += take
        if n > take:
            over.append((arc, take, n - take))
    for arc, rank, left in over:
        step = arc
        while left:
            step = (step + 1) % len(owner)
            s = int(owner[step])
            take = min(left, int(room[s]))
            if take:
                pieces.append((arc, rank, s, int(slot[s])))
                room[s] -= take
                slot[s] += take
                rank, left = rank + take, left - take
    return sorted(pieces)


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law).

    size is the text's UTF-8 bytes plus one; a null text counts as empty (size 1, CRC 0). Counts of shards differ by
    one at most; slots of a shard run from 0 without gaps. Null ids and repeated rows are placed like any others; rows
    that are alike may change places. An empty table gives an empty result; other columns are ignored.
    """
    at, owner = ring(shards, vnodes)
    n_arcs = len(at)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, position.to_numpy(np.int64)) % n_arcs).astype(np.int32))

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("position")), "ring")
    dealt = narrow.withColumn("arc", arc_of("position"))
    # the last arc of the ring goes on past its end: its documents beyond the last point come first
    dealt = dealt.withColumn("turn", F.when((F.col("arc") == 0) & (F.col("position") > int(at[-1])), F.lit(-1)).otherwise(F.col("arc")))

    def number(batches):
        seen: dict[int, int] = {}
        for b in batches:
            arcs = b["arc"]
            rank = arcs.groupby(arcs).cumcount() + arcs.map(seen).fillna(0)
            for a, n in arcs.value_counts().items():
                seen[a] = seen.get(a, 0) + int(n)
            yield b.assign(rank=rank.astype("int64"))

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = dealt.repartitionByRange(parts, "turn", "position", "doc_id", "text_crc32").sortWithinPartitions("turn", "position", "doc_id", "text_crc32")
    schema = "doc_id long, size long, text_crc32 long, position long, arc int, turn int, part int, rank long"
    ranked = cut(ranged.withColumn("part", F.spark_partition_id()).mapInPandas(number, schema), "ranks")

    # bounded: at most one row for each arc and one more for each partition, as partitions are stretches of the ring
    counts = sorted(ranked.groupBy("part", "arc").count().collect(), key=lambda r: r["part"])
    sizes, base = np.zeros(n_arcs, np.int64), {}
    for part, arc, n in counts:
        base[part, arc] = int(sizes[arc])
        sizes[arc] += n
    pieces = np.array(bounded_fill(sizes, owner, shards), np.int64).reshape(-1, 4)
    starts = {int(a): np.flatnonzero(pieces[:, 0] == a) for a in np.unique(pieces[:, 0])}

    @F.pandas_udf("shard int, slot long")
    def place(part: pd.Series, arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(arc), 2), np.int64)
        for (p, a), rows in pd.DataFrame({"p": part, "a": arc}).groupby(["p", "a"]).indices.items():
            own = starts[a]
            r = rank.to_numpy()[rows] + base[p, a]
            k = own[np.searchsorted(pieces[own, 1], r, side="right") - 1]
            out[rows, 0], out[rows, 1] = pieces[k, 2], pieces[k, 3] + r - pieces[k, 1]
        return pd.DataFrame({"shard": out[:, 0].astype(np.int32), "slot": out[:, 1]})

    placed = ranked.withColumn("to", place("part", "arc", "rank"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "to.shard", "to.slot", F.lit(None).cast("int").alias("grown_shard"))
