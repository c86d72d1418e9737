"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join.

The join walks one trie for each route, a rearrangement of the bits that brings some of them to the front: only node pairs
on one path through those are opened. Below, pairs of nodes are walked together a level at a time; differing bits add up
and a pair is dropped as soon as they exceed the budget. Trie nodes of few fingerprints are compared leaf by leaf. A task
walks the tries of many front values at once over sorted arrays. Fronts widen with the number of fingerprints, so that
few share one by chance and rows grow little faster than the input; a front value with more than `crowd` fingerprints is
dealt as pairs of chunks to several tasks.

near_dedup links fingerprints by their distance alone; routes are all choices of blocks that agree when at most `bits` bits
differ, so no link is lost, and what a task finds is merged at once. similar_groups decides by the similarity of shingle
sets: tables of fingerprints give candidates, of which each task returns a spanning forest of the closest pairs, a number
that grows with its rows and not with the square of a group; the similarity of each pair is then computed from the sets
themselves. That connects nearly all groups, large ones too, at little cost, but closeness of fingerprints is an estimate. A
join on prefixes makes it exact: with shingles in one order, rare ones first, two sets of a similarity s or more share one of
their first n - ceil(s * n) + 1 shingles, so every link between sets not yet connected is among the pairs that meet there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cache, forget, placed, whole_texts
from .components import components
from .words import begins, blank_words, mix, text_slices

#: Pairs of nodes and leaves that a walk holds at a time.
LOT = 100_000


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[a : a + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, code (the fingerprint as a signed long); a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        for b in batches:
            codes = np.array([fingerprint(t or "", shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes)], ["doc_id", "code"])

    return whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, code long")


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union-find over arrays: parent points to roots before and after."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def walk(keys: np.ndarray, roots: tuple[np.ndarray, ...], top: int, bits: int, found, leaf: int = 64, most: int = LOT) -> None:
    """Traverse pairs of trie nodes over sorted uint64 keys.

    roots: arrays (from, to, from, to) of node pairs whose keys agree on all bits from `top` up; found(i, j) gets
    positions of keys within `bits` differing bits. A pair of like nodes is given once. Pairs wait on a stack in lots
    of `most` at most, so memory is bounded however many pairs survive.
    """
    stack = [(top, *roots, np.zeros(len(roots[0]), np.int8))]
    ones = {}
    while stack:
        level, a0, a1, b0, b1, diff = stack.pop()
        area = (a1 - a0) * (b1 - b0)
        small = (area <= leaf) | (level == 0)
        pick = np.flatnonzero(small)
        while len(pick):  # leaves, in lots of bounded area
            n = max(1, int(np.searchsorted(np.cumsum(area[pick]), 5 * most)))
            own, pick = pick[:n], pick[n:]
            size = area[own]
            pair = np.repeat(np.arange(len(own)), size)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            width = (b1 - b0)[own][pair]
            i, j = a0[own][pair] + at // width, b0[own][pair] + at % width
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= bits) & ((a0[own][pair] != b0[own][pair]) | (i < j))
            found(i[near], j[near])
        a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        level -= 1
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((keys >> np.uint64(level)) & np.uint64(1), dtype=np.int64)])
        c = ones[level]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        other = ~same
        step = np.int8(1)
        nexts = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + step),
            (am[other], a1[other], b0[other], bm[other], diff[other] + step),
        ]
        lots = [np.concatenate(x) for x in zip(*nexts)]
        live = (lots[0] < lots[1]) & (lots[2] < lots[3]) & (lots[4] <= bits)
        lots = [x[live] for x in lots]
        for at in range(0, len(lots[0]), most):
            stack.append((level, *(x[at : at + most] for x in lots)))


def routes(bits: int, n: int) -> list[list[tuple[int, int]]]:
    """Rearrangements for codes within `bits` differing bits: lists of (first bit from the top, width) to bring to the
    front. Of `blocks` blocks all but `bits` agree; there are as many blocks as make fronts as wide as n codes ask for."""
    blocks = bits + 1
    while blocks < 2 * bits + 1 and 64 * (blocks - bits) // blocks < math.log2(max(2, n)) - 6:
        blocks += 1
    edge = [64 * k // blocks for k in range(blocks + 1)]
    return [[(edge[k], edge[k + 1] - edge[k]) for k in own] for own in combinations(range(blocks), blocks - bits)]


def turns(count: int, width: int) -> list[list[tuple[int, int]]]:
    """Rearrangements that bring a stretch of `width` bits to the front, starting at `count` places around the code."""
    starts = [64 * k // count for k in range(count)]
    return [[(a, width)] if a + width <= 64 else [(a, 64 - a), (0, a + width - 64)] for a in starts]


def front(code: Column, route: list[tuple[int, int]]) -> Column:
    """The bits of a route as one number."""
    out = F.lit(0).cast("long")
    for first, width in route:
        own = F.shiftrightunsigned(code, 64 - first - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = F.shiftleft(out, width).bitwiseOR(own)
    return out


def rearranged(code: np.ndarray, route: list[tuple[int, int]]) -> np.ndarray:
    """uint64 codes with the bits of a route first, the others after them in their order."""
    taken = sorted(route)
    rest, at = [], 0
    for first, width in taken:
        rest.append((at, first - at))
        at = first + width
    rest.append((at, 64 - at))
    out = np.zeros_like(code)
    for first, width in [*route, *(r for r in rest if r[1])]:
        out = (out << np.uint64(width % 64)) | ((code >> np.uint64(64 - first - width)) & np.uint64((1 << width) - 1))
    return out


#: Crowded front values up to this number go to every task, about 10 MB; more are met by a shuffle.
BROADCAST_CROWDS = 200_000
#: One in so many nodes tells which front values are crowded; that deals the work and changes no result.
LOOK = 16
#: Rows whose texts are read again: up to this number go to every task, about 30 MB.
BROADCAST_ASKED = 200_000


def dealt(codes: DataFrame, keep: list[str], slots: list[tuple[Column, Column]], crowd: int, n: int) -> DataFrame:
    """codes (node, ...) of n rows -> a row for each slot, given as (front value, struct of columns), dealt to tasks of about
    500,000 rows by slot and value: the struct's columns, `keep`, and `task`, which holds slot, lo, hi and chunk in 16 bits
    each. A crowded value is dealt as pairs of chunks lo <= hi, each row being in one of the two; all others as one."""
    at = F.array(*[F.struct(F.lit(k).alias("slot"), value.alias("value"), columns.alias("own")) for k, (value, columns) in enumerate(slots)])
    keyed = codes.select("node", *keep, F.explode(at).alias("at")).select("node", *keep, "at.slot", "at.value", "at.own.*")
    rest = [c for c in keyed.columns if c not in ("slot", "value")]
    task = F.shiftleft(F.col("slot").cast("long"), 48)
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(slots) // 500_000))
    if n > crowd:
        seen = keyed.where(F.pmod(F.xxhash64("node"), F.lit(LOOK)) == 0).groupBy("slot", "value").count().where(F.col("count") * LOOK > crowd)
        crowds = cut(seen.select("slot", "value", F.least(F.lit(1 << 15), F.ceil(F.col("count") * LOOK / crowd)).cast("int").alias("chunks")), "crowds")
        many = crowds.count()
        if many:
            marked = keyed.join(F.broadcast(crowds) if many <= BROADCAST_CROWDS else crowds, ["slot", "value"], "left").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("long"))
            pair = lambda t: F.shiftleft(F.least("chunk", t), 32) + F.shiftleft(F.greatest("chunk", t), 16) + F.col("chunk")
            own = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1), pair))
            marked = marked.withColumn("pair", F.explode(own))
            return marked.withColumn("task", task + F.col("pair")).repartition(parts, F.shiftright("task", 16), "value").select(*rest, "task")
    return keyed.withColumn("task", task).repartition(parts, "slot", "value").select(*rest, "task")


def walk_slots(table: pa.Table, slots: list[list[tuple[int, int]]], width: int, bits: int, found) -> None:
    """Walk the tries of all slots of a task's rows; found(i, j) gets rows of the table. Slot s has route s % len(slots)."""
    code = table["code"].to_numpy().astype(np.int64).view(np.uint64)
    task = table["task"].to_numpy().astype(np.int64)
    slot, lo, hi, chunk = (task >> (16 * k) & 0xFFFF for k in (3, 2, 1, 0))
    for k in np.unique(slot):
        mine = np.flatnonzero(slot == k)
        key = rearranged(code[mine], slots[int(k) % len(slots)])
        side = np.where(lo[mine] == hi[mine], 0, (chunk[mine] == hi[mine]).astype(np.int64))
        value = key >> np.uint64(64 - width)
        order = np.lexsort((key, side, hi[mine], lo[mine], value))
        mine, key, side = mine[order], key[order], side[order]
        group = np.stack([value[order].astype(np.int64), lo[mine], hi[mine]])
        new = np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(mine))
        split = stop - np.add.reduceat(side, start)  # where the second chunk starts
        # inside a single chunk (lo == hi): the node with itself; between two chunks: one node each
        one = lo[mine[start]] == hi[mine[start]]
        a0, a1 = start, np.where(one, stop, split)
        b0, b1 = np.where(one, start, split), stop
        full = np.where(one, a1 - a0 > 1, (a1 > a0) & (b1 > b0))
        walk(key, tuple(x[full] for x in (a0, a1, b0, b1)), 64 - width, bits, lambda i, j, own=mine: found(own[i], own[j]))


def near_links(codes: DataFrame, bits: int = 3, crowd: int = 8192, wide: int | None = None) -> DataFrame:
    """codes (code long, node long; distinct codes) -> links (a, b) of nodes that connect all codes within `bits` differing
    bits. wide: the number of codes that fronts are made for (default: as many as there are)."""
    n = codes.count()
    slots = routes(bits, wide or n)
    width = min(sum(w for _, w in r) for r in slots)
    values = [F.shiftrightunsigned(front(F.col("code"), r), sum(w for _, w in r) - width) for r in slots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        table = pa.Table.from_batches(own) if (own := list(batches)) else None
        if table is None or not table.num_rows:
            return
        node = table["node"].to_numpy()
        parent = np.arange(len(node))
        walk_slots(table, slots, width, bits, lambda i, j: merge(parent, i, j))
        linked = np.flatnonzero(parent != np.arange(len(parent)))
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[parent[linked]])], ["a", "b"])

    return dealt(codes, [], [(v, F.struct("code")) for v in values], crowd, n).mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, seed: int = 42, crowd: int = 8192, wide: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, code, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over fingerprints within `bits` differing bits, the row's own included; ids
    may be any longs. A null or empty text has fingerprint zero and links like any other. Rows with a null id link others;
    their component is the smallest id reachable, null if there is none. Repeated rows come back repeated; an empty table
    gives an empty result.
    """
    codes = cut(fingerprints(docs, id_col, text_col, shingle, seed), "codes")
    reps = cut(codes.groupBy("code").agg(F.min("doc_id").alias("least")).select("code", "least", F.monotonically_increasing_id().alias("node")), "distinct-codes")
    found = components(near_links(reps.select("code", "node"), bits, crowd, wide))
    named = reps.join(found, "node", "left").select("code", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("code", "component_id")
    return codes.join(named, "code").select("doc_id", "code", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


# --- groups by similarity of shingle sets ------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; all words of a text with fewer; none for a text without words."""
    words, ends = blank_words(texts)
    n = max(0, len(words) - shingle + 1)
    rolled = np.full(n, np.uint64(shingle))
    with np.errstate(over="ignore"):
        for k in range(shingle):
            rolled = mix(rolled * np.uint64(3) + words[k : k + n])
        for a, z in zip(begins(ends), ends):
            if z - a >= shingle:
                yield np.unique(rolled[a : z - shingle + 1])
            else:
                own = np.full(1, np.uint64(z - a))
                for w in words[a:z]:
                    own = mix(own * np.uint64(3) + w)
                yield own[: z - a]


def set_codes(shingles: np.ndarray, tables: int) -> np.ndarray:
    """SimHashes of a set of shingles, one per table."""
    total = np.zeros((tables, 64), np.int64)
    turn = np.arange(1, tables + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(shingles), 4096):
        x = mix(shingles[None, a : a + 4096] ^ turn)
        total += np.unpackbits(x.view(np.uint8).reshape(tables, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * total > len(shingles), axis=1, bitorder="little").view(np.uint64).reshape(-1)


class Forest:
    """Takes pairs of nodes with their distances lot by lot and keeps a minimum spanning forest of them."""

    def __init__(self, n: int, most: int = 1_000_000):
        self.n, self.most, self.held = n, most, 0
        self.lots: list[np.ndarray] = [np.zeros((3, 0), np.int64)]

    def add(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        self.lots.append(np.stack([distance.astype(np.int64), np.maximum(i, j), np.minimum(i, j)]))
        self.held += len(i)
        if self.held > self.most:
            self.pairs()
            self.held = 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The forest of all pairs so far: every round each tree takes its closest pair that leads out of it."""
        edges = np.concatenate(self.lots, axis=1)
        edges = edges[:, np.lexsort(edges[::-1])]
        parent, kept, left = np.arange(self.n), [np.zeros(0, np.int64)], np.arange(edges.shape[1])
        while len(left):
            a, b = parent[edges[1, left]], parent[edges[2, left]]
            left, a, b = left[a != b], a[a != b], b[a != b]
            closest = np.full(self.n, edges.shape[1])
            np.minimum.at(closest, a, left)
            np.minimum.at(closest, b, left)
            kept.append(np.unique(closest[closest < edges.shape[1]]))
            merge(parent, edges[1, kept[-1]], edges[2, kept[-1]])
        self.lots = [edges[:, np.concatenate(kept)]]
        return self.lots[0][1], self.lots[0][2]


#: Of 64 and of 128 bits, those that may differ for a candidate; a pair with similarity 0.8 differs in 9.7 and 19.4.
BITS, BOTH = 14, 28
TABLES, TURNS = 12, 5


def front_width(n: int) -> int:
    return min(40, max(16, math.ceil(math.log2(max(2, n))) - 6))


def tables_for(width: int) -> int:
    """As many tables as keep the chance of agreement on some front at a similarity of 0.8 (0.8485 per bit) what it is with
    TABLES and a width of 16."""
    return math.ceil(TABLES * 0.8485 ** (16 - width))


def candidate_pairs(reps: DataFrame, tables: int, width: int, n: int, crowd: int) -> DataFrame:
    """reps (node, codes) of n rows -> pairs (a, b) of nodes that may be similar: of each task the forest of its closest."""
    slots = turns(TURNS, width)
    code = lambda t: F.get("codes", F.lit(t % tables))
    columns = lambda t: F.struct(code(t).alias("code"), code(t + 1).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        table = pa.Table.from_batches(own) if (own := list(batches)) else None
        if table is None or not table.num_rows:
            return
        code, more = (table[c].to_numpy() for c in ("code", "more"))
        names, node = np.unique(table["node"].to_numpy(), return_inverse=True)
        forest = Forest(len(names))

        def found(i: np.ndarray, j: np.ndarray) -> None:
            apart = np.bitwise_count(code[i] ^ code[j]) + np.bitwise_count(more[i] ^ more[j])
            near = apart <= BOTH
            forest.add(node[i[near]], node[j[near]], apart[near])

        walk_slots(table, slots, width, BITS, found)
        a, b = forest.pairs()
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[a[k : k + 100_000]]), pa.array(names[b[k : k + 100_000]])], ["a", "b"])

    return dealt(reps, [], [(front(code(t), slots[k]), columns(t)) for t in range(tables) for k in range(TURNS)], crowd, n).mapInArrow(run, "a long, b long").distinct()


#: One in so many texts tells which shingles are frequent, those in COMMON of them or more, MOST_COMMON at most. That
#: orders the shingles and deals the work; any order gives the same links.
SEEN, COMMON, MOST_COMMON = 64, 3, 100_000
#: Pairs that a task makes at a time.
PAIRS = 1_000_000


def common_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of rows (text, file, line), sorted, and in how many of the texts looked at each one is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        for b in batches:
            for _, _, texts in text_slices(b.column(0), 500_000):
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts, shingle)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    looked = rows.where(F.pmod(F.xxhash64("file", "line"), F.lit(SEEN)) == 0).select("text").mapInArrow(count, "h long, n long")
    held = looked.groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {COMMON}").orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    h, n = np.array([r["h"] for r in held], np.int64).view(np.uint64), np.array([r["n"] for r in held], np.int64)
    return h[np.argsort(h)], n[np.argsort(h)]


def prefix(own: np.ndarray, similar: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set of distinct ones, as many as share one with each set of that similarity: rare ones first."""
    n = len(own)
    many = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        many = np.where(common[0][at] == own, common[1][at], 0)
    return own[np.lexsort((own, many))[: n - math.ceil(similar * n - 1e-9) + 1]] if n else own


def prefix_pairs(sets: DataFrame, groups: DataFrame, similar: float) -> DataFrame:
    """sets (node, n, head: the prefix), groups (node, group) -> pairs (a, b) of nodes of different groups that share a shingle of both
    prefixes and may be similar by their sizes, by what is left of both from there on, and by what their prefixes share: up to
    the end of one prefix the other holds all that can be shared, and beyond it no more than the rest of that set can be, nor
    beyond a shared shingle more than follows it in either set. No such pair is left out. A pair is given once for each
    shingle that both prefixes hold, so what they share is counted as pairs are merged, and no prefix goes to where a pair is."""
    total = sets.agg(F.sum(F.size("head"))).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 500_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        table = pa.Table.from_batches(own) if (own := list(batches)) else None
        if table is None or not table.num_rows:
            return
        h, node, back, size = (table[c].to_numpy() for c in ("h", "node", "back", "size"))
        group, n, at = node - back, size >> 32, size & 0xFFFFFFFF
        order = np.lexsort((n, h))
        h, group = h[order], group[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        apart = np.minimum.reduceat(group, start) < np.maximum.reduceat(group, start)
        kept = np.repeat(apart, np.diff(np.append(start, len(h))))
        order, h, group = order[kept], h[kept], group[kept]
        if not len(order):
            return
        node, n, at = node[order], n[order], at[order]
        rest = np.ceil(similar * n - 1e-9) - 1  # beyond the prefix
        value = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) << 32
        last = np.searchsorted(value + n, value + np.floor(n / similar + 1e-9).astype(np.int64), "right")
        count = np.maximum(last - np.arange(len(n)) - 1, 0)
        done = np.cumsum(count)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS, "right")))
            c = count[low:high]
            i = np.repeat(np.arange(low, high), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            least = (similar * (n[i] + n[j]) - 1e-6) / (1 + similar)  # that a similar pair shares
            left = np.minimum(n[i] - at[i], n[j] - at[j])
            may = (group[i] != group[j]) & (np.minimum(at[i], at[j]) + left >= least)
            i, j, least, left = i[may], j[may], least[may], left[may]
            a, b = node[i], node[j]
            need = np.ceil(least - np.minimum(np.maximum(rest[i], rest[j]), left - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need), pa.array(left >= least)], ["a", "b", "need", "first"])
            low = high

    # most groups are their only node: then back is 0
    rows = sets.join(groups, "node").select("node", (F.col("node") - F.col("group")).alias("back"), "n", F.posexplode("head").alias("at", "h"))
    packed = rows.select("h", "node", "back", (F.shiftleft("n", 32) + F.col("at")).alias("size")).repartition(parts, "h")
    met = packed.mapInArrow(run, "a long, b long, need int, first boolean")
    both = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"), F.max("first").alias("first"))
    return both.where("first AND shared >= need").select("a", "b")


def similar_groups(docs: DataFrame, text_col: str = "text", shingle: int = 5, similar: float = 0.8, carry: tuple[str, ...] = (), crowd: int = 8192, width: int | None = None, place: tuple[str, str] | None = None) -> DataFrame:
    """Groups of near copies: the carried columns, n_shingles, component_id; one row per row of docs.

    Rows link if the Jaccard similarity of their sets of word shingles is at least `similar`; groups are what links reach.
    Rows are told apart by a number of their own, not by an id, and component_id is the number of one row of the group.
    Candidates come from fingerprints first; a join on prefixes of the sets finds the links between what these leave apart, so
    none is missed, and no pair below `similar` is linked. Texts with fewer words than a shingle are one shingle;
    texts without words (null texts, too) are alike. Repeated rows come back repeated; an empty table gives an empty
    result; other columns are ignored. width: bits of fronts (default: by the number of rows). place: a string and a long
    column that tell where each row is stored, if docs has them.
    """
    if place is None:
        docs, place = placed(docs)
    rows = whole_texts(docs.select(F.col(text_col).alias("text"), F.col(place[0]).alias("file"), F.col(place[1]).alias("line"), *[F.col(c).alias(f"carry_{c}") for c in carry]))
    wide = width or front_width(rows.count())
    tables = tables_for(wide)
    names = rows.columns[1:]
    common = common_shingles(rows, shingle)

    def fingerprint_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        for b in batches:
            codes, sizes, digests, heads = [], [], ([], []), [np.zeros(0, np.uint64)]
            for _, _, texts in text_slices(b.column(0), 500_000):
                for own in shingle_sets(texts, shingle):
                    codes.append(set_codes(own, tables))
                    sizes.append(len(own))
                    digests[0].append(np.bitwise_xor.reduce(mix(own)) if len(own) else np.uint64(0))
                    digests[1].append(mix(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                    heads.append(prefix(own, similar, common))
            flat = np.concatenate(codes).view(np.int64) if codes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * tables, pa.array(flat))
            head = pa.ListArray.from_arrays(np.cumsum([len(x) for x in heads]).astype(np.int32), pa.array(np.concatenate(heads).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), lists, *[pa.array(np.array(d, np.uint64).view(np.int64)) for d in digests], head, *b.columns[1:]], ["n_shingles", "codes", "digest", "sum", "head", *names])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        for b in batches:
            for a, z, texts in text_slices(b.column(0), 500_000):
                own = list(shingle_sets(texts, shingle))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(a, z - a), lists], ["node", "shingles"])

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    codes = cut(rows.mapInArrow(fingerprint_sets, f"n_shingles long, codes array<long>, digest long, sum long, head array<long>{kinds}").withColumn("node", F.monotonically_increasing_id()), "codes")
    reps = cut(codes.groupBy("codes").agg(F.min("node").alias("node")), "distinct-codes")
    same = codes.join(reps.withColumnRenamed("node", "rep"), "codes").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))

    def judged(pairs: DataFrame) -> DataFrame:
        """pairs with `ok`, whether their similarity is enough. Only texts of some pair are read again."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        where = cut(codes.select("node", "file", "line").join(asked, "node", "left_semi"), "asked")
        few = where.count() <= BROADCAST_ASKED
        texts = rows.select("text", "file", "line").join(F.broadcast(where) if few else where, ["file", "line"]).select("text", "node")
        own = cut(texts.mapInArrow(sets, "node long, shingles array<long>"), "sets")
        both = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        shared = F.size(F.array_intersect("left", "right"))
        out = cut(both.select("a", "b", shared.alias("shared"), F.size("left").alias("l"), F.size("right").alias("r")).select("a", "b", F.expr(f"shared >= {similar} * (l + r - shared)").alias("ok")), "judged")
        forget(own)
        return out

    pairs = cut(candidate_pairs(reps.select("node", "codes"), tables, wide, reps.count(), crowd).union(same), "candidates")
    links = judged(pairs).where("ok").select("a", "b")
    found = cut(components(links), "groups")
    grouped = codes.select("node", "digest", "sum", "n_shingles").join(found, "node", "left").select("digest", "sum", "n_shingles", F.struct("node", F.coalesce("component", "node").alias("group")).alias("own"))
    # rows of one set are linked already: one of them stands for all. Two digests of 64 bits and the size tell sets apart
    groups = cut(grouped.groupBy("digest", "sum", "n_shingles").agg(F.min("own").alias("own")).select("own.*"), "set-groups")
    missed = cut(prefix_pairs(codes.select("node", F.col("n_shingles").alias("n"), "head"), groups, similar), "missed")
    out = codes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not missed.isEmpty():
        # groups are the nodes of what is left: links within them are not walked again
        named = lambda k: groups.select(F.col("node").alias(k), F.col("group").alias(f"group_{k}"))
        across = judged(missed).where("ok").join(named("a"), "a").join(named("b"), "b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))
        joined = components(across).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        out = out.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    return out.select(*[F.col(f"carry_{c}").alias(c) for c in carry], "n_shingles", F.col("component").alias("component_id"))
