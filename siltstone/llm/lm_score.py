"""LM scoring with a weighted backoff automaton.

Three passes, each over stored rows:
1. encode: texts become blocks of documents with block-local word numbers and the words' 64-bit hashes;
2. count: each block's distinct n-grams, as sorted 64-bit keys with training counts, go to the part that owns their top
   bits; a part adds the counts of all blocks and sends each block the totals of its own n-grams. Beyond 256 blocks they
   go through a tree: parts of some bits add up groups of blocks and pass on their sums by more bits;
3. score: a block builds the automaton of its n-grams and reads its documents once from left to right.

Automaton: a state for each context seen in training, an arc for each n-gram seen, and a failure arc from every context
to its shorter suffix. Smoothing is hierarchical: P(w|h) = (c(hw) + mu P(w|h')) / (c(h) + mu), so the failure arc of h
weighs log10(mu / (c(h) + mu)); the root discounts word counts by D = n1 / (n1 + 2 n2) and leaves D V / N to unseen words.
N-grams are told apart by 64-bit hashes, as usual in large n-gram models; nothing is pruned.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cache, whole_texts

BEGIN, END = 0, 1  # block-local numbers of the document's ends; words come after
FIXED = np.array([0x6A09E667F3BCC908, 0xBB67AE8584CAA73B], np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    """Compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def expand(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def expand_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Grams:
    """Distinct n-grams of a block. ids[n][t]: number of the n-gram that ends at t, -1 where a document has none."""

    def __init__(self, tokens: np.ndarray, words: np.ndarray, order: int):
        self.ids, self.keys, self.first = {}, {}, {}
        key = words[tokens]
        inside = np.flatnonzero(tokens != BEGIN)
        self.depth = None
        for n in range(1, order + 1):
            if n > 1:  # an n-gram starts no earlier than its document
                inside = inside[inside >= n - 1]
                inside = inside[(tokens[inside[:, None] - np.arange(1, n - 1)] != BEGIN).all(axis=1)] if n > 2 else inside
                with np.errstate(over="ignore"):
                    longer = mix(key[inside - 1] * np.uint64(3) + words[tokens[inside]])
                key = np.zeros(len(tokens), np.uint64)
                key[inside] = longer
            self.keys[n], first, number = np.unique(key[inside], return_index=True, return_inverse=True)
            self.first[n] = inside[first]
            ids = np.full(len(tokens), -1, np.int32)
            ids[inside] = number
            self.ids[n] = ids


def train_counts(grams: Grams, n: int, trained: np.ndarray) -> np.ndarray:
    ids = grams.ids[n][trained]
    return np.bincount(ids[ids >= 0], minlength=len(grams.keys[n]))


def encode(docs: DataFrame, id_col: str, text_col: str, folds: int, held_fold: int, block_chars: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds == held_fold, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        drop_cache()
        part, seq = TaskContext.get().partitionId(), itertools.count()
        fresh = lambda: (defaultdict(itertools.count(2).__next__), [], [], [], [])
        numbers, names, holds, lengths, streams = fresh()
        size = 0

        def block() -> pa.RecordBatch:
            words = np.concatenate([FIXED, np.fromiter(map(xxh64_intdigest, numbers), np.uint64, len(numbers))])
            row = {"block": [part * (1 << 20) + next(seq)], "ids": [names], "held": [holds], "lengths": [lengths], "tokens": [squeeze(np.concatenate(streams))], "words": [words.tobytes()]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary())]))

        for b in batches:
            for name, hold, text in zip(*(c.to_pylist() for c in b.columns)):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                own = np.empty(len(found) + 2, np.uint32)
                own[0], own[-1] = BEGIN, END
                own[1:-1] = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
                names.append(name)
                holds.append(hold)
                lengths.append(len(own))
                streams.append(own)
                size += len(text or "") + 16
                if size >= block_chars:
                    yield block()
                    numbers, names, holds, lengths, streams = fresh()
                    size = 0
        if names:
            yield block()

    return whole_texts(docs).select(F.col(id_col).cast("long"), held, F.col(text_col)).mapInArrow(run, "block long, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary")


def _trained(held: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(~held, lengths)


PIECE = "node long, n int, child long, keys binary, counts binary"
PIECES = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("child", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TOTALS = "block long, n int, part long, totals binary"


def levels(blocks: int, fan_bits: int) -> list[int]:
    """Bits by which each level of the count splits the keys: together enough for a part per block, each at most fan_bits."""
    bits = max(1, (blocks - 1).bit_length())
    n = -(-bits // fan_bits)
    return [bits // n + (i < bits % n) for i in range(n)]


def fan_out(keys: np.ndarray, counts: np.ndarray, place: int, depth: int, step: int) -> Iterator[tuple[int, bytes, bytes]]:
    """A node's sorted keys and counts for the nodes of the next level, which take `step` more bits of the key.

    A place is a group of blocks followed by `depth` bits of the key; at the next level `step` bits of the group give way to
    as many of the key, so every level has as many places, and a node sends and gets about 1 << step pieces.
    """
    group, own, after = place >> depth >> step, place & ((1 << depth) - 1), depth + step
    edges = np.searchsorted(keys >> np.uint64(64 - after), np.arange(own << step, ((own + 1) << step) + 1, dtype=np.uint64))
    for j in np.flatnonzero(np.diff(edges)):
        a, z = edges[j], edges[j + 1]
        yield (group << after) + (own << step) + int(j), squeeze_sorted(keys[a:z]), squeeze(counts[a:z])


def merge(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct keys of a node's pieces, their added counts, and for all pieces one after another each key's number."""
    keys = [expand_sorted(x) for x in pieces["keys"].to_pylist()]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([expand(x, np.int64) for x in pieces["counts"].to_pylist()])
    return distinct, np.bincount(number, counts, len(distinct)).astype(np.int64), number, [len(k) for k in keys]


def hand_back(pieces: pa.Table, total: np.ndarray, number: np.ndarray, sizes: list[int]) -> dict[str, pa.Array]:
    """For each piece of a node, the totals of its keys, for the child that sent it."""
    own = [squeeze(x) for x in np.split(total[number], np.cumsum(sizes)[:-1])]
    return {"block": pieces["child"], "n": pieces["n"], "part": pieces["node"], "totals": pa.array(own, pa.binary())}


def count(blocks: DataFrame, order: int, steps: list[int]) -> tuple[DataFrame, DataFrame]:
    """The totals of each block's n-grams (block, n, part, totals), and the sums over all words: tokens, types, once, twice.

    Pieces go up a tree of as many levels as there are steps, and totals come down the same way, so the number of pieces
    is blocks x levels x 2 ** step, whatever the number of blocks.
    """
    bits, top = sum(steps), len(steps) - 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, held, lengths, tokens, words in zip(*(b.column(c).to_pylist() for c in range(5))):
                grams = Grams(expand(tokens, np.uint32), np.frombuffer(words, np.uint64), order)
                trained = _trained(np.array(held, bool), np.array(lengths))
                place = int(mix(np.array([block + 1], np.uint64))[0] >> np.uint64(64 - bits))
                rows = [(node, n, block, keys, counts) for n in range(1, order + 1) for node, keys, counts in fan_out(grams.keys[n], train_counts(grams, n, trained), place, 0, steps[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    def ahead(level: int):
        def run(pieces: pa.Table) -> pa.Table:
            distinct, total, _, _ = merge(pieces)
            node, n = pieces["node"][0].as_py(), pieces["n"][0].as_py()
            rows = [(to, n, node, keys, counts) for to, keys, counts in fan_out(distinct, total, node, sum(steps[: level + 1]), steps[level + 1])]
            return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

        return run

    def add(pieces: pa.Table) -> pa.Table:
        _, total, number, sizes = merge(pieces)
        n = pieces["n"][0].as_py()
        sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())] if n == 1 else [0] * 4
        size = len(sizes)
        last = {"block": None, "n": n, "part": pieces["node"][0].as_py(), "totals": None}
        back = {c: pa.concat_arrays([*(x.chunks if isinstance(x, pa.ChunkedArray) else [x]), pa.array([last[c]], x.type)]) for c, x in hand_back(pieces, total, number, sizes).items()}
        return pa.table({**back, **{c: pa.array([0] * size + [v], pa.int64()) for c, v in zip(("tokens", "types", "once", "twice"), sums)}})

    def back(pieces: pa.Table, above: pa.Table) -> pa.Table:
        _, _, number, sizes = merge(pieces)
        lots = sorted(above.select(["part", "totals"]).to_pylist(), key=lambda r: r["part"])
        return pa.table(hand_back(pieces, np.concatenate([expand(r["totals"], np.int64) for r in lots]), number, sizes))

    pieces = [blocks.select("block", "held", "lengths", "tokens", "words").mapInArrow(split, PIECE)]
    for level in range(top):
        pieces[level] = cut(pieces[level], "lm-pieces")
        pieces.append(pieces[level].groupBy("node", "n").applyInArrow(ahead(level), PIECE))
    done = cut(pieces[top].groupBy("node", "n").applyInArrow(add, f"{TOTALS}, tokens long, types long, once long, twice long"), "lm-totals")
    totals = done.where("block IS NOT NULL").select("block", "n", "part", "totals")
    for level in reversed(range(top)):
        totals = pieces[level].groupBy("node", "n").cogroup(totals.groupBy("block", "n")).applyInArrow(back, TOTALS)
    return totals, done.where("block IS NULL").agg(*(F.sum(c).alias(c) for c in ("tokens", "types", "once", "twice")))


class Automaton:
    """States, arcs and failure arcs of a block's n-grams, given their training totals."""

    def __init__(self, grams: Grams, totals: dict[int, np.ndarray], docs: int, n_tokens: int, n_types: int, discount: float, mu: float):
        self.grams, self.order = grams, max(totals)
        self.seen = {n: totals[n] > 0 for n in totals}
        unseen = discount * n_types / n_tokens if n_tokens else 1.0
        p = {1: np.where(self.seen[1], (totals[1] - discount) / max(1, n_tokens), unseen)}
        self.fail: dict[int, np.ndarray] = {}  # by the number of a context of n - 1 words; its last entry: the document's begin
        for n in range(2, self.order + 1):
            context = np.append(totals[n - 1], docs if n == 2 else 0).astype(np.float64)
            self.fail[n] = np.log10(mu / (context + mu))
            at = grams.first[n]
            h = context[grams.ids[n - 1][at - 1]]  # -1, the begin, takes the last entry
            lower = p[n - 1][grams.ids[n - 1][at]]
            p[n] = (totals[n] + mu * lower) / (h + mu)
        self.arc = {n: np.log10(x) for n, x in p.items()}
        self.begin = 1 if docs and self.order > 1 else 0

    def read(self, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each document: all documents of the block step by step, the longest first."""
        start = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        start, length = start[order], lengths[order]
        score, depth = np.zeros(len(order)), np.full(len(order), self.begin)
        ids = self.grams.ids
        for step in range(1, int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -step, side="left"))  # documents with a token at this step
            at = start[:k] + step
            d, s = depth[:k], score[:k]
            for n in range(self.order, 1, -1):
                here = np.flatnonzero(d == n - 1)
                if len(here):
                    arc = ids[n][at[here]]
                    ok = (arc >= 0) & self.seen[n][arc]
                    go, back = here[ok], here[~ok]
                    s[go] += self.arc[n][arc[ok]]
                    d[go] = -min(n, self.order - 1) - 1  # arrived; told apart from contexts still to be tried
                    s[back] += self.fail[n][ids[n - 1][at[back] - 1]]
                    d[back] = n - 2
            here = np.flatnonzero(d == 0)
            arc = ids[1][at[here]]
            s[here] += self.arc[1][arc]
            d[here] = np.where(self.seen[1][arc] & (self.order > 1), -2, -1)
            depth[:k] = -d - 1
        out = np.empty(len(order))
        out[order] = score
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, folds: int = 7, held_fold: int = 2, mu: float = 200.0, block_chars: int = 12_000_000, fan_bits: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are what white space separates after lower-casing A-Z; each document ends with one end token. The model
    learns from rows whose crc32(id as text) mod folds is not held_fold; a row with a null id is learned from. A null
    text counts as empty. Without training rows every token has probability one. Repeated rows count and come back
    each; an empty table gives an empty result; other columns are ignored.
    """
    blocks = cut(encode(docs, id_col, text_col, folds, held_fold, block_chars), "lm-blocks")
    n_blocks, n_docs = blocks.agg(F.count("*"), F.sum(F.size(F.filter("held", lambda x: ~x)))).first()
    totals, sums = count(blocks, order, levels(n_blocks, fan_bits))
    n_tokens, n_types, once, twice = (int(x or 0) for x in sums.first())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    n_docs = int(n_docs or 0)

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not block.num_rows:
            return schema.empty_table()
        row = block.slice(0, 1).to_pylist()[0]
        lengths = np.array(row["lengths"])
        grams = Grams(expand(row["tokens"], np.uint32), np.frombuffer(row["words"], np.uint64), order)
        lots = defaultdict(list)
        for r in sorted(own.select(["n", "part", "totals"]).to_pylist(), key=lambda r: (r["n"], r["part"])):
            lots[r["n"]].append(expand(r["totals"], np.int64))
        found = {n: np.concatenate(lots[n]) if lots[n] else np.zeros(0, np.int64) for n in range(1, order + 1)}
        model = Automaton(grams, found, n_docs, n_tokens, n_types, discount, mu)
        own_ids = grams.ids[1]
        c = np.where(own_ids >= 0, found[1][own_ids], 0)
        base = np.where(own_ids >= 0, np.log10((c + 1) / (n_tokens + n_types + 1)), 0.0)
        at = np.cumsum(lengths) - lengths
        return pa.table({
            "doc_id": row["ids"], "held_out": row["held"], "n_tokens": lengths - 1, "n_known": np.add.reduceat((c > 0).astype(np.int64), at),
            "train_tokens": np.full(len(lengths), n_tokens, np.int64), "base_score": np.add.reduceat(base, at), "score": model.read(lengths),
        }, schema=schema)

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
