"""Packing: hierarchical multi-length packing of tokenized documents.

One pass without a shuffle: each input partition tokenizes its documents and packs them in blocks of about block_tokens
tokens. Windows have the lengths of `tiers` (powers of two). Whole long windows are cut from documents longer than the
longest tier; every other piece is routed to the shortest tier that holds it. Tiers are packed from the longest down:
a window starts with a piece of its own tier, its gap takes the longest whole pieces of shorter tiers that fit, and
what then remains is filled by cutting one more piece. Pieces that no full window took are carried to the next block;
at the end of the partition they fill windows of falling powers of two, so a sequence has no padding at all. Windows of
a block are dealt to step groups, each the next to the lightest group, so that groups of a step hold equal tokens.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts
from .tokens import tokenizer, vocabulary_path
from .words import text_slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, padding int, tier int, step_group long"
Piece = tuple[int, int, int]  # length, document, start


class TierPacker:
    """Packs pieces given as (length, document key, start); full windows come out as (window, [(piece, offset)])."""

    def __init__(self, tiers: tuple[int, ...]):
        if sorted(tiers) != list(tiers) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be rising powers of two")
        self.tiers = tiers
        self.waiting: list[Piece] = []  # sorted by length

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def add(self, document: int, n: int) -> Iterator[tuple[int, list[tuple[Piece, int]]]]:
        """Whole windows of a document's own at once; the rest waits."""
        top, start = self.tiers[-1], 0
        while n - start >= top:
            yield top, [((top, document, start), 0)]
            start += top
        if n > start:
            insort(self.waiting, (n - start, document, start))

    def _fill(self, window: int, first: Piece) -> list[tuple[Piece, int]]:
        """Piece by piece: the longest that fits, else the head of the shortest one that doesn't."""
        placed, used, piece = [], 0, first
        while True:
            placed.append((piece, used))
            used += piece[0]
            gap = window - used
            if not gap:
                return placed
            at = bisect_right(self.waiting, (gap, 1 << 62, 0))
            if at:
                piece = self.waiting.pop(at - 1)
            else:
                n, document, start = self.waiting.pop(0)
                piece = (gap, document, start)
                insort(self.waiting, (n - gap, document, start + gap))

    def full(self) -> Iterator[tuple[int, list[tuple[Piece, int]]]]:
        """Windows that can be filled to the end, from the longest tier down."""
        left = sum(p[0] for p in self.waiting)
        while self.waiting:
            longest = self.waiting[-1]
            window = self.tier(longest[0])
            if left < window:
                return
            self.waiting.pop()
            left -= window
            yield window, self._fill(window, longest)

    def rest(self) -> Iterator[tuple[int, list[tuple[Piece, int]]]]:
        """The end of the stream: what waits fills windows of falling powers of two."""
        yield from self.full()
        left = sum(p[0] for p in self.waiting)
        while left:
            window = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            first = self.waiting.pop()
            if first[0] > window:
                insort(self.waiting, (first[0] - window, first[1], first[2] + window))
                first = (window, first[1], first[2])
            yield window, self._fill(window, first)
            left -= window


def step_groups(windows: list[int], groups: int) -> list[int]:
    """The group of each window: longest first, each to the group with the fewest tokens."""
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: -windows[k]):
        load, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (load + windows[k], g))
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048, 4096),
    end_id: int = 2,
    block_tokens: int = 1_000_000,
    step_tokens: int = 65_536,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, padding, tier, step_group.

    A document's ids are its text's (null: empty) and end_id, so an empty text gives one id. Strings of special tokens in
    a text give the special ids, as in the library. Each id is in exactly one
    piece. A row with a null id is packed with doc_id null; repeated rows are packed again each; a text of any length
    is cut to windows. sequence_id is unique over all partitions. An empty table gives an empty result.
    """
    path = vocabulary or vocabulary_path()
    top = tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = tokenizer(path), TierPacker(tiers)
        base = TaskContext.get().partitionId() << 40
        ids: dict[int, np.ndarray] = {}
        named: dict[int, tuple[int | None, int]] = {}
        left: dict[int, int] = {}
        windows: list = []
        count = steps = key = held = 0

        def emit() -> pa.RecordBatch:
            nonlocal count, steps
            groups = max(1, sum(w for w, _ in windows) // step_tokens)
            group = step_groups([w for w, _ in windows], groups)
            rows = []
            for k, (window, placed) in enumerate(windows):
                for (n, doc, start), offset in placed:
                    name, total = named[doc]
                    rows.append((name, start, n, zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes()), total, base + count + k, offset, window, 0, next((t for t in tiers if total <= t), top), base + steps + group[k]))
                    left[doc] -= n
                    if not left[doc]:
                        del left[doc], ids[doc], named[doc]
            count, steps = count + len(windows), steps + groups
            windows.clear()
            kinds = [pa.int64()] * 7 + [pa.int32()] * 3 + [pa.int64()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 11, kinds)], names)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                for name, found in zip(names[a:b], words.encode(texts)):
                    own = np.append(found, np.uint16(end_id))
                    ids[key], named[key], left[key] = own, (name, len(own)), len(own)
                    windows.extend(packer.add(key, len(own)))
                    key += 1
                    held += len(own)
                if held >= block_tokens:
                    windows.extend(packer.full())
                    yield emit()
                    held = sum(p[0] for p in packer.waiting)
        windows.extend(packer.rest())
        if windows:
            yield emit()

    return whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
