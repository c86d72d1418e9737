"""Benchmark decontamination by latent semantic retrieval.

1. Statistics: the document frequency of every word over all documents, in a table of hashed buckets.
2. Index: benchmark items, cut into passages, become TF-IDF rows; a randomised SVD, its products made by Spark tasks,
   gives a latent space, and each passage a unit vector there. Items go in blocks of bounded size, and the passages of a
   block in parts of at most `rank`, each with a latent space of its own, so none loses anything of a passage.
3. Search: windows of all documents, every `stride` words, as wide as a part's longest passage, a quarter more and a
   stride, `window` at least; so a copy of a passage with a quarter of insertions stands whole in one of them. What
   window and passage share in the latent space is not divided by the window's norm: the words around a copy, and the
   rare ones above all, would count against it. It must reach the least TF-IDF mass that the check below can accept for
   the item, dealt over the item's passages by their mass. A passage's key words are its heaviest, so many that the rest
   of it is lighter than that; so windows without a key word, and those with less mass on the part's vocabulary, are
   left out without loss. The others are projected and compared with all passages of the part in one matrix product.
4. Check: for each candidate, the longest common subsequence of item and surrounding words; a document is contaminated
   by an item if `copied` of the item's words are in it in order, or `close` of them and the item's answer, its rarest
   words, too.

Items of fewer than `min_words` words give no latent vector worth a search and are looked up as phrases, word by word;
one of fewer than `phrase_words` words is no passage of anything, and is found in documents that consist of it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_cache, whole_texts
from .words import begins, letter_words, mix, stretches, text_slices

BUCKETS = 1 << 20
LOTS = 64
WORD = regex.compile(r"[\p{L}\p{N}]+")
SLICE = 500_000
#: Word places whose latent rows are added up at a time: rank x 4 bytes each.
PLACES = 16_384
#: Items of a block have this many passages together at most, but for a single longer item.
BLOCK_PASSAGES = 1024
#: Blocks are searched together, in one scan, up to this size of their arrays.
GROUP_BYTES = 64_000_000
#: Items with so many characters together, and 100 each, come to the driver in one job.
FEW_CHARS = 4_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return letter_words(words)[0]


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents per bucket, over all documents, and the number of documents. Partial tables are added slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for _, _, texts in text_slices(b.column(0), SLICE):
                words, ends = letter_words(texts.to_pylist())
                bucket = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
                own = np.repeat(np.arange(len(ends)), ends - begins(ends))
                total += np.bincount(np.unique(own * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
            n += b.num_rows
        lots = [zstandard.compress(x.tobytes(), 1) for x in total.reshape(LOTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(LOTS), pa.int32()), pa.array(lots, pa.binary()), pa.array([n if k == 0 else 0 for k in range(LOTS)], pa.int64())], ["lot", "counts", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // LOTS, np.int64)
        for x in table["counts"].to_pylist():
            total += np.frombuffer(zstandard.decompress(x), np.int64)
        return pa.table({"lot": table["lot"].slice(0, 1), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    shape = "lot int, counts binary, n long"
    rows = whole_texts(docs).select(F.col(text_col)).mapInArrow(count, shape).groupBy("lot").applyInArrow(add, shape).collect()  # LOTS rows, 8 MB before compression
    out = np.zeros((LOTS, BUCKETS // LOTS), np.int64)
    for r in rows:
        out[r["lot"]] = np.frombuffer(zstandard.decompress(r["counts"]), np.int64)
    return out.reshape(-1), sum(r["n"] for r in rows)


def passages_of(items: list[tuple[int, list[str]]], size: int) -> list[tuple[int, list[str]]]:
    """(item position, words): items over `size` words are cut into pieces of equal length."""
    out = []
    for k, (_, words) in enumerate(items):
        n = -(-len(words) // size)
        edges = np.linspace(0, len(words), n + 1).astype(int)
        out += [(k, words[a:z]) for a, z in zip(edges, edges[1:])]
    return out


def randomised_svd(spark, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, rank: int, seed: int = 5, rounds: int = 2) -> np.ndarray:
    """Right singular vectors (terms x rank) of sparse rows (columns, values), by a seeded range finder.

    Tasks hold stretches of the rows and make the products with them; the driver holds terms x (rank + 10) numbers.
    """
    width = min(rank + 10, len(rows), terms)
    data = spark.createDataFrame(pd.DataFrame({"cols": [c.tolist() for c, _ in rows], "vals": [v.tolist() for _, v in rows]}), "cols array<int>, vals array<double>").repartition(max(1, min(64, len(rows) // 256 + 1)))

    def square(basis: np.ndarray) -> np.ndarray:
        """A' A basis, as sums over rows."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for cols, vals in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    y = np.array(vals) @ basis[cols]
                    for c, v in zip(cols, vals):
                        total[c] = total[c] + v * y if c in total else v * y
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["term", "sums"])

        out = np.zeros_like(basis)
        for r in data.mapInArrow(part, "term int, sums binary").toLocalIterator():
            out[r["term"]] += np.frombuffer(r["sums"])
        return out

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(square(basis))[0]
    small = basis.T @ square(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    return basis @ turn[:, best[values[best] > 1e-9]]


def longest_common(a: dict[str, int], length: int, b: list[str]) -> int:
    """Length of the longest common subsequence; a: bit masks of the first sequence's words (bit-parallel)."""
    v = full = (1 << length) - 1
    for w in b:
        if m := a.get(w):
            u = v & m
            v = (v + u) | (v - u)
    return length - (v & full).bit_count()


class Part:
    """At most `rank` passages of a block, and their latent space, which holds each of them whole. local: the part's row of
    each vocabulary word of the block, or -1. key: whether a row is a key word of a passage. least: what a window must
    share with each passage's unit vector. width: words of a window, a multiple of the stride."""

    def __init__(self, owner, vectors, basis, local, key, least, width):
        self.owner, self.vectors, self.basis, self.local, self.key, self.least, self.width = owner, vectors, basis, local, key, least, width

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.owner, self.vectors, self.basis, self.local, self.key, self.least))


class Block:
    """What a task needs to search one block of items: the items (id, words), the sorted hashes of their words and the
    vocabulary row of each, the parts, each item's answer and bit masks, and short items by length and phrase hash."""

    def __init__(self, items, hashes, row, parts, answers, masks, short):
        self.items, self.hashes, self.row, self.parts, self.answers, self.masks, self.short = items, hashes, row, parts, answers, masks, short

    @property
    def nbytes(self) -> int:
        masks = sum(len(m) * (80 + len(words) // 8) for m, (_, words) in zip(self.masks, self.items))
        return sum(p.nbytes for p in self.parts) + self.hashes.nbytes + self.row.nbytes + masks + sum(64 * len(words) + 200 for _, words in self.items)


def least_share(masses: list[float], answer: list[int], copied: float, close: float) -> float:
    """The least share of an item's mass that a copy holds which the check accepts; masses: one for each word of the
    item; answer: one place of each answer word."""

    def lightest(own: list[float], n: int) -> float:
        return sum(sorted(own)[: max(0, n)])

    need = lambda share: math.ceil(share * len(masses) - 1e-9)
    other = [m for k, m in enumerate(masses) if k not in answer]
    with_answer = sum(masses[k] for k in answer) + lightest(other, need(close) - len(answer))
    return min(lightest(masses, need(copied)), with_answer) / sum(masses)


def key_words(masses: np.ndarray, least: float) -> np.ndarray:
    """Places of the heaviest of a passage's words, so many that the others together are lighter than the share `least`."""
    order = np.argsort(-masses, kind="stable")
    rest = masses.sum() - np.cumsum(masses[order])
    return order[: int(np.argmax(rest < least * masses.sum() * (1 - 1e-6))) + 1]


def _parts(sizes: list[int], rank: int) -> list[list[int]]:
    """Passages in parts of at most rank, of like length: less than twice the shortest, for windows that fit."""
    out: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if not out or len(out[-1]) == rank or sizes[k] >= 2 * sizes[out[-1][0]]:
            out.append([])
        out[-1].append(k)
    return out


def phrase_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place on."""
    n = max(0, len(words) - length + 1)
    out = np.full(n, np.uint64(length))
    with np.errstate(over="ignore"):
        for k in range(length):
            out = mix(out * np.uint64(3) + words[k : k + n])
    return out


def _index(spark, items: list[tuple[int, list[str]]], df: np.ndarray, n_docs: int, passage: int, rank: int, answer_words: int, window: int, stride: int, copied: float, close: float, min_words: int) -> Block:
    vocabulary: dict[str, int] = {}
    for _, words in items:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    hashes = word_hashes(list(vocabulary))
    weight = idf(df, n_docs)[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, (_, words) in enumerate(items):
        if len(words) < min_words:
            short[len(words)][int(phrase_hashes(hashes[[vocabulary[w] for w in words]], len(words))[0])].append(k)
    pieces = passages_of([(i, words if len(words) >= min_words else []) for i, words in items], passage)
    answers, masks, shares = [], [], []
    for _, words in items:
        answers.append(set(sorted(set(words), key=lambda w: (-weight[vocabulary[w]], w))[:answer_words]))
        mask: dict[str, int] = {}
        for k, w in enumerate(words):
            mask[w] = mask.get(w, 0) | (1 << k)
        masks.append(mask)
        shares.append(least_share([float(weight[vocabulary[w]]) ** 2 for w in words], [words.index(w) for w in answers[-1]], copied, close))
    rows, norms, keys = [], [], []
    for item, words in pieces:
        cols, tf = np.unique([vocabulary[w] for w in words], return_counts=True)
        vals = np.sqrt(tf) * weight[cols]
        norms.append(np.linalg.norm(vals))
        rows.append((cols, vals / norms[-1]))
        keys.append(cols[key_words(vals * vals, shares[item])])
    least = np.array([shares[k] for k, _ in pieces]) * np.array(norms) * (1 - 1e-4)  # room for 32-bit sums
    sizes = [len(words) for _, words in pieces]
    parts = []
    for mine in _parts(sizes, rank):
        own = [rows[k] for k in mine]
        known = np.unique(np.concatenate([c for c, _ in own]))
        local = np.full(len(vocabulary), -1, np.int32)
        local[known] = np.arange(len(known))
        own = [(local[c], v) for c, v in own]
        basis = randomised_svd(spark, own, len(known), rank)
        vectors = np.stack([v @ basis[c] for c, v in own])
        key = np.zeros(len(known), bool)
        key[local[np.concatenate([keys[k] for k in mine])]] = True
        longest = max(sizes[k] for k in mine)
        width = -(-max(window, longest + longest // 4 + stride - 1) // stride) * stride
        parts.append(Part(np.array([pieces[k][0] for k in mine]), vectors.astype(np.float32), basis.astype(np.float32), local, key, least[mine].astype(np.float32), width))
    order = np.argsort(hashes)
    return Block(items, hashes[order], order, parts, answers, masks, {n: dict(x) for n, x in short.items()})


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((1 + n_docs) / (1 + df)) + 0.1


def _lots(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of sizes that add up to about most."""
    reach, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + most)))
        yield slice(start, stop)
        start = stop


class Texts:
    """Words of a slice of texts, in cells of `stride` words; the last cell of a text may be shorter."""

    def __init__(self, texts: list[str], mass: np.ndarray, stride: int):
        self.texts = texts
        self.words, ends = letter_words(texts)
        self.begin = begins(ends)
        self.length = ends - self.begin
        self.mass = mass[(self.words & np.uint64(BUCKETS - 1)).astype(np.int64)]
        self.cells = -(-self.length // stride)  # of each text
        self.base = np.cumsum(self.cells) - self.cells
        self.text = np.repeat(np.arange(len(texts)), self.cells)  # of each cell
        self.place = np.arange(len(self.text)) - self.base[self.text]  # of each cell in its text
        own = np.repeat(np.arange(len(texts)), self.length)
        self.cell = self.base[own] + (np.arange(len(self.words)) - self.begin[own]) // stride  # of each word


def candidates(t: Texts, hit: np.ndarray, term: np.ndarray, part: Part, stride: int) -> Iterator[tuple[int, int, int, float]]:
    """(first cell, cell after the last, passage, what they share) of windows that may hold a passage of the part; hit and
    term: places of vocabulary words in the slice, and their vocabulary rows."""
    local = part.local[term]
    own = np.flatnonzero(local >= 0)
    place, local = hit[own], local[own]
    cell, n = t.cell[place], len(t.text)
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    mass = running(np.bincount(cell, t.mass[place], n))
    keys = running(np.bincount(cell[part.key[local]], minlength=n))
    width = part.width // stride
    start = np.flatnonzero(t.place <= np.maximum(t.cells - width, 0)[t.text])
    stop = np.minimum(start + width, (t.base + t.cells)[t.text[start]])
    live = (keys[stop] > keys[start]) & (mass[stop] - mass[start] >= float(part.least.min()) ** 2 * (1 - 1e-6))
    start, stop = start[live], stop[live]
    low, high = np.searchsorted(cell, start), np.searchsorted(cell, stop)
    terms = len(part.basis)
    for lot in _lots(high - low, PLACES):
        at = stretches(low[lot], (high - low)[lot])
        owner = np.repeat(np.arange(lot.stop - lot.start), (high - low)[lot])
        pair, first, tf = np.unique(owner * terms + local[at], return_index=True, return_counts=True)
        of, col = np.divmod(pair, terms)
        weight = np.sqrt(tf * t.mass[place[at[first]]], dtype=np.float32)
        head = np.flatnonzero(np.diff(of, prepend=-1))
        points = np.add.reduceat(weight[:, None] * part.basis[col], head, axis=0)
        shared = points @ part.vectors.T
        for k, p in zip(*np.nonzero(shared >= part.least)):
            w = lot.start + of[head[k]]
            yield int(start[w]), int(stop[w]), int(p), float(shared[k, p])


def phrases(t: Texts, block: Block, phrase_words: int) -> Iterator[tuple[int, int]]:
    """(text, item) of short items that stand in a text word by word, or that are the whole text."""
    for length, known in block.short.items():
        sought = np.array(sorted(known), np.uint64)
        found = phrase_hashes(t.words, length)
        at = np.minimum(np.searchsorted(sought, found), len(sought) - 1)
        for place in np.flatnonzero(sought[at] == found).tolist():
            text = int(np.searchsorted(t.begin, place, side="right")) - 1  # the last of texts that begin there
            first = place - int(t.begin[text])
            if first + length <= t.length[text] and (length >= phrase_words or length == t.length[text]):
                own = words_of(t.texts[text])[first : first + length]
                yield from ((text, k) for k in known[int(found[place])] if block.items[k][1] == own)


def search(texts: list[str], blocks: list[Block], mass: np.ndarray, stride: int, copied: float, close: float, phrase_words: int = 3) -> list[tuple[int, int, float, float, bool]]:
    """(place of the text, item id, cosine, share in order, answer found) for all contaminating items of the texts."""
    t = Texts(texts, mass, stride)
    if not len(t.words):
        return []
    out = []
    for block in blocks:
        at = np.minimum(np.searchsorted(block.hashes, t.words), len(block.hashes) - 1)
        hit = np.flatnonzero(block.hashes[at] == t.words)
        term = block.row[at[hit]]
        found: dict[tuple[int, int], float] = {}
        where: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for part in block.parts:
            for start, stop, p, shared in candidates(t, hit, term, part, stride):
                text = int(t.text[start])
                a = int(t.place[start]) * stride
                z = min(int(t.length[text]), a + (stop - start) * stride)
                pair = text, int(part.owner[p])
                whole = float(t.mass[t.begin[text] + a : t.begin[text] + z].sum())
                found[pair] = max(found.get(pair, 0.0), shared / math.sqrt(max(whole, 1e-12)))
                where[pair].add((a, z))
        words, shown = [], -1
        for (text, item), best in sorted(found.items()):
            if text != shown:
                words, shown = words_of(texts[text]), text
            size, hit_share = len(block.items[item][1]), None
            for a, z in sorted(where[text, item]):
                around = words[max(0, a - size) : z + size]
                share = longest_common(block.masks[item], size, around) / size
                answer = block.answers[item] <= set(around)
                if (share >= copied or (share >= close and answer)) and (hit_share is None or share > hit_share[0]):
                    hit_share = share, answer
            if hit_share:
                out.append((text, block.items[item][0], min(1.0, best), *hit_share))
        out += [(text, block.items[item][0], 1.0, 1.0, True) for text, item in sorted(set(phrases(t, block, phrase_words)))]
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 24,
    stride: int = 8,
    copied: float = 0.8,
    close: float = 0.6,
    rank: int = 256,
    passage: int = 48,
    answer_words: int = 3,
    min_words: int = 8,
    phrase_words: int = 3,
    block_passages: int = BLOCK_PASSAGES,
    group_bytes: int = GROUP_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per pair of a document and a benchmark item that it holds: doc_id, item_id, cosine, lcs_share, answer_found,
    and the document's carried columns.

    Items of fewer than min_words words are found as phrases, those of fewer than phrase_words as whole documents; an item
    without words is in no document. Equal items are reported each. Null texts hold nothing; a null doc_id is reported as
    null; repeated rows are reported each; texts are read whole. No rows come back for an empty table of either kind.
    Other columns are ignored. The corpus is read once for the statistics and once for each group of blocks of items:
    benchmark items stream through the driver, which holds a block at a time (and up to FEW_CHARS characters of items, which
    come in one job) and broadcasts groups of up to group_bytes.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    asked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL").orderBy("item_id", "text")
    texts = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry).where("text IS NOT NULL")
    result = spark.createDataFrame([], schema)
    n_chars = asked.agg(F.sum(F.length("text") + 100)).first()[0]
    if n_chars is None:
        return result
    df, n_docs = document_frequencies(docs, text_col)
    mass = (idf(df, n_docs) ** 2).astype(np.float32)

    def blocks() -> Iterator[Block]:
        own, passages = [], 0
        made = lambda: _index(spark, own, df, n_docs, passage, rank, answer_words, window, stride, copied, close, min_words)
        # an iterator runs a job for each partition
        for r in asked.collect() if n_chars <= FEW_CHARS else asked.toLocalIterator():
            if not (words := words_of(r["text"])):
                continue
            if own and passages + -(-len(words) // passage) > block_passages:
                yield made()
                own, passages = [], 0
            own.append((r["item_id"], words))
            passages += -(-len(words) // passage)
        if own:
            yield made()

    def searched(group: list[Block]) -> DataFrame:
        shared = spark.sparkContext.broadcast((group, mass))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop_cache()
            for b in batches:
                rows, at = [], []
                ids = b.column(0).to_pylist()
                for a, _, own in text_slices(b.column(1), SLICE):
                    for k, *rest in search(own.to_pylist(), *shared.value, stride, copied, close, phrase_words):
                        rows.append((ids[a + k], *rest))
                        at.append(a + k)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)] + [c.take(pa.array(at, pa.int64())) for c in b.columns[2:]], ["doc_id", "item_id", "cosine", "lcs_share", "answer_found", *carry])

        return texts.mapInArrow(run, schema)

    group: list[Block] = []
    for block in blocks():
        if group and sum(x.nbytes for x in group) + block.nbytes > group_bytes:
            result, group = result.union(searched(group)), []
        group.append(block)
    return result.union(searched(group)) if group else result
