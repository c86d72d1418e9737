"""Source divergence audit: how the words of each source differ from those of the others of its language.

Counts by language, source and term are pre-aggregated in the tasks that read texts and stored for the kept terms. A language's terms are then
dealt into blocks. A block is a dense int64 matrix of sources by terms; its terms' divergences of all ordered pairs of
sources come from one broadcast product per stretch of rows, and each source keeps a heap of its block's best terms. Blocks'
pair matrices are summed and heaps are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cache, whole_texts
from .words import begins, split_words, text_slices

#: Bytes of terms: letters a-z and all of non-ASCII characters; A-Z lower-cased, others blank.
_LETTERS = np.array([c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
#: Probabilities are in billionths; SPLIT * REST of them, so that products stay in 64 bits.
SPLIT, REST = 32_000, 31_250
MOST_PAIRS = 3_000_000  # (group, term) pairs that a task holds before it puts them out
CELLS = 1 << 21  # of a dense matrix, and of a broadcast product
BROADCAST_ROWS = 10_000


def plain_letters(texts: pa.Array) -> pa.Array:
    """texts without nulls -> the same with A-Z lower-cased and a blank for each other ASCII character that is no letter."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_LETTERS[raw]))


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[at], *(np.add.reduceat(c[order], at) if len(at) else c[:0] for c in columns))


class _Counter:
    """Occurrences and documents by (group, term) of what a task has read."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pairs = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        number, ends, distinct = split_words(plain_letters(texts), ascii_only=True)
        groups, terms = self.groups, self.terms
        own = np.fromiter((groups.setdefault(g, len(groups)) for g in zip(langs, sources)), np.int64, len(langs))
        known = np.fromiter((terms.setdefault(t, len(terms)) for t in distinct.to_pylist()), np.int64, len(distinct))
        text = np.repeat(np.arange(len(ends)), ends - begins(ends))
        keys, n = _summed(text * max(1, len(distinct)) + number, np.ones(len(number), np.int64))  # by document and term
        text, number = keys // max(1, len(distinct)), keys % max(1, len(distinct))
        self.parts.append(_summed(own[text] << 32 | known[number], n, np.ones(len(n), np.int64)))
        self.pairs += len(self.parts[-1][0])
        if self.pairs > MOST_PAIRS:
            self.merge()

    def merge(self) -> None:
        self.parts = [_summed(*(np.concatenate([p[k] for p in self.parts]) for k in range(3)))] if self.parts else []
        self.pairs = sum(len(p[0]) for p in self.parts)

    def full(self) -> bool:
        return self.pairs > MOST_PAIRS or len(self.terms) > MOST_PAIRS

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, n, docs in self.parts:
            terms, groups = pa.array(self.terms, pa.string()), list(self.groups)
            langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for a in range(0, len(keys), 50_000):
                part = keys[a : a + 50_000]
                group = pa.array(part >> 32)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(pa.array(part & 0xFFFFFFFF)), pa.array(n[a : a + 50_000]), pa.array(docs[a : a + 50_000])], ["lang", "source", "term", "n", "docs"])
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_cache()
    counter = _Counter()
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text")):
            counter.add(batch.column("lang").slice(a, b - a).to_pylist(), batch.column("source").slice(a, b - a).to_pylist(), texts)
            if counter.full():
                yield from counter.rows()
    yield from counter.rows()


def shares(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / (total + kinds)), in two exact divisions that stay in 64 bits below 2.8e14 words."""
    under = total + kinds
    q, r = np.divmod((count + 1) * SPLIT, under)
    return 1 + q * REST + r * REST // under


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pair_matrix(p: np.ndarray) -> np.ndarray:
    """Sources x terms -> for each ordered pair of sources the sum of their divergences over the terms."""
    n, terms = p.shape
    out = np.zeros((n, n), np.int64)
    rows = max(1, CELLS // max(1, n * terms))
    for a in range(0, n, rows):
        out[a : a + rows] = divergences(p[a : a + rows, None, :], p[None]).sum(axis=2)
    return out


def _block(most: int):
    def work(terms: pa.Table, groups: pa.Table) -> pa.Table:
        drop_cache()
        groups = groups.take(pc.sort_indices(groups["source"]))
        lang, kinds, sources = groups["lang"][0], groups["kinds"][0].as_py(), groups["source"].combine_chunks()
        total = groups["total"].to_numpy()
        if terms.num_columns and terms.num_rows:
            terms = terms.take(pc.sort_indices(terms["term"])).combine_chunks()
            names, lists = terms["term"].combine_chunks(), terms["counts"].combine_chunks()
            column = np.repeat(np.arange(len(names)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            row = pc.index_in(flat.field("source"), sources).to_numpy(zero_copy_only=False)
            count = np.zeros((len(sources), len(names)), np.int64)
            count[row, column] = flat.field("n").to_numpy(zero_copy_only=False)
        else:
            names, count = pa.array([], pa.string()), np.zeros((len(sources), 0), np.int64)
        p = shares(count, total[:, None], kinds)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        out = [(np.full(len(a), "pair"), a, sources.take(pa.array(b)), pair_matrix(p)[a, b])]
        q = shares(count.sum(axis=0), groups["lang_total"].to_numpy()[0], kinds)
        for k in range(len(sources)):
            own = np.flatnonzero((count[k] > 0) & (p[k] > q))
            f = divergences(p[k][own], q[own])
            best = np.argsort(-f, kind="stable")[:most]  # of equal values the smaller term, since terms are sorted
            out.append((np.full(len(best), "term"), np.full(len(best), k), names.take(pa.array(own[best])), f[best]))
        part, source, item, value = zip(*out)
        source = np.concatenate(source)
        return pa.table({"lang": pa.repeat(lang, len(source)), "source": sources.take(pa.array(source)), "part": pa.array(np.concatenate(part), pa.string()), "item": pa.concat_arrays([*item]), "value": pa.array(np.concatenate(value), pa.int64())})

    return work


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """docs (lang, source, text without nulls) -> lang, term, counts array<struct<source, n>>: terms in least_docs documents of the language at least."""
    counted = whole_texts(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_term.where(F.col("docs") >= least_docs).drop("docs")


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, most_terms: int = 200, block_terms: int = 4096) -> DataFrame:
    """docs -> lang, source, part, item, value long, rank int.

    A language keeps the V terms ([^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z lower-cased) in least_docs of its rows at least. A
    source of a language, and the language, gives a kept term p = 1 + floor(10**9 * (count + 1) / (N + V)): count of its
    occurrences, N the sum of counts. f = floor((p - q) ** 2 / q). Part `pair`: every other source of the language, the sum of f over all
    kept terms, q the other's. Part `term`: the terms with count > 0 and p > q, q the language's, up to rank most_terms.
    Ranks are by value, the greatest first, then by the item's UTF-8. All values are exact while a language has under 2**31 kept terms and 2.8e14 words.

    Null texts, languages and sources count as empty strings; repeated rows are documents of their own; a language
    without kept terms gives its pairs with value 0; a lone source gives no pairs; an empty table gives an empty result; other columns are ignored.
    Memory of a task: MOST_PAIRS counts while it reads, a matrix of about CELLS cells in a block (at least 64 terms wide), and one row per source of a term. The number of
    pairs is the result's own size. A block's matrix of a frequent source is no larger than another's, since counts are summed before.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = cut(kept_terms(docs, least_docs), "kept-terms")
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n")).alias("t")
    kinds = kept.groupBy("lang").agg(F.count("*").alias("v"))
    every = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("kinds"))
    width = F.greatest(F.lit(64), F.least(F.lit(block_terms), F.floor(F.lit(CELLS) / F.count("*").over(every))))
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kinds") / width)).cast("int")).withColumn("lang_total", F.sum("total").over(every))
    groups = cut(groups, "term-groups")
    langs = groups.select("lang", "blocks").distinct()
    langs = F.broadcast(langs) if langs.count() <= BROADCAST_ROWS else langs
    terms = kept.join(langs, "lang").select(F.col("lang"), F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), F.col("term"), F.col("counts"))
    sides = groups.select(F.col("lang").alias("lang"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("source").alias("source"), F.col("total").alias("total"), F.col("kinds").alias("kinds"), F.col("lang_total").alias("lang_total"))
    found = terms.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(_block(most_terms), "lang string, source string, part string, item string, value long")
    found = cut(found, "divergences")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(best)
