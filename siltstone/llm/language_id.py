"""Language ID: a linear-chain conditional random field over words, decoded by forward-backward.

A word's emission scores sum learned weights of its character n-grams, affixes and lexicon entry; they depend on the
word alone, so each Python worker keeps them for chunks met before. A white-space chunk of up to 32 characters is one word;
a longer one is cut at what isn't a letter, and what is still longer into pieces of 32, so each of its letters counts. Transitions between languages are learned from
chains that splice stretches of differently labelled documents, as code-switched text does. Prediction cuts a text
into chains of `chain` words, runs forward-backward over all chains of a batch at once, and averages the words' marginals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_texts, worker_cache
from .words import Column, Known, begins, split_words, stretches, text_slices

WIDTH = 32  # the most characters of a word
CELLS = 6_000_000  # words of the sample x languages, at most; the fit's memory and time grow with them
BITS = 15
MARK = 1  # stands for a word's ends and for what isn't a letter


def spell(chunk: str) -> list[str]:
    """The words of a white-space chunk, lower-cased, with marks in place of what isn't a letter; none without letters."""
    low = chunk.lower()
    if not low.isalpha():
        low = "".join(c if c.isalpha() else "\x01" for c in low).strip("\x01")
    if len(low) <= WIDTH:
        return [low] if low else []
    return [w[k : k + WIDTH] for w in low.split("\x01") for k in range(0, len(w), WIDTH)]


def features(words: list[str], width: int = WIDTH) -> np.ndarray:
    """Hashed feature numbers, one row per word; 0 stands for no feature. width: characters of the longest word at least;
    it changes nothing but the number of empty columns."""
    n, mask = len(words), np.uint32((1 << BITS) - 1)
    letters = np.zeros((n, width + 2), np.uint32)
    letters[:, 0] = MARK
    spelt = np.array(words, f"<U{width}").view(np.uint32).reshape(n, width)
    letters[:, 1:-1] = spelt
    length = (spelt > 0).sum(axis=1)
    letters[np.arange(n), length + 1] = MARK
    out = []
    with np.errstate(over="ignore"):
        for size in (1, 2, 3, 4):
            h = np.full((n, width + 3 - size), np.uint32(size * 7919), np.uint32)
            for k in range(size):
                h = (h ^ letters[:, k : width + 3 - size + k]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(13)
            h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            there = np.arange(width + 3 - size)[None, :] <= (length + 2 - size)[:, None]
            h = np.where(there, np.maximum(h & mask, 1), 0)
            if size == 4:  # affixes of three letters only
                last = np.maximum(length + 2 - size, 0)
                h = np.stack([h[:, 0], h[np.arange(n), last]], axis=1)
            out.append(h)
    return np.concatenate(out, axis=1)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    lexicon: dict[str, np.ndarray]
    moves: np.ndarray  # log scores from language to language
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for low, width in ((0, 6), (6, 10), (10, 16), (16, WIDTH)):
            own = np.flatnonzero((length > low) & (length <= width))
            for a in range(0, len(own), 10_000):
                lot = own[a : a + 10_000]
                out[lot] = self.weights[features([words[k] for k in lot], width)].sum(axis=1)
        get = self.lexicon.get
        for k, w in enumerate(words):
            if (known := get(w)) is not None:
                out[k] += known
        return out


def forward_backward(scores: np.ndarray, length: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scores: steps x chains x languages, zero beyond a chain's length. Marginals, forward and backward vectors (scaled)."""
    steps, chains, n = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(moves - moves.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    f = e[0] * np.exp(start - start.max())
    forward[0] = f / f.sum(axis=1, keepdims=True)
    for k in range(1, steps):
        f = (forward[k - 1] @ t) * e[k]
        f /= f.sum(axis=1, keepdims=True)
        forward[k] = np.where((k < length)[:, None], f, forward[k - 1])
    for k in range(steps - 2, -1, -1):
        b = (e[k + 1] * backward[k + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        backward[k] = np.where((k + 1 < length)[:, None], b, 1.0)
    m = forward * backward
    m /= m.sum(axis=2, keepdims=True)
    return m, forward, backward


def _row_sums(table: np.ndarray, at: np.ndarray, first: np.ndarray, cells: int = 500_000) -> np.ndarray:
    """Sums of the table's rows at[first[k] : first[k + 1]], by lots of about `cells` numbers."""
    out = np.empty((len(first), table.shape[1]), table.dtype)
    ends = np.append(first[1:], len(at))
    a = 0
    while a < len(first):
        z = max(a + 1, int(np.searchsorted(ends, first[a] + cells // table.shape[1], side="right")))
        out[a:z] = np.add.reduceat(table[at[first[a] : ends[z - 1]]], first[a:z] - first[a], axis=0)
        a = z
    return out


def expected_moves(f: np.ndarray, b: np.ndarray, scores: np.ndarray, both: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Languages x languages: how often each move is expected, over all steps whose two places are real. One matrix product a
    step, so memory grows with chains x languages."""
    t = np.exp(moves - moves.max()).astype(np.float64)
    out = np.zeros_like(t)
    for k in range(len(both)):
        left = f[k][both[k]].astype(np.float64)
        inner = np.exp(scores[k + 1] - scores[k + 1].max(axis=1, keepdims=True))[both[k]] * b[k + 1][both[k]].astype(np.float64)
        out += (left / ((left @ t) * inner).sum(axis=1, keepdims=True)).T @ inner
    return t * out


def train(texts: list[tuple[str, list[str]]], chain: int = 64, rounds: int = 60, rate: float = 0.25, lexicon_count: int = 5, seed: int = 7, settled: float = 1e-4) -> Model | None:
    """texts: (language, its words). Adagrad on the conditional log-likelihood of spliced chains, until `rounds` or until
    five rounds have raised the mean marginal of the right language by less than `settled`."""
    langs = sorted({lang for lang, _ in texts})
    pieces = []
    rng = np.random.default_rng(seed)
    for lang, chunks in texts:
        words = [w for c in chunks for w in spell(c)]
        at = 0
        while at < len(words):
            n = int(rng.choice([6, 16, chain]))
            pieces.append((langs.index(lang), words[at : at + n]))
            at += n
    if not pieces:
        return None
    rng.shuffle(order := np.arange(len(pieces)))
    names: dict[str, int] = {}
    tokens = np.array([names.setdefault(w, len(names)) for k in order for w in pieces[k][1]])
    labels = np.array([pieces[k][0] for k in order for _ in pieces[k][1]])
    n = len(langs)
    words = list(names)
    count = np.bincount(tokens, minlength=len(words))
    own = {w: k for k, w in enumerate(w for w in words if count[names[w]] >= lexicon_count)}
    entry = np.array([own.get(w, -1) for w in words])
    lots = []  # the driver fits, so it holds features of so many words at a time
    for a in range(0, len(words), 10_000):
        rows = features(words[a : a + 10_000])
        lots.append((rows[rows > 0], (rows > 0).sum(axis=1)))
    flat, sizes = (np.concatenate(x) for x in zip(*lots))
    first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    by_feature = np.argsort(flat, kind="stable")
    sorted_flat, sorted_owner = flat[by_feature], owner[by_feature]
    feature_first = np.flatnonzero(np.concatenate([[True], sorted_flat[1:] != sorted_flat[:-1]]))
    del lots, rows, owner, by_feature
    chains = -(-len(tokens) // chain)
    padded = np.zeros(chains * chain, np.int64)
    padded[: len(tokens)] = tokens
    gold = np.full(chains * chain, -1)
    gold[: len(labels)] = labels
    ids, gold = padded.reshape(chains, chain).T, gold.reshape(chains, chain).T
    length = (gold >= 0).sum(axis=0)
    real = gold >= 0
    hot = np.zeros((chain, chains, n), np.float32)
    hot[real, gold[real]] = 1
    w, lex, moves, start = np.zeros((1 << BITS, n), np.float32), np.zeros((len(own), n), np.float32), np.eye(n, dtype=np.float32), np.zeros(n, np.float32)
    sums = [np.full_like(x, 1e-2) for x in (w, lex, moves, start)]
    known = entry >= 0
    both = real[1:] & real[:-1]
    gold_moves = np.bincount(gold[:-1][both] * n + gold[1:][both], minlength=n * n).reshape(n, n)
    right: list[float] = []
    for _ in range(rounds):
        e = _row_sums(w, flat, first)
        e[known] += lex[entry[known]]
        scores = np.where(real[:, :, None], e[ids], 0).astype(np.float32)
        m, f, b = forward_backward(scores, length, moves, start)
        right.append(float((m * hot).sum()) / len(tokens))
        if len(right) > 10 and right[-1] - right[-6] < settled:
            break
        gap = np.where(real[:, :, None], hot - m, 0)
        by_word = np.stack([np.bincount(ids.ravel(), gap[:, :, k].ravel(), len(words)) for k in range(n)], axis=1)
        g_w = np.zeros((1 << BITS, n))
        g_w[sorted_flat[feature_first]] = _row_sums(by_word, sorted_owner, feature_first)
        g_lex = by_word[known]
        g_moves = gold_moves - expected_moves(f, b, scores, both, moves)
        g_start = (hot[0] - m[0]).sum(axis=0)
        for x, s, g in zip((w, lex, moves, start), sums, (g_w, g_lex, g_moves, g_start)):
            g = (g / max(1, len(tokens)) * 100 - 1e-3 * x).astype(np.float32)
            s += g * g
            x += rate * g / np.sqrt(s)
    return Model(langs, w, {k: lex[v] for k, v in own.items()}, moves, start)


class Tagger(Known):
    """Marginals for batches of texts; keeps the emission scores of known chunks."""

    def __init__(self, model: Model, chain: int = 64):
        self.model, self.chain = model, chain
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.first, self.count, self.scores = Column(np.int64), Column(np.int64), Column(np.float32, (len(self.model.langs),))

    def learn(self, chunks: list[str]) -> None:
        spelt = [spell(c) for c in chunks]
        own: dict[str, int] = {}
        word = np.array([own.setdefault(w, len(own)) for ws in spelt for w in ws], np.int64)
        count = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.first.add(self.scores.n + np.cumsum(count) - count)
        self.count.add(count)
        self.scores.add(self.model.emissions(list(own))[word])
        self.bytes += 4 * len(self.model.langs) * len(word)

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts without nulls -> words x languages, one text after the other, and where each text's words end."""
        number, ends, distinct = split_words(texts)
        chunk = self.look_up(distinct)[number]
        first, count = self.first.values[chunk], self.count.values[chunk]
        scores = self.scores.values[stretches(first, count)]
        ends = np.concatenate([[0], np.cumsum(count)])[ends]
        if not len(scores):
            return scores, ends
        sizes = ends - begins(ends)
        chains = -(-sizes // self.chain)
        place = np.arange(len(scores)) - np.repeat(begins(ends), sizes)
        row = np.repeat(np.cumsum(chains) - chains, sizes) + place // self.chain
        step = place % self.chain
        grid = np.zeros((int(step.max()) + 1, int(chains.sum()), scores.shape[1]), np.float32)
        grid[step, row] = scores
        return forward_backward(grid, np.bincount(row), self.model.moves, self.model.start)[0][step, row], ends


def summaries(m: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the most likely language's number, its mean marginal, words, and changes from word to word."""
    first = begins(ends)
    sizes = ends - first
    best, mean, switches = np.zeros(len(ends), np.int64), np.zeros(len(ends)), np.zeros(len(ends), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        means = np.add.reduceat(m, first[some], axis=0, dtype=np.float64) / sizes[some, None]
        best[some] = means.argmax(axis=1)
        mean[some] = np.minimum(1.0, means.max(axis=1))
        top = m.argmax(axis=1)
        changed = np.concatenate([[False], top[1:] != top[:-1]])
        changed[first[some]] = False
        switches[some] = np.add.reduceat(changed.astype(np.int64), first[some])
    return best, mean, sizes, switches


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, use: Column, per_lang: int, words: int, most_rows: int) -> list[tuple[str, list[str]]]:
    """At most 2 x most_rows labelled rows, about per_lang of each language, chosen by a hash (of the text where the id is null), and a stretch of `words` words of each.

    With many languages both shrink until words x languages of the whole sample are about CELLS: first the rows, down
    to 16 a language, then the words, down to 20.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & use).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = cut(labelled.groupBy("lang").count(), "languages")  # one row per language
    langs = counts.count()
    room = CELLS // max(1, langs) ** 2  # words of a language
    per_lang = max(16, min(per_lang, room // words))
    words = max(20, min(words, room // per_lang))
    draw = F.pmod(F.when(F.col("id").isNull(), F.xxhash64(F.lit("draw"), "text")).otherwise(F.xxhash64(F.lit("draw"), "id")), F.lit(1 << 30))
    share = F.least(F.lit(1.0), F.lit(min(per_lang, most_rows / max(1, langs))) / F.col("count")) * (1 << 30)
    # in the order of the hash, so that a run again draws the same rows
    drawn = labelled.join(counts, "lang").withColumn("draw", draw).where(F.col("draw") < share).orderBy("draw", F.xxhash64("text"), "id").limit(2 * most_rows)
    split = F.split(F.trim("text"), r"\s+")
    cutout = F.slice("all", (F.pmod(F.xxhash64(F.lit("from"), "id"), F.greatest(F.size("all") - words, F.lit(1))) + 1).cast("int"), words)
    return sorted((r["lang"], r["words"]) for r in drawn.withColumn("all", split).select("lang", cutout.alias("words")).collect())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, per_lang: int = 400, most_rows: int = 20_000, words_per_row: int = 200, chain: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, n_words, n_switches, and the carried columns.

    The field is fitted on about per_lang rows of each language (2 x most_rows in all at most), words_per_row words of
    each (fewer of both with over 12 languages, see training_rows), among rows with a language and text whose crc32(id as text) mod folds is not held_fold. lang_pred is `und`
    with score 0 for a null text, a text without letters, or when there is nothing to learn from; n_switches counts
    changes of the most likely language from word to word. A null id is held in no fold. Repeated rows come back
    repeated, texts of any length are read whole, and so are words (see spell); an empty table gives an empty result,
    other columns are ignored.
    """
    fold = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds
    held = F.coalesce(fold == held_fold, F.lit(False))
    model = train(training_rows(docs, id_col, text_col, lang_col, ~held, per_lang, words_per_row, most_rows), chain)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))  # 2**15 weights and a lexicon per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, model = shared.value
        tagger = worker_cache(("tagger", token), lambda: Tagger(model or Model(["und"], np.zeros((1 << BITS, 1), np.float32), {}, np.zeros((1, 1)), np.zeros(1)), chain))
        langs = np.array([*tagger.model.langs, "und"], object)
        for b in batches:
            found = [summaries(*tagger.marginals(texts)) for _, _, texts in text_slices(b.column(2), 1_000_000)]
            best, mean, words, switches = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
            lang = langs[np.where(words > 0, best, len(langs) - 1)]
            score = np.where(lang == "und", 0.0, mean)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(words, pa.int64()), pa.array(switches, pa.int64()), *b.columns[3:]], ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches", *carry])

    rows = whole_texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), *carry)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long{kinds}")
