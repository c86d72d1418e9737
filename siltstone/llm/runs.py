"""Periodic runs of words: a Lyndon stack scanned right to left under both orders of the words.

Of a text's words, only stretches in which each word recurs soon enough to stand in a run are scanned; this screen is a
necessary condition over whole arrays, so it loses no run. In a stretch the stack gives the longest Lyndon word at each
place, under the order of word numbers and under the reverse; each run has such a word as its root. Comparisons and extensions ask for
longest common extensions, found by binary search over rolling hashes; each answer is verified word by word, but for
what an earlier answer at the same distance verified, so the checks of a text stay linear in it for each distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_cache, whole_texts
from .words import begins, split_words, text_slices

PRIME = (1 << 61) - 1
POINT = 0x1B873593CC9E2D51 % PRIME
DIRECT = 8  # words compared one by one before hashes are asked


class Extensions:
    """Longest common extensions of the places of one word sequence."""

    def __init__(self, words: np.ndarray):
        self.array, self.words = words, words.tolist()
        self.n = len(words)
        self.hashes, self.powers = [0], [1]
        h, p = 0, 1
        for w in self.words:
            h = (h * POINT + w + 1) % PRIME
            p = p * POINT % PRIME
            self.hashes.append(h)
            self.powers.append(p)
        #: By distance: the stretch [from, to) whose words equal those at the distance; they differ at `to`, or it is the end.
        self.known: dict[int, tuple[int, int]] = {}

    def alike(self, i: int, j: int, length: int) -> bool:
        h, p = self.hashes, self.powers[length]
        return (h[i + length] - h[i] * p - h[j + length] + h[j] * p) % PRIME == 0

    def right(self, i: int, j: int) -> int:
        """The number of words from i on that equal those from j on, i < j."""
        words, most = self.words, self.n - j
        k, near = 0, min(DIRECT, most)
        while k < near and words[i + k] == words[j + k]:
            k += 1
        if k < near or k == most:
            return k
        start, stop = self.known.get(j - i, (self.n, self.n))
        if start <= i + k and i < stop:
            self.known[j - i] = min(i, start), stop
            return stop - i
        step = k
        while k + step <= most and self.alike(i, j, k + step):
            k += step
            step *= 2
        low, high = k, min(most, k + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.alike(i, j, mid) else (low, mid - 1)
        fresh = min(low, start - i) if i < start <= i + low else low
        differ = np.flatnonzero(self.array[i : i + fresh] != self.array[j : j + fresh])
        if len(differ):  # two hashes were equal by chance
            low = int(differ[0])
        elif fresh < low:
            low = stop - i
        while i < self.n and j + low < self.n and words[i + low] == words[j + low]:
            low += 1
        self.known[j - i] = (i, i + low)
        return low

    def left(self, i: int, j: int) -> int:
        """The number of words before i that equal those before j, i < j."""
        words, k = self.words, 0
        near = min(DIRECT, i)
        while k < near and words[i - k - 1] == words[j - k - 1]:
            k += 1
        if k < near or k == i:
            return k
        low, high = k, i
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.alike(i - mid, j - mid, mid) else (low, mid - 1)
        differ = np.flatnonzero(self.array[i - low : i] != self.array[j - low : j])
        if len(differ):
            return low - 1 - int(differ[-1])
        while low < i and words[i - low - 1] == words[j - low - 1]:
            low += 1
        return low


def lyndon_runs(numbers: np.ndarray, exponent: int = 4, least: int = 6) -> set[tuple[int, int, int]]:
    """All (start, length, period) of maximal stretches of smallest period `period` and length >= max(least, exponent * period), exponent >= 2."""
    lce = Extensions(numbers)
    words, n, found = lce.words, lce.n, set()
    for rising in (True, False):
        end = [n] * (n + 1)  # of the longest Lyndon word at each place; following it from place to place is the stack
        last: dict[int, int] = {}
        for i in range(n - 1, -1, -1):
            own, j = words[i], i + 1
            while j < n:
                if own != words[j]:
                    below = own < words[j]
                else:
                    k = lce.right(i, j)
                    if j + k == n:  # the later suffix begins the earlier one, so it is the smaller
                        break
                    below = words[i + k] < words[j + k]
                if below != rising:
                    break
                j = end[j]
            end[i] = j
            period = j - i
            if i + (exponent - 1) * period > n or j == n or words[j] != own or last.get(period, n) <= i:
                continue
            length = lce.right(i, j)
            if length < (exponent - 2) * period:
                continue
            before = lce.left(i, j)
            start, length = i - before, before + length + period
            last[period] = start
            if length >= max(least, exponent * period):
                found.add((start, length, period))
    return found


def stretches_with_runs(words: np.ndarray, text: np.ndarray, ends: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches [from, to) of places that hold all runs. words: numbers, text: each word's text, ends: of texts.

    In a run of period q, all but the last q words recur within q words. So for periods over 2**(k-1) and up to 2**k, a
    run lies in (exponent - 1) * q places in a row that recur within 2**k words, and the 2**k places after them.
    """
    n = len(words)
    order = np.argsort(text * (int(words.max()) + 1) + words, kind="stable") if n else np.zeros(0, np.int64)
    same = (words[order[1:]] == words[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    ahead = np.full(n, n + 1, np.int64)
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    longest = int(np.diff(np.concatenate([[0], ends])).max(initial=0))
    starts, stops = [], []
    reach = 1
    while exponent * (reach // 2 + 1) <= longest or reach == 1:
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = ahead <= reach
        step = np.diff(near)
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        q = reach // 2 + 1 if reach > 1 else 1
        kept = b - a >= max((exponent - 1) * q, least - reach)
        a, b = a[kept], b[kept]
        starts.append(a)
        stops.append(np.minimum(b + reach, ends[text[a]]) if len(a) else b)
        reach *= 2
    starts, stops = np.concatenate(starts), np.concatenate(stops)
    out: list[tuple[int, int]] = []
    for k in np.lexsort((stops, starts)):
        a, b = int(starts[k]), int(stops[k])
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _slice_runs(texts: pa.Array, seeds: pa.Array, exponent: int, least: int) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """For each text its runs by start and period, and the text without their repeats."""
    number, ends, distinct = split_words(texts, ascii_only=True)
    first = begins(ends)
    for k in np.flatnonzero(seeds.is_valid().to_numpy(zero_copy_only=False)):
        seed, n = seeds[int(k)].as_py(), int(ends[k] - first[k])
        if n:
            a = seed % n
            p = 1 + (n - a) // (3 + seed % 8)
            own = number[first[k] : ends[k]]
            own[a:] = own[a + np.arange(n - a) % p]
    text = np.repeat(np.arange(len(ends)), ends - first)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(ends))]
    kept = np.ones(len(number), bool)
    for a, b in stretches_with_runs(number, text, ends, exponent, least):
        k = int(text[a])
        for start, length, period in lyndon_runs(number[a:b], exponent, least):
            runs[k].append((a + start - int(first[k]), length, period))
            kept[a + start + period : a + start + length] = False
    count = np.concatenate([[0], np.cumsum(kept)])[ends]
    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], count]), pa.int32()), distinct.take(pa.array(number[kept])))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs], pc.binary_join(words, " ")


def find_runs(docs: DataFrame, text_col: str = "text", seed: str | None = None, carry: tuple[str, ...] = ("doc_id",), exponent: int = 4, least: int = 6) -> DataFrame:
    """docs -> carry, n_words long, runs array<struct<start long, length long, period long>>, collapsed string; a row per row.

    A run is a stretch of consecutive words with smallest period q and length >= max(least, exponent * q) that no
    neighbouring word extends; runs come by start, then period. collapsed: the words outside of all runs' repeats (what a run
    holds after its first q words), joined by one space. Words are [^\\x20\\x09-\\x0D]+ as they are written.
    seed: a column of longs; where it isn't null the words are made periodic first: with n words, a = seed % n and
    p = 1 + (n - a) // (3 + seed % 8), word i >= a becomes word a + (i - a) % p.
    A null text counts as empty: no words, no runs, an empty collapsed text. Carried columns pass as they are, nulls and repeated rows
    included; other columns are ignored, whatever their names. Nothing is shuffled; a task holds a batch of texts, and a text of n words
    costs n log n at most, and memory in proportion to n.
    """
    rows = docs.select(*[F.col(c).alias(f"carry_{c}") for c in carry], F.col(text_col).alias("own_text"), (F.lit(None) if seed is None else F.col(seed)).cast("long").alias("own_seed"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)]] + ["n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for a, b, texts in text_slices(batch.column("own_text")):
                runs, collapsed = _slice_runs(texts, batch.column("own_seed").slice(a, b - a), exponent, least)
                count = pc.list_value_length(pc.ascii_split_whitespace(pc.ascii_trim(texts, " \t\n\r\x0b\x0c")))
                count = pc.if_else(pc.equal(pc.binary_length(pc.ascii_trim(texts, " \t\n\r\x0b\x0c")), 0), 0, count).cast(pa.int64())
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), spans)
                own = [batch.column(c).slice(a, b - a) for c in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*own, count, lists.cast(kind), collapsed.cast(pa.string())], [*[f"carry_{c}" for c in carry], "n_words", "runs", "collapsed"])

    return whole_texts(rows).mapInArrow(work, schema).select(*[F.col(f"carry_{c}").alias(c) for c in carry], "n_words", "runs", "collapsed")


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of op11: doc_id, n_runs, the run of greatest length, digests of all runs and of the collapsed text.

    A document whose crc32(doc_id) divides by ten is made periodic first, with floor(crc32 / 10) as its seed; one without
    doc_id isn't.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    seeded = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("seed"))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = find_runs(seeded, seed="seed").withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
