"""URL filters: exact membership of URL keys in lists by Bloom filter cascades, without joins.

A key is a host suffix of whole labels and a path prefix, written one after the other (`org/`, `example.org/en/1`, `example.net`). The
corpus's complete key universe is known: the keys of its URLs, of the shapes (labels, path characters) that lists have. Level 0 of a
cascade encodes the listed keys, level 1 the other keys of the universe that level 0 lets through, level 2 the listed keys
that level 1 lets through, and so on until none are left; so for every key of the universe the first level that
stops it tells exactly whether it is listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_cache
from .words import begins, mix

#: Rules that hold for every URL that they fit, the longest first.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words of host labels that put a host on the block list.
HOST_WORDS = (
    "ad", "ads", "adserver", "adult", "bet", "bets", "betting", "casino", "casinos", "cialis", "click", "crack", "escort", "escorts", "gambling", "jackpot",
    "loans", "lottery", "malware", "meds", "nude", "payday", "phishing", "pills", "poker", "popup", "porn", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx",
)
SHARD_KEYS = 500_000  # of the universe, in a shard's own cascade
SHIPPED_BYTES = 64_000_000  # of cascades that tasks get in one pass
MOST_LEVELS = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def url_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The URL's keys of these shapes as an array, the longest first, of equal ones that with the longer host."""
    labels, shape = _labels(host), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes])
    fit = F.filter(shape, lambda s: (s["n"] <= F.size(labels)) & (s["m"] <= F.length(path)))

    def key(s: Column) -> Column:
        suffix = F.array_join(F.slice(labels, -s["n"], s["n"]), ".")
        return F.struct((-F.length(suffix) - s["m"]).alias("long"), (-F.length(suffix)).alias("host"), F.concat(suffix, F.substring(path, F.lit(1), s["m"])).alias("key"))

    return F.transform(F.array_sort(F.transform(fit, key)), lambda s: s["key"])


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


# --- cascades --------------------------------------------------------------------------------------------------------


@dataclass
class Bloom:
    bits: np.ndarray  # bytes
    size: int
    hashes: int
    level: int

    @classmethod
    def of(cls, keys: np.ndarray, rate: float, level: int) -> Bloom:
        """keys: (n, 2) uint64; rate: of false positives."""
        hashes = max(1, round(np.log2(1 / rate)))
        size = max(64, int(len(keys) * np.log2(1 / rate) * 1.45) + 1)
        held = np.zeros(size, bool)
        out = cls(held, size, hashes, level)
        for at in out._places(keys):
            held[at] = True
        out.bits = np.packbits(held)
        return out

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix(keys[:, 0] ^ np.uint64(self.level + 1) * np.uint64(0x9E3779B97F4A7C15))
            step = mix(keys[:, 1] + np.uint64(self.level)) | np.uint64(1)
            for _ in range(self.hashes):
                yield (h % np.uint64(self.size)).astype(np.int64)
                h = mix(h + step)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def cascade(listed: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """Levels that tell the listed keys from all others; both (n, 2) uint64, without repeats or a common key."""
    levels: list[Bloom] = []
    inside, outside = listed, others
    while len(inside):
        if len(levels) > MOST_LEVELS:
            raise ValueError("two keys of the universe share all 128 bits of their hashes")
        rate = min(0.5, 0.7 * len(inside) / max(1, len(outside))) if not levels else 0.5
        levels.append(Bloom.of(inside, rate, len(levels)))
        inside, outside = outside[levels[-1].passes(outside)], inside
    return levels


def listed_by(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed: a key is if the first level that stops it is an odd one, or if none stops it
    and the last one is even."""
    out = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for k, level in enumerate(levels):
        passed = level.passes(keys[left])
        if k % 2:
            out[left[~passed]] = True
        left = left[passed]
    if len(levels) % 2:
        out[left] = True
    return out


def _pairs(table) -> np.ndarray:
    """Columns h1 and h2 as an (n, 2) uint64 array without repeats."""
    if not table.num_columns or not table.num_rows:
        return np.zeros((0, 2), np.uint64)
    both = np.stack([np.asarray(table.column(c)).astype(np.int64).view(np.uint64) for c in ("h1", "h2")], axis=1)
    return np.unique(both, axis=0)


def _members(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which rows of `keys` are rows of `of`; both without repeats."""
    if not len(of) or not len(keys):
        return np.zeros(len(keys), bool)
    both, back, n = np.unique(np.concatenate([keys, of]), axis=0, return_inverse=True, return_counts=True)
    return n[back.ravel()[: len(keys)]] > 1


def _build(universe: pa.Table, lists: pa.Table) -> pa.Table:
    drop_cache()
    every, out = _pairs(universe), []
    if lists.num_columns and lists.num_rows:
        shard = lists["shard"][0].as_py()
        names = np.array(lists["list"].to_pylist(), object)
        for name in sorted(set(names)):
            own = _pairs(lists.filter(pa.array(names == name)))
            inside = _members(every, own)
            out += [(shard, name, b.level, b.size, b.hashes, b.bits.tobytes()) for b in cascade(every[inside], every[~inside])]
    columns = zip(*out) if out else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "list", "level", "size", "hashes", "bits"])


def cascades(universe: DataFrame, lists: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """universe (key), lists (list, key) -> the cascades' levels (shard, list, level, size, hashes, bits), and the number of shards.

    Keys are dealt by hash into shards of about shard_keys; each shard's cascades are built in one task from its own keys.
    """
    h1, h2 = _hashes(F.col("key"))
    every = cut(universe.select("key").distinct().select(h1.alias("h1"), h2.alias("h2")), "url-keys")
    shards = max(1, -(-every.count() // shard_keys))
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")
    own = lists.where("key is not null").select("list", h1.alias("h1"), h2.alias("h2")).distinct().select(shard, "list", F.col("h1").alias("h1"), F.col("h2").alias("h2"))
    sides = every.select(shard, F.col("h1").alias("h1"), F.col("h2").alias("h2"))
    return cut(sides.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_build, "shard int, list string, level int, size long, hashes int, bits binary"), "cascades"), shards


def _lots(levels: DataFrame, most_bytes: int) -> Iterator[dict[int, dict[str, list[Bloom]]]]:
    """Shards' cascades in lots of at most most_bytes (one shard at least), by shard and list. The driver holds a lot at a time."""
    sizes = sorted((r["shard"], r["bytes"]) for r in levels.groupBy("shard").agg(F.sum(F.length("bits")).alias("bytes")).collect())
    while sizes:
        lot, room = [], most_bytes
        while sizes and (not lot or sizes[0][1] <= room):
            room -= sizes[0][1]
            lot.append(sizes.pop(0)[0])
        out: dict[int, dict[str, list[Bloom]]] = {}
        for r in sorted(levels.where(F.col("shard").isin(lot)).collect(), key=lambda r: (r["shard"], r["list"], r["level"])):
            out.setdefault(r["shard"], {}).setdefault(r["list"], []).append(Bloom(np.frombuffer(r["bits"], np.uint8), r["size"], r["hashes"], r["level"]))
        yield out


def _look_up(shipped, shards: int, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_cache()
        held = shipped.value
        for batch in batches:
            lists = batch.column("keys")
            flat, count = lists.flatten(), np.diff(np.asarray(lists.offsets).astype(np.int64))
            keys = np.stack([np.asarray(flat.field(c)).astype(np.int64).view(np.uint64) for c in ("h1", "h2")], axis=1) if len(flat) else np.zeros((0, 2), np.uint64)
            first = begins(np.cumsum(count))
            row = np.repeat(np.arange(len(count)), count)
            shard = keys[:, 0].view(np.int64) % shards
            columns = list(batch.columns[: batch.num_columns - len(names)])
            for k, name in enumerate(names):
                member = np.zeros(len(keys), bool)
                for s, by_list in held.items():
                    own = np.flatnonzero(shard == s) if shards > 1 else np.arange(len(keys))
                    member[own] = listed_by(by_list.get(name, []), keys[own])
                best = np.asarray(batch.column(batch.num_columns - len(names) + k).fill_null(1 << 30)).astype(np.int64)
                at = np.flatnonzero(member)
                np.minimum.at(best, row[at], at - first[row[at]])
                columns.append(pa.array(best, pa.int32(), mask=best == 1 << 30))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return work


def match_lists(pages: DataFrame, lists: DataFrame, url_col: str = "url", carry: tuple[str, ...] = ("page_id",), shard_keys: int = SHARD_KEYS, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """pages, lists (list string, key string) -> carry, host, path, matched map<string, string>; a row per row.

    matched: for each list that holds a key of the URL its longest one; of equally long ones that with the longer host. A key fits the
    hosts that are its host or end with a dot and it, if the path starts with its path. A null URL, or one without ://, has an empty host and path and matches nothing.
    Null keys are no keys; repeated ones count once; without lists the maps are empty. The lists' distinct shapes (labels, path characters) and names come to the
    driver: a few, or hundreds for long lists of whole URLs. Cascades go to tasks in lots of shipped_bytes; each lot more is one more pass over the URLs' hashes.
    Other columns are ignored; carried ones may be null or repeat.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*[F.col(c).alias(f"carry_{c}") for c in carry], host.alias("host"), path.alias("path"))
    lists = lists.where("key is not null").select("list", "key")
    host_of = F.regexp_extract("key", r"\A([^/]*)", 1)
    shapes = sorted(tuple(r) for r in lists.select(F.size(_labels(host_of)), F.length("key") - F.length(host_of)).distinct().collect())
    names = sorted(r["list"] for r in lists.select("list").distinct().collect())
    carried = [*[F.col(f"carry_{c}").alias(c) for c in carry], F.col("host"), F.col("path")]
    if not shapes:
        return rows.select(*carried, F.create_map().cast("map<string,string>").alias("matched"))
    keys = url_keys(F.col("host"), F.col("path"), shapes)
    levels, shards = cascades(rows.select(F.explode(keys).alias("key")), lists, shard_keys)
    hashed = rows.withColumn("keys", F.transform(keys, lambda k: F.struct(_hashes(k)[0].alias("h1"), _hashes(k)[1].alias("h2"))))
    found = hashed.withColumns({f"at_{k}": F.lit(None).cast("int") for k in range(len(names))})
    for n, lot in enumerate(_lots(levels, shipped_bytes)):
        if n:
            found = cut(found, "url-matches")
        found = found.mapInArrow(_look_up(pages.sparkSession.sparkContext.broadcast(lot), shards, names), found.schema)
    entry = F.array(*[F.struct(F.lit(name).alias("key"), F.get(keys, F.col(f"at_{k}")).alias("value")) for k, name in enumerate(names)])
    return found.select(*carried, F.map_from_entries(F.filter(entry, lambda e: e["value"].isNotNull())).alias("matched"))


def listed_hosts(pages: DataFrame, url_col: str = "url", words: tuple[str, ...] = HOST_WORDS) -> DataFrame:
    """key: for each host of the corpus with a label, but the last, that holds one of the words (split at what isn't a-z),
    the host from its last such label on; so the key fits the host's sisters too."""
    labels = _labels(F.col("host"))
    own = F.slice(labels, F.lit(1), F.size(labels) - 1)
    bad = F.transform(own, lambda x, i: F.when(F.arrays_overlap(F.split(x, "[^a-z]+"), F.array(*map(F.lit, words))), i + 1))
    hosts = pages.select(host_and_path(F.col(url_col))[0].alias("host")).distinct().withColumn("at", F.array_max(bad))
    return hosts.where("at is not null").select(F.array_join(F.slice(labels, F.col("at"), F.size(labels)), ".").alias("key")).distinct()


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked: DataFrame | None = None) -> DataFrame:
    """The contract's columns of op13: page_id, host, path, rule, verdict; and blocked_key.

    The longest rule that fits decides (allow or block). Without one a URL is blocked if it has a key of `blocked` (key string; default: listed_hosts of the
    pages), else allowed. blocked_key: its longest such key, whatever the rules say.
    """
    blocked = listed_hosts(pages) if blocked is None else blocked.select("key")
    spark = pages.sparkSession
    lists = spark.createDataFrame([(f"rule {verdict}", key) for key, verdict in rules], "list string, key string").unionByName(blocked.select(F.lit("blocked").alias("list"), "key"))
    allow, block, listed = (F.element_at("matched", F.lit(f)) for f in ("rule allow", "rule block", "blocked"))
    longer = lambda a, b: F.when(b.isNull() | (F.length(a) > F.length(b)), a).when(a.isNull() | (F.length(b) > F.length(a)), b).when(F.length(F.substring_index(a, "/", 1)) > F.length(F.substring_index(b, "/", 1)), a).otherwise(b)
    found = match_lists(pages, lists).select("page_id", "host", "path", allow.alias("a"), block.alias("b"), listed.alias("blocked_key"))
    found = found.withColumn("rule", longer(F.col("a"), F.col("b")))
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("blocked_key").isNull(), "allow").otherwise("block")).when(F.col("rule") == F.col("a"), "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "blocked_key")
