"""Periodic runs, the source divergence audit and URL filters against brute force, SQL and edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from siltstone.llm.divergence import audit_sources, pair_matrix, shares
from siltstone.llm.queries import oracle_sql
from siltstone.llm.runs import _slice_runs, find_runs, lyndon_runs, run_digests
from siltstone.llm.url_filters import RULES, cascade, judge_urls, listed_by, match_lists

DOCS = "doc_id long, text string, lang string, source string, runs string, words string, carry_doc_id string, own_text string"


# --- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(w, exponent=4, least=6):
    out = []
    for p in range(1, len(w) // exponent + 1):
        x = 0
        while x < len(w) - p:
            y = x
            while y < len(w) - p and w[y] == w[y + p]:
                y += 1
            length = y - x + p
            if y > x and length >= max(least, exponent * p) and not any(all(w[z] == w[z + d] for z in range(x, y + p - d)) for d in range(1, p)):
                out.append((x, length, p))
            x = max(y, x + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    k = rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 3)):
        root = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words[at:at] = (root * 8)[: rng.randint(1, len(root) * 8)]
    return words


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_lyndon_runs_equal_brute_force(exponent):
    rng = random.Random(exponent)
    for _ in range(700):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 4))]
        least = rng.choice([1, 6])
        want = [brute_runs(w, exponent, least) for w in texts]
        for w, runs in zip(texts, want):
            assert lyndon_runs(np.array(w, np.int64), exponent, least) == set(runs)
        got, _ = _slice_runs(pa.array([" ".join(map(str, w)) for w in texts], pa.string()), pa.nulls(len(texts), pa.int64()), exponent, least)
        assert got == want


def test_runs_of_long_texts_take_near_linear_time():
    for words, runs in (([0] * 100_000, {(0, 100_000, 1)}), ([0, 1, 0, 2, 1] * 20_000, {(0, 100_000, 5)}), (list(range(5000)) * 6, {(0, 30_000, 5000)})):
        assert lyndon_runs(np.array(words)) == runs
    rng = random.Random(3)
    words = [rng.randrange(10_000) for _ in range(20_000)]
    words[7000:7000] = list(range(20_000, 20_300)) * 4  # found between long stretches without any run
    assert lyndon_runs(np.array(words)) == {(7000, 1200, 300)}


def digests_of(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_digests_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, " \n"[i % 2].join(f"w{x}é" for x in periodic_words(rng)) + "\t" * (i % 3)) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x0b\x0c\r "), (None, "a a a a a a a"), (1003, "a\u00a0b a\u00a0b A\u2028 x"), (1004, "no " * 3000), (1004, "no " * 3000), (1005, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "l", "s", "clash", "clash", "clash", "clash") for i, t in rows], DOCS).repartition(3)
    got = [tuple(r) for r in run_digests(docs).collect()]
    assert sorted(got, key=str) == sorted((digests_of(i, t) for i, t in rows), key=str)
    assert run_digests(docs.limit(0)).count() == 0
    row = find_runs(docs.where("doc_id = 1004"), carry=("doc_id", "lang")).first()
    assert (row.lang, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("l", 3000, [(0, 3000, 1)], "no")


# --- source divergence audit -----------------------------------------------------------------------------------------


def test_shares_and_pairs_are_exact():
    rng = random.Random(2)
    count = [rng.randrange(10**k) for k in range(1, 15) for _ in range(20)]
    for total, kinds in ((max(count), 1), (2 * 10**14, 5 * 10**8), (max(count) + 7, 12345)):
        got = shares(np.array(count, np.int64), np.int64(total), kinds)
        assert got.tolist() == [1 + 10**9 * (c + 1) // (total + kinds) for c in count]
    count = np.array([[rng.choice([0, 0, 1, 10**12, rng.randrange(1, 10**6)]) if k % 3 else (j == k) * 10**13 for j in range(300)] for k in range(9)], np.int64)
    p = shares(count, count.sum(axis=1)[:, None], 300)  # a row's sum is near 10**9, so sums of divergences stay in 64 bits
    want = [[sum((a - b) ** 2 // b for a, b in zip(map(int, x), map(int, y))) for y in p] for x in p]
    assert pair_matrix(p).tolist() == want


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], DOCS).repartition(3)
    return sorted(tuple(r) for r in audit_sources(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def audit_by_sql(rows):
    db = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    db.register("documents", documents)
    return sorted(db.sql(f"SELECT lang, source, part, item, value, rank FROM ({oracle_sql()['op12_source_divergence']})").fetchall())


def test_audit_equals_sql(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklé日" for b in ("", "X", "zz", "ß", "\u00a0")]
    rows = [(i, rng.choice([" ", "1", "-\n"]).join(rng.choice(vocabulary[: rng.choice([5, 20, 60])]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "ß", None, ""])) for i in range(160)]
    rows += [(900, None, "en", "s1"), (901, "", None, None), (None, "a b c", "xx", "only"), (902, "lonely words", "yy", "p"), (903, None, "yy", "q"), (904, "the " * 20_000, "en", "s2"), rows[0], rows[0]]
    want = audit_by_sql(rows)
    assert audited(spark, rows) == want and len({r[0] for r in want}) == 4
    assert audited(spark, rows, block_terms=3) == want  # several blocks a language (64 terms is the least)
    assert audited(spark, []) == []


def test_audit_ranks_are_cut_after_200(spark):
    rows = [(i, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(300)), "en", "s1" if i < 3 else "s2") for i in range(3)] + [(9, "aax other", "en", "s2")]
    got = audited(spark, rows)
    assert got == audit_by_sql(rows) and max(r[5] for r in got if r[2] == "term") == 200


# --- URL filters -----------------------------------------------------------------------------------------------------


def test_cascades_are_exact():
    rng = np.random.default_rng(5)
    for listed, others in ((0, 50), (1, 0), (1, 5000), (400, 400), (3000, 200), (500, 60_000)):
        keys = np.unique(rng.integers(0, 1 << 63, (listed + others, 2)).astype(np.uint64), axis=0)
        keys = keys[rng.permutation(len(keys))]
        levels = cascade(keys[:listed], keys[listed:])
        assert listed_by(levels, keys).tolist() == [True] * listed + [False] * others
        bits = sum(level.size for level in levels)
        assert bits <= 64 * len(levels) + listed * 1.5 * (np.log2(1 + others / max(1, listed)) + 6)


def brute_match(url, lists):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = re.sub(r"[?#].*", "", url.split("://", 1)[1], flags=re.S)
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    best = {}
    for name, key in lists:
        k_host, slash, k_path = key.partition("/")
        if (host == k_host or host.endswith("." + k_host)) and path.startswith(slash + k_path) and host:
            best[name] = max(best.get(name, (0, 0, "")), (len(key), len(k_host), key))
    return host, path, {n: k for n, (_, _, k) in best.items()}


@pytest.mark.parametrize("options", [{}, {"shard_keys": 40, "shipped_bytes": 60}])
def test_matches_equal_brute_force(spark, options):
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "news", "org", "xn--é", ""])
    host = lambda most: ".".join(label() for _ in range(rng.randint(1, most)))
    path = lambda: "".join(rng.choice(["/", "/en", "1", "é"]) for _ in range(rng.randint(0, 4)))
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host(4).upper() if rng.random() < 0.3 else host(4)}{rng.choice(['', '/'])}{path()}{rng.choice(['', '?q=://x/', '#top', '/?'])}" for _ in range(300)]
    urls += [None, "", "no url", "://", "http://a\n.b/c", "http://" + "x." * 3000 + "org/" + "y" * 5000] + urls[:5]
    lists = [(rng.choice(["one", "two"]), host(2) + rng.choice(["", "/" + path()])) for _ in range(60)] + [("one", None), ("two", "org/"), ("two", "org/")]
    lists = [x for x in lists if x[1] != ""]
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, keys string, at_0 string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.matched) for r in match_lists(pages, spark.createDataFrame(lists, "list string, key string"), **options).collect()}
    known = [x for x in lists if x[1] is not None]
    # an empty host has the empty label, which no list here names
    assert got == {i: (h, p, m) for i, u in enumerate(urls) for h, p, m in [brute_match(u, known)]}
    assert any(len(m) == 2 for _, _, m in got.values()) and any(not m for _, _, m in got.values())


def test_judged_urls_equal_sql(spark):
    urls = ["HTTP://A.Org/x", "x://org", "x://org/", "x://borg/", "://example.org/en/1/?q", "a://www.example.org/en/1#", "a://sub.example.org/es/", "a://b.com/fr/x", "a://casino-x.b.com/fr/y", "a://casino-x.b.net", "q://casino-x.b.net?x", "q://m.casino-x.b.net/zz"]
    urls += ["no url", None, "", "a:///path", "a://a.b..org/", "a://b.com/de/x?://z.org/", "a://net.ads/", "a://org/é/x", "a://badspammer.net/", "a://spam.org/1", "a://xn--ads.net:80/x", "a://org/en/1"]
    frame = pd.DataFrame({"page_id": [*range(len(urls)), 0], "url": [*urls, urls[0]]})
    db = duckdb.connect()
    db.register("pages", frame)
    columns = ["page_id", "host", "path", "rule", "verdict", "blocked_key"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in zip([*range(len(urls)), 0], [*urls, urls[0]])], "page_id long, url string, rule string, verdict string")
    got = sorted((tuple(r) for r in judge_urls(pages).select(*columns).collect()), key=str)
    assert got == sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()['op13_url_filters']})").fetchall(), key=str)
    verdict = {urls[r[0]]: r[3:] for r in got}
    assert verdict["a://casino-x.b.net"] == (None, "block", "casino-x.b.net") and verdict["a://casino-x.b.com/fr/y"] == ("com/fr/", "allow", "casino-x.b.com")
    assert verdict["a://www.example.org/en/1#"][0] == "example.org/en/1" and verdict["a://badspammer.net/"] == (None, "allow", None)
    assert judge_urls(pages.limit(0)).count() == 0
    alone = judge_urls(pages, rules=RULES[:1], blocked=spark.createDataFrame([], "key string"))
    assert {r.verdict for r in alone.collect()} == {"allow"}
