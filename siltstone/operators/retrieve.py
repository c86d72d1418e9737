"""Retrieval for a whole table of questions in one plan: ranked lists, fusion, assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import values as V

from .lexicon import Lexicon


def top(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


# --- lexical ---------------------------------------------------------------------------------------------------------


def search_terms(questions: DataFrame) -> DataFrame:
    """questions (question_id, question) -> question_id, term number, the term's tokens."""
    terms = questions.select("question_id", F.posexplode(X.query_terms(F.col("question"))).alias("term_no", "term"))
    return terms.withColumn("phrase", X.tokens(F.col("term"))).where(F.size("phrase") > 0)


def lexical_list(lexicon: Lexicon, questions: DataFrame, k: int, strata: bool = False) -> DataFrame:
    """The k best chunks by BM25: question_id, [stratum,] chunk_id, score, rank."""
    by = ["question_id", "stratum"] if strata else ["question_id"]
    return top(lexicon.search(search_terms(questions), k, strata), by, k, F.desc("score"), F.asc("chunk_id"))


# --- semantic --------------------------------------------------------------------------------------------------------


#: Of a matrix of chunks by questions that a task makes at a time.
CELLS = 1_000_000


def first_of_each(k: int, before: tuple | None, like: np.ndarray, chunk: np.ndarray) -> tuple:
    """The k best of each question, ties by the smaller chunk: (question number, chunk, likeness), with those found before.

    like (chunks x questions); NaN is no match. What falls short of a question's k-th so far is left out first.
    """
    x = np.where(np.isnan(like), -np.inf, like)
    edge = np.full(x.shape[1], -np.inf)
    if before is not None and len(before[0]):
        held = np.bincount(before[0], minlength=x.shape[1])
        full = np.flatnonzero(held == k)
        edge[full] = before[2][np.cumsum(held)[full] - 1]
    hit = (x >= edge) & (x > -np.inf)
    if len(x) > k and hit.sum() > k * x.shape[1]:
        hit &= x >= np.partition(x, len(x) - k, axis=0)[len(x) - k]  # ties of the k-th stay
    at, q = np.nonzero(hit)
    rows = q, chunk[at], x[at, q]
    if before is not None:
        rows = tuple(np.concatenate(c) for c in zip(before, rows))
    order = np.lexsort((rows[1], -rows[2], rows[0]))
    q = rows[0][order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return tuple(c[order[nth < k]] for c in rows)


def semantic_list(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 9, block: int = 2048) -> DataFrame:
    """Cosine top k per question and stratum: question_id, stratum, chunk_id, score, rank.

    vectors (chunk_id long, stratum string, vector array<double>), queries (question_id long, vector). Questions go in
    blocks of at most `block` to the tasks; a task multiplies CELLS of a batch and the block at a time and keeps k of each question and
    stratum, so the shuffle carries at most k rows per task, question and stratum.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    for number in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == number)
        rows = part.select("question_id", "vector").collect()  # at most about `block` rows
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        norms = np.sqrt((matrix * matrix).sum(axis=1))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix, norms=norms) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                chunk = b.column(0).to_numpy().astype(np.int64)
                strata = np.array(b.column(1).to_pylist(), object)
                own = b.column(2).flatten().to_numpy().astype(np.float64).reshape(len(b), -1)
                size = np.sqrt((own * own).sum(axis=1))
                for s in dict.fromkeys(strata):
                    of = np.flatnonzero(strata == s)
                    for a in range(0, len(of), lot := max(1, CELLS // len(ids))):
                        mine = of[a : a + lot]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            like = np.round((own[mine] @ matrix.T) / (size[mine, None] * norms[None, :]), digits)
                        best[s] = first_of_each(k, best.get(s), like, chunk[mine])
            rows = [(int(ids[q]), s, c, x) for s, lot in best.items() for q, c, x in zip(*(c.tolist() for c in lot))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["question_id", "stratum", "chunk_id", "score"])

        found = vectors.select("chunk_id", "stratum", "vector").mapInArrow(run, "question_id long, stratum string, chunk_id long, score double")
        out = found if out is None else out.union(found)
    return top(out, ["question_id", "stratum"], k, F.desc("score"), F.asc("chunk_id"))


# --- fusion and assembly ---------------------------------------------------------------------------------------------


def fuse(ranked: DataFrame, weights: dict[str, float], k: int = V.RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: question_id, chunk_id, score, best_rank, ranks ('list:rank' joined by commas), rank.

    ranked (question_id, list, chunk_id, rank). An id that repeats in a list counts at its best rank. Terms are added in
    the order of `weights`, so the sum doesn't depend on the plan. Ties: best single rank, then the smaller chunk id.
    """
    each = [F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"r{i}") for i, name in enumerate(weights)]
    wide = ranked.groupBy("question_id", "chunk_id").agg(*each)
    score, shown = F.lit(0.0), []
    for i, (name, w) in enumerate(weights.items()):
        score = score + F.coalesce(F.lit(float(w)) / (k + F.col(f"r{i}")), F.lit(0.0))
        shown.append(F.when(F.col(f"r{i}").isNotNull(), F.concat(F.lit(f"{name}:"), F.col(f"r{i}").cast("string"))))
    best = F.array_min(F.array(*[F.col(f"r{i}") for i in range(len(weights))]))
    fused = wide.select("question_id", "chunk_id", F.round(score, 12).alias("score"), best.alias("best_rank"), F.concat_ws(",", *shown).alias("ranks"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "best_rank", "chunk_id")))


def assemble(ranked: DataFrame, k: int = V.TOP_K, per_file: int | None = V.MAX_PER_FILE, least: float | None = None) -> DataFrame:
    """Threshold, cap per file, first k. ranked (question_id, path, score, rank, ...); rank is numbered anew."""
    kept = ranked if least is None else ranked.where(F.col("score") >= least)
    if per_file is not None:
        kept = kept.withColumn("of_file", F.row_number().over(Window.partitionBy("question_id", "path").orderBy("rank"))).where(F.col("of_file") <= per_file).drop("of_file")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("rank") <= k)


def lists(lexicon: Lexicon, vectors: DataFrame, questions: DataFrame, queries: DataFrame, limit: int, strata: bool) -> DataFrame:
    """The ranked lists of a hybrid search, one row per entry: question_id, list, chunk_id, rank, score."""
    pool = vectors if strata else vectors.withColumn("stratum", F.lit("all"))
    semantic = semantic_list(pool, queries, limit)
    lexical = lexical_list(lexicon, questions, limit, strata)
    name = (lambda kind: F.concat(F.lit(f"{kind}_"), F.col("stratum"))) if strata else (lambda kind: F.lit(kind))
    return semantic.select("question_id", name("semantic").alias("list"), "chunk_id", "rank", "score").union(lexical.select("question_id", name("lexical").alias("list"), "chunk_id", "rank", "score"))


def pooled(lists: DataFrame, limit: int) -> DataFrame:
    """Ranked lists of all strata (question_id, list 'kind_stratum', chunk_id, rank, score) -> one list of each kind, its first
    `limit` rows: the same as a search of all strata at once, if each stratum's list holds its first `limit`."""
    return top(lists.select("question_id", F.substring_index("list", "_", 1).alias("list"), "chunk_id", "score"), ["question_id", "list"], limit, F.desc("score"), F.asc("chunk_id")).select("question_id", "list", "chunk_id", "rank", "score")


def stratified_weights() -> dict[str, float]:
    return {f"{kind}_{stratum}": w * s for stratum, s in (("code", V.CODE_WEIGHT), ("prose", V.PROSE_WEIGHT)) for kind, w in (("semantic", V.SEMANTIC_WEIGHT), ("lexical", V.LEXICAL_WEIGHT))}


POOLED_WEIGHTS = {"semantic": V.SEMANTIC_WEIGHT, "lexical": V.LEXICAL_WEIGHT}


def hybrid(chunks: DataFrame, lexicon: Lexicon, vectors: DataFrame, questions: DataFrame, queries: DataFrame, strata: bool, k: int = V.TOP_K, candidates: int = V.CANDIDATE_K) -> DataFrame:
    """Hybrid search, chunks (chunk_id, path): question_id, rank, chunk_id, path, score, ranks."""
    limit = max(candidates // 2, 10) if strata else max(candidates, k)
    fused = fuse(lists(lexicon, vectors, questions, queries, limit, strata), stratified_weights() if strata else POOLED_WEIGHTS)
    return assemble(fused.join(chunks.select("chunk_id", "path"), "chunk_id"), k).select("question_id", "rank", "chunk_id", "path", "score", "ranks")


def code_floor(pooled: DataFrame, code: DataFrame, is_code: Column, floor: int, k: int = V.TOP_K) -> DataFrame:
    """At least `floor` code rows among the first k, where there are as many.

    pooled: assembled rows with their language; code: fused code-only rows (question_id, chunk_id, score, rank, language).
    The best code rows not chosen yet come in, the lowest prose rows go, and rows are ranked by score again.
    """
    chosen = pooled.withColumn("is_code", is_code)
    missing = chosen.groupBy("question_id").agg(F.greatest(F.lit(floor) - F.count_if("is_code"), F.lit(0)).alias("missing"), F.count("*").alias("rows"))
    fresh = code.join(chosen.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    fresh = fresh.withColumn("order", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).join(missing, "question_id").where(F.col("order") <= F.col("missing"))
    added = fresh.groupBy("question_id").agg(F.count("*").alias("added"))
    prose = Window.partitionBy("question_id", "is_code").orderBy(F.desc("rank"))
    left = chosen.join(missing, "question_id").join(added, "question_id", "left").withColumn("from_end", F.row_number().over(prose))
    over = F.greatest(F.col("rows") + F.coalesce("added", F.lit(0)) - k, F.lit(0))
    left = left.where(F.col("is_code") | (F.col("from_end") > over))
    rows = left.select("question_id", "chunk_id", "score").union(fresh.select("question_id", "chunk_id", "score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)


def merge_candidates(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Union by id with the scores and ranks of both lists: question_id, chunk_id, semantic_score, lexical_score."""
    a = semantic.select("question_id", "chunk_id", F.col("score").alias("semantic_score"))
    b = lexical.select("question_id", "chunk_id", F.col("score").alias("lexical_score"))
    return a.join(b, ["question_id", "chunk_id"], "full")
