"""Search queries over the stand-in corpus, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import values as V
from siltstone.operators import index as I
from siltstone.operators import retrieve as R
from siltstone.operators.cells import CellIndex
from siltstone.sources import fixtures as S
from siltstone.sources.store import cut, fresh_path


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.hashed_vectors(S.questions(spark, sf_dir), "question_id", "question")


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table of vectors, and every vector whose id is divisible by 50 as a question."""
    e = S.table(spark, sf_dir, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = e.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") < 3, "code").otherwise("prose").alias("stratum"), vector.alias("vector"))
    return rows, rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("question_id"), "vector")


def semantic_topk(spark, sf_dir):
    vectors, queries = _given(spark, sf_dir)
    return R.semantic_list(vectors.withColumn("stratum", F.lit("all")), queries, 10, digits=8).select("question_id", "rank", "chunk_id", "score")


def semantic_filtered_topk(spark, sf_dir):
    vectors, queries = _given(spark, sf_dir)
    return R.semantic_list(vectors.where("stratum = 'code'"), queries, 10, digits=8).select("question_id", "rank", "chunk_id", "score")


def score_threshold(spark, sf_dir):
    vectors, queries = _given(spark, sf_dir)
    return R.semantic_list(vectors.withColumn("stratum", F.lit("all")), queries, 20, digits=8).where("score >= 0.5").select("question_id", "rank", "chunk_id", "score")


def _cells(spark, sf_dir):
    vectors, queries = _given(spark, sf_dir)
    index = CellIndex.build(vectors, fresh_path(spark, "cells"))
    n = len(index.centres)
    return index.search(queries, 10, probes=-(-3 * n // 4), rerank=50)


def ann_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


def ann_lsh(spark, sf_dir):
    """The query's name of earlier rounds; nearest neighbours come from cells now."""
    return _cells(spark, sf_dir)


def ann_recall(spark, sf_dir):
    """Whether the approximate search finds nine in ten of the ten nearest, and how many questions were asked."""
    exact = semantic_topk(spark, sf_dir).select("question_id", "chunk_id")
    found = exact.join(_cells(spark, sf_dir).select("question_id", "chunk_id", F.lit(1).alias("hit")), ["question_id", "chunk_id"], "left")
    return found.agg(F.count_distinct("question_id").alias("questions"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


def embed_hash(spark, sf_dir):
    vectors = I.hashed_vectors(S.questions(spark, sf_dir), "question_id", "question")
    return vectors.select("question_id", F.posexplode("vector").alias("dimension", "value")).where("value > 0")


def lexical_query_terms(spark, sf_dir):
    return S.questions(spark, sf_dir).select("question_id", F.posexplode(X.query_terms(F.col("question"))).alias("term_no", "term"))


def bm25_topk(spark, sf_dir):
    return R.lexical_list(S.search_index(spark, sf_dir).lexicon, S.questions(spark, sf_dir), 10).select("question_id", "rank", "chunk_id", "score")


def bm25_phrase(spark, sf_dir):
    asked = S.questions(spark, sf_dir).select("question_id", F.slice(X.tokens(F.col("question")), 1, 2).alias("phrase")).where(F.size("phrase") == 2)
    scores = S.search_index(spark, sf_dir).lexicon.search(asked, 10)
    return R.top(scores, ["question_id"], 10, F.desc("score"), F.asc("chunk_id")).select("question_id", "rank", "chunk_id", "score")


def index_postings(spark, sf_dir):
    return S.search_index(spark, sf_dir).lexicon.counts()


def index_counts(spark, sf_dir):
    index = S.search_index(spark, sf_dir)
    statistics = spark.read.parquet(f"{index.lexicon.path}/statistics")
    return statistics.crossJoin(index.vectors.agg(F.count("*").alias("vectors"))).select("n_docs", F.round("avg_length", 6).alias("avg_length"), "vectors")


def lexical_only(spark, sf_dir):
    return R.assemble(R.lexical_list(S.search_index(spark, sf_dir).lexicon, S.questions(spark, sf_dir), V.CANDIDATE_K).join(S.chunks(spark, sf_dir).select("chunk_id", F.col("package").alias("path")), "chunk_id")).select("question_id", "rank", "chunk_id", "path", "score")


def semantic_only(spark, sf_dir):
    ranked = R.semantic_list(S.search_index(spark, sf_dir).vectors.withColumn("stratum", F.lit("all")), _queries(spark, sf_dir), V.CANDIDATE_K)
    return R.assemble(ranked.join(S.chunks(spark, sf_dir).select("chunk_id", "path"), "chunk_id")).select("question_id", "rank", "chunk_id", "path", "score")


def _lists(spark, sf_dir, strata):
    limit = V.CANDIDATE_K // 2 if strata else V.CANDIDATE_K
    index = S.search_index(spark, sf_dir)
    return R.lists(index.lexicon, index.vectors, S.questions(spark, sf_dir), _queries(spark, sf_dir), limit, strata)


def _hybrid(spark, sf_dir, strata):
    index = S.search_index(spark, sf_dir)
    return R.hybrid(S.chunks(spark, sf_dir), index.lexicon, index.vectors, S.questions(spark, sf_dir), _queries(spark, sf_dir), strata)


def rrf_fuse(spark, sf_dir):
    return R.fuse(_lists(spark, sf_dir, False), R.POOLED_WEIGHTS).where("rank <= 20").select("question_id", "rank", "chunk_id", "score", "ranks")


def hybrid_pooled(spark, sf_dir):
    return _hybrid(spark, sf_dir, False)


def hybrid_stratified(spark, sf_dir):
    return _hybrid(spark, sf_dir, True)


def hybrid_code_floor(spark, sf_dir):
    """Both indexes are searched once, by stratum: the pooled lists are the best of all strata's, the code lists the first of the code's own."""
    index, chunks = S.search_index(spark, sf_dir), S.chunks(spark, sf_dir)
    both = cut(R.lists(index.lexicon, index.vectors, S.questions(spark, sf_dir), _queries(spark, sf_dir), V.CANDIDATE_K, True), fresh_path(spark, "lists"))
    ranked = R.fuse(R.pooled(both, V.CANDIDATE_K), R.POOLED_WEIGHTS).join(chunks.select("chunk_id", "path", "stratum"), "chunk_id")
    own = both.where((F.col("rank") <= V.CANDIDATE_K // 2) & F.col("list").endswith("_code")).withColumn("list", F.regexp_replace("list", "_code$", ""))
    return R.code_floor(R.assemble(ranked), R.fuse(own, R.POOLED_WEIGHTS), F.col("stratum") == "code", 3).select("question_id", "rank", "chunk_id", "score")


def cap_per_file(spark, sf_dir):
    ranked = R.fuse(_lists(spark, sf_dir, False), R.POOLED_WEIGHTS).join(S.chunks(spark, sf_dir).select("chunk_id", F.col("package").alias("path")), "chunk_id")
    return R.assemble(ranked, k=10, per_file=2).select("question_id", "rank", "chunk_id", "path", "score")


def candidate_merge(spark, sf_dir):
    both = _lists(spark, sf_dir, False)
    return R.merge_candidates(both.where("list = 'semantic'"), both.where("list = 'lexical'"))


QUERIES = [semantic_topk, semantic_filtered_topk, score_threshold, ann_cells, ann_lsh, ann_recall, embed_hash, lexical_query_terms, bm25_topk, bm25_phrase, index_postings, index_counts, lexical_only, semantic_only, rrf_fuse, hybrid_pooled, hybrid_stratified, hybrid_code_floor, cap_per_file, candidate_merge]

# --- the same in SQL -------------------------------------------------------------------------------------------------

_FOLD = f"translate(lower(%s), '{V.ACCENTED}', '{V.PLAIN}')"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({_FOLD % x}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


_STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)
_QUESTIONS = "questions AS (SELECT item_id AS question_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS question FROM benchmark)"
_CHUNKS = f"""chunks AS (SELECT doc_id AS chunk_id, source || '/' || doc_id || '.txt' AS path, source AS package, array_to_string(({_tokens("string_split(text, chr(10))[1]")})[1:3], ' ') AS symbol,
    text AS content, lang AS language, CASE WHEN lang = 'en' THEN 'prose' ELSE 'code' END AS stratum FROM documents)"""
_RAW = f"""raw AS (SELECT question_id, i, w FROM (SELECT question_id, unnest(list_filter(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: NOT list_contains([{_STOP}], lower(w)) AND length(w) >= 2)) AS w,
    generate_subscripts(list_filter(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: NOT list_contains([{_STOP}], lower(w)) AND length(w) >= 2), 1) AS i FROM questions))"""
_TERMS = f"""{_RAW}, parts AS (SELECT *, list_filter(string_split(w, '_'), lambda p: p <> '') AS ps, regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS apart FROM raw),
    options AS (SELECT question_id, i, CASE WHEN len(ps) > 1 THEN [array_to_string(ps, ' ')] || list_filter(ps, lambda p: NOT list_contains([{_STOP}], lower(p))) WHEN apart = w THEN [w] ELSE [w, apart] END AS ts FROM parts),
    listed AS (SELECT question_id, i, unnest(ts) AS term, generate_subscripts(ts, 1) AS j FROM options),
    terms AS (SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY min(i * 1000 + j)) - 1 AS term_no FROM listed GROUP BY question_id, term)"""
_FIELDS = f"""fielded AS (SELECT chunk_id, 2.0 AS weight, 'path' AS field, {_tokens('path')} AS toks FROM chunks UNION ALL SELECT chunk_id, 5.0, 'symbol', {_tokens('symbol')} FROM chunks UNION ALL SELECT chunk_id, 1.0, 'content', {_tokens('content')} FROM chunks),
    sizes AS (SELECT chunk_id, sum(len(toks)) AS length FROM fielded GROUP BY 1), stats AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM sizes)"""
_POSTINGS = "postings AS (SELECT chunk_id, weight, field, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM fielded)"
_PHRASES = f"asked AS (SELECT question_id, {_tokens('term')} AS phrase FROM terms WHERE len({_tokens('term')}) > 0)"
_SCORES = """freq AS (SELECT a.phrase, p.chunk_id, sum(p.weight) AS f FROM (SELECT DISTINCT phrase FROM asked) a JOIN postings p ON p.token = a.phrase[1]
        LEFT JOIN postings p2 ON len(a.phrase) = 2 AND p2.chunk_id = p.chunk_id AND p2.field = p.field AND p2.pos = p.pos + 1 AND p2.token = a.phrase[2]
        WHERE len(a.phrase) = 1 OR p2.token IS NOT NULL GROUP BY 1, 2),
    idf AS (SELECT phrase, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT phrase, count(*) AS n FROM freq GROUP BY 1), stats),
    bm25 AS (SELECT question_id, freq.chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg_length))), 9) AS score FROM asked JOIN freq USING (phrase) JOIN idf USING (phrase) JOIN sizes ON sizes.chunk_id = freq.chunk_id, stats GROUP BY 1, 2)"""
_LEXICAL = f"{_QUESTIONS}, {_CHUNKS}, {_TERMS}, {_FIELDS}, {_POSTINGS}, {_PHRASES}, {_SCORES}"
_BUCKET = "(('0x' || substr(sha1(token), 1, 7))::INT % 64)"


def _hashed(name: str, key: str, rows: str, text: str) -> str:
    return f"""{name}_cells AS (SELECT {key}, {_BUCKET} AS b, count(*) AS c FROM (SELECT {key}, unnest({_tokens(text)}) AS token FROM {rows}) GROUP BY 1, 2),
    {name}_norms AS (SELECT {key}, sum(c * c) AS n FROM {name}_cells GROUP BY 1)"""


_SEMANTIC = f"""{_hashed('d', 'chunk_id', 'chunks', 'content')}, {_hashed('q', 'question_id', 'questions', 'question')},
    cosine AS (SELECT question_id, chunk_id, round(dot / (sqrt(qn.n) * sqrt(dn.n)), 9) AS score FROM (SELECT question_id, chunk_id, sum(q_cells.c * d_cells.c) AS dot FROM q_cells JOIN d_cells USING (b) GROUP BY 1, 2) JOIN q_norms qn USING (question_id) JOIN d_norms dn USING (chunk_id)),
    zero AS (SELECT q.question_id, d.chunk_id, 0.0 AS score FROM q_norms q, d_norms d WHERE NOT EXISTS (SELECT 1 FROM cosine c WHERE c.question_id = q.question_id AND c.chunk_id = d.chunk_id)),
    semantic AS (SELECT * FROM cosine UNION ALL SELECT * FROM zero)"""
_ALL = f"{_LEXICAL}, {_SEMANTIC}"


def _ranked(name: str, score: str, limit: int, strata: bool) -> str:
    part = "question_id, stratum" if strata else "question_id"
    label = f"'{name}_' || stratum" if strata else f"'{name}'"
    return f"SELECT question_id, {label} AS list, chunk_id, score, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, chunk_id) AS rank FROM {score} JOIN chunks USING (chunk_id) QUALIFY rank <= {limit}"


def _fused(weights: dict[str, float], source: str = "lists", name: str = "fused") -> str:
    score = " + ".join(f"coalesce({float(w)} / (60 + min(CASE WHEN list = '{n}' THEN rank END)), 0.0)" for n, w in weights.items())
    shown = ", ".join(f"'{n}:' || min(CASE WHEN list = '{n}' THEN rank END)" for n in weights)
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM
        (SELECT question_id, chunk_id, round(0.0 + {score}, 12) AS score, min(rank) AS best_rank, concat_ws(',', {shown}) AS ranks FROM {source} GROUP BY 1, 2))"""


def _assembled(k: int, path: str = "path", name: str = "result", source: str = "fused") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (of_file, old), row_number() OVER (PARTITION BY question_id ORDER BY old) AS rank FROM
        (SELECT f.question_id, f.chunk_id, c.{path} AS path, c.stratum, f.score, f.ranks, f.rank AS old, row_number() OVER (PARTITION BY f.question_id, c.{path} ORDER BY f.rank) AS of_file FROM {source} f JOIN chunks c USING (chunk_id)) WHERE of_file <= 2 QUALIFY rank <= {k})"""


_POOLED = f"{_ALL}, lists AS ({_ranked('semantic', 'semantic', 40, False)} UNION ALL {_ranked('lexical', 'bm25', 40, False)}), {_fused(R.POOLED_WEIGHTS)}"
_STRATA = f"({_ranked('semantic', 'semantic', 20, True)} UNION ALL {_ranked('lexical', 'bm25', 20, True)})"


def _given_sql(where: str, k: int, least: str = "") -> str:
    return f"""SELECT question_id, rank, chunk_id, score FROM (SELECT q.vec_id AS question_id, d.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 8) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 8) DESC, d.vec_id) AS rank
        FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 {where} QUALIFY rank <= {k}) {least}"""


_OUT = "SELECT question_id, rank, chunk_id, path, score, ranks FROM result"
SQL = {
    "semantic_topk": _given_sql("", 10),
    "semantic_filtered_topk": _given_sql("AND d.label < 3", 10),
    "score_threshold": _given_sql("", 20, "WHERE score >= 0.5"),
    "ann_recall": "SELECT count(*) AS questions, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0",
    "embed_hash": f"WITH {_QUESTIONS}, {_hashed('q', 'question_id', 'questions', 'question')} SELECT question_id, b AS dimension, c::DOUBLE AS value FROM q_cells",
    "lexical_query_terms": f"WITH {_QUESTIONS}, {_TERMS} SELECT question_id, term_no, term FROM terms",
    "bm25_topk": f"WITH {_LEXICAL}, r AS ({_ranked('lexical', 'bm25', 10, False)}) SELECT question_id, rank, chunk_id, score FROM r",
    "bm25_phrase": f"WITH {_QUESTIONS}, {_CHUNKS}, {_FIELDS}, {_POSTINGS}, asked AS (SELECT question_id, ({_tokens('question')})[1:2] AS phrase FROM questions WHERE len({_tokens('question')}) >= 2), {_SCORES}, r AS ({_ranked('lexical', 'bm25', 10, False)}) SELECT question_id, rank, chunk_id, score FROM r",
    "index_postings": f"WITH {_CHUNKS}, {_FIELDS}, {_POSTINGS} SELECT token, field, count(DISTINCT chunk_id) AS chunks, count(*) AS occurrences, sum(pos)::BIGINT AS pos_sum FROM postings GROUP BY token, field",
    "index_counts": f"WITH {_CHUNKS}, {_FIELDS} SELECT n_docs, round(avg_length, 6) AS avg_length, (SELECT count(*) FROM documents) AS vectors FROM stats",
    "lexical_only": f"WITH {_LEXICAL}, fused AS (SELECT *, '' AS ranks FROM ({_ranked('lexical', 'bm25', 40, False)})), {_assembled(5, 'package')} SELECT question_id, rank, chunk_id, path, score FROM result",
    "semantic_only": f"WITH {_ALL}, fused AS (SELECT *, '' AS ranks FROM ({_ranked('semantic', 'semantic', 40, False)})), {_assembled(5)} SELECT question_id, rank, chunk_id, path, score FROM result",
    "rrf_fuse": f"WITH {_POOLED} SELECT question_id, rank, chunk_id, score, ranks FROM fused WHERE rank <= 20",
    "hybrid_pooled": f"WITH {_POOLED}, {_assembled(5)} {_OUT}",
    "hybrid_stratified": f"WITH {_ALL}, lists AS {_STRATA}, {_fused(R.stratified_weights())}, {_assembled(5)} {_OUT}",
    "hybrid_code_floor": f"""WITH {_POOLED}, {_assembled(5)}, strata AS {_STRATA}, own AS (SELECT question_id, replace(list, '_code', '') AS list, chunk_id, score, rank FROM strata WHERE list LIKE '%_code'), {_fused(R.POOLED_WEIGHTS, 'own', 'code')},
        lack AS (SELECT question_id, greatest(3 - count(*) FILTER (stratum = 'code'), 0) AS missing, count(*) AS n FROM result GROUP BY 1),
        fresh AS (SELECT * FROM (SELECT c.question_id, c.chunk_id, c.score, row_number() OVER (PARTITION BY c.question_id ORDER BY c.rank) AS o FROM code c WHERE NOT EXISTS (SELECT 1 FROM result r WHERE r.question_id = c.question_id AND r.chunk_id = c.chunk_id)) JOIN lack USING (question_id) WHERE o <= missing),
        added AS (SELECT question_id, count(*) AS added FROM fresh GROUP BY 1),
        stay AS (SELECT question_id, chunk_id, score FROM (SELECT r.*, n, coalesce(added, 0) AS added, row_number() OVER (PARTITION BY r.question_id, r.stratum = 'code' ORDER BY r.rank DESC) AS e FROM result r JOIN lack USING (question_id) LEFT JOIN added USING (question_id)) WHERE stratum = 'code' OR e > greatest(n + added - 5, 0))
        SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM stay UNION ALL SELECT question_id, chunk_id, score FROM fresh) QUALIFY rank <= 5""",
    "cap_per_file": f"WITH {_POOLED}, {_assembled(10, 'package')} SELECT question_id, rank, chunk_id, path, score FROM result",
    "candidate_merge": f"WITH {_POOLED} SELECT coalesce(s.question_id, l.question_id) AS question_id, coalesce(s.chunk_id, l.chunk_id) AS chunk_id, s.score AS semantic_score, l.score AS lexical_score FROM (SELECT * FROM lists WHERE list = 'semantic') s FULL JOIN (SELECT * FROM lists WHERE list = 'lexical') l ON s.question_id = l.question_id AND s.chunk_id = l.chunk_id",
}
