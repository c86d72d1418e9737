"""Evaluation, verification and conversation queries, and the SQL that they are held against.

Result lists, answers and claims are made from the golden questions by fixed arithmetic, since no model can be run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import evaluate as E
from siltstone.operators import verify as C
from siltstone.plans.search import _CHUNKS, _QUESTIONS
from siltstone.sources import fixtures as S

KEYWORDS = ["blockchain", "redis", "graphql"]
VERDICTS = ["supported", "Unsupported", "contradicted ", "unclear"]
PROMPT = "Answer from the sources and cite them as [n]."


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, run (a or b), rank, path: twenty results each; every ninth is a directory."""
    g = S.golden(spark, sf_dir)
    files = S.files(spark, sf_dir).select("doc_id", "path", "package")
    n = files.agg(F.count("*").alias("n"))
    q = F.col("question_id")
    rows = g.crossJoin(F.broadcast(n)).select("question_id", "expected_files", "n", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run")).select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rank"))
    doc = F.when(F.col("run") == "a", q * 31 + F.col("rank") * 17).otherwise(q * 29 + F.col("rank") * 13 + 5) % F.col("n")
    place = F.when(F.col("run") == "a", q % 12).otherwise(q * 7 % 15) + 1
    joined = rows.withColumn("doc_id", doc).withColumn("place", place).join(files, "doc_id")
    path = F.when((F.col("rank") == F.col("place")) & (F.size("expected_files") > 0), F.try_element_at("expected_files", F.lit(1))).when(F.col("rank") % 9 == 0, F.concat("package", F.lit("/"))).otherwise(F.col("path"))
    return joined.select("question_id", "run", "rank", path.alias("path"))


def answers(spark, sf_dir):
    q = F.col("question_id")
    text = F.when(q % 7 == 0, "INSUFFICIENT_CONTEXT nothing found").otherwise(F.concat(F.lit("See ["), (q % 6 + 1).cast("string"), F.lit("] and ["), (q * 3 % 8 + 1).cast("string"), F.lit("].")))
    return S.questions(spark, sf_dir).select("question_id", text.alias("answer"))


def sources(spark, sf_dir):
    """Six sources per question, with spans that are right, wrong, missing or directories."""
    r = runs(spark, sf_dir).where("run = 'a' AND rank <= 6").select("question_id", "rank", F.col("path").alias("found"))
    files = S.chunks(spark, sf_dir).select(F.col("path").alias("found"), "package", "symbol", "content")
    q, k = F.col("question_id"), F.col("rank")
    path = F.when((k == 5) & (q % 2 == 0), F.concat(F.lit("missing/"), q.cast("string"), F.lit(".txt"))).when((k == 4) & (q % 3 == 0), F.concat("package", F.lit("/"))).when((k == 4) & (q % 3 == 1), "nowhere/").otherwise(F.col("found"))
    start = F.when(k != 6, q % 4).cast("int")
    return r.join(files, "found").select("question_id", "rank", path.alias("path"), start.alias("start_line"), (start + k).cast("int").alias("end_line"), "symbol", F.array_join(F.slice(X.lines(F.col("content")), 1, 2), "\n").alias("content"), (q % 2).cast("int").alias("header_lines"))


def _checks(spark, sf_dir):
    own = sources(spark, sf_dir).withColumn("span_id", F.col("question_id") * 10 + F.col("rank"))
    checked = C.verify_spans(own, S.files(spark, sf_dir))
    return checked.withColumn("question_id", F.floor(F.col("span_id") / 10)).withColumn("index", (F.col("span_id") % 10).cast("int"))


def claims(spark, sf_dir):
    q = F.col("question_id")
    rows = S.questions(spark, sf_dir).select("question_id", F.explode(F.sequence(F.lit(1), F.greatest(q % 5, F.lit(1)).cast("int"))).alias("c"))
    at = lambda items, n: F.element_at(X.literals(items), (n + 1).cast("int"))
    bad = q % 11 == 0
    return rows.select("question_id", F.concat(F.lit("It uses "), at(KEYWORDS, (q + F.col("c")) % 3)).alias("claim"), F.when((q % 5 > 0) & ~bad, at(VERDICTS, (q + F.col("c")) % 4)).alias("verdict"), F.when(bad, "failed").alias("error"))


def load_golden(spark, sf_dir):
    return S.golden(spark, sf_dir).where(F.size("expected_files") > 0).select("question_id", "question", "type", F.array_join("expected_files", "|").alias("expected_files"))


def _metrics(spark, sf_dir, run="a"):
    return E.question_metrics(runs(spark, sf_dir).where(F.col("run") == run).drop("run"), S.golden(spark, sf_dir))


def first_hit_rank(spark, sf_dir):
    return E.hit_ranks(runs(spark, sf_dir).where("run = 'a'"), S.golden(spark, sf_dir)).groupBy("question_id").agg(F.min("rank").alias("first_hit_rank"))


def question_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


def retrieval_report(spark, sf_dir):
    return E.retrieval_report(_metrics(spark, sf_dir))


def compare_runs(spark, sf_dir):
    return E.compare_runs(_metrics(spark, sf_dir, "b"), _metrics(spark, sf_dir, "a"))


def compare_metrics(spark, sf_dir):
    return E.compare_metrics(E.retrieval_report(_metrics(spark, sf_dir, "b")), E.retrieval_report(_metrics(spark, sf_dir, "a")))


def noise_floor(spark, sf_dir):
    return E.noise_floor(_metrics(spark, sf_dir, "b"), _metrics(spark, sf_dir, "a"))


def rewrite_report(spark, sf_dir):
    both = E.question_metrics(runs(spark, sf_dir), S.golden(spark, sf_dir), ("run",))
    hit = lambda k: F.round(F.avg(F.col(f"hit_at_{k}").cast("int")), 9).alias(f"recall_{k}")
    return both.groupBy(F.when(F.col("run") == "b", "raw").otherwise("rewritten").alias("kind")).agg(F.count("*").alias("n"), hit(5), hit(10), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"))


def fusion_sweep(spark, sf_dir):
    lists = runs(spark, sf_dir).select("question_id", F.when(F.col("run") == "a", "semantic").otherwise("lexical").alias("list"), "path", "rank")
    return E.fusion_sweep(lists, S.golden(spark, sf_dir))


def parse_markers(spark, sf_dir):
    return answers(spark, sf_dir).select("question_id", F.posexplode(X.markers(F.col("answer"))).alias("pos", "index"))


def refusal_flag(spark, sf_dir):
    return answers(spark, sf_dir).select("question_id", X.refused(F.col("answer")).alias("refused"))


def verify_span(spark, sf_dir):
    return _checks(spark, sf_dir).select("span_id", "path", "start_line", "end_line", "exists", "span_valid", "content_matches", "problem")


def verify_answer(spark, sf_dir):
    return C.verify_answers(answers(spark, sf_dir), _checks(spark, sf_dir).select("question_id", "index", "span_valid", "problem"))


def verification_summary(spark, sf_dir):
    return C.verification_summary(verify_answer(spark, sf_dir))


def answer_marks(spark, sf_dir):
    return C.answer_marks(answers(spark, sf_dir), _checks(spark, sf_dir).select("question_id", "index", "span_valid", "problem"))


def build_context(spark, sf_dir):
    return C.prompt_context(sources(spark, sf_dir))


def _grades(spark, sf_dir):
    own = runs(spark, sf_dir).where("run = 'a' AND rank <= 6").select("question_id", "rank", "path")
    return E.answer_grades(answers(spark, sf_dir), own, S.golden(spark, sf_dir))


def answer_grade(spark, sf_dir):
    return _grades(spark, sf_dir)


def answer_report(spark, sf_dir):
    return E.answer_report(_grades(spark, sf_dir))


def gradeable(spark, sf_dir):
    return E.gradeable(_grades(spark, sf_dir), answers(spark, sf_dir)).select("question_id", "type", "answer")


def claim_report(spark, sf_dir):
    return E.claim_report(E.claim_totals(claims(spark, sf_dir)))


def worst_answers(spark, sf_dir):
    totals = E.claim_totals(claims(spark, sf_dir)).where("total > 0")
    return totals.orderBy("faithfulness", "question_id").limit(5).select("question_id", "total", "supported", F.round("faithfulness", 9).alias("faithfulness"))


def judge_validation(spark, sf_dir):
    keyword = S.questions(spark, sf_dir).select("question_id", F.element_at(X.literals(KEYWORDS), (F.col("question_id") % 3 + 1).cast("int")).alias("keyword"))
    return E.injected_claims(claims(spark, sf_dir).where("verdict IS NOT NULL"), keyword)


def stratified_sample(spark, sf_dir):
    return E.stratified_sample(S.golden(spark, sf_dir).where("type <> 'unanswerable'"), "type", 12, "question_id").select("question_id", "type")


def history_turns(spark, sf_dir):
    return C.last_turns(S.table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role", F.length("text").alias("chars"))


def format_history(spark, sf_dir):
    return C.format_history(S.table(spark, sf_dir, "conversations"))


def chat_messages(spark, sf_dir):
    return C.chat_messages(S.table(spark, sf_dir, "conversations"), PROMPT)


def list_messages(spark, sf_dir):
    """The first fifty of each conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return S.table(spark, sf_dir, "conversations").withColumn("place", place).where("place <= 50").select("conv_id", "turn", "role", "text")


def looks_dependent(spark, sf_dir):
    return S.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.looks_dependent(F.col("text")).alias("dependent"))


QUERIES = [load_golden, first_hit_rank, question_metrics, retrieval_report, compare_runs, compare_metrics, noise_floor, rewrite_report, fusion_sweep, parse_markers, refusal_flag, verify_span, verify_answer, verification_summary, answer_marks, build_context, answer_grade, answer_report, gradeable, claim_report, worst_answers, judge_validation, stratified_sample, history_turns, format_history, chat_messages, list_messages, looks_dependent]

# --- the same in SQL -------------------------------------------------------------------------------------------------

_GOLDEN = f"""{_QUESTIONS}, {_CHUNKS}, hits AS (SELECT b.item_id AS question_id, d.doc_id, d.lang, d.source || '/' || d.doc_id || '.txt' AS path FROM benchmark b, documents d WHERE contains(d.text, b.text)),
    golden AS (SELECT question_id, question, coalesce(first(lang ORDER BY doc_id), 'unanswerable') AS type, coalesce(list(path ORDER BY doc_id) FILTER (path IS NOT NULL), []) AS expected_files FROM questions LEFT JOIN hits USING (question_id) GROUP BY 1, 2)"""
_RUNS = f"""{_GOLDEN}, runs AS (SELECT question_id, run, rank, CASE WHEN rank = place AND len(expected_files) > 0 THEN expected_files[1] WHEN rank % 9 = 0 THEN package || '/' ELSE path END AS path FROM
    (SELECT question_id, expected_files, run, rank, CASE WHEN run = 'a' THEN question_id * 31 + rank * 17 ELSE question_id * 29 + rank * 13 + 5 END % (SELECT count(*) FROM documents) AS doc, CASE WHEN run = 'a' THEN question_id % 12 ELSE question_id * 7 % 15 END + 1 AS place
     FROM golden, (VALUES ('a'), ('b')) r(run), range(1, 21) k(rank)) JOIN chunks ON chunk_id = doc)"""
_METRICS = f"""{_RUNS}, satisfied AS (SELECT DISTINCT r.question_id, r.run, r.rank FROM runs r JOIN golden g USING (question_id), unnest(g.expected_files) e(f) WHERE r.path = f OR (r.path LIKE '%/' AND starts_with(f, r.path))),
    firsts AS (SELECT question_id, run, min(rank) AS first_hit_rank FROM satisfied GROUP BY 1, 2),
    metrics AS (SELECT g.question_id, r.run, g.type, any_value(f.first_hit_rank) AS first_hit_rank, coalesce(1.0::DOUBLE / any_value(f.first_hit_rank), 0.0) AS reciprocal_rank, coalesce(any_value(f.first_hit_rank) <= 1, false) AS hit_at_1, coalesce(any_value(f.first_hit_rank) <= 5, false) AS hit_at_5, coalesce(any_value(f.first_hit_rank) <= 10, false) AS hit_at_10,
        count(DISTINCT r.path) FILTER (r.rank <= 10) AS distinct_files, string_agg(r.path, '|' ORDER BY r.rank) FILTER (r.rank <= 5) AS top_paths FROM golden g JOIN runs r USING (question_id) LEFT JOIN firsts f USING (question_id, run) WHERE len(g.expected_files) > 0 GROUP BY 1, 2, 3)"""


def _report(run: str, name: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS segment, count(*) AS n, round(avg(hit_at_1::INT), 9) AS recall_1, round(avg(hit_at_5::INT), 9) AS recall_5, round(avg(hit_at_10::INT), 9) AS recall_10, round(avg(reciprocal_rank), 9) AS mrr,
        coalesce(string_agg(question_id::VARCHAR, ',' ORDER BY question_id) FILTER (NOT hit_at_10), '') AS missed FROM metrics WHERE run = '{run}' GROUP BY GROUPING SETS ((), (type)))"""


_ANSWERS = "answers AS (SELECT question_id, CASE WHEN question_id % 7 = 0 THEN 'INSUFFICIENT_CONTEXT nothing found' ELSE 'See [' || (question_id % 6 + 1) || '] and [' || (question_id * 3 % 8 + 1) || '].' END AS answer FROM questions)"
_MARKS = "marks AS (SELECT question_id, list_position(found, m) - 1 AS pos, m::INT AS index FROM (SELECT question_id, found, unnest(list_distinct(found)) AS m FROM (SELECT question_id, regexp_extract_all(answer, '\\[(\\d{1,2})\\]', 1) AS found FROM answers)))"
_POS = "marked AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY pos) - 1 AS pos, index FROM marks)"
_LINES = "CASE WHEN string_split({0}, chr(10))[-1] = '' THEN string_split({0}, chr(10))[:-2] ELSE string_split({0}, chr(10)) END"
_SOURCES = f"""sources AS (SELECT r.question_id, r.rank, CASE WHEN rank = 5 AND question_id % 2 = 0 THEN 'missing/' || question_id || '.txt' WHEN rank = 4 AND question_id % 3 = 0 THEN package || '/' WHEN rank = 4 AND question_id % 3 = 1 THEN 'nowhere/' ELSE r.path END AS path,
    (CASE WHEN rank <> 6 THEN question_id % 4 END)::INT AS start_line, (CASE WHEN rank <> 6 THEN question_id % 4 + rank END)::INT AS end_line, c.symbol, array_to_string(({_LINES.format('c.content')})[1:2], chr(10)) AS content, (question_id % 2)::INT AS header_lines FROM runs r JOIN chunks c ON c.path = r.path WHERE run = 'a' AND rank <= 6)"""
_CHECKS = f"""{_RUNS}, {_ANSWERS}, {_MARKS}, {_POS}, {_SOURCES}, spans AS (SELECT s.*, c.path AS file, {_LINES.format('c.content')} AS lines, EXISTS (SELECT 1 FROM chunks d WHERE d.package || '/' = s.path) AS dir, list_filter(list_transform((string_split(s.content, chr(10)))[s.header_lines + 1:], lambda x: trim(x)), lambda x: x <> '') AS body FROM sources s LEFT JOIN chunks c ON c.path = s.path),
    judged AS (SELECT *, CASE WHEN path LIKE '%/' AND NOT dir THEN 'directory not found' WHEN path LIKE '%/' THEN NULL WHEN file IS NULL THEN 'file not found' WHEN start_line IS NULL THEN NULL WHEN start_line < 1 OR start_line > len(lines) THEN 'start_line ' || start_line || ' outside file (' || len(lines) || ' lines)' WHEN coalesce(end_line, 0) > len(lines) THEN 'end_line ' || end_line || ' outside file (' || len(lines) || ' lines)' END AS problem FROM spans),
    checks AS (SELECT question_id, rank AS index, question_id * 10 + rank AS span_id, path, start_line, end_line, CASE WHEN path LIKE '%/' THEN dir ELSE file IS NOT NULL END AS exists, problem IS NULL AS span_valid,
        CASE WHEN problem IS NULL AND path NOT LIKE '%/' AND start_line IS NOT NULL THEN coalesce(list_contains(list_transform(lines[start_line:CASE WHEN end_line > 0 THEN end_line ELSE start_line END], lambda x: trim(x)), body[-1]), false) END AS content_matches, problem FROM judged),
    verified AS (SELECT m.question_id, m.pos, m.index, c.span_id IS NULL AS fabricated, c.span_valid, c.problem FROM marked m LEFT JOIN checks c USING (question_id, index))"""
_GRADES = f"""{_METRICS}, {_ANSWERS}, {_MARKS}, {_POS}, own AS (SELECT * FROM runs WHERE run = 'a' AND rank <= 6), cites AS (SELECT question_id, count(*) AS cited, count(o.path) AS checked FROM marked m LEFT JOIN own o ON o.question_id = m.question_id AND o.rank = m.index GROUP BY m.question_id),
    inside AS (SELECT question_id, rank FROM satisfied WHERE run = 'a' AND rank <= 6), grades AS (SELECT a.question_id, g.type, len(expected_files) > 0 AS answerable, starts_with(upper(trim(answer)), 'INSUFFICIENT_CONTEXT') AS refused, coalesce(c.cited, 0) > 0 AS has_citations,
        CASE WHEN len(expected_files) > 0 THEN EXISTS (SELECT 1 FROM inside i JOIN marked m ON m.question_id = i.question_id AND m.index = i.rank WHERE i.question_id = a.question_id) END AS grounded, CASE WHEN len(expected_files) > 0 THEN EXISTS (SELECT 1 FROM inside i WHERE i.question_id = a.question_id) END AS context_had_answer,
        coalesce(c.checked, 0) AS checked, coalesce(c.cited, 0) - coalesce(c.checked, 0) AS fabricated, answer FROM answers a JOIN golden g USING (question_id) LEFT JOIN cites c USING (question_id)),
    graded AS (SELECT *, CASE WHEN answerable THEN refused AND NOT context_had_answer END AS warranted, CASE WHEN answerable THEN refused AND context_had_answer END AS unwarranted FROM grades)""".replace("cites AS (SELECT question_id,", "cites AS (SELECT m.question_id,")
_RATES = "count(*) AS n, " + ", ".join(f"round(avg({c}::INT), 9) AS {c}_rate" for c in ("refused", "unwarranted", "warranted", "has_citations", "grounded", "context_had_answer")) + ", sum(checked)::BIGINT AS checked, sum(fabricated)::BIGINT AS fabricated"
_CLAIMS = f"""{_QUESTIONS}, claims AS (SELECT question_id, 'It uses ' || {KEYWORDS}[(question_id + c) % 3 + 1] AS claim, CASE WHEN question_id % 5 > 0 AND question_id % 11 <> 0 THEN {VERDICTS}[(question_id + c) % 4 + 1] END AS verdict, CASE WHEN question_id % 11 = 0 THEN 'failed' END AS error FROM questions, unnest(range(1, greatest(question_id % 5, 1) + 1)) k(c)),
    judged AS (SELECT *, CASE WHEN lower(trim(verdict)) IN ('supported', 'unsupported', 'contradicted') THEN lower(trim(verdict)) WHEN verdict IS NOT NULL THEN 'unsupported' END AS v FROM claims),
    totals AS (SELECT question_id, count(verdict) AS total, count(*) FILTER (v = 'supported') AS supported, count(*) FILTER (v = 'unsupported') AS unsupported, count(*) FILTER (v = 'contradicted') AS contradicted, max(error) AS error FROM judged GROUP BY 1)"""
_TURNS = "turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations)"
_WEIGHTS = ", ".join(f"({n}, {s}::DOUBLE, {x}::DOUBLE, {k})" for n, s, x, k in E.configurations())
_PART = "CASE WHEN {0} > 0 AND {1} IS NOT NULL THEN {0} / (k + {1}) ELSE 0 END"
_VERIFIED = f"WITH {_CHECKS} SELECT"
SQL = {
    "load_golden": f"WITH {_GOLDEN} SELECT question_id, question, type, array_to_string(expected_files, '|') AS expected_files FROM golden WHERE len(expected_files) > 0",
    "first_hit_rank": f"WITH {_METRICS} SELECT question_id, first_hit_rank FROM firsts WHERE run = 'a'",
    "question_metrics": f"WITH {_METRICS} SELECT * EXCLUDE (run) FROM metrics WHERE run = 'a'",
    "retrieval_report": f"WITH {_METRICS}, {_report('a', 'report')} SELECT * FROM report",
    "compare_runs": f"WITH {_METRICS} SELECT a.question_id, a.type, b.first_hit_rank AS before_rank, a.first_hit_rank AS after_rank, CASE WHEN coalesce(a.first_hit_rank, 999) < coalesce(b.first_hit_rank, 999) THEN 'improved' ELSE 'regressed' END AS change FROM metrics a JOIN metrics b USING (question_id) WHERE a.run = 'a' AND b.run = 'b' AND a.first_hit_rank IS DISTINCT FROM b.first_hit_rank",
    "compare_metrics": f"WITH {_METRICS}, {_report('b', 'old')}, {_report('a', 'new')}, o AS (UNPIVOT (SELECT segment, recall_1, recall_5, recall_10, mrr FROM old) ON recall_1, recall_5, recall_10, mrr INTO NAME metric VALUE v), w AS (UNPIVOT (SELECT segment, recall_1, recall_5, recall_10, mrr FROM new) ON recall_1, recall_5, recall_10, mrr INTO NAME metric VALUE v) SELECT segment, metric, o.v AS before, w.v AS after, round(w.v - o.v, 9) AS delta FROM o JOIN w USING (segment, metric)",
    "noise_floor": f"""WITH {_METRICS}, pairs AS (SELECT a.question_id, unnest(['overall', a.type]) AS segment, a.hit_at_1::INT::DOUBLE - b.hit_at_1::INT AS hit_at_1, a.hit_at_5::INT::DOUBLE - b.hit_at_5::INT AS hit_at_5, a.hit_at_10::INT::DOUBLE - b.hit_at_10::INT AS hit_at_10, a.reciprocal_rank - b.reciprocal_rank AS reciprocal_rank FROM metrics a JOIN metrics b USING (question_id) WHERE a.run = 'a' AND b.run = 'b'),
        u AS (SELECT *, ('0x' || substr(md5(question_id || ':' || round), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT *, unnest(range(1, 501)) AS round FROM pairs)),
        w AS (SELECT *, {' + '.join(f'(u >= {x!r}::DOUBLE)::INT' for x in E.POISSON)} AS w FROM u),
        m AS (SELECT segment, round, {', '.join(f'round(sum(w * {m}) / sum(w), 9) AS {m}' for m in E.METRICS)} FROM w WHERE w > 0 GROUP BY 1, 2),
        d AS (UNPIVOT m ON {', '.join(E.METRICS)} INTO NAME metric VALUE v), l AS (SELECT segment, metric, list_sort(list(v)) AS draws FROM d GROUP BY 1, 2),
        o AS (UNPIVOT (SELECT segment, count(*) AS questions, {', '.join(f'round(avg({m}), 9) AS {m}' for m in E.METRICS)} FROM pairs GROUP BY 1) ON {', '.join(E.METRICS)} INTO NAME metric VALUE delta)
        SELECT segment, metric, questions, delta, draws[floor(len(draws) * {(1 - 0.95) / 2!r}::DOUBLE)::INT + 1] AS low, draws[greatest(ceil(len(draws) * {1 - (1 - 0.95) / 2!r}::DOUBLE)::INT, 1)] AS high, low > 0 OR high < 0 AS real FROM o JOIN l USING (segment, metric)""",
    "rewrite_report": f"WITH {_METRICS} SELECT CASE WHEN run = 'b' THEN 'raw' ELSE 'rewritten' END AS kind, count(*) AS n, round(avg(hit_at_5::INT), 9) AS recall_5, round(avg(hit_at_10::INT), 9) AS recall_10, round(avg(reciprocal_rank), 9) AS mrr FROM metrics GROUP BY 1",
    "fusion_sweep": f"""WITH {_RUNS}, grid(config, semantic, lexical, k) AS (VALUES {_WEIGHTS}), wide AS (SELECT question_id, path, min(rank) FILTER (run = 'a') AS s, min(rank) FILTER (run = 'b') AS l FROM runs GROUP BY 1, 2),
        scored AS (SELECT *, round({_PART.format('semantic', 's')} + {_PART.format('lexical', 'l')}, 12) AS score FROM wide, grid), ranked AS (SELECT *, row_number() OVER (PARTITION BY config, question_id ORDER BY score DESC, least(CASE WHEN semantic > 0 THEN s END, CASE WHEN lexical > 0 THEN l END), path) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20),
        first_hits AS (SELECT config, question_id, min(rank) AS rank FROM ranked JOIN golden USING (question_id) WHERE list_contains(expected_files, path) GROUP BY 1, 2), sums AS (SELECT config, sum(1.0::DOUBLE / rank) AS total FROM first_hits GROUP BY 1), report AS (SELECT grid.*, round(coalesce(total / (SELECT count(*) FROM golden WHERE len(expected_files) > 0), 0.0), 9) AS mrr FROM grid LEFT JOIN sums USING (config))
        SELECT *, row_number() OVER (ORDER BY mrr DESC, config) = 1 AS best FROM report""",
    "parse_markers": f"WITH {_QUESTIONS}, {_ANSWERS}, {_MARKS}, {_POS} SELECT question_id, pos, index FROM marked",
    "refusal_flag": f"WITH {_QUESTIONS}, {_ANSWERS} SELECT question_id, starts_with(upper(trim(answer)), 'INSUFFICIENT_CONTEXT') AS refused FROM answers",
    "verify_span": f"{_VERIFIED} span_id, path, start_line, end_line, exists, span_valid, content_matches, problem FROM checks",
    "verify_answer": f"{_VERIFIED} question_id, pos, index, fabricated, span_valid, problem FROM verified",
    "verification_summary": f"""{_VERIFIED} question_id, cited, checked, valid, fabricated, valid = cited AND fabricated = '' AS all_valid, valid || '/' || checked || ' citations verified' || CASE WHEN fabricated <> '' THEN '; fabricated: ' || fabricated ELSE '' END AS summary FROM
        (SELECT question_id, count(*) AS cited, count(*) FILTER (NOT fabricated) AS checked, count(*) FILTER (coalesce(span_valid, false)) AS valid, coalesce(string_agg(index::VARCHAR, ',' ORDER BY pos) FILTER (fabricated), '') AS fabricated FROM verified GROUP BY 1)""",
    "answer_marks": f"{_VERIFIED} c.question_id, c.index, CASE WHEN m.index IS NULL THEN '' WHEN c.span_valid THEN 'OK' ELSE '!!' END AS mark, coalesce(CASE WHEN m.index IS NOT NULL THEN c.problem END, '') AS note FROM checks c LEFT JOIN marked m ON m.question_id = c.question_id AND m.index = c.index",
    "build_context": f"""{_VERIFIED} question_id, string_agg('[' || rank || '] ' || path || CASE WHEN start_line IS NOT NULL AND end_line IS NOT NULL THEN ':' || start_line || '-' || end_line WHEN start_line IS NOT NULL THEN ':' || start_line ELSE '' END || CASE WHEN coalesce(symbol, '') = '' THEN '' ELSE ' (' || symbol || ')' END || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM sources GROUP BY 1""",
    "answer_grade": f"WITH {_GRADES} SELECT question_id, type, answerable, refused, has_citations, grounded, context_had_answer, warranted, unwarranted, checked, fabricated FROM graded",
    "answer_report": f"WITH {_GRADES} SELECT CASE WHEN answerable THEN 'answerable' ELSE 'unanswerable' END AS segment, {_RATES} FROM graded GROUP BY 1 UNION ALL SELECT 'type:' || type, {_RATES} FROM graded GROUP BY 1",
    "gradeable": f"WITH {_GRADES} SELECT question_id, type, answer FROM graded WHERE answerable AND NOT refused AND trim(answer) <> ''",
    "claim_report": f"""WITH {_CLAIMS}, t AS (SELECT *, error IS NULL AND total > 0 AS ok FROM totals) SELECT count(*) FILTER (ok) AS answers_graded, count(*) FILTER (NOT ok) AS answers_skipped, (sum(total) FILTER (ok))::BIGINT AS total_claims, (sum(supported) FILTER (ok))::BIGINT AS supported, (sum(unsupported) FILTER (ok))::BIGINT AS unsupported, (sum(contradicted) FILTER (ok))::BIGINT AS contradicted,
        round(sum(supported) FILTER (ok) / sum(total) FILTER (ok), 9) AS claim_faithfulness, round(avg(supported / total) FILTER (ok), 9) AS mean_answer_faithfulness, round(avg((supported = total)::INT) FILTER (ok), 9) AS clean_answer_rate FROM t""",
    "worst_answers": f"WITH {_CLAIMS} SELECT question_id, total, supported, round(supported / total, 9) AS faithfulness FROM totals WHERE total > 0 ORDER BY supported / total, question_id LIMIT 5",
    "judge_validation": f"""WITH {_CLAIMS}, k AS (SELECT question_id, {KEYWORDS}[question_id % 3 + 1] AS keyword FROM questions), seen AS (SELECT question_id, bool_or(v <> 'supported') AS caught FROM judged JOIN k USING (question_id) WHERE verdict IS NOT NULL AND contains(lower(claim), keyword) GROUP BY 1)
        SELECT question_id, keyword, CASE WHEN caught THEN 'caught' WHEN caught IS NOT NULL THEN 'wrong' ELSE 'dropped' END AS status FROM k LEFT JOIN seen USING (question_id)""",
    "stratified_sample": f"WITH {_GOLDEN}, t AS (SELECT question_id, type, row_number() OVER (PARTITION BY type ORDER BY question_id) AS turn FROM golden WHERE type <> 'unanswerable') SELECT question_id, type FROM t ORDER BY turn, type LIMIT 12",
    "history_turns": f"WITH {_TURNS} SELECT conv_id, turn, role, length(text)::INT AS chars FROM turns WHERE from_end <= 6",
    "format_history": f"""WITH {_TURNS}, entries AS (SELECT conv_id, turn, from_end, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 600) AS entry FROM turns WHERE from_end <= 6),
        spent AS (SELECT *, sum(length(entry)) OVER (PARTITION BY conv_id ORDER BY from_end) AS spent FROM entries) SELECT conv_id, string_agg(entry, chr(10) ORDER BY turn) AS history FROM spent WHERE spent <= 2400 GROUP BY 1""",
    "chat_messages": f"""WITH {_TURNS}, m AS (SELECT DISTINCT conv_id, -1 AS o, 'system' AS role, '{PROMPT}' AS content FROM turns UNION ALL SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, substr(coalesce(text, ''), 1, 800) FROM turns WHERE from_end <= 4) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS seq, role, content FROM m""",
    "list_messages": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= 50",
    "looks_dependent": """SELECT conv_id, turn, regexp_matches(trim(text), '(?i)^\\s*(and|but|so|what about|how about|why|ok|okay|then|also)\\b') OR regexp_matches(trim(text), '(?i)\\b(it|its|it''s|that|this|these|those|there|then|they|them|their|he|she|same|above|previous|instead|also|too|as well)\\b')
        OR len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) <= 4 AS dependent FROM conversations WHERE role = 'user'""",
}
