"""Retrieval metrics, answer grading, claim reports, run comparison and weight sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X

MISS = 999


def hit_ranks(results: DataFrame, golden: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ranks at which a result satisfies an expected entry: question_id, [keys,] rank.

    A result path satisfies the same path; a directory (ending in /) satisfies any expected file below it. Expected
    files are spread to themselves and their directories, so this is an equi-join. results (question_id, rank, path),
    golden (question_id, expected_files).
    """
    file = golden.select("question_id", F.explode("expected_files").alias("file"))
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    spread = file.select("question_id", F.explode(F.array_union(F.array("file"), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")))).alias("path")).distinct()
    return results.join(spread, ["question_id", "path"]).select("question_id", *keys, "rank")


def question_metrics(results: DataFrame, golden: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per answerable question [and key]: first_hit_rank, reciprocal_rank, hit_at_1/5/10, distinct_files, top_paths."""
    by = ["question_id", *keys]
    asked = golden.where(F.size("expected_files") > 0)
    hits = hit_ranks(results, asked, keys)
    if keys:
        asked = asked.join(results.select(*by).distinct(), "question_id")
    first = hits.groupBy(*by).agg(F.min("rank").alias("first_hit_rank"))
    shape = results.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("rank") <= 10, F.col("path"))).alias("distinct_files"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "path")))), lambda s: s["path"]), "|").alias("top_paths"),
    )
    out = asked.select(*by, "type").join(first, by, "left").join(shape, by, "left")
    hit = lambda k: F.coalesce(F.col("first_hit_rank") <= k, F.lit(False)).alias(f"hit_at_{k}")
    return out.select(*by, "type", "first_hit_rank", F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)).alias("reciprocal_rank"), hit(1), hit(5), hit(10), "distinct_files", "top_paths")


def retrieval_report(metrics: DataFrame) -> DataFrame:
    """segment (overall or a type), n, recall_1/5/10, mrr, missed (ids without a hit in ten, joined in order)."""
    one = metrics.withColumn("missed", F.when(~F.col("hit_at_10"), F.col("question_id")))
    rate = lambda c: F.round(F.avg(c), 9)
    cube = one.groupingSets([[], ["type"]], "type").agg(
        F.grouping("type").alias("all"), F.count("*").alias("n"), *[rate(F.col(f"hit_at_{k}").cast("int")).alias(f"recall_{k}") for k in (1, 5, 10)], rate(F.col("reciprocal_rank")).alias("mrr"),
        F.array_join(F.transform(F.array_sort(F.collect_list("missed")), lambda x: x.cast("string")), ",").alias("missed"),
    )
    return cube.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("type")).alias("segment"), "n", "recall_1", "recall_5", "recall_10", "mrr", "missed")


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Questions whose first hit moved: question_id, type, before_rank, after_rank, change."""
    b = before.select("question_id", F.col("first_hit_rank").alias("before_rank"))
    a = after.select("question_id", "type", F.col("first_hit_rank").alias("after_rank"))
    joined = a.join(b, "question_id").where(~F.col("before_rank").eqNullSafe(F.col("after_rank")))
    better = F.coalesce("after_rank", F.lit(MISS)) < F.coalesce("before_rank", F.lit(MISS))
    return joined.select("question_id", "type", "before_rank", "after_rank", F.when(better, "improved").otherwise("regressed").alias("change"))


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of two reports: segment, metric, before, after, delta."""
    names = ["recall_1", "recall_5", "recall_10", "mrr"]
    long = lambda df, c: df.unpivot("segment", names, "metric", c)
    return long(after, "after").join(long(before, "before"), ["segment", "metric"]).select("segment", "metric", "before", "after", F.round(F.col("after") - F.col("before"), 9).alias("delta"))


METRICS = ("hit_at_1", "hit_at_5", "hit_at_10", "reciprocal_rank")
#: Up to which share of draws a Poisson count of mean one is 0, 1, 2, ...
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12))


def draw_weight(question: Column, round_no: Column) -> Column:
    """A Poisson(1) count that depends on the question and the round alone, so a retried task draws the same."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", question.cast("string"), round_no.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # transform() computes the hash once for all comparisons
    return F.element_at(F.transform(F.array(u), lambda x: sum(((x >= share).cast("int") for share in POISSON), F.lit(0))), 1)


def noise_floor(before: DataFrame, after: DataFrame, rounds: int = 500, share: float = 0.95) -> DataFrame:
    """How far a metric's difference of two runs over the same questions could come from the choice of questions: segment
    (overall or a type), metric, questions, delta, low, high, real (the interval leaves out zero).

    A paired Poisson bootstrap in one pass: each question counts draw_weight times in a round, in both runs alike; tasks
    add up weighted differences by round before the shuffle, and a segment's `rounds` differences give the interval that holds `share` of them. Rounds in which no question
    of a segment counts are left out. before, after: question_metrics.
    """
    values = lambda df, n: df.select("question_id", "type", *[F.col(m).cast("double").alias(f"{n}_{m}") for m in METRICS])
    pairs = values(after, "a").join(values(before, "b").drop("type"), "question_id")
    segments = F.explode(F.array(F.lit("overall"), F.col("type"))).alias("segment")
    diffs = pairs.select("question_id", segments, *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in METRICS])
    # round 0 counts every question once: what was observed
    number = F.col("round")
    drawn = diffs.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds)))).withColumn("w", F.when(number == 0, 1).otherwise(draw_weight(F.col("question_id"), number)))
    means = drawn.groupBy("segment", "round").agg(F.count("*").alias("n"), *[F.round(F.sum(F.col("w") * F.col(m)) / F.nullif(F.sum("w"), F.lit(0)), 9).alias(m) for m in METRICS])
    each = [F.struct(F.lit(m).alias("metric"), F.max(F.when(number == 0, F.col(m))).alias("delta"), F.sort_array(F.collect_list(F.when(number > 0, F.col(m)))).alias("draws")) for m in METRICS]
    out = means.groupBy("segment").agg(F.max("n").alias("questions"), F.array(*each).alias("each")).select("segment", "questions", F.explode("each").alias("e")).select("segment", "questions", "e.*")
    cut = (1 - share) / 2
    n = F.size("draws")
    at = lambda k: F.element_at("draws", k.cast("int"))
    out = out.select("segment", "metric", "questions", "delta", at(F.floor(n * F.lit(cut)) + 1).alias("low"), at(F.greatest(F.ceil(n * F.lit(1 - cut)), F.lit(1))).alias("high"))
    return out.withColumn("real", (F.col("low") > 0) | (F.col("high") < 0))


#: Weights (semantic, lexical) and constants of a sweep; pure modes ignore the constant.
GRID = [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (1.0, 5.0), (0.5, 1.0), (0.25, 1.0)]
SWEEP_K = (10, 60)


def configurations() -> list[tuple[int, float, float, int]]:
    found = [(s, x, k) for k in SWEEP_K for s, x in GRID if k == SWEEP_K[0] or (s and x)]
    return [(n, *c) for n, c in enumerate(found)]


def fusion_sweep(lists: DataFrame, golden: DataFrame, keep: int = 20) -> DataFrame:
    """Mean reciprocal rank of each configuration over the same two ranked lists; best marks the first of the highest.

    lists (question_id, list in semantic/lexical, path, rank). Configurations are a fixed small table, so only the fused
    rows grow by their number.
    """
    spark = lists.sparkSession
    grid = spark.createDataFrame(configurations(), "config int, semantic double, lexical double, k int")
    wide = lists.groupBy("question_id", "path").agg(F.min(F.when(F.col("list") == "semantic", F.col("rank"))).alias("s"), F.min(F.when(F.col("list") == "lexical", F.col("rank"))).alias("l"))
    part = lambda w, r: F.when((F.col(w) > 0) & F.col(r).isNotNull(), F.col(w) / (F.col("k") + F.col(r))).otherwise(0.0)
    scored = wide.crossJoin(F.broadcast(grid)).withColumn("score", F.round(part("semantic", "s") + part("lexical", "l"), 12)).where("score > 0")
    best = F.least(F.when(F.col("semantic") > 0, F.col("s")), F.when(F.col("lexical") > 0, F.col("l")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("config", "question_id").orderBy(F.desc("score"), best, "path"))).where(F.col("rank") <= keep)
    asked = golden.where(F.size("expected_files") > 0).select("question_id", F.explode("expected_files").alias("path"))
    first = ranked.join(asked, ["question_id", "path"]).groupBy("config", "question_id").agg(F.min("rank").alias("rank"))
    total = golden.where(F.size("expected_files") > 0).agg(F.count("*").alias("n"))
    sums = first.groupBy("config").agg(F.sum(1.0 / F.col("rank")).alias("sum"))
    report = grid.join(sums, "config", "left").join(F.broadcast(total)).withColumn("mrr", F.round(F.coalesce(F.col("sum") / F.col("n"), F.lit(0.0)), 9))
    order = F.row_number().over(Window.orderBy(F.desc("mrr"), "config"))
    return report.select("config", "semantic", "lexical", "k", "mrr", (order == 1).alias("best"))


def answer_grades(answers: DataFrame, sources: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per answer: answerable, refused, has_citations, grounded, context_had_answer, warranted, unwarranted, checked, fabricated.

    answers (question_id, answer), sources (question_id, rank, path). Grades of unanswerable questions are null.
    """
    cited = answers.select("question_id", F.explode(X.markers(F.col("answer"))).alias("rank"))
    marks = cited.join(sources, ["question_id", "rank"], "left").groupBy("question_id").agg(F.count("*").alias("cited"), F.count("path").alias("checked"))
    within = hit_ranks(sources, golden).distinct()
    context = within.groupBy("question_id").agg(F.lit(True).alias("context"))
    grounded = within.join(cited, ["question_id", "rank"]).groupBy("question_id").agg(F.lit(True).alias("grounded"))
    joined = answers.join(golden.select("question_id", "type", (F.size("expected_files") > 0).alias("answerable")), "question_id").join(marks, "question_id", "left").join(context, "question_id", "left").join(grounded, "question_id", "left")
    refused, had = X.refused(F.col("answer")), F.coalesce("context", F.lit(False))
    only = lambda c: F.when(F.col("answerable"), c)
    return joined.select(
        "question_id", "type", "answerable", refused.alias("refused"), (F.coalesce("cited", F.lit(0)) > 0).alias("has_citations"), only(F.coalesce("grounded", F.lit(False))).alias("grounded"), only(had).alias("context_had_answer"),
        only(refused & ~had).alias("warranted"), only(refused & had).alias("unwarranted"), F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), (F.coalesce("cited", F.lit(0)) - F.coalesce("checked", F.lit(0))).cast("long").alias("fabricated"),
    )


def answer_report(grades: DataFrame) -> DataFrame:
    """segment (answerable, unanswerable or a type), n and rates; rates that don't apply are null."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 9).alias(f"{c}_rate")
    rates = [F.count("*").alias("n"), *map(rate, ("refused", "unwarranted", "warranted", "has_citations", "grounded", "context_had_answer")), F.sum("checked").alias("checked"), F.sum("fabricated").alias("fabricated")]
    kind = grades.groupBy(F.when(F.col("answerable"), "answerable").otherwise("unanswerable").alias("segment")).agg(*rates)
    return kind.union(grades.groupBy(F.concat(F.lit("type:"), "type").alias("segment")).agg(*rates))


def gradeable(grades: DataFrame, answers: DataFrame) -> DataFrame:
    return grades.where("answerable AND NOT refused").join(answers.where(F.trim("answer") != "").select("question_id", "answer"), "question_id")


def claim_verdict(verdict: Column) -> Column:
    low = F.lower(F.trim(verdict))
    return F.when(low.isin("supported", "unsupported", "contradicted"), low).otherwise("unsupported")


def claim_totals(claims: DataFrame) -> DataFrame:
    """claims (question_id, verdict, error) -> per answer: total, supported, unsupported, contradicted, faithfulness, clean, error."""
    v = claim_verdict(F.col("verdict"))
    given = F.col("verdict").isNotNull()
    n = lambda name: F.count_if(given & (v == name))
    rows = claims.groupBy("question_id").agg(F.count_if(given).alias("total"), n("supported").alias("supported"), n("unsupported").alias("unsupported"), n("contradicted").alias("contradicted"), F.max("error").alias("error"))
    return rows.withColumn("faithfulness", F.when(F.col("total") > 0, F.col("supported") / F.col("total"))).withColumn("clean", (F.col("total") > 0) & (F.col("supported") == F.col("total")))


def claim_report(totals: DataFrame) -> DataFrame:
    ok = F.col("error").isNull() & (F.col("total") > 0)
    of = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0))
    return totals.agg(
        F.count_if(ok).alias("answers_graded"), F.count_if(~ok).alias("answers_skipped"), of("total").alias("total_claims"), of("supported").alias("supported"), of("unsupported").alias("unsupported"), of("contradicted").alias("contradicted"),
        F.round(of("supported") / of("total"), 9).alias("claim_faithfulness"), F.round(F.avg(F.when(ok, F.col("faithfulness"))), 9).alias("mean_answer_faithfulness"), F.round(F.avg(F.when(ok, F.col("clean").cast("int"))), 9).alias("clean_answer_rate"),
    )


def injected_claims(claims: DataFrame, keywords: DataFrame) -> DataFrame:
    """Fate of an injected claim per answer: caught, wrong (seen and called supported) or dropped.

    claims (question_id, claim, verdict), keywords (question_id, keyword).
    """
    match = claims.join(keywords, "question_id").where(F.lower("claim").contains(F.col("keyword")))
    seen = match.groupBy("question_id").agg(F.bool_or(claim_verdict(F.col("verdict")) != "supported").alias("caught"))
    return keywords.join(seen, "question_id", "left").select("question_id", "keyword", F.when(F.col("caught"), "caught").when(F.col("caught").isNotNull(), "wrong").otherwise("dropped").alias("status"))


def stratified_sample(rows: DataFrame, stratum: str, n: int, *order: str) -> DataFrame:
    """n rows taken from the strata in turn. A window per stratum orders them; the sample itself is a top-n."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", stratum).limit(n)
