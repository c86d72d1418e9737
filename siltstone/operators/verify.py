"""Citation checks, prompt context and conversation windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import values as V


def verify_spans(spans: DataFrame, files: DataFrame) -> DataFrame:
    """spans (span_id, path, start_line, end_line, content, header_lines) with exists, span_valid, content_matches, problem.

    files (path, content). The first case that applies: no path; a directory, which exists if some file is below it; no
    such file; no start line; start outside the file; end past the file; valid.
    """
    own = files.select(F.col("path").alias("file"), X.lines(F.col("content")).alias("lines"))
    parts = F.split("path", "/")
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))).alias("dir")).distinct()
    joined = spans.join(own, spans["path"] == own["file"], "left").join(dirs, F.col("path") == F.col("dir"), "left")
    n, start, end = F.size("lines"), F.col("start_line"), F.col("end_line")
    is_dir = F.col("path").endswith("/")
    bad_start = ~start.between(1, n)
    bad_end = F.coalesce(end, F.lit(0)) > n
    problem = (
        F.when(F.coalesce("path", F.lit("")) == "", "no path in metadata")
        .when(is_dir & F.col("dir").isNull(), "directory not found")
        .when(is_dir, F.lit(None))
        .when(F.col("file").isNull(), "file not found")
        .when(start.isNull(), F.lit(None))
        .when(bad_start, F.concat(F.lit("start_line "), start.cast("string"), F.lit(" outside file ("), n.cast("string"), F.lit(" lines)")))
        .when(bad_end, F.concat(F.lit("end_line "), end.cast("string"), F.lit(" outside file ("), n.cast("string"), F.lit(" lines)")))
    )
    cited = F.transform(F.slice("lines", start, F.greatest(F.coalesce(F.when(end > 0, end), start) - start + 1, F.lit(0))), lambda x: F.trim(x))
    text = X.lines(F.coalesce("content", F.lit("")))
    body = X.filled(F.transform(F.slice(text, F.coalesce("header_lines", F.lit(0)) + 1, F.size(text)), lambda x: F.trim(x)))
    matches = F.when(F.size(body) > 0, F.array_contains(cited, F.element_at(body, -1))).otherwise(F.lit(False))
    out = joined.withColumn("problem", problem)
    exists = F.coalesce(F.when(is_dir, F.col("dir").isNotNull()).otherwise(F.col("file").isNotNull()), F.lit(False))
    checked = F.col("problem").isNull() & ~is_dir & start.isNotNull()
    return out.select("span_id", "path", "start_line", "end_line", exists.alias("exists"), F.col("problem").isNull().alias("span_valid"), F.when(checked, matches).alias("content_matches"), "problem")


def verify_answers(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per cited marker: question_id, pos, index, fabricated, span_valid, problem.

    answers (question_id, answer), checks (question_id, index, span_valid, problem), one for each source.
    """
    marks = answers.select("question_id", F.posexplode(X.markers(F.col("answer"))).alias("pos", "index"))
    joined = marks.join(checks.withColumn("there", F.lit(True)), ["question_id", "index"], "left")
    return joined.select("question_id", "pos", "index", F.col("there").isNull().alias("fabricated"), "span_valid", "problem")


def verification_summary(verified: DataFrame) -> DataFrame:
    """Per answer: cited, checked, valid, fabricated (joined), all_valid, summary."""
    per = verified.groupBy("question_id").agg(
        F.count("*").alias("cited"), F.count_if(~F.col("fabricated")).alias("checked"), F.count_if(F.coalesce("span_valid", F.lit(False))).alias("valid"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fabricated"), F.struct("pos", "index")))), lambda s: s["index"].cast("string")), ",").alias("fabricated"),
    )
    text = F.concat(F.col("valid").cast("string"), F.lit("/"), F.col("checked").cast("string"), F.lit(" citations verified"))
    return per.select("question_id", "cited", "checked", "valid", "fabricated", ((F.col("valid") == F.col("cited")) & (F.col("fabricated") == "")).alias("all_valid"), F.when(F.col("fabricated") != "", F.concat(text, F.lit("; fabricated: "), "fabricated")).otherwise(text).alias("summary"))


def answer_marks(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """Per source: OK if cited and valid, !! if cited and not, else blank; with the problem as a note."""
    marks = answers.select("question_id", F.explode(X.markers(F.col("answer"))).alias("index")).withColumn("cited", F.lit(True))
    joined = checks.join(marks, ["question_id", "index"], "left")
    mark = F.when(F.col("cited").isNull(), "").when(F.col("span_valid"), "OK").otherwise("!!")
    return joined.select("question_id", "index", mark.alias("mark"), F.coalesce(F.when(F.col("cited"), F.col("problem")), F.lit("")).alias("note"))


def prompt_context(sources: DataFrame) -> DataFrame:
    """sources (question_id, rank, path, start_line, end_line, symbol, content) -> question_id, context of numbered blocks."""
    label = F.when(F.coalesce("symbol", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), "symbol", F.lit(")")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), X.location(F.col("path"), F.col("start_line"), F.col("end_line")), label, F.lit("\n"), "content")
    return sources.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda s: s["block"]), "\n\n").alias("context"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation. turns (conv_id, turn, role, text)."""
    return turns.withColumn("from_end", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("from_end") <= n)


def format_history(turns: DataFrame) -> DataFrame:
    """conv_id, history: the last turns, oldest first, from the newest back as long as the character budget lasts."""
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    entry = F.concat(speaker, F.lit(": "), F.substring(X.collapse(F.coalesce("text", F.lit(""))), 1, V.TURN_CHARS))
    rows = last_turns(turns, V.HISTORY_TURNS).withColumn("entry", entry)
    spent = F.sum(F.length("entry")).over(Window.partitionBy("conv_id").orderBy("from_end"))
    kept = rows.withColumn("spent", spent).where(F.col("spent") <= V.HISTORY_CHARS)
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "entry"))), lambda s: s["entry"]), "\n").alias("history"))


def chat_messages(turns: DataFrame, system: str, asked: str = "user", turns_kept: int = 4, chars: int = 800) -> DataFrame:
    """Messages for a model, in order: the system prompt, the last turns cut to `chars`, roles as the chat API knows them."""
    kept = last_turns(turns, turns_kept)
    rows = kept.select("conv_id", F.col("turn").alias("order"), F.when(F.col("role") == asked, "user").otherwise("assistant").alias("role"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("content"))
    heads = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("order"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    both = heads.union(rows)
    return both.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("order")) - 1).alias("seq"), "role", "content")
