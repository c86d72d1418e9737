"""Column functions over text: tokens, identifiers, markers, slugs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def literals(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def filled(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def tokens(text: Column) -> Column:
    """Index tokens: lower case, accents folded, runs of letters and digits."""
    low = F.lower(text)
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, V.ACCENTED, V.PLAIN))
    return filled(F.split(plain, r"[^\p{L}\p{N}]+"))


def words(text: Column) -> Column:
    return filled(F.split(text, r"\s+"))


def query_terms(question: Column) -> Column:
    """Search terms of a question, phrases as words with spaces; in first-seen order, each once.

    Identifiers without stop words and single letters; a name with underscores gives a phrase and its parts, a camel-case
    name also the phrase of its parts.
    """
    raw = F.filter(F.regexp_extract_all(question, F.lit("([A-Za-z_][A-Za-z0-9_]*)")), lambda w: (~F.lower(w).isin(V.STOPWORDS)) & (F.length(w) >= 2))

    def expand(w: Column) -> Column:
        parts = filled(F.split(w, "_"))
        snake = F.concat(F.array(F.array_join(parts, " ")), F.filter(parts, lambda p: ~F.lower(p).isin(V.STOPWORDS)))
        apart = F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2")
        plain = F.when(apart == w, F.array(w)).otherwise(F.array(w, apart))
        return F.when(F.size(parts) > 1, snake).otherwise(plain)

    return F.array_distinct(F.flatten(F.transform(raw, expand)))


def token_count(text: Column) -> Column:
    """Default token counter: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def lines(text: Column) -> Column:
    """Lines without a trailing empty one."""
    found = F.split(text, "\n", -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def markers(answer: Column) -> Column:
    """Cited numbers [n] of one or two digits, in first-seen order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]")), lambda x: x.cast("int")))


def slug(repo: Column, strategy: Column | None = None) -> Column:
    name = F.lower(F.regexp_replace(F.regexp_replace(repo, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", ""))
    name = F.concat(F.lit("repo_"), F.when(name == "", "repo").otherwise(name))
    if strategy is not None:
        name = F.when(F.coalesce(strategy, F.lit("")) == "", name).otherwise(F.concat(name, F.lit("__"), strategy))
    return F.substring(name, 1, 63)


def refused(answer: Column) -> Column:
    return F.upper(F.trim(answer)).startswith(V.REFUSAL)


def looks_dependent(question: Column) -> Column:
    """Whether a question leans on earlier turns: an opener, a word that refers back, or at most four words."""
    q = F.trim(question)
    return q.rlike(V.OPENERS) | q.rlike(V.REFERENCES) | (F.size(words(q)) <= 4)


def location(path: Column, start: Column, end: Column) -> Column:
    shown = F.coalesce(path, F.lit("unknown"))
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(shown, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).when(start.isNotNull(), F.concat(shown, F.lit(":"), start.cast("string"))).otherwise(shown)


def parent(path: Column) -> Column:
    """Directory of a path, '.' at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(".")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def symbol_text(qualified: Column, symbol: Column, parent_symbol: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(qualified, symbol, parent_symbol), lambda x: F.coalesce(x, F.lit("")) != "")), " ")


def language_of(file_name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(V.LANGUAGE_OF.items()) for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(file_name, r".(\.[^.]*)$", 1))], F.lit("unknown"))
