"""Chunkers as table functions for SQL: windows over ordered lines, files by structure, and chunkers of users' own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .chunk import HEADER_CHARS, SCHEMA, count_tokens, plain_lines, structural_rows

WINDOWS = "path string, part int, start_line int, end_line int, header_lines int, text string"


class WindowedLines:
    """windowed_lines(TABLE(lines) PARTITION BY path ORDER BY (line_no), max_tokens), lines (path, line_no, line): parts of a file
    within the budget. Parts after the first restate the first line, cut to 300 characters. Lines come one by one; one part and one running sum are held."""

    def __init__(self):
        self.path = self.head = None
        self.room = self.used = self.part = self.first = self.last = 0
        self.held: list[str] = []

    def _flush(self) -> Iterator[tuple]:
        if not self.held:
            return
        self.part += 1
        again, body = self.part > 1, "\n".join(self.held)
        yield self.path, self.part, self.first, self.last, len(plain_lines(self.head)) if again else 0, (f"{self.head}\n{body}" if again else body).strip(" ")
        self.held, self.used = [], 0

    def eval(self, row: Row, max_tokens: int) -> Iterator[tuple]:
        line = row["line"] or ""
        if self.head is None:
            self.path, self.head = row["path"], line[:HEADER_CHARS]
            self.room = max(max_tokens - min(count_tokens(self.head), max_tokens // 4), max_tokens // 4)
        cost = count_tokens(line) + 1
        if self.used + cost > self.room:
            yield from self._flush()
        if not self.held:
            self.first = row["line_no"]
        self.held.append(line)
        self.used += cost
        self.last = row["line_no"]

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()


def chunker_function(rows: Callable[[str, str, str], Iterator[tuple]]) -> type:
    """A table function of (path, language, text) around a chunker of single texts."""

    class Chunker:
        def eval(self, path: str, language: str, text: str) -> Iterator[tuple]:
            yield from rows(path, language, text or "")

    return Chunker


def register(spark: SparkSession) -> None:
    """windowed_lines and source_chunks (path, language, text), for SQL: `FROM files, LATERAL source_chunks(path, language, content)`."""
    spark.udtf.register("windowed_lines", udtf(WindowedLines, returnType=WINDOWS))
    register_chunker(spark, "source_chunks", structural_rows)


def register_chunker(spark: SparkSession, name: str, rows: Callable[[str, str, str], Iterator[tuple]], schema: str = SCHEMA) -> None:
    """A user's chunker under a name: a function of (path, language, text) that gives rows of the schema."""
    spark.udtf.register(name, udtf(chunker_function(rows), returnType=schema))
