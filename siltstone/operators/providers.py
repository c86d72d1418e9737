"""Models behind small interfaces: embedding, chat and judging, with offline stand-ins that only exercise the plumbing."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import values as V

from .index import hashed_vectors
from .verify import prompt_context


class Embedder(Protocol):
    def vectors(self, items: DataFrame, key: str, text: str) -> DataFrame:
        """items -> key, vector array<double>."""


class Chat(Protocol):
    def reply(self, question: str, context: str) -> str: ...


class Judge(Protocol):
    def verdict(self, claim: str, context: str) -> str:
        """supported, unsupported or contradicted."""


class HashedEmbedder:
    def vectors(self, items: DataFrame, key: str, text: str) -> DataFrame:
        return hashed_vectors(items, key, text)


def embedding_batches(texts: Iterable[str], count: Callable[[str], int], size: int = 64, tokens: int = 180_000) -> Iterator[list[str]]:
    """Requests for an embedding service: at most `size` texts and `tokens` tokens each, a text over that alone; a blank text
    is sent as one space."""
    batch, held = [], 0
    for text in texts:
        n = count(text)
        if batch and (len(batch) == size or held + n > tokens):
            yield batch
            batch, held = [], 0
        batch.append(text if text.strip() else " ")
        held += n
    if batch:
        yield batch


class ServiceEmbedder:
    """Vectors from a service that takes lists of texts; every task makes its own requests.

    request: texts -> vectors; a request that fails is made again after waits of `wait` seconds, each twice the last, `tries` times in all.
    store: a folder for vectors by the hash of their text; texts found there are not asked for again. Vectors are
    written as the task goes on, a file per request, so a task that was lost asks again for its open request at most.
    """

    def __init__(self, request: Callable[[list[str]], list[list[float]]], count: Callable[[str], int] = lambda t: max(1, len(t) // 4), store: str | None = None, tries: int = 3, wait: float = 1.0):
        self.request, self.count, self.store, self.tries, self.wait = request, count, store, tries, wait

    def _ask(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.tries):
            try:
                return self.request(texts)
            except Exception:  # services fail in many ways; the last failure is the task's
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**attempt)
        return []

    def _requests(self, rows: Iterator[tuple[str, str]], size: int, tokens: int) -> Iterator[tuple[list[str], list[list[float]]]]:
        """(hashes, vectors) of requests that are filled over all batches of a task; texts come by length, so a request's are alike."""
        waiting: list[tuple[str, str]] = []
        for lot in embedding_batches((t for h, t in rows if not waiting.append((h, t))), self.count, size, tokens):
            own, waiting[:] = waiting[: len(lot)], waiting[len(lot) :]
            yield [h for h, _ in own], self._ask(lot)

    def vectors(self, items: DataFrame, key: str, text: str, size: int = 64, tokens: int = 180_000, tasks: int | None = None) -> DataFrame:
        """items -> key, vector. Equal texts are asked for once; a null text counts as empty.

        tasks: tasks that make requests (default: the session's shuffle partitions); each leaves one request unfilled at most.
        """
        own = items.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
        asked = own.select("hash", "text").distinct()
        spark, known = items.sparkSession, None
        if self.store:
            known = self.stored(spark)
            asked = asked.join(known.select("hash"), "hash", "left_anti")
        tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # in ranges of (length, hash): a task's texts are about as long as each other, and no length makes a task too large
        asked = asked.withColumn("length", F.length("text")).repartitionByRange(tasks, "length", "hash").sortWithinPartitions("length", "hash")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((h, t) for b in batches for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for hashes, found in self._requests(rows, size, tokens):
                out = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(found, pa.list_(pa.float64()))], ["hash", "vector"])
                if self.store:
                    self._write(out)
                yield out

        fresh = asked.select("hash", "text").mapInArrow(run, "hash string, vector array<double>")
        if self.store:
            fresh.write.format("noop").mode("overwrite").save()
            fresh = self.stored(spark)
        found = fresh.groupBy("hash").agg(F.any_value("vector").alias("vector"))
        return own.join(found, "hash").select(F.col("key").alias(key), "vector")

    def stored(self, spark) -> DataFrame:
        """hash, vector of what is stored; a hash may come twice if a task ran twice."""
        files, base = fs.FileSystem.from_uri(self.store)
        files.create_dir(base)
        return spark.read.schema("hash string, vector array<double>").parquet(self.store)

    def _write(self, rows: pa.RecordBatch) -> None:
        """One file per request, named by its content; written aside and then moved, so no half file is read."""
        files, base = fs.FileSystem.from_uri(self.store)
        name = hashlib.sha256("".join(rows.column(0).to_pylist()).encode()).hexdigest()[:32]
        aside = f"{base}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            pq.write_table(pa.Table.from_batches([rows]), out)
        files.move(aside, f"{base}/{name}.parquet")


class ExtractiveChat:
    """Quotes the first sentence of the first sources with their markers, or refuses without sources."""

    def __init__(self, quoted: int = 2):
        self.quoted = quoted

    def reply(self, question: str, context: str) -> str:
        blocks = re.findall(r"^\[(\d+)\][^\n]*\n([^\n.]*\.?)", context or "", re.M)
        return " ".join(f"{text.strip()} [{n}]" for n, text in blocks[: self.quoted]) or f"{V.REFUSAL}\nNothing was retrieved for this question."


class OverlapJudge:
    """Calls a claim supported if enough of its words are in the sources."""

    def __init__(self, share: float = 0.7):
        self.share = share

    def verdict(self, claim: str, context: str) -> str:
        words = set(re.findall(r"\w+", claim.lower()))
        return "supported" if words and len(words & set(re.findall(r"\w+", context.lower()))) >= self.share * len(words) else "unsupported"


def answer(questions: DataFrame, sources: DataFrame, chat: Chat) -> DataFrame:
    """question_id, answer. One call per question, inside tasks; questions without sources are refused without a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"question_id": b["question_id"], "answer": [chat.reply(q, c or "") for q, c in zip(b["question"], b["context"])]})

    joined = questions.join(prompt_context(sources), "question_id", "left").select("question_id", "question", "context")
    asked = joined.where(F.col("context").isNotNull()).mapInPandas(run, "question_id long, answer string")
    refused = joined.where(F.col("context").isNull()).select("question_id", F.lit(f"{V.REFUSAL}\nNothing was retrieved for this question.").alias("answer"))
    return asked.union(refused)


def judge_claims(claims: DataFrame, contexts: DataFrame, judge: Judge) -> DataFrame:
    """claims (question_id, claim) with contexts (question_id, context) -> question_id, claim, verdict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"question_id": b["question_id"], "claim": b["claim"], "verdict": [judge.verdict(c, t or "") for c, t in zip(b["claim"], b["context"])]})

    return claims.join(contexts, "question_id", "left").select("question_id", "claim", "context").mapInPandas(run, "question_id long, claim string, verdict string")
