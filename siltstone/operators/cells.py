"""An approximate index of vectors: cells around centroids, short codes in them, full vectors for the best codes.

Centroids come from k-means rounds over the whole table. Each vector goes to the nearest centroid's cell and gets a code: the
number of the nearest of 256 codewords for each stretch of its dimensions. The table is stored in the order of cells, so a search
reads row groups of the cells near its questions only, and of these the codes; full vectors are compared for
the `rerank` best codes of a question. Codes hold a byte for each dimension (up to 256): the more rows there are, the closer
the likeness of the tenth nearest is to that of the fiftieth, and coarser codes let it slip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import LIGHT, light
from .retrieve import CELLS, first_of_each, top

CODEWORDS = 256
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64_000_000  # of the rows that first centroids are fitted on
WORD_ROWS = 16 * CODEWORDS  # of these, those that codewords are fitted on
CENTROID_BYTES = 64_000_000
BLOCK = 2048  # questions that tasks get at a time


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row of x the nearest centre, of equally near ones the first."""
    out = np.zeros(len(x), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    lot = max(1, CELLS // max(1, len(centres)))
    for a in range(0, len(x), lot):
        out[a : a + lot] = (x[a : a + lot] @ centres.T - half).argmax(axis=1)
    return out


def local_means(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """k-means of a bounded sample, from rows drawn at random."""
    rng = np.random.default_rng(7)
    first = x[rng.permutation(len(x))[:n]]
    centres = first if len(first) == n else first[np.arange(n) % max(1, len(first))]
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def mean_round(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """One round of k-means over the whole table: tasks send a sum per cell, cells without rows keep their centre."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            if len(b):
                x = unit(matrix(b.column(0)))
                own = nearest(x, centres)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(centres))
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.float64()))], ["cell", "n", "total"])

    def add(cell: pa.Table) -> pa.Table:
        return pa.table({"cell": cell["cell"].slice(0, 1), "centre": pa.array([matrix(cell["total"].combine_chunks()).sum(axis=0) / sum(cell["n"].to_pylist())], pa.list_(pa.float64()))})

    out = centres.copy()
    for r in vectors.select("vector").mapInArrow(partial, "cell long, n long, total array<double>").groupBy("cell").applyInArrow(add, "cell long, centre array<double>").collect():
        out[r["cell"]] = r["centre"]
    return out


class CellIndex:
    """An index stored under `path`: cells (cell, chunk_id, stratum, code, vector), centres and codewords."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/cells")
        held = spark.read.parquet(f"{path}/model").collect()
        by = {kind: sorted((r["number"], r["value"]) for r in held if r["kind"] == kind) for kind in ("centre", "words")}
        self.centres = np.array([v for _, v in by["centre"]])
        self.words = np.array([v for _, v in by["words"]]).reshape(len(by["words"]), CODEWORDS, -1)
        self.width = self.centres.shape[1]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, stretches: int | None = None, rounds: int = 4) -> CellIndex:
        """vectors (chunk_id long, stratum string, vector array<double>, all of one width) -> the index under `path`, written anew; every row is indexed.

        cells: default the root of the number of rows; at most CENTROID_BYTES of centres are made. First centres are fitted on at most SAMPLE_ROWS rows and SAMPLE_BYTES, drawn by the hash of the id,
        codewords on WORD_ROWS of these; rounds run over all rows. stretches: bytes of a code, default one a dimension, at most 256. Rows of a null vector are left out.
        """
        spark = vectors.sparkSession
        vectors = vectors.where("vector IS NOT NULL")
        n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
        width = width or 1
        stretches = min(stretches or 256, width)
        cells = max(1, min(cells or int(n**0.5), CENTROID_BYTES // (8 * width)))
        most = max(CODEWORDS, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
        drawn = vectors.select("vector").orderBy(F.xxhash64("chunk_id", F.lit("sample")), "chunk_id").limit(most).collect()
        sample = unit(np.array([r[0] for r in drawn], np.float64).reshape(-1, width))
        sample = sample if len(sample) else np.zeros((1, width))
        centres = local_means(sample, cells, 6)
        for _ in range(rounds):
            centres = mean_round(vectors, centres)
        span = -(-width // stretches)
        padded = np.pad(sample[:WORD_ROWS], ((0, 0), (0, span * stretches - width)))
        words = np.stack([local_means(padded[:, k * span : (k + 1) * span], CODEWORDS) for k in range(stretches)])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = unit(matrix(b.column(2)))
                wide = np.pad(x, ((0, 0), (0, span * stretches - width)))
                code = np.stack([nearest(wide[:, k * span : (k + 1) * span], words[k]) for k in range(stretches)], axis=1).astype(np.uint8)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stretches), len(b), [None, pa.py_buffer(np.ascontiguousarray(code))])
                yield pa.RecordBatch.from_arrays([pa.array(nearest(x, centres).astype(np.int32)), b.column(0), b.column(1), codes.cast(pa.binary()), b.column(2)], ["cell", "chunk_id", "stratum", "code", "vector"])

        placed = vectors.select("chunk_id", "stratum", "vector").mapInArrow(place, "cell int, chunk_id long, stratum string, code binary, vector array<double>")
        # ranges of (cell, chunk): a cell that holds much of the table is split over files like any other
        placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.mode("overwrite").parquet(f"{path}/cells")
        model = [("centre", k, c.tolist()) for k, c in enumerate(centres)] + [("words", k, w.ravel().tolist()) for k, w in enumerate(words)]
        spark.createDataFrame(model, "kind string, number int, value array<double>").write.mode("overwrite").parquet(f"{path}/model")
        return cls(spark, path)

    def near_cells(self, asked: np.ndarray, probes: int) -> np.ndarray:
        """questions x probes: the cells nearest to each question."""
        far = (self.centres * self.centres).sum(axis=1) / 2 - unit(asked) @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :probes]

    def candidates(self, ids: np.ndarray, asked: np.ndarray, probes: int, rerank: int) -> DataFrame:
        """question_id, chunk_id, cell: for each question the rerank best codes of its cells."""
        near, words, width = self.near_cells(asked, probes), self.words, self.width
        stretches = len(words)
        asked = unit(asked)
        probing = np.zeros((len(self.centres), len(asked)), bool)
        probing[near.ravel(), np.repeat(np.arange(len(asked)), near.shape[1])] = True

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, held, most = None, [], 4 * rerank * len(ids)
            for b in batches:
                cell, chunk = b.column(0).to_numpy(), b.column(1).to_numpy()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(b), stretches)
                meant = np.concatenate([words[m][code[:, m]] for m in range(stretches)], axis=1)[:, :width]
                for c in np.unique(cell):
                    q = np.flatnonzero(probing[c])
                    own = np.flatnonzero(cell == c)
                    for a in range(0, len(own), lot := max(1, CELLS // max(1, len(q)))):
                        mine = own[a : a + lot]
                        at, chunks, x = first_of_each(rerank, None, meant[mine] @ asked[q].T, chunk[mine])
                        held.append((q[at], chunks, x, np.full(len(at), c)))
                        if sum(len(h[0]) for h in held) > most:
                            best, held = cut(([best] if best else []) + held), []
            best = cut(([best] if best else []) + held) if best or held else None
            q, chunks, x, c = best if best is not None else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids[q].astype(np.int64)), pa.array(chunks.astype(np.int64)), pa.array(c.astype(np.int32)), pa.array(x.astype(np.float64))], ["question_id", "chunk_id", "cell", "likeness"])

        def cut(lots: list[tuple]) -> tuple:
            rows = tuple(np.concatenate(z) for z in zip(*lots))
            order = np.lexsort((rows[1], -rows[2], rows[0]))
            q = rows[0][order]
            kept = order[np.arange(len(q)) - np.searchsorted(q, q) < rerank]
            return tuple(z[kept] for z in rows)

        rows = self.rows.where(F.col("cell").isin(np.unique(near).tolist())).select("cell", "chunk_id", "code")
        found = rows.mapInArrow(run, "question_id long, chunk_id long, cell int, likeness double")
        return top(found, ["question_id"], rerank, F.desc("likeness"), F.asc("chunk_id")).select("question_id", "chunk_id", "cell")

    def search(self, queries: DataFrame, k: int, probes: int, rerank: int, digits: int = 8) -> DataFrame:
        """queries (question_id long, vector) -> question_id, rank, chunk_id, score (cosine), near the k best of each question.

        probes cells are read for a question, of all their codes, and rerank vectors in full. Questions go to tasks in blocks of BLOCK.
        """
        n = queries.count()
        blocks, out = max(1, -(-n // BLOCK)), None
        for number in range(blocks):
            part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == number)
            rows = part.select("question_id", "vector").collect()  # at most about BLOCK rows
            if not rows:
                continue
            ids, asked = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
            order = np.argsort(ids, kind="stable")
            ids, asked = ids[order], unit(asked[order])
            chosen = self.candidates(ids, asked, probes, rerank)
            cells = np.unique(self.near_cells(asked, probes)).tolist()
            chosen = F.broadcast(chosen) if 24 * rerank * len(ids) <= LIGHT else light(chosen, F.lit(24))
            full = self.rows.where(F.col("cell").isin(cells)).select("cell", "chunk_id", "vector").join(chosen, ["cell", "chunk_id"])

            def compare(batches: Iterator[pa.RecordBatch], ids=ids, asked=asked) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if len(b):
                        score = np.round((unit(matrix(b.column(2))) * asked[np.searchsorted(ids, b.column(0).to_numpy())]).sum(axis=1), digits)
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["question_id", "chunk_id", "score"])

            found = full.select("question_id", "chunk_id", "vector").mapInArrow(compare, "question_id long, chunk_id long, score double")
            out = found if out is None else out.union(found)
        if out is None:
            out = self.spark.createDataFrame([], "question_id long, chunk_id long, score double")
        return top(out, ["question_id"], k, F.desc("score"), F.asc("chunk_id")).select("question_id", "rank", "chunk_id", "score")
