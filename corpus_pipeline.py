"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes the documents that the stage before kept, as stored rows. A filtering stage decides with its operator,
which carries where each row is stored, and drops the rows decided against with an anti join on that place; so rows with
a null or repeated doc_id are decided one by one, and all columns of documents pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, forget, placed, scratch
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.exact_dedup import exact_dedup
from siltstone.llm.language_id import identify
from siltstone.llm.packing import pack
from siltstone.llm.simhash import similar_groups

#: SQL has no forward-backward, fingerprint trie, latent space or tokenizer.
ORACLE_SQL = None
#: About 30 MB as a hash table.
BROADCAST_ROWS = 200_000
LEAST_SCORE = 1 / 3


def _without(docs: DataFrame, dropped: DataFrame, place: tuple[str, str]) -> DataFrame:
    """docs without the dropped places. Up to BROADCAST_ROWS places go to every task; more are met by a shuffle."""
    places = cut(dropped.select(*place).distinct(), "dropped")
    few = places.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(places) if few else places, list(place), "left_anti").drop(*place)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: a null text, one without letters, or one of which no language holds a third by the
    field's marginals (mean of the best language under LEAST_SCORE). Without rows to learn from only the first two go."""
    docs, place = placed(docs)
    found = cut(identify(docs, carry=place), "languages")
    learned = not found.where("lang_pred <> 'und'").isEmpty()
    return _without(docs, found.where(f"n_words = 0 OR (score < {LEAST_SCORE} AND {str(learned).lower()})"), place)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    docs, place = placed(docs)
    return _without(docs, exact_dedup(docs, carry=place).where("NOT kept"), place)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (sets of five-word shingles with a similarity of 0.8 or more, and what such links reach), the row
    with the smallest doc_id stays. Rows are told apart by their places, so a repeated doc_id groups nothing."""
    docs, place = placed(docs)
    groups = cut(similar_groups(docs, carry=("doc_id", *place), place=place), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *place)
    stays = groups.groupBy("component_id").agg(F.min(order).alias("first")).select("first.*")
    return _without(docs, groups.join(stays, list(place), "left_anti"), place)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    docs, place = placed(docs)
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=place), place)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables stored on the way only the last one's documents stay."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            after = cut(stage(spark, docs, sf_dir), name)
            made.remove(after)
        if stored is not None:
            forget(stored)
        docs = stored = after
    return STAGES[-1][1](spark, docs, sf_dir)
