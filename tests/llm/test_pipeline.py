"""The pipeline's stages against their operators, on a small table."""

import collections
import random
from pathlib import Path

import corpus_pipeline as P


def table(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(30))) for k in range(5)]
    rows = [(i, " ".join(text(120)), "en", "s", 1) for i in range(40)]
    rows += [(50, rows[0][1].upper(), "en", "s", 1), (51, rows[1][1].replace(" ", " extra ", 1), "en", "s", 1), (52, rows[2][1] + " " + items[0][1] + " " + " ".join(text(40)), "en", "s", 1), (53, None, None, None, None), (54, "123 !!", "en", "s", 1), (55, "", "en", "s", 1), (None, " ".join(text(80)), "en", "s", 1), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def test_stages(spark, tmp_path):
    rows = table(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = P.cut(out, name)
        kept.append(collections.Counter(r["doc_id"] for r in docs.collect()))
    everything = collections.Counter(r[0] for r in rows)
    assert everything - kept[0] == collections.Counter([53, 54, 55])
    assert kept[0] - kept[1] == collections.Counter([0, 3])  # 50 equals 0; a repeated row of 3
    assert kept[1] - kept[2] == collections.Counter([51])
    assert kept[2] - kept[3] == collections.Counter([52])
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(kept[3])


def test_rows_are_decided_one_by_one(spark, tmp_path):
    """Repeated ids with other texts, and columns named like the pipeline's own."""
    table(spark, tmp_path)
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en", "f", 1, 0), (1, b, "en", "f", 2, 1), (2, c, "en", "g", 1, 2), (2, c + " more", "en", "g", 1, 3), (1, c + " words", "en", "g", 1, 4), (None, a + " x", "en", "h", 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stored_file string, stored_row int, n int")
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, str(tmp_path)), name)
    assert {r["n"] for r in docs.collect()} == {0, 1, 4}
    assert docs.columns == ["doc_id", "text", "lang", "stored_file", "stored_row", "n"]


def test_stored_tables_are_deleted(spark, tmp_path):
    from siltstone.llm.common import shared_dir

    table(spark, tmp_path)
    before = set(Path(shared_dir(spark)).iterdir())
    P.run(spark, str(tmp_path))
    assert [p.name.split("-")[0] for p in set(Path(shared_dir(spark)).iterdir()) - before] == ["decontamination"]


def test_no_language_to_learn(spark, tmp_path):
    table(spark, tmp_path)
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "12", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in P.language_id(spark, docs, str(tmp_path)).collect()] == [1]


def test_empty_table(spark, tmp_path):
    table(spark, tmp_path / "full")
    full = tmp_path / "full"
    (tmp_path / "none").mkdir()
    spark.read.parquet(str(full / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.read.parquet(str(full / "benchmark.parquet")).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
