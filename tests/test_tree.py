"""The data source over real folders."""

import os
from collections import Counter

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from siltstone.functions import values as V
from siltstone.sources import tree as T


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    files = {
        "README.md": b"# Title\r\nline\rnext\n", "src/main.py": b"print(1)\n", "src/deep/er/UPPER.PY": b"x = 1\n", "src/big.py": b"x" * 2_000_000, "src/edge.py": b"y" * V.MAX_FILE_BYTES, "src/empty.py": b"",
        "src/nul.py": b"a\0b", "src/late_nul.py": b"a" * V.SNIFF_BYTES + b"\0", "src/broken.py": b"caf\xe9", "src/utf8.py": "é日 x\n".encode(), "src/noext": b"x", "src/.hidden": b"x", "src/a.min.js": b"x", "src/yarn.lock": b"x",
        ".git/config": b"x", ".git/objects/a.py": b"x", "node_modules/p/index.js": b"x", "src/node_modules/q.js": b"x", "pkg.egg-info/top.txt": b"x", "docs/en/a.md": b"a", "docs/english/b.md": b"b", "docs/file with space.md": b"s", "build.md": b"not a folder",
    }
    for path, content in files.items():
        os.makedirs(os.path.dirname(base / path) or ".", exist_ok=True)
        (base / path).write_bytes(content)
    os.symlink("/nowhere/at/all.py", base / "src" / "dangling.py")
    return str(base)


def test_tree_is_read_with_reasons(spark, root):
    rows = {r["path"]: r for r in T.read_tree(spark, root).collect()}
    reasons = {p: r["skip_reason"] for p, r in rows.items()}
    assert reasons == {
        "README.md": None, "build.md": None, "docs/en/a.md": None, "docs/english/b.md": None, "docs/file with space.md": None, "src/main.py": None, "src/deep/er/UPPER.PY": None, "src/edge.py": None, "src/late_nul.py": None, "src/utf8.py": None,
        "src/.hidden": "unknown extension", "src/a.min.js": "ignored extension", "src/big.py": "too large", "src/broken.py": "decode error", "src/empty.py": "empty file", "src/noext": "unknown extension", "src/nul.py": "binary", "src/yarn.lock": "ignored filename",
    }
    assert rows["README.md"]["text"] == "# Title\nline\nnext\n" and rows["src/utf8.py"]["text"] == "é日 x\n"
    assert rows["src/deep/er/UPPER.PY"]["language"] == "python" and rows["src/big.py"]["size_bytes"] == 2_000_000
    assert all((r["text"] is None) == (r["skip_reason"] is not None) for r in rows.values())


def test_include_and_exclude_go_part_by_part(spark, root):
    rows = {r["path"]: r["skip_reason"] for r in T.read_tree(spark, root, include=["docs/en", "src"], exclude=["src/deep"]).collect()}
    assert rows["docs/en/a.md"] is None and rows["docs/english/b.md"] == "outside include list" and rows["src/deep/er/UPPER.PY"] == "user excluded"


def test_ignored_folders_are_never_opened(root):
    listed = []

    class Counting:
        def __init__(self):
            self.own = fs.LocalFileSystem()

        def get_file_info(self, what):
            listed.append(what.base_dir.removeprefix(root).lstrip("/"))
            return self.own.get_file_info(what)

    found = dict(T.walk(Counting(), root))
    assert sorted(listed) == ["", "docs", "docs/en", "docs/english", "src", "src/deep", "src/deep/er"]
    assert "src/big.py" in found and not any("node_modules" in p or ".git/" in p for p in found)


def test_files_are_dealt_out_by_size_before_they_are_read():
    found = [T.File(f"d{k % 3}/{k:03}", k * 10, None if k % 4 else "too large") for k in range(200)]
    parts = T.planned(found, 4000, 30)
    flat = [f for p in parts for f in p]
    assert flat == sorted(found, key=lambda f: f.path.split("/")) and len(parts) > 10
    assert all(sum(f.cost for f in p) <= 4000 and len(p) <= 30 for p in parts)
    assert [len(p) for p in T.planned([T.File("a", 9000, None), T.File("b", 1, None)], 4000)] == [1, 1]


def test_partitions_and_pushed_languages(spark, root):
    rows = T.read_tree(spark, root, partition_bytes=100_000)
    assert rows.rdd.getNumPartitions() > 2
    markdown = rows.where(F.col("language") == "markdown")
    assert {r["path"] for r in markdown.collect()} == {"README.md", "build.md", "docs/en/a.md", "docs/english/b.md", "docs/file with space.md"}
    reader = T.TreeReader({"path": root})
    left = list(reader.pushFilters([T.EqualTo(("language",), "markdown"), T.EqualTo(("path",), "x")]))
    assert [f.attribute for f in left] == [("path",)]
    assert Counter(T.language(f.path) for p in reader.partitions() for f in p.files) == {"markdown": 5}


def test_missing_and_empty_folders(spark, root, tmp_path):
    assert T.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no folder"):
        T.read_tree(spark, str(tmp_path / "none")).count()


def test_written_trees_read_back(spark, tmp_path):
    files = spark.createDataFrame([("a/b.py", bytearray(b"x = 1\n")), ("c.md", bytearray("é".encode())), ("d/empty.py", None)], "path string, content binary")
    T.write_tree(files, str(tmp_path / "t"))
    T.write_tree(files, str(tmp_path / "t"))  # a task that runs again
    got = {r["path"]: (r["skip_reason"], r["text"]) for r in T.read_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {"a/b.py": (None, "x = 1\n"), "c.md": (None, "é"), "d/empty.py": ("empty file", None)}


def test_repositories_keep_files_of_one_path_apart(spark, tmp_path):
    files = spark.createDataFrame([("0/src/yarn.lock", bytearray(b"a")), ("1/src/yarn.lock", bytearray(b"bc")), ("1/node_modules/x.js", bytearray(b"x")), ("0/docs/a.md", bytearray(b"t"))], "path string, content binary")
    T.write_tree(files, str(tmp_path / "r"))
    rows = T.read_tree(spark, str(tmp_path / "r"), include=["src"], repositories=True).collect()
    assert sorted((r["path"], r["size_bytes"], r["skip_reason"]) for r in rows) == [("docs/a.md", 1, "outside include list"), ("src/yarn.lock", 1, "ignored filename"), ("src/yarn.lock", 2, "ignored filename")]


def test_scan_tree_gives_every_document_that_shares_a_path(spark, tmp_path):
    from siltstone.plans.corpus import scan_tree

    spark.createDataFrame([(k * 91, "x" * k, "en", "src2", k) for k in range(1, 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["path"], r["size_bytes"]) for r in scan_tree(spark, str(tmp_path)).orderBy("size_bytes").collect()] == [("src/src2/yarn.lock", k) for k in range(1, 4)]
