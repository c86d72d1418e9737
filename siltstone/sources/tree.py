"""A folder of source files as a Spark data source: `spark.read.format("source_tree").load(root)`.

The planner walks the folder, never opens an ignored directory, decides on names and sizes, and deals the files out by
size before a byte is read. Readers sniff, decode and return one row per file: why it is skipped, or its text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from siltstone.functions import values as V

NAME = "source_tree"
FIELDS = [("path", pa.string()), ("language", pa.string()), ("size_bytes", pa.int64()), ("skip_reason", pa.string()), ("text", pa.string())]
PARTITION_BYTES, PARTITION_FILES = 16_000_000, 10_000
BATCH_BYTES = 4_000_000


@dataclass(frozen=True)
class File:
    path: str  # below the root, or below its repository
    size: int | None  # None where the size can't be told
    reason: str | None  # why it is skipped, as far as name and size tell
    repository: str = ""  # folder of the root that holds it, where the root is a folder of repositories

    @property
    def cost(self) -> int:
        """Bytes that reading the file takes."""
        return 0 if self.reason or self.size is None else self.size


def ignored(directory: str) -> bool:
    return directory in V.IGNORED_DIRS or directory.endswith(".egg-info")


def language(path: str) -> str:
    stem, dot, end = path.rpartition("/")[2].rpartition(".")
    return V.LANGUAGE_OF.get(f".{end.lower()}", "unknown") if dot and stem else "unknown"


def below(path: str, prefixes: list[str]) -> bool:
    """Part by part, so docs/en doesn't hold docs/english."""
    return any(f"{path}/".startswith(p.rstrip("/") + "/") for p in prefixes)


def early_reason(path: str, size: int | None, include: list[str], exclude: list[str]) -> str | None:
    """The first reason to skip a file that needs none of its bytes."""
    name = path.rpartition("/")[2]
    checks: list[tuple[str, Callable[[], bool]]] = [
        ("outside include list", lambda: bool(include) and not below(path, include)), ("user excluded", lambda: below(path, exclude)),
        ("ignored filename", lambda: name in V.IGNORED_NAMES), ("ignored extension", lambda: name.endswith(tuple(V.IGNORED_SUFFIXES))),
        ("unknown extension", lambda: language(path) == "unknown"), ("stat failed", lambda: size is None),
        ("empty file", lambda: size == 0), ("too large", lambda: size > V.MAX_FILE_BYTES),
    ]
    return next((reason for reason, holds in checks if holds()), None)


def walk(files: fs.FileSystem, root: str) -> Iterator[tuple[str, int | None]]:
    """(path below root, size) of all files but those in ignored directories, which are not listed."""
    waiting = [""]
    while waiting:
        at = waiting.pop()
        for info in files.get_file_info(fs.FileSelector(f"{root}/{at}".rstrip("/"))):
            path = f"{at}/{info.base_name}" if at else info.base_name
            if info.type == fs.FileType.Directory:
                if not ignored(info.base_name):
                    waiting.append(path)
            elif info.type == fs.FileType.File:
                yield path, info.size


def planned(found: list[File], most_bytes: int, most_files: int = PARTITION_FILES) -> list[list[File]]:
    """Files in the order of their paths, in stretches of at most most_bytes to read and most_files (a larger file alone)."""
    out: list[list[File]] = []
    held = 0
    for file in sorted(found, key=lambda f: (f.path.split("/"), f.repository)):
        if not out or held + file.cost > most_bytes or len(out[-1]) == most_files:
            out.append([])
            held = 0
        out[-1].append(file)
        held += file.cost
    return out


def read_file(files: fs.FileSystem, root: str, file: File) -> tuple[str | None, str | None]:
    """(skip reason, text) of a file that its name and size let through."""
    try:
        with files.open_input_stream("/".join(filter(None, (root, file.repository, file.path)))) as stream:
            content = stream.read(V.SNIFF_BYTES)
            if b"\0" in content:
                return "binary", None
            content += stream.read()
    except OSError:
        return "binary", None  # a file that can't be opened can't be sniffed
    try:
        return None, content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return "decode error", None


@dataclass
class Stretch(InputPartition):
    files: list[File]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("load() takes the folder's path")
        self.uri = options["path"]
        self.include, self.exclude = (json.loads(options.get(k, "[]")) for k in ("include", "exclude"))
        self.most_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.repositories = options.get("repositories", "false") == "true"
        self.languages: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Files of other languages are left out before they are dealt out (spark.sql.python.filterPushdown.enabled)."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("language",):
                self.languages = wanted if self.languages is None else self.languages & wanted
            elif not (isinstance(f, IsNotNull) and f.attribute in (("language",), ("path",))):
                yield f

    def partitions(self) -> list[Stretch]:
        files, root = fs.FileSystem.from_uri(self.uri)
        if files.get_file_info(root).type != fs.FileType.Directory:
            raise ValueError(f"no folder {self.uri}")
        held = [i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory] if self.repositories else [""]
        found = [File(p, n, early_reason(p, n, self.include, self.exclude), r) for r in held for p, n in walk(files, f"{root}/{r}".rstrip("/")) if self.languages is None or language(p) in self.languages]
        return [Stretch(x) for x in planned(found, self.most_bytes)] or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(self.uri)
        rows, held = [], 0
        for file in partition.files:
            reason, text = (file.reason, None) if file.reason else read_file(files, root, file)
            rows.append((file.path, language(file.path), file.size, reason, text))
            held += file.cost
            if held > BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS])


class SourceTree(DataSource):
    """Options: path (load()'s), include and exclude (JSON lists of paths below it), partitionBytes, repositories (whether
    the folders below path are trees of their own, from which paths are counted)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, language string, size_bytes long, skip_reason string, text string"

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), partition_bytes: int = PARTITION_BYTES, repositories: bool = False) -> DataFrame:
    """path (below root), language, size_bytes, skip_reason, text (null where skipped) of the files under root, a row per
    file outside of ignored directories, in the order of paths over the partitions. repositories: root's folders are trees
    of their own and paths are counted from these, so a path can come back once from each.

    Text is strict UTF-8 with \\n as the end of lines. root: a folder or URI of a file system that pyarrow opens. The planner holds names and sizes only.
    """
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(NAME).option("partitionBytes", str(partition_bytes)).option("repositories", str(repositories).lower())
    return rows.option("include", json.dumps(list(include))).option("exclude", json.dumps(list(exclude))).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """files (path, content binary) as files under root. Each is written whole by its task, so a task that runs again
    leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.create_dir(f"{base}/{path}".rpartition("/")[0])
                with out.open_output_stream(f"{base}/{path}") as stream:
                    stream.write(content or b"")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["none"])

    files.select("path", "content").mapInArrow(run, "none int").write.format("noop").mode("overwrite").save()
