"""A data source for trees of files: all names, hidden ones too, folders that are ignored are never opened.

    tree.register(spark)
    spark.read.format("tree").option("path", root).load().where("path like 'src/%'")
    spark.readStream.format("tree").option("path", root).load()

A batch read plans partitions by opening the upper folders until there are ``splits`` of
them; each task walks the folders that are its own. Filters on the path reach the plan
(register() turns that on for the session), so folders that can't hold such a path
are not opened. A stream tells files by their time of change, each time all those changed since.

Folders may lie wherever Arrow's file systems reach: file, hdfs, s3 and others by their scheme.
Files that vanish while they are listed are left out; the content of one that vanishes later is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from tessera.sources.scan import IGNORED_DIRS, MOST_BYTES, SNIFFED

#: Folders or files of a partition are planned until there are so many.
SPLITS = 64


@dataclass
class Part(InputPartition):
    """Folders to walk, single files, and the times of change (from, to] that are told, in nanoseconds."""

    folders: list[str]
    files: list[str]
    after: int | None = None
    until: int | None = None


class Tree:
    """A tree below a root and what is never opened in it."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the tree needs the option path")
        self.system, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
        self.root = self.root.rstrip("/")
        self.pruned = frozenset(x for x in options.get("prune", ",".join(IGNORED_DIRS)).split(",") if x)
        self.most = int(options.get("mostbytes", MOST_BYTES))
        self.splits = int(options.get("splits", SPLITS))

    def below(self, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders to open and files of a folder, by their relative paths."""
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True))
        folders = [self.relative(i) for i in found if i.type == fs.FileType.Directory and i.base_name not in self.pruned]
        return sorted(folders), sorted((i for i in found if i.type == fs.FileType.File), key=lambda i: i.path)

    def relative(self, info: fs.FileInfo) -> str:
        return info.path[len(self.root) + 1 :]

    def walk(self, folders: Iterable[str]) -> Iterator[fs.FileInfo]:
        todo = list(folders)
        while todo:
            more, files = self.below(todo.pop())
            todo += more
            yield from files

    def plan(self, within: list[str] | None = None) -> list[Part]:
        """Partitions of the whole tree, or of what may hold paths that begin with one of ``within``."""
        useful = lambda p: within is None or any(f"{p}/".startswith(w) or w.startswith(f"{p}/") for w in within)
        open_, single = [""], []
        while open_ and len(open_) + len(single) < self.splits:
            deeper = []
            for folder in open_:
                more, files = self.below(folder)
                deeper += [f for f in more if useful(f)]
                single += [f for f in map(self.relative, files) if within is None or any(f.startswith(w) for w in within)]
            if not deeper:
                open_ = []
                break
            open_ = deeper
        n = max(1, min(self.splits, len(open_) + len(single)))
        parts = [Part(open_[i::n], single[i::n]) for i in range(n)]
        return [p for p in parts if p.folders or p.files] or [Part([], [])]

    def rows(self, part: Part) -> Iterator[tuple]:
        listed = (i for i in self.system.get_file_info([f"{self.root}/{f}" for f in part.files]) if i.type == fs.FileType.File) if part.files else ()
        for source in (listed, self.walk(part.folders)):
            for i in source:
                at = i.mtime_ns or 0
                if (part.after is None or at > part.after) and (part.until is None or at <= part.until):
                    content = self.content(i)
                    yield self.relative(i), i.size, at // 1000, content, content is not None and b"\0" in content[:SNIFFED]

    def content(self, info: fs.FileInfo) -> bytes | None:
        """The bytes of a file that isn't too large, or null."""
        if info.size > self.most:
            return None
        try:
            with self.system.open_input_stream(info.path) as f:
                return f.read()
        except OSError:
            return None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.within = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what narrows the path for the plan; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                wanted = [f.value] if isinstance(f, (EqualTo, StringStartsWith)) else list(f.value) if isinstance(f, In) else None
                if wanted is not None:
                    self.within = wanted if self.within is None else [w for w in wanted if any(w.startswith(x) or x.startswith(w) for x in self.within)]
            yield f

    def partitions(self) -> list[Part]:
        return Tree(self.options).plan(self.within)

    def read(self, partition: Part) -> Iterator[tuple]:
        return Tree(self.options).rows(partition)


class TreeStream(DataSourceStreamReader):
    """Files by time of change: offsets are the latest time that has been told."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"after": -1}

    def latestOffset(self) -> dict:
        tree = Tree(self.options)
        return {"after": max((i.mtime_ns or 0 for i in tree.walk([""])), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = Tree(self.options).plan()
        for p in parts:
            p.after, p.until = start["after"], end["after"]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        return Tree(self.options).rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """Format "tree": path, size, modified (microseconds), content (null if over mostbytes) and binary."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, modified long, content binary, binary boolean"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema: StructType) -> TreeStream:
        return TreeStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def ignore_files(files: DataFrame) -> DataFrame:
    """(base, text) of the tree's ignore files, as rules are loaded from."""
    own = files.where(F.col("path").rlike("(^|/)\\.gitignore$") & F.col("content").isNotNull())
    return own.select(F.regexp_replace("path", "/?\\.gitignore$", "").alias("base"), F.decode("content", "UTF-8").alias("text"))
