"""Local or shared folders as tables: a catalog of paths, and their bytes.

Listing a tree is metadata work and happens on the driver; reading happens on
the executors, one row per file, so a folder must be one that all of them see.
Spark's own binaryFile source passes over empty and hidden files and knows no
folders, so it is not used.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.paths import DEFAULT_EXCLUDES, normalize_path

LISTED = "disk string, path string, size long, mode int, mtime_ns long, ctime_ns long, ino long"


@dataclass
class Catalog:
    """What a walk found: (disk path, archive path, stat), folders and what was left out."""

    files: list[tuple[str, str, os.stat_result]] = field(default_factory=list)
    directories: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def _fits(path: str, patterns: Sequence[str]) -> bool:
    parts = path.split("/")
    return any(p in parts or fnmatch.fnmatchcase(path, p) for p in patterns)


class _Names:
    """Archive paths and inodes that are taken."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}
        self.nodes: set[tuple[str, int, int]] = set()

    def take(self, path: str, kind: str, info: os.stat_result) -> None:
        node = (kind, info.st_dev, info.st_ino)
        if node in self.nodes:
            raise ValueError(f"{path!r} is the same {kind} as one before")
        if (key := path.casefold()) in self.paths:
            raise ValueError(f"{path!r} collides with {self.paths[key]!r}")
        self.nodes.add(node)
        self.paths[key] = path


def walk(inputs: Sequence[str], *, profile: str = "general", exclude: Sequence[str] = (), include: Sequence[str] = (), include_all: bool = False, follow_symlinks: bool = False, reserved: Sequence[str] = ()) -> Catalog:
    """All files below the inputs under normal archive paths, sorted.

    Excludes apply below a root, not to the root's own name or a file that is
    named directly; includes apply to files only. `reserved` is never read.
    """
    patterns = [*(() if include_all or profile != "source" else DEFAULT_EXCLUDES), *exclude]
    kept_out = {os.path.realpath(p) for p in reserved}
    kept_nodes = {(s.st_dev, s.st_ino) for s in (os.stat(p) for p in reserved if os.path.exists(p))}

    def is_reserved(disk: str) -> bool:
        """By its real path, or as another name of the same node."""
        if os.path.realpath(disk) in kept_out:
            return True
        info = os.stat(disk) if kept_nodes and os.path.exists(disk) else None
        return info is not None and (info.st_dev, info.st_ino) in kept_nodes

    out, names = Catalog(), _Names()

    def add(disk: str, path: str) -> None:
        info = os.stat(disk)
        names.take(path, "file", info)
        out.files.append((disk, path, info))

    def descend(disk: str, path: str, below: str) -> None:
        names.take(path, "folder", os.stat(disk))
        out.directories.append(path)
        for entry in sorted(os.scandir(disk), key=lambda e: e.name):
            inner, tail = normalize_path(f"{path}/{entry.name}"), f"{below}/{entry.name}".lstrip("/")
            skip = (entry.is_symlink() and not follow_symlinks) or _fits(tail, patterns) or _fits(inner, [p for p in patterns if "/" in p or "*" in p])
            if skip or is_reserved(entry.path):
                out.excluded.append(inner)
            elif entry.is_dir():
                descend(entry.path, inner, tail)
            elif include and not _fits(inner, include):
                out.excluded.append(inner)
            elif entry.is_file():
                add(entry.path, inner)

    for source in map(os.fspath, inputs):
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        name = normalize_path(os.path.basename(os.path.abspath(source)))
        if os.path.islink(source) and not follow_symlinks:
            out.excluded.append(name)
        elif os.path.isfile(source):
            if is_reserved(source):
                raise ValueError(f"the output cannot be an input: {source}")
            if not include or _fits(name, include):
                add(source, name)
        else:
            descend(source, name, "")
    out.files.sort(key=lambda f: f[1])
    out.directories, out.excluded = sorted(set(out.directories)), sorted(set(out.excluded))
    return out


def catalog_tables(spark: SparkSession, catalog: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listing, directories, excluded) as DataFrames."""
    rows = [(os.path.abspath(d), p, s.st_size, s.st_mode & 0o777, s.st_mtime_ns, s.st_ctime_ns, s.st_ino) for d, p, s in catalog.files]
    listing = spark.createDataFrame(rows, LISTED)
    return listing, spark.createDataFrame([(d,) for d in catalog.directories], "path string"), spark.createDataFrame([(e,) for e in catalog.excluded], "path string")


def read_contents(listing: DataFrame) -> DataFrame:
    """(path, content, mode); a file that is another than when it was listed, or changed since, is an error.

    Nodes are compared by inode and times; device numbers differ from host to host.
    """

    def read(batches):
        for batch in batches:
            for disk, path, mode, *listed in zip(*(batch[c].to_pylist() for c in ("disk", "path", "mode", "size", "mtime_ns", "ctime_ns", "ino")), strict=True):
                with open(disk, "rb") as f:
                    before = os.fstat(f.fileno())
                    data = f.read()
                    after = os.fstat(f.fileno())
                same = all([s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_ino] == listed for s in (before, after))
                if not same or len(data) != listed[0]:
                    raise OSError(f"{disk} changed while it was read")
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([data], pa.binary()), "mode": pa.array([mode], pa.int32())})

    n = max(1, min(listing.count(), 4 * listing.sparkSession.sparkContext.defaultParallelism))
    return listing.repartition(n).mapInArrow(read, "path string, content binary, mode int")


def text_files(df: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """A text column as files: path = folder/key."""
    return df.select(F.concat(F.lit(folder + "/"), F.col(key).cast("string")).alias("path"), F.col(text).cast("string").cast("binary").alias("content"))
