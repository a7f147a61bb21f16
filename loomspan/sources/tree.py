"""A Spark data source for a tree of files: batch reading by folders, and streaming of what has changed.

``register(spark)``, then ``spark.read.format("file_tree").load(root)`` or ``spark.readStream``. Planning walks the folders and leaves
out ignored names before it enters them; partitions are groups of folders, and tasks list and read the files. Symbolic links are left
out, as loops could hide behind them; with ``follow`` each folder or file is read once, by device and inode, under the first path
that leads to it. The root has to be a folder that the driver and all executors see under this path.

Options: ``path``; ``ignore``, names as a JSON list (the engine's own list); ``follow`` (false); ``folders``, the most folders of a
partition (64); ``max_bytes``, the size above which a file is left out (the engine's limit).

The stream's offset is the latest change time in nanoseconds that was seen. A batch holds the files that changed after the last one;
a file that changes again before it is read comes once, as it is then; one that changes in the nanosecond of an offset would be
missed, and files that are deleted do not show: the manifest tells them.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file_path string, content binary, length long, modified timestamp"


@dataclass
class Folders(InputPartition):
    """Folders as (absolute, relative path), links to read as files, and the span of change times that is wanted."""

    folders: list[tuple[str, str]]
    links: list[tuple[str, str]]
    after: int = -1
    until: int | None = None


class Walk:
    def __init__(self, options: dict):
        from ..config import SETTINGS
        from .files import IGNORED_NAMES

        self.root = options["path"].removeprefix("file://").removeprefix("file:").rstrip("/") or "/"
        self.ignored = frozenset(json.loads(options["ignore"]) if "ignore" in options else IGNORED_NAMES)
        self.follow = options.get("follow", "false").lower() == "true"
        self.most = int(options.get("folders", 64))
        self.max_bytes = int(options.get("max_bytes", SETTINGS.file_bytes))

    def entries(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as found:
                return sorted((e for e in found if e.name not in self.ignored), key=lambda e: e.name)
        except (PermissionError, FileNotFoundError):
            return []

    def folders(self) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        """All folders in order, and the links that are read as files."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        own = lambda p: (lambda s: (s.st_dev, s.st_ino))(os.stat(p))
        seen, out, linked, todo, later = {own(self.root)}, [], [], [(self.root, "")], []
        while todo or later:
            if not todo:  # folders behind links come when all others have been seen
                path, name = later.pop(0)
                if not os.path.exists(path) or (key := own(path)) in seen:
                    continue
                seen.add(key)
                if not os.path.isdir(path):
                    linked.append((path, name))
                    continue
                todo.append((path, name))
            path, name = todo.pop()
            out.append((path, name))
            inside = []
            for e in self.entries(path):
                to = (e.path, f"{name}/{e.name}" if name else e.name)
                if e.is_symlink():
                    later += [to] * self.follow
                elif e.is_dir(follow_symlinks=False) and (key := own(e.path)) not in seen:
                    seen.add(key)
                    inside.append(to)
                elif self.follow and e.is_file(follow_symlinks=False):
                    seen.add(own(e.path))
            todo += reversed(inside)
        return out, linked

    def partitions(self, after: int = -1, until: int | None = None) -> list[Folders]:
        out, linked = self.folders()
        groups = [Folders(out[k : k + self.most], [], after, until) for k in range(0, len(out), self.most)]
        groups[0].links = linked
        return groups

    def files(self, part: Folders) -> Iterator[tuple[str, str, os.stat_result]]:
        for folder, name in part.folders:
            for e in self.entries(folder):
                if not e.is_symlink() and e.is_file(follow_symlinks=False):
                    yield e.path, f"{name}/{e.name}" if name else e.name, e.stat()
        for path, name in part.links:
            if os.path.exists(path):
                yield path, name, os.stat(path)

    def rows(self, part: Folders) -> Iterator[tuple]:
        for path, name, stat in self.files(part):
            if stat.st_size > self.max_bytes or stat.st_ctime_ns <= part.after or (part.until is not None and stat.st_ctime_ns > part.until):
                continue
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError:  # gone or closed to us meanwhile
                continue
            yield name, content, len(content), dt.datetime.fromtimestamp(stat.st_mtime, dt.timezone.utc)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.walk = Walk(options)

    def partitions(self) -> list[Folders]:
        return self.walk.partitions()

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.walk.rows(partition)


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.walk = Walk(options)

    def initialOffset(self) -> dict:
        return {"changed_ns": -1}

    def latestOffset(self) -> dict:
        return {"changed_ns": max((s.st_ctime_ns for part in self.walk.partitions() for _, _, s in self.walk.files(part)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.walk.partitions(start["changed_ns"], end["changed_ns"])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.walk.rows(partition)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FileTree)
    return spark
