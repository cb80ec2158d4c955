"""A Spark data source that walks file trees: ``spark.read.format("mediatree")``.

Unlike the built-in file index it keeps hidden and empty files, and drops directories whose names start with ``$``
or ``_replaced``. One partition for each directory below the root (and one for the root's own files), split down to
``depth`` levels, so that large trees are walked by all executors. Only metadata is read.

Options: ``path`` (the root), ``depth`` (levels that partitions are made of, 1), ``skip`` (a JSON list of relative
directories not to enter, such as complete ones), ``media`` (``true``: media files only).
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mendspan.functions.names import EXTENSIONS

SCHEMA = "relpath string, path string, size long, mtime double, is_dir boolean, readable boolean"


class Part(InputPartition):
    def __init__(self, relpath: str, deep: bool) -> None:
        self.relpath, self.deep = relpath, deep


def enters(name: str) -> bool:
    return not name.startswith(("$", "_replaced"))


class MediaTreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.depth = int(options.get("depth", "1"))
        self.skip = set(json.loads(options.get("skip", "[]")))
        self.media = options.get("media", "false").lower() == "true"
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is not a directory")

    def partitions(self) -> list[Part]:
        parts, level = [], [""]
        for _ in range(self.depth):
            below = []
            for rel in level:
                parts.append(Part(rel, deep=False))
                below += self._children(rel)
            level = below
        return [*parts, *(Part(rel, deep=True) for rel in level)]

    def _children(self, rel: str) -> list[str]:
        try:
            with os.scandir(os.path.join(self.root, rel)) as found:
                names = sorted(x.name for x in found if x.is_dir(follow_symlinks=False) and enters(x.name))
        except OSError:
            return []
        return [y for y in (f"{rel}/{n}" if rel else n for n in names) if y not in self.skip]

    def read(self, part: Part):
        todo = [part.relpath]
        while todo:
            rel = todo.pop()
            try:
                with os.scandir(os.path.join(self.root, rel)) as found:
                    entries = sorted(found, key=lambda x: x.name)
            except OSError:
                yield rel, os.path.join(self.root, rel), None, None, True, False
                continue
            yield rel, os.path.join(self.root, rel), None, None, True, True
            for x in entries:
                inner = f"{rel}/{x.name}" if rel else x.name
                if x.is_dir(follow_symlinks=False):
                    if part.deep and enters(x.name) and inner not in self.skip:
                        todo.append(inner)
                elif not self.media or x.name.lower().endswith(tuple(f".{e}" for e in EXTENSIONS)):
                    try:
                        stat = x.stat()
                    except OSError:
                        continue
                    yield inner, x.path, stat.st_size, stat.st_mtime, False, True


class MediaTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mediatree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaTreeReader:
        return MediaTreeReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(MediaTree)


def volume_serial(path: str) -> str:
    """An identity of the volume that holds ``path``."""
    try:
        return f"dev-{os.stat(path).st_dev:x}"
    except OSError:
        return "unknown"


def volume_label(path: str) -> str:
    """A label for a volume that was given none: the last name of its mount point, or ``drive``."""
    place = os.path.abspath(path)
    while not os.path.ismount(place):
        place = os.path.dirname(place)
    return os.path.basename(place) or "drive"
