"""S9, F41 as a data source: folders of video files, listed where the tasks run.

The driver lists the roots' own entries only; each folder below is one
partition, walked by its task, which skips hidden folders instead of listing
them first. With ``ends`` a task also reads so many bytes from both ends of
each file, and nothing between them. As a stream, the source polls.

Roots are folders that all executors see, such as a mounted library.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions import helpers as H
from ..functions.constants import VIDEO_EXTENSIONS

#: Bytes of each end that a fingerprint is made of.
ENDS = 65_536
_FILE = "path string, size long, mtime double"


def _is_video(name: str) -> bool:
    return name.lower().endswith(VIDEO_EXTENSIONS) and not name.startswith(".")


def _ends(path: str, size: int, n: int) -> tuple[bytes, bytes]:
    with open(path, "rb") as f:
        head = f.read(n)
        f.seek(max(0, size - n))
        return head, f.read(n)


def walked(folder: str, deep: bool = True) -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime) of the video files in ``folder``, by name; hidden folders are not entered, files that vanish are left out."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        try:
            if e.is_dir():
                if deep and not e.name.startswith("."):
                    yield from walked(e.path)
            elif _is_video(e.name):
                found = e.stat()
                yield e.path, found.st_size, found.st_mtime
        except OSError:
            continue


@dataclass
class _Folder(InputPartition):
    path: str
    deep: bool


def _folders(roots: list[str]) -> list[_Folder]:
    """The partitions: each root's own files, and each folder right below a root."""
    out = []
    for root in roots:
        out.append(_Folder(root, False))
        out += [_Folder(e.path, True) for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir() and not e.name.startswith(".")]
    return out


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], ends: int):
        self.roots, self.ends = roots, ends

    def partitions(self) -> list[_Folder]:
        return _folders(self.roots)

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for path, size, mtime in walked(partition.path, partition.deep):
            if not self.ends:
                yield path, size, mtime
                continue
            try:
                yield path, size, mtime, *_ends(path, size, self.ends)
            except OSError:
                continue


class _Polls(SimpleDataSourceStreamReader):
    """Each batch lists the roots once. A poll that is lost with its batch is not repeated: the next one sees what is there."""

    def __init__(self, roots: list[str], every_s: float):
        self.roots, self.every_s = roots, every_s

    def initialOffset(self) -> dict:
        return {"poll": 0, "at": 0.0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = time.time()
        if now - start["at"] < self.every_s:
            return iter([]), start
        rows = []
        for root in self.roots:
            for path, size, mtime in walked(root):
                rows.append((path, size, max(0.0, now - mtime), datetime.fromtimestamp(now, UTC), start["poll"]))
        return iter(rows), {"poll": start["poll"] + 1, "at": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([])

    def commit(self, end: dict) -> None:
        pass


class VideoFiles(DataSource):
    """Format ``videos``; options roots (a JSON list), ends (bytes) and, for streams, every_s."""

    @classmethod
    def name(cls) -> str:
        return "videos"

    def _roots(self) -> list[str]:
        return [r.removeprefix("file://").rstrip("/") or "/" for r in json.loads(self.options["roots"])]

    def schema(self) -> str:
        if self.options.get("polls") == "true":
            return "path string, size long, quiet_s double, polled_at timestamp, event_id long"
        return _FILE + (", head binary, tail binary" if int(self.options.get("ends", 0)) else "")

    def reader(self, schema) -> _Reader:
        return _Reader(self._roots(), int(self.options.get("ends", 0)))

    def simpleStreamReader(self, schema) -> _Polls:
        return _Polls(self._roots(), float(self.options.get("every_s", 15)))


def list_folders(spark: SparkSession, roots: list[str], ends: int = 0) -> DataFrame:
    """(path, size, mtime) of video files under the roots; with ``ends`` also so many bytes of their head and tail."""
    spark.dataSource.register(VideoFiles)
    return spark.read.format("videos").option("roots", json.dumps(roots)).option("ends", ends).load()


def fingerprints(spark: SparkSession, roots: list[str]) -> DataFrame:
    """F41 over files: (path, size, fingerprint), read from 64 KB of each end."""
    files = list_folders(spark, roots, ENDS)
    return files.select("path", "size", H.oshash(files["size"], files["head"], files["tail"]).alias("fingerprint"))


def polls(spark: SparkSession, roots: list[str], every_s: float = 15.0) -> DataFrame:
    """A stream for T1: (path, size, quiet_s, polled_at, event_id) of every poll of the roots."""
    spark.dataSource.register(VideoFiles)
    return spark.readStream.format("videos").option("roots", json.dumps(roots)).option("polls", "true").option("every_s", every_s).load()
