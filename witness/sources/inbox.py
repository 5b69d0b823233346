"""The drop folder as a data source of its own: files are claimed by offset and routed when their batch is done.

``spark.dataSource.register(Inbox)``, then ``spark.read.format("inbox").load(path)`` or ``spark.readStream``.  Files lie in
the folder itself until they are routed to ``processed`` or ``failed`` below it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from witness.sources.drop_folder import route_files

SCHEMA = "path string, pos int, payload string"
FOLDERS = ("processed", "failed")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def waiting(path: str) -> list[str]:
    """Names of the JSON files that lie in the folder."""
    store, at = _store(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.extension == "json")


def entries(raw: str) -> list[str] | None:
    """The payloads of a file: its array's members, those of its ``items``, or the one object that it is; None if it is
    none of these."""
    try:
        found = json.loads(raw)
    except ValueError:
        return None
    if isinstance(found, dict):
        found = found["items"] if isinstance(found.get("items"), list) else [found]
    return [json.dumps(x, ensure_ascii=False) for x in found] if isinstance(found, list) else None


@dataclass
class Files(InputPartition):
    names: list[str]


def _read(path: str, names: list[str]) -> Iterator[tuple[str, int, str | None]]:
    """Rows of files, wherever routing may have brought them by now; position -1 without a payload for an unreadable one."""
    store, at = _store(path)
    for name in names:
        for folder in ("", *(f"/{f}" for f in FOLDERS)):
            full = f"{at}{folder}/{name}"
            if store.get_file_info(full).type == fs.FileType.File:
                with store.open_input_stream(full) as f:
                    found = entries(f.read().decode("utf-8", "replace"))
                yield from ((name, k, x) for k, x in enumerate(found)) if found is not None else ((name, -1, None),)
                break


def _split(names: list[str], n: int) -> list[Files]:
    return [Files(names[k::n]) for k in range(min(n, len(names)))]


class InboxReader(DataSourceReader):
    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path, tasks

    def partitions(self) -> list[Files]:
        return _split(waiting(self.path), self.tasks) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.path, partition.names)


class InboxStream(DataSourceStreamReader):
    """An offset names the files of its batch, ``most`` at a time.  A batch that is run again after a crash asks for the
    same names and finds them, routed or not; a file that isn't routed yet stays in the folder and comes with the next
    offset only if it isn't one of the last."""

    def __init__(self, path: str, tasks: int, most: int):
        self.path, self.tasks, self.most, self.last = path, tasks, most, {"files": []}

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        new = [n for n in waiting(self.path) if n not in set(self.last["files"])][: self.most]
        if new:
            self.last = {"files": new}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = end
        before = set(start["files"])
        return _split([n for n in end["files"] if n not in before], self.tasks) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.path, partition.names)

    def commit(self, end: dict) -> None:
        pass


class Inbox(DataSource):
    """Options: ``path``, ``tasks`` (tasks of a batch, 8 by default), ``most`` (files of a stream's batch, 1000)."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return SCHEMA

    def _tasks(self) -> int:
        return int(self.options.get("tasks", 8))

    def reader(self, schema) -> InboxReader:
        return InboxReader(self.options["path"], self._tasks())

    def streamReader(self, schema) -> InboxStream:
        return InboxStream(self.options["path"], self._tasks(), int(self.options.get("most", 1000)))


def route(verdicts: DataFrame, path: str) -> dict[str, str]:
    """Moves the files of a batch (path, pos, verdict) to ``processed`` or ``failed``, as ``route_files`` says, and tells where.

    The last thing a batch does: one that is run again finds its files where they went and moves them no further.
    """
    store, at = _store(path)
    told = {r.path: r.folder for r in route_files(verdicts).collect()}  # the files of one batch
    for folder in FOLDERS:
        store.create_dir(f"{at}/{folder}")
    for name, folder in told.items():
        if store.get_file_info(f"{at}/{name}").type == fs.FileType.File:
            store.move(f"{at}/{name}", f"{at}/{folder}/{name}")
    return told
