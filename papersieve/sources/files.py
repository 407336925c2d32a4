"""Document files as a Spark data source: hidden names included, tasks bounded by bytes, streams as well.

Register it once for a session, then read a folder:

    spark.dataSource.register(DocumentFiles)
    spark.read.format("documents").option("path", folder).load()
    spark.readStream.format("documents").option("path", folder).option("log", log).load()
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Fixed value: file names taken as documents, in any letter case.
PATTERN = "*.pdf"
BYTES = 128 << 20
"""Bytes of the files of one task; a larger file is a task of its own."""
FILES = 10_000
"""Files of one task, so that tasks of very small ones end soon as well."""
BATCH_BYTES = 16 << 20
"""Bytes that a task hands on at once."""


class File(NamedTuple):
    path: str
    size: int
    modified: int
    """Microseconds since 1970."""


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (a path, or an address with a scheme) and its path there."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder[5:]}")


def list_files(folder: str, pattern: str = PATTERN) -> list[File]:
    """Files directly inside a folder whose names match, in order of names; an absent folder is an error.

    Hidden names are listed as well, subfolders are not, whatever their names.
    """
    system, path = _opened(folder)
    found = system.get_file_info(pafs.FileSelector(path, recursive=False))
    kept = [f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name.lower(), pattern)]
    return [File(f.path, f.size or 0, (f.mtime_ns or 0) // 1000) for f in sorted(kept, key=lambda f: f.base_name)]


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, files: list[File]):
        super().__init__([tuple(f) for f in files])


def dealt(files: Iterable[File], most_bytes: int = BYTES, most_files: int = FILES) -> list[Files]:
    """Files in tasks of at most ``most_bytes`` bytes, or of one file."""
    tasks: list[Files] = []
    held: list[File] = []
    size = 0
    for file in files:
        if held and (size + file.size > most_bytes or len(held) >= most_files):
            tasks.append(Files(held))
            held, size = [], 0
        held.append(file)
        size += file.size
    return [*tasks, Files(held)] if held else tasks


class _Rows:
    """Reads the files of a task; runs on executors."""

    def __init__(self, options: dict[str, str]):
        self.folder = options.get("path", "")
        if not self.folder:
            raise ValueError("name a folder: .option('path', ...)")
        self.pattern = options.get("pattern", PATTERN).lower()
        self.content = options.get("content", "true").lower() != "false"
        self.bytes = int(options.get("bytes", BYTES))

    def rows(self, files: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        held: list[tuple] = []
        size = 0
        for path, length, modified in files:
            content = None
            if self.content:
                with system.open_input_stream(path) as stream:
                    content = stream.read()
            held.append((path, path.rpartition("/")[2], length, modified, content))
            size += len(content or b"") + len(path)
            if size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary()]
        names = ["path", "file_name", "size", "modified", "content"]
        n = 5 if self.content else 4
        columns = list(zip(*rows, strict=True))[:n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[:n])


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._rows = _Rows(options)

    def partitions(self) -> list[InputPartition]:
        return dealt(list_files(self._rows.folder, self._rows.pattern), self._rows.bytes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self._rows.rows(partition.value)


class DocumentStreamReader(DataSourceStreamReader):
    """New files by name, each once. An offset is a number of entries in a log of listings.

    An entry lists the files that a listing has found and no entry before it. It is written before its
    offset is handed out, so a batch that is repeated reads the same files, and a
    restarted query goes on behind what it has read. Files are known by name: one that
    is replaced later does not come again.
    """

    def __init__(self, options: dict[str, str]):
        self._rows = _Rows(options)
        if "log" not in options:
            raise ValueError("a stream needs a folder of its own for listings: .option('log', ...)")
        self._system, self._log = _opened(options["log"])
        self._entries = 0
        self._known: set[str] = set()

    def _entry(self, number: int) -> str:
        return f"{self._log.rstrip('/')}/{number:010d}.json"

    def _read(self, number: int) -> list[File]:
        with self._system.open_input_stream(self._entry(number)) as stream:
            return [File(*f) for f in json.loads(stream.read())]

    def _catch_up(self) -> None:
        """Read entries that were written before this reader was made."""
        while self._system.get_file_info(self._entry(self._entries)).type == pafs.FileType.File:
            self._known.update(f.path for f in self._read(self._entries))
            self._entries += 1

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        new = [f for f in list_files(self._rows.folder, self._rows.pattern) if f.path not in self._known]
        if new:
            self._system.create_dir(self._log, recursive=True)
            aside = f"{self._entry(self._entries)}.new"
            with self._system.open_output_stream(aside) as stream:
                stream.write(json.dumps(new).encode())
            self._system.move(aside, self._entry(self._entries))  # whole or not at all
            self._catch_up()
        return {"entries": self._entries}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [f for number in range(start["entries"], end["entries"]) for f in self._read(number)]
        return dealt(files, self._rows.bytes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self._rows.rows(partition.value)

    def commit(self, end: dict) -> None:
        """Entries stay: they tell what was read."""


class DocumentFiles(DataSource):
    """Options: ``path``, a folder; ``pattern`` of lower-cased names (``*.pdf``); ``content`` false leaves contents
    unread; ``bytes`` of a task; ``log``, a folder of a stream for its listings.

    Listings are made on the driver, contents are read by the tasks, and both go through Arrow's
    file systems: local and mounted paths, ``hdfs://``, ``s3://``, ``gs://``.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        columns = "path string, file_name string, size bigint, modified timestamp"
        content = self.options.get("content", "true").lower() != "false"
        return columns + (", content binary" if content else "")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DocumentReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return DocumentStreamReader(dict(self.options))
