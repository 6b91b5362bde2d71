"""Folders of notes as a data source: files are listed once, and only those that filters on their path, name, age or
size leave over are opened, in tasks of about so many bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, name string, modified timestamp, length long, raw string"
#: Bytes of files that one task reads.
TASK_BYTES = 16_000_000
# Folders and files that are never read.
EXCLUDED_FOLDERS = [".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".tox"]
EXCLUDED_NAMES = [".env", "id_rsa", "id_dsa", "password-store", "Passwords", "login.keychain-db"]
EXCLUDED_ENDINGS = [".key", ".pem", ".p12", ".pfx", ".keystore"]
SECRET_FOLDERS = ["password-store", "passwords", "secrets", "credentials"]


def excluded(path: str) -> str | None:
    """Why a file (a path relative to the folder) is not read."""
    *folders, name = path.split("/")
    if any(f in EXCLUDED_FOLDERS for f in folders):
        return "excluded folder"
    if name in EXCLUDED_NAMES or name.lower().startswith(".env") or name.lower().endswith(tuple(EXCLUDED_ENDINGS)):
        return "secret file"
    if any(part.lower() in SECRET_FOLDERS for part in (*folders, name)):
        return "secret store"
    return None


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str, float, int]]  # relative path, place, modified, length


TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


class NotesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.listing = options.get("content", "true") == "false"
        self.filters: list[tuple[type, str, Any, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes those that a listing can answer; Spark evaluates the rest."""
        for f in filters:
            inner, wanted = (f.child, False) if isinstance(f, Not) else (f, True)
            column = getattr(inner, "attribute", ("",))
            if type(inner) in TESTS and column[0] in ("path", "name", "length") and inner.value is not None:
                self.filters.append((type(inner), column[0], inner.value, wanted))
            else:
                yield f

    def _wanted(self, path: str, length: int) -> bool:
        values = {"path": path, "name": path.rsplit("/", 1)[-1], "length": length}
        return all(TESTS[kind](values[column], value) == wanted for kind, column, value, wanted in self.filters)

    def partitions(self) -> Sequence[InputPartition]:
        """The files to read, in path order, cut into tasks; lists the folder, opens none."""
        system, root = pa.fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] or self.options["path"].startswith("file:") else (pa.fs.LocalFileSystem(), self.options["path"])
        root = root.rstrip("/")
        hidden, endings = self.options.get("hidden", "false") == "true", tuple(x for x in self.options.get("endings", ".md").split(",") if x)
        found = []
        for info in system.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            path = info.path[len(root) :].lstrip("/")
            if info.type != pa.fs.FileType.File or excluded(path) and not self.listing or not hidden and any(p.startswith(".") for p in path.split("/")):
                continue
            if (not endings or path.lower().endswith(endings)) and self._wanted(path, info.size):
                found.append((path, info.path, info.mtime.timestamp() if info.mtime else 0.0, info.size))
        groups, size = [[]], 0
        for file in sorted(found):
            if groups[-1] and size + file[3] > int(self.options.get("taskbytes", TASK_BYTES)):
                groups.append([])
                size = 0
            groups[-1].append(file)
            size += file[3]
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system = pa.fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] or self.options["path"].startswith("file:") else pa.fs.LocalFileSystem()
        for path, place, modified, length in partition.files:
            if self.listing:
                yield path, path.rsplit("/", 1)[-1], datetime.fromtimestamp(modified, timezone.utc), length, None
                continue
            with system.open_input_stream(place) as file:
                yield path, path.rsplit("/", 1)[-1], datetime.fromtimestamp(modified, timezone.utc), length, file.read().decode("utf-8", "replace")


class NotesSource(DataSource):
    """spark.read.format("notes").load(folder): path (relative), name, modified, length, raw.

    Options: endings (".md"; a list with commas, empty for all), hidden ("true" reads hidden files too), taskBytes, and
    content ("false" lists all files, excluded ones too, and opens none: raw is null). Secret files and stores are
    never opened."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("load() needs the folder")
        return NotesReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NotesSource)
