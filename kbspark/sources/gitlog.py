"""A streaming source of landed git logs: `spark.readStream.format("gitlog").load(folder)`.

A folder holds, for each repository, a folder of its log dumps (readers.gitlog_to_events has their format, newest commit
first), of which the last by name counts; a poll lands a new one. The offset is, per repository, the dump that was read and
its newest sha. A commit is new if it stands in the dump and not in the one before: told by sha and never by date, so that
rebased, merged and equally dated commits arrive, each once. A repository's first batch is its newest `first` commits.

Files are opened by pyarrow's file systems, so the folder is a local or mounted path or an address that they know. A
repository is a partition: one dump is one task's text.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "repository string, sha string, author string, occurred_at timestamp, subject string, body string"


def _listed(folder: str) -> dict[str, list[str]]:
    """The dumps of each repository, in order of their names."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found: dict[str, list[str]] = {}
    for info in system.get_file_info(fs.FileSelector(path, recursive=True)):
        parts = info.path[len(path) :].strip("/").split("/")
        if info.is_file and len(parts) == 2 and not parts[1].startswith((".", "_")):
            found.setdefault(parts[0], []).append(parts[1])
    return {repository: sorted(names) for repository, names in found.items()}


def _read(folder: str, repository: str, name: str) -> str:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    with system.open_input_stream(f"{path}/{repository}/{name}") as f:
        return f.read().decode("utf-8", "replace")


def commits(dump: str) -> Iterator[tuple[str, str, datetime | None, str, str]]:
    """(sha, author, date, subject, body) of a dump's records; those of fewer than four fields are left out."""
    for record in dump.split("\x1e"):
        fields = record.strip("\n").split("\x00")
        if len(fields) >= 4 and fields[0].strip():
            try:
                at = datetime.fromisoformat(fields[2].strip())
            except ValueError:
                at = None
            yield fields[0].strip(), fields[1], at, fields[3], fields[4] if len(fields) > 4 else ""


class Log(InputPartition):
    """A repository's dump, and the one before it, if there was any."""

    def __init__(self, repository: str, name: str, before: str | None):
        super().__init__(None)
        self.repository, self.name, self.before = repository, name, before


class GitLogReader(DataSourceStreamReader):
    def __init__(self, folder: str, first: int):
        self.folder, self.first = folder, first

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {repository: names[-1] for repository, names in _listed(self.folder).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Log(r, name, start.get(r)) for r, name in sorted(end.items()) if start.get(r) != name]

    def read(self, partition: Log) -> Iterator[tuple]:
        known = {c[0] for c in commits(_read(self.folder, partition.repository, partition.before))} if partition.before else set()
        left = -1 if partition.before else self.first
        for sha, author, at, subject, body in commits(_read(self.folder, partition.repository, partition.name)):
            if sha in known:
                continue
            if left == 0:
                break
            known.add(sha)
            left -= 1
            yield partition.repository, sha, author, at, subject, body

    def commit(self, end: dict) -> None:
        pass


class GitLogSource(DataSource):
    """Registered by `spark.dataSource.register(GitLogSource)`. Options: path, first (200)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GitLogReader(self.options["path"], int(self.options.get("first", "200")))
