"""Captures as a data source: what clients recorded, written whole and read again in batch or as a stream.

A capture is one compressed JSON document (schema_version, provider, captured_at, pages).  ``captures`` is a Spark
data source: a partition is some files, a stream's offset the name of the last file, as names begin with the time at
which they were written.  Writing goes to names that readers don't look at; the commit moves them, an abort deletes
them, so a task that was killed in the middle leaves nothing behind.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PAGES = "file string, provider string, captured_at timestamp, page int, body string, error string"
VERSION = 1
ENDING = ".capture.json.gz"


def _listed(path: str) -> list[str]:
    """Names of the captures in a folder, in order."""
    return [name for name, _ in _sized(path)]


def _sized(path: str) -> list[tuple[str, int]]:
    """Captures in a folder with their bytes, in order of their names."""
    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.base_name.endswith(ENDING))


#: Parts that captures are dealt to, at least, if there are so many; and bytes of a part, about, where there are more.
FEWEST, PART = 64, 8 << 20


@dataclass
class CaptureFiles(InputPartition):
    names: list[str]

    def __post_init__(self) -> None:
        super().__init__(tuple(self.names))


def _parts(files: list[tuple[str, int]]) -> list[CaptureFiles]:
    """Captures next to each other as parts of about equal bytes; a task holds one capture of its part at a time."""
    total = sum(size for _, size in files)
    each = min(PART, total / FEWEST)
    parts: list[list[str]] = []
    held = each
    for name, size in files:
        if held >= each:
            parts.append([])
            held = 0
        parts[-1].append(name)
        held += size
    return [CaptureFiles(names) for names in parts]


def pages_of(name: str, data: bytes, version: int = VERSION) -> Iterator[tuple]:
    """A row for each page of a capture; one with ``error`` where it can't be read or is of another version."""
    try:
        document = json.loads(gzip.decompress(data))
        if document["schema_version"] != version:
            raise ValueError(f"schema version {document['schema_version']}")
        at = datetime.fromisoformat(document["captured_at"])
        if at.tzinfo is None:
            raise ValueError("captured_at needs a time zone")
        rows = [(name, str(document["provider"]), at, i, body if body is None else str(body), None) for i, body in enumerate(document["pages"])]
    except (OSError, EOFError, ValueError, KeyError, TypeError) as e:
        rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
    yield from rows


class _Reading:
    """What both kinds of reader share."""

    def __init__(self, options):
        self.path, self.version = options["path"], int(options.get("version", VERSION))

    def read(self, partition: CaptureFiles | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        system, root = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                data = stream.read()
            yield from pages_of(name, data, self.version)


class CaptureReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[CaptureFiles]:
        return _parts(_sized(self.path))


class CaptureStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(_listed(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[CaptureFiles]:
        return _parts([(n, size) for n, size in _sized(self.path) if start["file"] < n <= end["file"]])

    def commit(self, end: dict) -> None:
        """Captures stay; there is nothing to let go."""


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class CaptureWriter(DataSourceWriter):
    """Rows of provider, captured_at and pages: a document each."""

    def __init__(self, options):
        self.path = options["path"]
        self.stamp = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
        #: Readers pass over what begins so.
        self.hidden = f".{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        names: list[str] = []
        for row in rows:
            at = row["captured_at"]
            if at is None:
                raise ValueError("a capture needs the time at which it was taken")
            document = {"schema_version": VERSION, "provider": row["provider"], "captured_at": at.astimezone(timezone.utc).isoformat(), "pages": list(row["pages"] or [])}
            if not names:
                system.create_dir(f"{root}/{self.hidden}", recursive=True)
            names.append(f"{self.stamp}-{uuid.uuid4().hex}{ENDING}")
            with system.open_output_stream(f"{root}/{self.hidden}/{names[-1]}", compression=None) as out:
                out.write(gzip.compress(json.dumps(document).encode(), mtime=0))
        return Written(names)

    def commit(self, messages: Sequence[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        for name in sorted(n for m in messages if m for n in m.names):
            system.move(f"{root}/{self.hidden}/{name}", f"{root}/{name}")
        self._cleared()

    def abort(self, messages: Sequence[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.hidden}")


class CaptureSource(DataSource):
    """``spark.read.format("captures")`` and ``spark.readStream.format("captures")`` with the option ``path`` (a URI),
    and ``df.write.format("captures").mode("append")`` for rows of provider, captured_at, pages."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CaptureStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("captures are only added to")
        return CaptureWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
