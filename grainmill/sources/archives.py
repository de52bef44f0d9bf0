"""ZIP archives as a Spark data source, and nested documents out of their members.

The reader plans from an archive's directory: a partition holds one member, or
consecutive small ones up to a number of bytes, and a task reads its members
only. Archives with repeated or unsafe member names, and bytes that differ from
their pinned hashes, are refused. The writer leaves one archive for each task and publishes
them when all tasks are done, so a repeated task cannot publish twice.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from grainmill.functions.text import unique_json

SCHEMA = "archive string, member string, n_bytes long, content binary"
#: Members below this size share a partition up to it.
PARTITION_BYTES = 8 << 20
_CHUNK = 1 << 20


def _place(path: str):
    """File system and path; whatever Arrow opens by URI serves driver and executors alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _place(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(f"{path.rstrip('/')}/{posixpath.basename(f.path)}" for f in found if f.is_file and f.path.endswith(".zip"))


def _open(path: str):
    system, at = _place(path)
    return system.open_input_file(at)


@contextmanager
def _zip(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive to read from; a small one from memory, since seeking before a file's start is an error of its own kind there."""
    with _open(path) as stream:
        source = io.BytesIO(stream.read()) if stream.size() < _CHUNK else stream
        with zipfile.ZipFile(source) as z:
            yield z


def file_sha256(path: str) -> str:
    """Hash of a file's bytes, read in pieces."""
    digest = hashlib.sha256()
    with _open(path) as stream:
        while piece := stream.read(_CHUNK):
            digest.update(piece)
    return digest.hexdigest()


def check_names(names: list[str], exempt: str | None = None) -> None:
    """Refuse repeated names, and absolute, climbing or non-POSIX ones outside the folder ``exempt``."""
    if len(names) != len(set(names)):
        raise ValueError("archive repeats a member name")
    for name in names:
        parts = PurePosixPath(name)
        unsafe = parts.is_absolute() or ".." in parts.parts or "\\" in name or "\0" in name
        if unsafe and not (exempt and name.startswith(exempt)):
            raise ValueError(f"archive has an unsafe member name: {name!r}")


@dataclass
class Members(InputPartition):
    archive: str
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.sha256 = options.get("sha256")
        self.pins: dict[str, str] = json.loads(options.get("pins", "{}"))
        self.only: list[str] | None = json.loads(options["members"]) if "members" in options else None
        self.exempt = options.get("exempt")
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        missing = set(self.only or ()) | set(self.pins)
        for archive in _archives(self.path):
            if self.sha256 and file_sha256(archive) != self.sha256:
                raise ValueError("archive differs from its pinned hash")
            with _zip(archive) as z:
                check_names([i.orig_filename for i in z.infolist()], self.exempt)
                held, size = [], 0
                for info in z.infolist():
                    missing.discard(info.filename)
                    if info.is_dir() or (self.only is not None and info.filename not in self.only):
                        continue
                    if held and size + info.file_size > self.bytes:
                        out.append(Members(archive, tuple(held)))
                        held, size = [], 0
                    held.append(info.filename)
                    size += info.file_size
                if held:
                    out.append(Members(archive, tuple(held)))
        if missing:
            raise ValueError(f"archive lacks members: {sorted(missing)[:5]}")
        return out or [Members("", ())]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.names:
            return
        with _zip(partition.archive) as z:
            for name in partition.names:
                content = z.read(name)
                pin = self.pins.get(name)
                if pin and hashlib.sha256(content).hexdigest() != pin:
                    raise ValueError(f"member {name!r} differs from its pinned hash")
                yield partition.archive, name, len(content), content


@dataclass
class Part(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, rows: Iterator[Row]) -> Part:
        system, at = _place(self.path)
        system.create_dir(at, recursive=True)
        name = f"{at}/_{uuid.uuid4().hex}.tmp"
        seen: set[str] = set()
        with system.open_output_stream(name) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            for row in rows:
                check_names([row["member"]])
                if row["member"] in seen:
                    raise ValueError(f"member {row['member']!r} repeats")
                seen.add(row["member"])
                z.writestr(zipfile.ZipInfo(row["member"]), bytes(row["content"] or b""), zipfile.ZIP_DEFLATED)
        return Part(name if seen else "")

    def commit(self, messages: list[Part | None]) -> None:
        system, _ = _place(self.path)
        for message in messages:
            if message is not None and message.path:
                folder, name = posixpath.split(message.path)
                system.move(message.path, f"{folder}/part-{name[1:-4]}.zip")

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = _place(self.path)
        for message in messages:
            if message is not None and message.path:
                system.delete_file(message.path)


class ArchiveSource(DataSource):
    """``format("zip_members")``: members of the archive, or of all archives of the folder, at ``path``.

    Options: ``sha256`` of the archive, ``pins`` (JSON, hash by member), ``members`` (JSON list of the only ones to
    open), ``exempt`` (a folder whose names are not checked) and ``partitionBytes``. Written rows need ``member`` and ``content``.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Members of an archive or a folder of archives; see ``ArchiveSource`` for options."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("zip_members").options(**options).load(path)


def write_archives(members: DataFrame, path: str) -> None:
    """Rows of ``member`` and ``content`` as archives in a folder; names must be safe and distinct within a task."""
    members.sparkSession.dataSource.register(ArchiveSource)
    members.select("member", F.col("content").cast("binary").alias("content")).write.format("zip_members").mode("append").save(path)


_DOCUMENTS = "documents array<struct<id: string, text: string, annotation_sets: array<struct<annotations: map<string, struct<choice: string>>>>>>, labels map<string, struct<hypothesis: string>>"


def document_questions(members: DataFrame, content: str | Column = "content") -> DataFrame:
    """Questions of nested documents: ``document``, ``text``, ``question``, ``hypothesis`` and ``choice``.

    A member is JSON with ``documents`` (``id``, ``text`` and the annotations of the first set by question) and ``labels``
    (the hypothesis of each question). Members that are no JSON or repeat a key in an object are left
    out: ``malformed`` lists them. Questions without a hypothesis give no row.
    """
    raw = F.col(content) if isinstance(content, str) else content
    parsed = members.select(F.from_json(unique_json(raw.cast("string")), _DOCUMENTS).alias("m"))
    each = parsed.select("m.labels", F.explode("m.documents").alias("d"))
    asked = each.select("d.id", "d.text", "labels", F.explode(F.get("d.annotation_sets", F.lit(0))["annotations"]).alias("question", "a"))
    rows = asked.select(F.col("id").alias("document"), "text", "question", F.try_element_at("labels", F.col("question"))["hypothesis"].alias("hypothesis"), F.col("a.choice").alias("choice"))
    return rows.where("hypothesis IS NOT NULL")


def malformed(members: DataFrame, content: str = "content") -> DataFrame:
    """Archive and member whose content is not JSON with distinct keys."""
    return members.where(unique_json(F.col(content).cast("string")).isNull()).select("archive", "member")
