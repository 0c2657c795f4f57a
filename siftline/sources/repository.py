"""File sources: directory trees (dot files included) and archives, as Python data sources with limits."""

from __future__ import annotations

import io
import os
import shutil
import stat
import tempfile
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftline.functions.fixed import EXCLUDED_DIRS, UPLOAD_SUFFIXES
from siftline.operators.graph import written
from siftline.sources.model import ReportError

MAX_FILES, MAX_FILE_BYTES, PER_TASK = 200_000, 5 << 20, 256
ARCHIVE_FILES, ARCHIVE_FILE_BYTES, ARCHIVE_BYTES = 50_000, 100 << 20, 2 << 30
#: Bytes of a zip that a task unpacks, about.
PART_BYTES = 64 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str, bool]]):
        self.paths = paths


class TreeReader(DataSourceReader):
    """Every file of a tree is a row.  Those beyond ``max_files`` (in path order), too large ones and unreadable ones have no
    content; links and files under excluded directories are rows only with ``skipped`` (for the profile's count)."""

    def __init__(self, root: str, max_files: int, max_bytes: int, skipped: bool):
        self.root, self.max_files, self.max_bytes, self.skipped = root, max_files, max_bytes, skipped

    def partitions(self) -> list[_Files]:
        found: list[tuple[str, str, bool]] = []
        count = 0
        for folder, dirs, names in os.walk(self.root, followlinks=False):
            own = os.path.relpath(folder, self.root).split(os.sep)
            outside = any(d in EXCLUDED_DIRS for d in own)
            dirs[:] = sorted(d for d in dirs if (self.skipped or d not in EXCLUDED_DIRS) and not os.path.islink(os.path.join(folder, d)))
            for name in sorted(names):
                path = os.path.join(folder, name)
                link = os.path.islink(path)
                count += not (link or outside)
                if self.skipped or not link:
                    found.append((path, os.path.relpath(path, self.root).replace(os.sep, "/"), not (link or outside) and count <= self.max_files))
        return [_Files(found[i : i + PER_TASK]) for i in range(0, len(found), PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for full, path, wanted in partition.paths:
            yield _file_row(full, path, wanted, self.max_bytes)


class Tree(DataSource):
    """``spark.read.format("siftline-tree").load(root)``: path, size, content (null where too large or unreadable), is_binary.

    Options maxFiles, maxBytes; skipped=true adds rows (without size) for links and for files under excluded directories,
    which ``findings.file_counts`` counts.  The tree must be in a file system that the driver and all executors mount.  The
    driver lists it; ``read_tree`` gives the same rows of larger trees.
    """

    @classmethod
    def name(cls) -> str:
        return "siftline-tree"

    def schema(self) -> str:
        return "path string, size long, content binary, is_binary boolean"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("maxFiles", MAX_FILES)), int(self.options.get("maxBytes", MAX_FILE_BYTES)), self.options.get("skipped", "false").lower() == "true")


def read_tree(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_FILE_BYTES, skipped: bool = False) -> DataFrame:
    """The rows of ``siftline-tree`` for trees of any number of files: folders are listed in tasks, level by level.

    The folders of a level are a written table, of which tasks list a few each and give files and the next level's folders;
    so the driver sees neither.  Where there are more than ``max_files`` files, the place in walk order (a folder's files
    by name, then its folders by name) of the last one that is read is found by counting ranges of that order.  Runs a job
    a level when it is called.
    """
    own = "folder string, outside boolean, place binary"
    row = "path string, wanted boolean, place binary"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, outside, place in zip(*(batch.column(x).to_pylist() for x in ("folder", "outside", "place"))):
                files, folders = [], []
                try:
                    entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
                except OSError:  # it can't be read, or is gone
                    continue
                for e in entries:
                    path = f"{folder}/{e.name}" if folder else e.name
                    name = e.name.encode("utf-8", "surrogateescape") + b"\0"
                    if e.is_dir() and not e.is_symlink():
                        if skipped or e.name not in EXCLUDED_DIRS:
                            folders.append((path, outside or e.name in EXCLUDED_DIRS, place + b"\2" + name))
                    elif not e.is_dir() and (skipped or not e.is_symlink()):
                        files.append((path, not (e.is_symlink() or outside), place + b"\1" + name))
                for kind, found in ((True, files), (False, folders)):
                    for at in range(0, len(found), 4096):
                        columns = list(zip(*found[at : at + 4096]))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary()), pa.array([kind] * len(columns[0]))], ["path", "flag", "place", "is_file"])

    tables: list[DataFrame] = []
    level = spark.createDataFrame([("", False, bytearray())], own)
    while True:
        tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, -(-level.count() // 16)))
        found = written(level.repartition(tasks).mapInArrow(listed, "path string, flag boolean, place binary, is_file boolean"), "listing")
        tables.append(found.where("is_file").selectExpr("path", "flag AS wanted", "place"))
        level = found.where("NOT is_file").selectExpr("path AS folder", "flag AS outside", "place")
        if level.isEmpty():
            break
    files = tables[0]
    for more in tables[1:]:
        files = files.unionByName(more)
    allowed = F.col("wanted")
    if files.where("wanted").count() > max_files:
        allowed &= F.col("place") <= F.lit(_place_of(files.where("wanted"), max_files))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column("wanted").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_file_row(os.path.join(root, path), path, wanted, max_bytes), (pa.string(), pa.int64(), pa.binary(), pa.bool_()))], ["path", "size", "content", "is_binary"])

    return files.withColumn("wanted", allowed).select("path", "wanted").mapInArrow(read, "path string, size long, content binary, is_binary boolean")


def _place_of(files: DataFrame, number: int) -> bytearray:
    """The place of the ``number``-th file: by counts of ranges, then within one range."""
    slices = max(2, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = written(files.select("place").repartitionByRange(slices, "place").withColumn("slice", F.spark_partition_id()), "places")
    before = 0
    for r in x.groupBy("slice").count().orderBy("slice").collect():  # a row a range
        if before + r["count"] >= number:
            return x.where(F.col("slice") == r.slice).orderBy("place").offset(number - before - 1).limit(1).first().place
        before += r["count"]
    raise ValueError(f"there are fewer than {number} files")


def _file_row(full: str, path: str, wanted: bool, max_bytes: int) -> tuple[str, int | None, bytes | None, bool]:
    size = content = None
    try:
        size = os.path.getsize(full) if wanted else None
        if wanted and size <= max_bytes:
            with open(full, "rb") as f:
                content = f.read()
    except OSError:  # counts as binary, and as skipped where it has no size
        content = None
    return path, size, content, content is None or b"\0" in content[:8192]


def unsafe(name: str) -> bool:
    p = name.replace("\\", "/")
    return not p or "\0" in p or len(p) > 4096 or p.startswith("/") or p[1:2] == ":" or ".." in p.split("/")


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """A file for reading and seeking: a plain path, or an address of a file system that Arrow knows."""
    if "://" not in path:
        with open(path, "rb") as f:
            yield f
        return
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        yield f


class Account:
    """The limits of one archive, counted as it is read."""

    def __init__(self):
        self.files = self.total = 0

    def member(self, name: str, size: int) -> None:
        self.files += 1
        if unsafe(name) or self.files > ARCHIVE_FILES:
            raise ValueError(f"unsafe member or too many: {name!r}")
        self.content(name, size)

    def content(self, name: str, size: int) -> None:
        self.total += size
        if size > ARCHIVE_FILE_BYTES or self.total > ARCHIVE_BYTES:
            raise ValueError(f"archive too large at {name!r}")


def _directory(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """A zip's files by its central directory, checked before any is unpacked."""
    account, found = Account(), []
    for info in z.infolist():
        if info.external_attr >> 16 & 0o170000 == 0o120000:
            raise ValueError(f"link: {info.filename!r}")
        if not info.is_dir():
            account.member(info.filename, info.file_size)
            found.append(info)
    return found


def _unpacked(z: zipfile.ZipFile, infos: list[zipfile.ZipInfo]) -> Iterator[tuple[str, bytes]]:
    for info in infos:
        with z.open(info) as f:
            content = f.read(info.file_size + 1)
        if len(content) > info.file_size:  # it holds more than it says
            raise ValueError(f"archive too large at {info.filename!r}")
        yield info.filename, content


def is_zip(head: bytes) -> bool:
    return head[:4] in (b"PK\3\4", b"PK\5\6", b"PK\7\x08")


def members(source: bytes | BinaryIO) -> Iterator[tuple[str, bytes]]:
    """(path, content) of an archive's regular files, one at a time; ValueError for unsafe members, links and exceeded limits.

    A zip is read by its central directory, a tar as a stream.
    """
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    head = source.read(4)
    source.seek(0)
    if is_zip(head):
        with zipfile.ZipFile(source) as z:
            yield from _unpacked(z, _directory(z))
        return
    account = Account()
    with tarfile.open(fileobj=source, mode="r|*") as t:
        for info in t:
            if not (info.isreg() or info.isdir()):
                raise ValueError(f"neither file nor folder: {info.name!r}")
            if info.isreg():
                account.member(info.name, 0)
                content = t.extractfile(info).read(ARCHIVE_FILE_BYTES + 1)
                account.content(info.name, len(content))
                yield info.name, content


class _Part(InputPartition):
    """Members first .. last (by the central directory; all, where last is None) of an archive."""

    def __init__(self, path: str, first: int = 0, last: int | None = None):
        self.path, self.first, self.last = path, first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], part_bytes: int):
        self.paths, self.part_bytes = paths, part_bytes

    def partitions(self) -> list[_Part]:
        """A part an archive; several for a zip of more than ``part_bytes``, of about that many unpacked bytes each."""
        parts = []
        for path in self.paths:
            with opened(path) as f:
                head = f.read(4)
                if not is_zip(head) or f.seek(0, os.SEEK_END) <= self.part_bytes:
                    parts.append(_Part(path))
                    continue
                f.seek(0)
                with zipfile.ZipFile(f) as z:
                    sizes = [info.file_size for info in _directory(z)]
            first = held = 0
            for no, size in enumerate(sizes):
                if no > first and held + size > self.part_bytes:
                    parts.append(_Part(path, first, no))
                    first, held = no, 0
                held += size
            parts.append(_Part(path, first, len(sizes)))
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        with opened(partition.path) as f:
            if partition.last is None:
                found = members(f)
            else:
                z = zipfile.ZipFile(f)
                found = _unpacked(z, _directory(z)[partition.first : partition.last])
            for path, content in found:
                yield partition.path, path, len(content), content, b"\0" in content[:8192]


class Archive(DataSource):
    """``spark.read.format("siftline-archive").load(paths)``: archive, path, size, content, is_binary.

    Paths may be addresses (``s3://``, ``hdfs://``) of file systems that Arrow reads.  One task an archive; a zip of more
    than ``partBytes`` is dealt out to several, which seek their members by its central directory.  A task holds a member.
    """

    @classmethod
    def name(cls) -> str:
        return "siftline-archive"

    def schema(self) -> str:
        return "archive string, path string, size long, content binary, is_binary boolean"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"].split(","), int(self.options.get("partBytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tree)
    spark.dataSource.register(Archive)


UPLOAD_BYTES = 200 << 20


def save_upload(name: str, chunks: Iterable[bytes], path: str, most: int = UPLOAD_BYTES) -> int:
    """Streams an uploaded archive to ``path`` and returns its size; ReportError for another suffix, too many bytes or none."""
    if not name.lower().endswith(UPLOAD_SUFFIXES):
        raise ReportError(f"an upload must be one of: {', '.join(UPLOAD_SUFFIXES)}")
    size = 0
    try:
        with open(path, "wb") as out:
            for chunk in chunks:
                size += len(chunk)
                if size > most:
                    raise ReportError(f"the upload exceeds {most >> 20} MB")
                out.write(chunk)
        if not size:
            raise ReportError("the upload is empty")
    except ReportError:
        os.unlink(path)
        raise
    return size


def extraction(archives):
    """(archive, files, total_bytes) of the rows of ``siftline-archive``: what unpacking each archive yields."""
    return archives.groupBy("archive").agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes"))


def _writable(remove, path, _) -> None:
    """Makes a read-only entry and its folder writable, and removes it."""
    os.chmod(os.path.dirname(path), stat.S_IRWXU)
    os.chmod(path, stat.S_IRWXU)
    remove(path)


@contextmanager
def work_tree(source: str | None = None, prefix: str = "siftline-"):
    """A private folder on the driver, with ``source`` staged in it (excluded directories left out); gone afterwards, whatever happens."""
    folder = tempfile.mkdtemp(prefix=prefix)
    try:
        if source is not None:
            shutil.copytree(source, os.path.join(folder, "source"), symlinks=True, ignore=lambda _, names: [n for n in names if n in EXCLUDED_DIRS])
        yield folder
    finally:
        shutil.rmtree(folder, onexc=_writable)
