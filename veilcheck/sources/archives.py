"""Zip archives: one row per member that is worth scanning.

An archive is read in two steps.  Its directory, at its end, tells where each
member lies; members, not archives, are then dealt to tasks by bytes, and a task
reads no more of an archive than its members.  So one archive of many members is
unpacked by as many tasks as its bytes are worth.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import DEFAULT_OPTIONS, ScanOptions
from ..session import written
from .code_tree import BATCH_BYTES, TASK_BYTES, _suffix, list_tree, open_file, reading_tasks

SCHEMA = "archive string, path string, content string"
# Where a member lies, and what unpacking it needs.
MEMBER = "name string, at long, size long, unpacked long, method int, flags int, crc long"
_MEMBER = ["name", "at", "size", "unpacked", "method", "flags", "crc"]
_LOCAL_HEADER, _ENCRYPTED = 30, 1


def _members(file, opts: ScanOptions) -> Iterator[tuple]:
    """The members of an archive that are worth scanning, in its order, from its directory."""
    skip_dirs, skip_extensions = set(opts.skip_dirs), set(opts.skip_extensions)

    def wanted(member: str) -> bool:
        return (
            not member.endswith("/")
            and skip_dirs.isdisjoint(member.split("/"))
            and _suffix(member.encode("utf-8", "surrogateescape")) not in skip_extensions
        )

    with zipfile.ZipFile(file) as zf:
        # A name stored twice is listed twice, with the text of its later entry.
        for name in filter(wanted, zf.namelist()):
            m = zf.getinfo(name)
            yield name, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.flag_bits, m.CRC


def _packed(file, at: int, size: int) -> bytes:
    """The bytes of a member, after its own header."""
    file.seek(at)
    header = file.read(_LOCAL_HEADER)
    if header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member begins where the directory has one")
    file.seek(at + _LOCAL_HEADER + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little"))
    return file.read(size)


def _text(member: dict, packed: bytes) -> str:
    """The unpacked text of a member; its checksum is verified."""
    if member["flags"] & _ENCRYPTED:
        raise RuntimeError(f"{member['name']} is encrypted")
    info = zipfile.ZipInfo(member["name"])
    info.compress_type, info.compress_size = member["method"], member["size"]
    info.file_size, info.CRC, info.flag_bits = member["unpacked"], member["crc"], member["flags"]
    with zipfile.ZipExtFile(io.BytesIO(packed), "r", info) as unpacked:
        return unpacked.read().decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")


def _unpacker(packed: Callable[[dict], bytes]):
    """Texts of members; ``packed`` gets the bytes of one."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["archive", "path", "content"]
        )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for incoming in batches:
            for member in incoming.to_pylist():
                rows.append((member["archive"], member["name"], _text(member, packed(member))))
                size += len(rows[-1][2])
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return unpack


def _directories(opts: ScanOptions, key: str, opened, with_bytes: bool):
    """The members of archives; ``opened`` makes a file of the second column's value."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def batch(archive: str, value, rows: list[tuple]) -> pa.RecordBatch:
        members = [pa.array(c, kind) for c, kind in zip(zip(*[r[:7] for r in rows], strict=True), kinds, strict=True)]
        extra = pa.array([r[7] for r in rows], pa.binary()) if with_bytes else pa.array([value] * len(rows), pa.binary())
        names = ["archive", *_MEMBER, "packed" if with_bytes else key]
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), *members, extra], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for incoming in batches:
            for archive, value in zip(incoming.column(0).to_pylist(), incoming.column(1), strict=True):
                rows, held = [], 0
                with opened(value) as file:
                    for m in list(_members(file, opts)):
                        rows.append((*m, _packed(file, m[1], m[2]) if with_bytes else None))
                        held += m[2] if with_bytes else len(m[0])
                        if held >= BATCH_BYTES or len(rows) >= 10_000:
                            yield batch(archive, None if with_bytes else value.as_py(), rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(archive, None if with_bytes else value.as_py(), rows)

    return run


def explode_archives(archives: DataFrame, opts: ScanOptions = DEFAULT_OPTIONS, tasks: int | None = None) -> DataFrame:
    """``files(archive, path, content)`` from ``archives(archive, bytes)``.

    Members are left out if any part of their path, the file name included, is a
    skipped directory name, or if their suffix is skipped; those are never
    unpacked.  Members leave the task in batches, so an archive is not held
    unpacked as a whole.  ``tasks`` deals the packed members over so many tasks
    before they are unpacked; without it they are unpacked where their archive
    lies.  A file that is no archive fails the scan.
    """
    members = archives.select("archive", "bytes").mapInArrow(
        _directories(opts, "raw", lambda value: io.BytesIO(value.as_buffer()), True), f"archive string, {MEMBER}, packed binary"
    )
    dealt = members.repartition(tasks) if tasks else members
    return dealt.mapInArrow(_unpacker(lambda member: member["packed"]), SCHEMA)


def read_archives(spark: SparkSession, paths: list[str] | str, opts: ScanOptions = DEFAULT_OPTIONS,
                  task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files(archive, path, content)`` of zip files, by name or all ``.zip`` files below a folder.

    Hidden archives count like any other; one that is named but missing is an
    error.  Reading the directories is an action.  Members are read in place,
    each by its range of the archive, so neither an archive nor its members lie
    in one task as a whole.
    """
    named = [paths] if isinstance(paths, str) else list(paths)
    files = list_tree(spark, named, [], [], strict=True)
    files = files.filter(F.col("path").isin(named) | F.lower("path").endswith(".zip"))
    listing = _directories(opts, "raw", lambda value: open_file(value.as_py()), False)
    members = files.select("path", "raw").repartition(reading_tasks(files, task_bytes)).mapInArrow(
        listing, f"archive string, {MEMBER}, raw binary"
    )
    members = written(members, "members")

    def packed(member: dict) -> bytes:
        with open_file(member["raw"]) as file:
            return _packed(file, member["at"], member["size"])

    return members.repartition(reading_tasks(members, task_bytes)).mapInArrow(_unpacker(packed), SCHEMA)
