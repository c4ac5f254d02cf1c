r"""Zip archives as a data source: partitions planned from the archives' directories, members read apart.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("pattern", r"\.jsonl$").option("content", "lines").load(folder)

The driver reads only the directories at the ends of the archives. A partition is a list
of members of about ``bytes`` compressed bytes; its task seeks to each member and reads no other, so an archive of many members
is read by many tasks, and neither an archive nor, by lines, a member has to fit in a row or in memory.
"""

from __future__ import annotations

import codecs
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Compressed bytes that a partition should read.
PARTITION_BYTES = 64 << 20
#: Bytes that are unpacked at once.
CHUNK = 1 << 20
SHAPES = {
    "whole": "archive string, member string, place bigint, size bigint, content binary",
    "lines": "archive string, member string, place bigint, line_no bigint, line string",
}


class ArchiveError(ValueError):
    """An archive that can't be read as it stands."""


@dataclass(frozen=True)
class Member:
    name: str
    place: int
    at: int
    packed: int
    size: int
    method: int
    crc: int


class Members(InputPartition):
    def __init__(self, archive: str, members: list[Member]):
        self.archive, self.members = archive, members


def _opened(path: str):
    """A seekable file of any file system that pyarrow knows; a plain path is a local or mounted one."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def readable(path: str) -> bool:
    """Whether pyarrow knows the path's file system; Spark knows others too."""
    from pyarrow import ArrowInvalid, fs

    try:
        return not ("://" in path or path.startswith("file:")) or fs.FileSystem.from_uri(path) is not None
    except (ArrowInvalid, NotImplementedError, OSError):
        return False


def _archives(path: str) -> Iterator[str]:
    """The path itself, or all .zip files below it."""
    from pyarrow import fs

    whole = "://" in path or path.startswith("file:")
    system, inner = fs.FileSystem.from_uri(path) if whole else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise ArchiveError(f"there is no {path}")
    if info.type == fs.FileType.File:
        yield path
        return
    head = path[: len(path) - len(inner)] if whole and path.endswith(inner) else "file://" if whole else ""
    for x in sorted(system.get_file_info(fs.FileSelector(inner, recursive=True)), key=lambda x: x.path):
        if x.type == fs.FileType.File and x.path.lower().endswith(".zip"):
            yield head + x.path


def directory(path: str) -> list[Member]:
    """The members of an archive, in order of their names; read from its end alone."""
    with _opened(path) as f:
        if f.size() < 22:
            raise zipfile.BadZipFile("shorter than an archive's end")
        z = zipfile.ZipFile(f)
        infos = sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)
    for i in infos:
        if i.flag_bits & 1:
            raise ArchiveError(f"{path}: {i.filename} is encrypted")
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ArchiveError(f"{path}: {i.filename} is packed by an unknown method")
    return [Member(i.filename, k, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for k, i in enumerate(infos)]


def pieces(f, m: Member) -> Iterator[bytes]:
    """A member's bytes, unpacked a piece at a time; a wrong checksum raises at the end."""
    f.seek(m.at)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ArchiveError(f"{m.name}: no member begins here")
    names, more = struct.unpack("<HH", head[26:30])
    f.seek(m.at + 30 + names + more)
    left, crc = m.packed, 0
    unpack = zlib.decompressobj(-zlib.MAX_WBITS) if m.method == zipfile.ZIP_DEFLATED else None
    while left:
        held = f.read(min(CHUNK, left))
        if not held:
            raise ArchiveError(f"{m.name}: the archive ends too soon")
        left -= len(held)
        while held:
            out = unpack.decompress(held, CHUNK) if unpack else held
            held = unpack.unconsumed_tail if unpack else b""
            crc = zlib.crc32(out, crc)
            if out:
                yield out
    if unpack and (out := unpack.flush()):
        crc = zlib.crc32(out, crc)
        yield out
    if crc != m.crc:
        raise ArchiveError(f"{m.name}: its checksum is wrong")


def lines_of(parts: Iterator[bytes]) -> Iterator[str]:
    """Lines without their ends; a byte order mark is left out, and no empty line follows the last end."""
    decode, rest = codecs.getincrementaldecoder("utf-8-sig")(), ""
    for part in parts:
        *whole, rest = (rest + decode.decode(part)).split("\n")
        yield from (x.removesuffix("\r") for x in whole)
    rest += decode.decode(b"", True)
    if rest:
        yield rest.removesuffix("\r")


def planned(archive: str, members: list[Member], size: int) -> Iterator[Members]:
    """Members in the order of their places in the file, cut where ``size`` compressed bytes are reached."""
    held, n = [], 0
    for m in sorted(members, key=lambda m: m.at):
        if held and n + m.packed > size:
            yield Members(archive, held)
            held, n = [], 0
        held.append(m)
        n += m.packed
    if held:
        yield Members(archive, held)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.lines = options.get("content", "whole") == "lines"

    def partitions(self) -> list[InputPartition]:
        wanted, skip = re.compile(self.options.get("pattern", "")), self.options.get("badarchives", "fail") == "skip"
        out: list[InputPartition] = []
        for archive in _archives(self.options["path"]):
            try:
                members = directory(archive)
            except zipfile.BadZipFile as e:
                if skip:
                    continue
                raise ArchiveError(f"{archive} is no zip archive") from e
            out += planned(archive, [m for m in members if wanted.search(m.name)], int(self.options.get("bytes", PARTITION_BYTES)))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.members:
            return
        with _opened(partition.archive) as f:
            for m in partition.members:
                if self.lines:
                    for k, line in enumerate(lines_of(pieces(f, m))):
                        yield partition.archive, m.name, m.place, k, line
                else:
                    if m.size >= 1 << 31:
                        raise ArchiveError(f"{m.name} is too large for a row: read it by lines")
                    yield partition.archive, m.name, m.place, m.size, b"".join(pieces(f, m))


class ZipMembers(DataSource):
    """Options: path; pattern, a regular expression that a member's name must hold; content, whole or lines; bytes, compressed bytes of a partition; badArchives, fail or skip."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        content = self.options.get("content", "whole")
        if content not in SHAPES:
            raise ArchiveError(f"content is whole or lines, not {content!r}")
        return SHAPES[content]

    def reader(self, schema) -> DataSourceReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def members(spark: SparkSession, path: str, pattern: str = "", content: str = "whole", size: int = PARTITION_BYTES, skip_bad: bool = False) -> DataFrame:
    """The members of an archive, or of all archives below a folder, whose names hold ``pattern``: a row for each, or for each line."""
    spark.dataSource.register(ZipMembers)
    read = spark.read.format("zip_members").option("pattern", pattern).option("content", content).option("bytes", str(size))
    return read.option("badArchives", "skip" if skip_bad else "fail").load(path)
