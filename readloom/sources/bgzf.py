"""Block-compressed files: concatenated gzip members of at most 64 KiB that state their size, so that any byte range can be read alone."""

from __future__ import annotations

import bisect
import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.sources import files

#: Fixed values of the format: the empty last member, and the most raw bytes of a member.
EOF_MARKER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAX_RAW = 0xFF00
#: Bytes of compressed file that one task reads.
SPLIT_BYTES = 32 << 20


class FormatError(ValueError):
    """Content that is not of the format."""


def member_size(buf: bytes, at: int = 0) -> int:
    """Size of the member whose header starts at `at`, or 0 if there is no such header."""
    if len(buf) - at < 18 or buf[at : at + 4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = struct.unpack_from("<H", buf, at + 10)[0]
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(buf)):
        length = struct.unpack_from("<H", buf, i + 2)[0]
        if buf[i : i + 2] == b"BC" and length == 2 and i + 6 <= len(buf):
            return struct.unpack_from("<H", buf, i + 4)[0] + 1
        i += 4 + length
    return 0


def inflate(member: bytes) -> bytes:
    extra = struct.unpack_from("<H", member, 10)[0]
    try:
        raw = zlib.decompress(member[12 + extra : -8], wbits=-15)
    except zlib.error as e:
        raise FormatError(f"damaged block: {e}") from e
    crc, size = struct.unpack("<II", member[-8:])
    if size != len(raw) or crc != zlib.crc32(raw):
        raise FormatError("block checksum")
    return raw


def deflate(raw: bytes, level: int = 6) -> bytes:
    """One member of up to 64 KiB raw bytes; stored if it would not fit compressed."""
    if not -1 <= level <= 9:
        raise ValueError("level is -1..9")
    for lv in (level, 0):
        c = zlib.compressobj(lv, zlib.DEFLATED, -15)
        body = c.compress(raw) + c.flush()
        if len(body) + 26 <= 1 << 16:
            break
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw))


class BlockWriter:
    """Members of whole writes where they fit: a write goes into the open block if there is room, else opens a new one."""

    def __init__(self, out, level: int = 6):
        self.out, self.level, self.buf = out, level, bytearray()

    def write(self, data: bytes) -> None:
        if self.buf and len(self.buf) + len(data) > MAX_RAW:
            self.flush()
        self.buf += data
        while len(self.buf) > MAX_RAW:
            self.out.write(deflate(bytes(self.buf[:MAX_RAW]), self.level))
            del self.buf[:MAX_RAW]

    def write_records(self, data: bytes, ends: list[int]) -> None:
        """Records that end at the given places of data, as if each was written alone."""
        done, i = 0, 0
        while i < len(ends):
            j = bisect.bisect_right(ends, done + MAX_RAW - len(self.buf), i)
            if j == i and self.buf:
                self.flush()
                continue
            j = max(j, i + 1)
            self.write(data[done : ends[j - 1]])
            done, i = ends[j - 1], j

    def flush(self) -> None:
        if self.buf:
            self.out.write(deflate(bytes(self.buf), self.level))
            self.buf.clear()

    def close(self) -> None:
        self.flush()
        self.out.write(EOF_MARKER)


def first_member(f, start: int, size: int) -> int:
    """Offset of the first member at or after start: a header whose size leads to another header or to the end of the file."""
    at = start
    while at < size:
        f.seek(at)
        window = f.read(1 << 17)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            if n := member_size(window, i):
                nxt = at + i + n
                if nxt == size:
                    return at + i
                if nxt < size:
                    f.seek(nxt)
                    if member_size(f.read(64)):
                        return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        if len(window) < 1 << 17:
            return size
        at += len(window) - 64
    return size


def members(f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(file offset, raw bytes) of the members from start on; start is a member's."""
    at = start
    while at < size:
        f.seek(at)
        buf = f.read(1 << 16)
        n = member_size(buf)
        if not n or n > len(buf):
            raise FormatError(f"no block at {at}")
        yield at, inflate(buf[:n])
        at += n


def has_eof(path: str) -> bool:
    """The file ends with the end marker, i.e. is not truncated."""
    size = files.size_of(path)
    if size < len(EOF_MARKER):
        return False
    with files.open_input(path) as f:
        f.seek(size - len(EOF_MARKER))
        return f.read() == EOF_MARKER


class RangePartition(InputPartition):
    def __init__(self, path: str, src: int, start: int, end: int, first: int | None = None):
        self.path, self.src, self.start, self.end, self.first = path, src, start, end, first


def byte_ranges(path: str, split: int) -> list[RangePartition]:
    return [RangePartition(p, i, at, min(at + split, n)) for i, p in enumerate(files.list_files(path)) if (n := files.size_of(p)) for at in range(0, n, split)]


def parse_chunks(text: str) -> list[tuple[int, int]]:
    """`begin-end,begin-end` of virtual offsets."""
    return [tuple(map(int, x.split("-"))) for x in text.split(",") if x]


#: Columns of lines, and rows of an Arrow batch of them.
LINES, BATCH = pa.schema([("_src_id", pa.int32()), ("_voff_begin", pa.int64()), ("_voff_end", pa.int64()), ("line", pa.string())]), 8192


class LinesReader(DataSourceReader):
    """Lines of block-compressed text with their virtual offsets. A line belongs to the range in which its first byte's block starts."""

    def __init__(self, options: dict):
        self.path, self.split, self.chunks = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), parse_chunks(options.get("chunks", ""))

    def partitions(self):
        if self.chunks:
            return [RangePartition(p, i, b, e, 0) for i, p in enumerate(files.list_files(self.path)) for b, e in self.chunks]
        return byte_ranges(self.path, self.split)

    def read(self, part: RangePartition) -> Iterator[pa.RecordBatch]:
        rows = self._rows(part)
        while some := list(itertools.islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), LINES.types, strict=True)], schema=LINES)

    def _rows(self, part: RangePartition) -> Iterator[tuple[int, int, int, str]]:
        size = files.size_of(part.path)
        with files.open_input(part.path) as f:
            if part.first is not None:
                yield from self._chunk(f, part, size)
                return
            begin = first_member(f, part.start, size)
            skip = part.start > 0  # the line that is open at the border belongs to the range before
            if skip and begin < part.end:
                skip = not self._ends_line(f, begin)
            line, at = bytearray(), None
            for off, raw in members(f, begin, size):
                if off >= part.end and not line and not skip:
                    return
                i = 0
                while i < len(raw):
                    if off >= part.end and (skip or at is None):
                        return
                    j = raw.find(b"\n", i)
                    if at is None:
                        at = off << 16 | i
                    if j < 0:
                        line += raw[i:]
                        break
                    line += raw[i:j]
                    if not skip:
                        end = off << 16 | (j + 1) if j + 1 < len(raw) else -1
                        yield (part.src, at, end, line.rstrip(b"\r").decode("utf-8", "replace"))
                    skip, line, at, i = False, bytearray(), None, j + 1
                    if off >= part.end:
                        return
            if line and not skip:
                yield (part.src, at, -1, line.decode("utf-8", "replace"))

    @staticmethod
    def _ends_line(f, begin: int) -> bool:
        """The member before begin ends a line. Its start is searched for backwards, at most 64 KiB."""
        low = max(0, begin - (1 << 16))
        f.seek(low)
        before = f.read(begin - low)
        i = before.rfind(b"\x1f\x8b\x08\x04")
        while i >= 0:
            if member_size(before, i) == len(before) - i:
                raw = inflate(before[i:])
                return raw.endswith(b"\n") if raw or low + i == 0 else LinesReader._ends_line(f, low + i)
            i = before.rfind(b"\x1f\x8b\x08\x04", 0, i)
        return False

    def _chunk(self, f, part: RangePartition, size: int):
        line, at, skip = bytearray(), None, part.start & 0xFFFF
        for off, raw in members(f, part.start >> 16, size):
            i = skip
            skip = 0
            while i < len(raw):
                if at is None:
                    at = off << 16 | i
                    if at >= part.end:
                        return
                j = raw.find(b"\n", i)
                if j < 0:
                    line += raw[i:]
                    break
                line += raw[i:j]
                yield (part.src, at, off << 16 | (j + 1) if j + 1 < len(raw) else -1, line.rstrip(b"\r").decode("utf-8", "replace"))
                line, at, i = bytearray(), None, j + 1
        if line:
            yield (part.src, at, -1, line.decode("utf-8", "replace"))


class BgzfLines(DataSource):
    """spark.read.format("bgzf_lines"): options path, splitBytes, chunks (virtual offsets `begin-end,...`). _voff_end is -1 at the end of a block."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "_src_id INT, _voff_begin BIGINT, _voff_end BIGINT, line STRING"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)
