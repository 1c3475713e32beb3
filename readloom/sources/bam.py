"""Binary alignment files: splittable scan, and a parallel writer whose parts are concatenated on commit."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from readloom.functions.cigar import OPS
from readloom.functions.sequences import CODES
from readloom.operators.header import Header, parse_header
from readloom.sources import bgzf, columns, files
from readloom.sources.bgzf import FormatError, RangePartition

SCHEMA = (
    "qname STRING, flag INT, ref_id INT, rname STRING, pos BIGINT, mapq SMALLINT, cigar ARRAY<STRUCT<len: BIGINT, op: STRING>>, mate_ref_id INT, mate_rname STRING, mate_pos BIGINT, tlen INT, "
    "seq STRING, qual ARRAY<SMALLINT>, aux ARRAY<STRUCT<tag: STRING, type: STRING, subtype: STRING, sval: STRING, ival: BIGINT, fval: FLOAT, iarr: ARRAY<BIGINT>, farr: ARRAY<FLOAT>, bval: BINARY>>, "
    "_voff_begin BIGINT, _voff_end BIGINT, _src_id INT, _src_ord BIGINT"
)
_INT = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}  # fixed: struct code of each integer type
_FIXED, _SIZE = struct.Struct("<iiBBHHHiiii"), struct.Struct("<i")
#: Records that must follow each other plausibly for a split to trust a record start, rows of an Arrow batch, and raw bytes that are walked at a time.
CHAIN, BATCH, STRETCH = 8, 8192, 2 << 20


def read_header(data: bytes) -> tuple[Header, list[tuple[str, int]], int]:
    """(text header, binary references, bytes used). References that the text lacks are taken from the binary list."""
    if data[:4] != b"BAM\1":
        raise FormatError("no alignment header")
    n = struct.unpack_from("<i", data, 4)[0]
    if n < 0 or 12 + n > len(data):
        raise FormatError("truncated header")
    text = data[8 : 8 + n].split(b"\0")[0].decode("utf-8", "replace")
    at = 8 + n
    count = struct.unpack_from("<i", data, at)[0]
    at += 4
    refs = []
    for _ in range(count):
        size = struct.unpack_from("<i", data, at)[0]
        if at + 8 + size > len(data):
            raise FormatError("truncated header")
        refs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    h = parse_header(text)
    known = {r["sn"]: r["ln"] for r in h.rows["SQ"]}
    for i, (name, length) in enumerate(refs):
        if name not in known:
            h.rows["SQ"].append({"ref_id": i, "sn": name, "ln": length, "other_tags": None})
        elif known[name] != length:
            raise FormatError(f"reference {name!r} has two lengths")
    return h, refs, at


def encode_header(text: str) -> bytes:
    h = parse_header(text)
    raw = text.encode()
    out = [b"BAM\1", struct.pack("<i", len(raw)), raw, struct.pack("<i", len(h.rows["SQ"]))]
    for r in h.rows["SQ"]:
        name = r["sn"].encode() + b"\0"
        out.append(struct.pack("<i", len(name)) + name + struct.pack("<i", r["ln"]))
    return b"".join(out)


def file_header(path: str) -> tuple[Header, list[tuple[str, int]], int]:
    """(header, references, virtual offset of the first record)."""
    size = files.size_of(path)
    data, marks = b"", []
    with files.open_input(path) as f:
        for off, raw in bgzf.members(f, 0, size):
            marks.append((len(data), off, len(raw)))
            data += raw
            try:
                h, refs, used = read_header(data)
            except (FormatError, struct.error):
                if len(data) > 4 and data[:4] != b"BAM\1":
                    raise
                continue
            base, block, length = next(m for m in reversed(marks) if m[0] <= used)
            if used == base + length:
                return h, refs, (block + _member_len(f, block)) << 16
            return h, refs, block << 16 | (used - base)
    raise FormatError("truncated header")


def _member_len(f, at: int) -> int:
    f.seek(at)
    return bgzf.member_size(f.read(64))


class Stream:
    """Decompressed bytes from a member on, with the virtual offset of every position."""

    def __init__(self, f, start: int, size: int):
        self.blocks, self.data, self.base, self.marks, self.done = bgzf.members(f, start, size), bytearray(), 0, [], False

    def fill(self, upto: int) -> bool:
        """Make the bytes before `upto` (absolute) available."""
        while self.base + len(self.data) < upto and not self.done:
            try:
                off, raw = next(self.blocks)
            except StopIteration:
                self.done = True
                break
            if raw:
                self.marks.append((self.base + len(self.data), off))
                self.data += raw
        return self.base + len(self.data) >= upto

    def voffset(self, at: int) -> int:
        """Virtual offset of an absolute position that is available."""
        for begin, off in reversed(self.marks):
            if begin <= at:
                return off << 16 | (at - begin)
        raise IndexError(at)

    def voffsets(self, at: np.ndarray) -> np.ndarray:
        """Virtual offsets of absolute positions that are available, ascending."""
        begins, offs = (np.array(x, np.int64) for x in zip(*self.marks, strict=True))
        mark = np.searchsorted(begins, at, "right") - 1
        return offs[mark] << 16 | (at - begins[mark])

    def forget(self, before: int) -> None:
        drop = before - self.base
        if drop > 1 << 20:
            del self.data[:drop]
            self.base = before
            while len(self.marks) > 1 and self.marks[1][0] <= before:
                self.marks.pop(0)

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.base : at - self.base + n])


def _plausible(s: Stream, at: int, refs: int) -> int:
    """Size with prefix of a record that may start at `at`; 0 if none can; -1 if the data end there."""
    if not s.fill(at + 4):
        return -1 if s.base + len(s.data) == at else 0
    if not s.fill(at + 36):
        return 0
    size = struct.unpack("<i", s.get(at, 4))[0]
    ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = _FIXED.unpack(s.get(at + 4, 32))
    need = 32 + name + 4 * ops + (bases + 1) // 2 + bases
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and name >= 1 and bases >= 0 and need <= size < 1 << 28):
        return 0
    if not s.fill(at + 36 + name):
        return 0
    text = s.get(at + 36, name)
    return size + 4 if text.find(0) == name - 1 else 0  # names may hold any byte but NUL, or none


def find_record(s: Stream, at: int, limit: int, refs: int) -> int | None:
    """First position from `at` on, before `limit`, that starts CHAIN plausible records (or all up to the end)."""
    while at < limit and s.fill(at + 1):
        p, n = at, 0
        while n < CHAIN and (size := _plausible(s, p, refs)) > 0:
            p, n = p + size, n + 1
        if n and (n == CHAIN or size == -1):
            return at
        at += 1
    return None


class BamReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split, self.omit = options["path"], int(options.get("splitBytes", bgzf.SPLIT_BYTES)), options.get("omit", "none")
        if self.omit not in ("none", "aux", "variable"):
            raise ValueError("omit is none, aux or variable")
        self.chunks, self.schema = bgzf.parse_chunks(options.get("chunks", "")), schema

    def partitions(self):
        if self.chunks:
            return [RangePartition(p, i, b, e, 0) for i, p in enumerate(files.list_files(self.path)) for b, e in self.chunks]
        return bgzf.byte_ranges(self.path, self.split)

    def read(self, part: RangePartition) -> Iterator[pa.RecordBatch]:
        """Only the columns of the schema asked for are decoded, a stretch of records at a time."""
        schema = to_arrow_schema(self.schema)
        _, refs, first = file_header(part.path)
        names = [r[0] for r in refs]
        for data, starts, sizes, begin, after in self._stretches(part, names, first):
            for i in range(0, len(starts), BATCH):
                j = slice(i, i + BATCH)
                low, high = int(starts[j][0]), int(starts[j][-1] + sizes[j][-1])
                yield columns.decode(np.frombuffer(data, np.uint8, high - low, low), starts[j] - low, sizes[j], begin[j], after[j], part.src, names, self.omit, schema)

    def _stretches(self, part: RangePartition, names: list[str], first: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, place of the record bodies in them, their sizes, their virtual begins, their virtual ends)."""
        size = files.size_of(part.path)
        with files.open_input(part.path) as f:
            if part.first is not None:
                end, at = part.end, part.start & 0xFFFF
                s = Stream(f, part.start >> 16, size)
            else:
                end = part.end << 16
                found = self._start(f, part.start, part.end, size, len(names), first)
                if found is None:
                    return
                s, at = found
            if not s.fill(at + 4):
                return
            begin = s.voffset(at)
            while begin < end and s.fill(at + 4):
                s.fill(at + STRETCH)
                places, at = self._walk(s, at)
                after = s.voffset(at) if s.fill(at + 1) else size << 16
                if not places:  # an empty record ends the data
                    return
                starts, sizes = np.array(places, np.int64), np.diff(np.array([*places, at + 4])) - 4
                begins = s.voffsets(starts - 4)
                mine = int(np.searchsorted(begins, end))  # what begins at or after the end is the next range's
                if mine:
                    low = places[0]
                    yield s.get(low, at - low), starts[:mine] - low, sizes[:mine], begins[:mine], np.r_[begins[1:], after][:mine]
                begin = int(begins[mine]) if mine < len(begins) else after
                s.forget(at)
            if part.first is None:
                self._check_next(f, part.end, begin, size, len(names), first)

    @staticmethod
    def _walk(s: Stream, at: int) -> tuple[list[int], int]:
        """Places of the bodies of the whole records from `at` on that are available, at least one; and where the one after them begins."""
        take = _SIZE.unpack_from
        n = take(s.data, at - s.base)[0]
        if n == 0:
            return [], at
        if n < 32 or not s.fill(at + 4 + n):
            raise FormatError(f"truncated record at {s.voffset(at)}")
        out, data, p, stop, base = [], s.data, at - s.base, len(s.data), s.base
        while p + 4 <= stop and (n := take(data, p)[0]) >= 32 and p + 4 + n <= stop:
            out.append(base + p + 4)
            p += 4 + n
        return out, base + p

    def _start(self, f, start: int, end: int, size: int, refs: int, first: int) -> tuple[Stream, int] | None:
        """Stream and position of the first record of a byte range; None if none is found."""
        block = bgzf.first_member(f, start, size) if start else 0
        if block >= end:
            return None
        if block <= first >> 16:
            return Stream(f, first >> 16, size), first & 0xFFFF
        s = Stream(f, block, size)
        at = find_record(s, 0, self._length_before(f, block, end, size), refs)
        return None if at is None else (s, at)

    def _check_next(self, f, start: int, begin: int, size: int, refs: int, first: int) -> None:
        """Raise if the next range does not begin with the record at `begin`, where this one ended: records would be lost or read twice."""
        while start < size:
            end = min(start + self.split, size)
            found = self._start(f, start, end, size, refs, first)
            if found and found[0].fill(found[1] + 4):
                if found[0].voffset(found[1]) != begin:
                    raise FormatError(f"the range at {start} does not begin with the record at {begin}; read with chunks or a larger splitBytes")
                return
            if begin < end << 16:
                raise FormatError(f"no record found in the range at {start}, but there is one at {begin}; read with chunks or a larger splitBytes")
            start = end

    @staticmethod
    def _length_before(f, block: int, end: int, size: int) -> int:
        """Raw bytes of the members that start before end: a record that starts there is the range's own."""
        total, at = 0, block
        while at < min(end, size):
            n = _member_len(f, at)
            f.seek(at + n - 4)
            total += struct.unpack("<I", f.read(4))[0]
            at += n
        return total


class Part(WriterCommitMessage):
    def __init__(self, index: int, path: str):
        self.index, self.path = index, path


class PartsWriter(DataSourceArrowWriter):
    """Option layout: with `folder` every task writes a complete file, which the commit only renames, so that no content passes through the driver; the readers
    take such a folder as they take a file. With `file` (the default) every task writes a part into a hidden folder beside the target, and the commit
    puts head, parts in partition order and tail together: all bytes pass through the driver, for those who need the one file."""

    ending = ""

    def __init__(self, options: dict):
        self.path, self.layout = options["path"], options.get("layout", "file")
        if self.layout not in ("file", "folder"):
            raise ValueError("layout is file or folder")
        self.parts = f"{self.path}.parts"

    def head(self) -> bytes:
        return b""

    def tail(self) -> bytes:
        return b""

    def encode(self, batches: Iterator[pa.RecordBatch], out) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        c = TaskContext.get()
        whole = self.layout == "folder"
        path = f"{self.path if whole else self.parts}/_{c.partitionId():06d}-{c.taskAttemptId()}"
        with files.open_output(path) as out:
            if whole:
                out.write(self.head())
            self.encode(iterator, out)
            if whole:
                out.write(self.tail())
        return Part(c.partitionId(), path)

    def commit(self, messages: list[Part | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.index)
        if self.layout == "folder":
            for m in done:
                files.move(m.path, f"{self.path}/part-{m.index:06d}{self.ending}")
            return
        with files.open_output(self.path) as out:
            out.write(self.head())
            for m in done:
                with files.open_input(m.path) as f:
                    while chunk := f.read(8 << 20):
                        out.write(chunk)
            out.write(self.tail())
        self._clean()

    def abort(self, messages) -> None:
        if self.layout == "folder":
            for m in messages:
                if m:
                    files.delete_file(m.path)
            return
        self._clean()

    def _clean(self) -> None:
        try:
            files.delete_folder(self.parts)
        except (FileNotFoundError, OSError):
            pass


class BamWriter(PartsWriter):
    ending = ".bam"

    def __init__(self, options: dict):
        super().__init__(options)
        self.level, self.header = int(options.get("level", 6)), options["header"]

    def head(self) -> bytes:
        raw = encode_header(self.header)
        return b"".join(bgzf.deflate(raw[i : i + bgzf.MAX_RAW], self.level) for i in range(0, len(raw), bgzf.MAX_RAW))

    def tail(self) -> bytes:
        return bgzf.EOF_MARKER

    def encode(self, batches, out) -> None:
        w = bgzf.BlockWriter(out, self.level)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                data, ends = columns.encode(b.slice(i, BATCH))
                w.write_records(data, ends)
        w.flush()


class Bam(DataSource):
    """spark.read.format("bam"): options path (file or folder), omit (none, aux, variable), chunks, splitBytes; with
    .schema(some columns) nothing else is decoded. df.write.format("bam"): path, header, level, layout."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


