"""Structure of reference-compressed files: containers and blocks, with checksums. Records are not decoded."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.functions.codecs import read_itf8, read_ltf8, write_itf8, write_ltf8
from readloom.sources import files
from readloom.sources.bgzf import FormatError

SCHEMA = (
    "container_no INT, ref_id INT, start INT, span INT, n_rec INT, rec_count BIGINT, bases BIGINT, block_no INT, method TINYINT, block_type TINYINT, content_id INT, raw_size INT, data BINARY, crc32 BIGINT"
)
#: Fixed value: the container that ends a complete file.
EOF_CONTAINER = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
#: What a file begins with: magic, version 3.0 and an empty name.
FILE_HEAD = b"CRAM\x03\x00" + bytes(20)
_METHODS = ("raw", "gzip", "bzip2", "lzma", "rans")


def has_eof(path: str) -> bool:
    size = files.size_of(path)
    if size < len(EOF_CONTAINER):
        return False
    with files.open_input(path) as f:
        f.seek(size - len(EOF_CONTAINER))
        return f.read() == EOF_CONTAINER


def container_header(buf: bytes) -> tuple[dict, int, int]:
    """(fields, header size, size of the blocks)."""
    if len(buf) < 4:
        raise FormatError("truncated container")
    length, at, v = struct.unpack_from("<i", buf)[0], 4, {}
    try:
        for name in ("ref_id", "start", "span", "n_rec"):
            v[name], at = read_itf8(buf, at)
        for name in ("rec_count", "bases"):
            v[name], at = read_ltf8(buf, at)
        v["blocks"], at = read_itf8(buf, at)
        n, at = read_itf8(buf, at)
        if n < 0 or v["blocks"] < 0 or length < 0:
            raise FormatError("negative count")
        for _ in range(n):
            _, at = read_itf8(buf, at)
        crc = struct.unpack_from("<I", buf, at)[0]
    except (IndexError, struct.error, ValueError) as e:
        raise FormatError(f"bad container: {e}") from e
    if crc != zlib.crc32(buf[:at]):
        raise FormatError("container checksum")
    v["crc32"] = crc
    return v, at + 4, length


def block(buf: bytes, at: int) -> tuple[dict, int]:
    """(fields with the stored data, next offset)."""
    begin = at
    try:
        method, kind = buf[at], buf[at + 1]
        content, at = read_itf8(buf, at + 2)
        stored, at = read_itf8(buf, at)
        raw, at = read_itf8(buf, at)
        if stored < 0 or at + stored + 4 > len(buf):
            raise FormatError("truncated block")
        data = buf[at : at + stored]
        at += stored
        crc = struct.unpack_from("<I", buf, at)[0]
    except (IndexError, struct.error, ValueError) as e:
        raise FormatError(f"bad block: {e}") from e
    if crc != zlib.crc32(buf[begin:at]):
        raise FormatError("block checksum")
    return {"method": method, "block_type": kind, "content_id": content, "raw_size": raw, "data": data, "crc32": crc}, at + 4


def expand(method: int, data: bytes, raw_size: int) -> bytes:
    """Uncompressed data of a block. The range coder is not implemented."""
    if method == 0:
        out = data
    elif method == 1:
        out = zlib.decompress(data, wbits=47)
    elif method == 2:
        out = bz2.decompress(data)
    elif method == 3:
        out = lzma.decompress(data)
    else:
        raise NotImplementedError(f"block method {_METHODS[method] if method < len(_METHODS) else method}")
    if len(out) != raw_size:
        raise FormatError("block size")
    return out


def encode_container(blocks: list[tuple[int, int, int, bytes]], ref_id: int = -1, start: int = 0, span: int = 0, n_rec: int = 0, rec_count: int = 0, bases: int = 0) -> bytes:
    """A container of blocks (method, type, content id, data), which are compressed here. The range coder is not implemented."""
    body = bytearray()
    for method, kind, content, data in blocks:
        if method == 0:
            stored = data
        elif method == 1:
            stored = gzip.compress(data, mtime=0)
        elif method == 2:
            stored = bz2.compress(data)
        elif method == 3:
            stored = lzma.compress(data)
        else:
            raise NotImplementedError(f"block method {method}")
        one = bytes([method, kind]) + write_itf8(content) + write_itf8(len(stored)) + write_itf8(len(data)) + stored
        body += one + struct.pack("<I", zlib.crc32(one))
    head = struct.pack("<i", len(body)) + b"".join(write_itf8(x) for x in (ref_id, start, span, n_rec)) + write_ltf8(rec_count) + write_ltf8(bases) + write_itf8(len(blocks)) + write_itf8(0)
    return head + struct.pack("<I", zlib.crc32(head)) + bytes(body)


def header_block(text: str) -> bytes:
    """Data of a block of type 0."""
    raw = text.encode()
    return struct.pack("<i", len(raw)) + raw


def header_text_of(data: Column) -> Column:
    """Header text of the data of a block of type 0."""
    size = F.conv(F.concat(*[F.hex(F.substring(data, i, 1)) for i in (4, 3, 2, 1)]), 16, 10).cast("int")
    return F.decode(data.substr(F.lit(5), size), "UTF-8")


def header_text(data: bytes) -> str:
    """Header text of a block of type 0."""
    n = struct.unpack_from("<i", data)[0]
    return data[4 : 4 + n].decode()


def containers(path: str) -> Iterator[tuple[int, dict, int, int]]:
    """(number, fields, offset of the blocks, their size) by walking the headers only."""
    size = files.size_of(path)
    with files.open_input(path) as f:
        if f.read(4) != b"CRAM":
            raise FormatError("not a container file")
        at, no = 26, 0
        while at < size:
            f.seek(at)
            v, head, length = container_header(f.read(1 << 16))
            yield no, v, at + head, length
            at, no = at + head + length, no + 1


class _Containers(InputPartition):
    def __init__(self, path: str, items: list):
        self.path, self.items = path, items


class CramReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per, self.raw = options["path"], int(options.get("containersPerTask", 64)), options.get("decompress", "false").lower() != "true"

    def partitions(self):
        out = []
        for p in files.list_files(self.path):
            items = list(containers(p))
            out += [_Containers(p, items[i : i + self.per]) for i in range(0, len(items), self.per)]
        return out

    def read(self, part: _Containers):
        with files.open_input(part.path) as f:
            for no, v, at, length in part.items:
                f.seek(at)
                buf, pos = f.read(length), 0
                for i in range(v["blocks"]):
                    b, pos = block(buf, pos)
                    data = b["data"] if self.raw or b["method"] > 3 else expand(b["method"], b["data"], b["raw_size"])
                    yield (no, v["ref_id"], v["start"], v["span"], v["n_rec"], v["rec_count"], v["bases"], i, b["method"], b["block_type"], b["content_id"], b["raw_size"], data, b["crc32"])


class CramBlocks(DataSource):
    """spark.read.format("cram_blocks"): a row a block. Options path, containersPerTask, decompress (range-coded blocks stay as stored)."""

    @classmethod
    def name(cls) -> str:
        return "cram_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CramReader:
        return CramReader(self.options)
