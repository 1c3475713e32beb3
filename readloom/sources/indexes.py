"""Coordinate index files (.bai, .csi v1/v2, .tbi): flat rows to bytes and back.

An index file belongs to one alignment file and is small against it; it is read by one task, encoded a reference a task and written by one. Rows are dicts of ROW's columns: kind `bin` (ref_id, bin, left_voff, records, chunk_begin, chunk_end), `linear` (ref_id, tile, voff), `stats`
(ref_id, chunk_begin, chunk_end, mapped, unmapped) and `unplaced` (unmapped).
"""

from __future__ import annotations

import struct
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.functions.bins import STATS_BIN, level_offset
from readloom.session import cut
from readloom.sources import files
from readloom.sources.bgzf import FormatError

ROW = "kind STRING, ref_id INT, bin BIGINT, left_voff BIGINT, records BIGINT, chunk_begin BIGINT, chunk_end BIGINT, tile INT, voff BIGINT, mapped BIGINT, unmapped BIGINT"
COLUMNS = [x.split()[0] for x in ROW.split(", ")]
META = "format INT, zero_based BOOLEAN, name_col INT, begin_col INT, end_col INT, meta_char STRING, skip INT, names ARRAY<STRING>, min_shift INT, depth INT, version INT, aux BINARY"


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, code: str) -> tuple:
        try:
            out = struct.unpack_from("<" + code, self.data, self.at)
        except struct.error as e:
            raise FormatError(f"truncated index at {self.at}") from e
        self.at += struct.calcsize("<" + code)
        return out

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError(f"truncated index at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def count(self) -> int:
        (n,) = self.take("i")
        if n < 0:
            raise FormatError("negative count")
        return n


def _row(kind: str, **values) -> dict:
    return dict.fromkeys(COLUMNS) | {"kind": kind} | values


def _body(c: _Cursor, n_ref: int, stats_bin: int, version: int | None) -> list[dict]:
    """References of an index. version None: linear tiles after the bins; 1: left offsets; 2: left offsets and record counts."""
    rows = []
    for ref in range(n_ref):
        own = []
        for _ in range(c.count()):
            (number,) = c.take("I")
            left, records = (c.take("Q")[0] if version else None), (c.take("Q")[0] if version == 2 else None)
            n = c.count()
            if number == stats_bin:
                if n != 2:
                    raise FormatError("bad statistics bin")
                b, e, m, u = c.take("4Q")
                rows.append(_row("stats", ref_id=ref, chunk_begin=b, chunk_end=e, mapped=m, unmapped=u))
                continue
            for _ in range(n):
                b, e = c.take("2Q")
                own.append(_row("bin", ref_id=ref, bin=number, left_voff=left, records=records, chunk_begin=b, chunk_end=e))
        rows += sorted(own, key=lambda r: (r["bin"], r["chunk_begin"]))
        if version is None:
            rows += [_row("linear", ref_id=ref, tile=t, voff=v) for t in range(c.count()) for (v,) in [c.take("Q")]]
    if c.at + 8 <= len(c.data):
        rows.append(_row("unplaced", unmapped=c.take("Q")[0]))
    return rows


def parse_index(data: bytes) -> tuple[list[dict], dict]:
    """(rows, meta) of an uncompressed index of any of the three kinds."""
    c, meta = _Cursor(data), dict.fromkeys(x.split()[0] for x in META.split(", "))
    magic = c.bytes(4)
    if magic == b"BAI\1":
        return _body(c, c.count(), STATS_BIN, None), meta
    if magic == b"TBI\1":
        n = c.count()
        form, name, beg, end, char, skip, size = c.take("7i")
        names = [x.decode() for x in c.bytes(size).split(b"\0")[:-1]]
        meta |= {"format": form & 0xFFFF, "zero_based": bool(form & 0x10000), "name_col": name, "begin_col": beg, "end_col": end, "meta_char": chr(char), "skip": skip, "names": names}
        return _body(c, n, STATS_BIN, None), meta
    if magic[:3] == b"CSI" and magic[3] in (1, 2):
        shift, depth, size = c.take("3i")
        if not (0 <= shift < 64 and 0 <= depth < 21):
            raise FormatError("bad index geometry")
        meta |= {"min_shift": shift, "depth": depth, "version": magic[3], "aux": c.bytes(size)}
        return _body(c, c.count(), level_offset(depth + 1) + 1, magic[3]), meta
    raise FormatError("not an index")


def _head(kind: str, n_ref: int, meta: dict) -> tuple[bytes, int, int | None]:
    """(bytes before the references, statistics bin, version of left offsets)."""
    if kind == "bai":
        return b"BAI\1" + struct.pack("<i", n_ref), STATS_BIN, None
    if kind == "tbi":
        names = b"".join(x.encode() + b"\0" for x in meta["names"])
        form = meta["format"] | (0x10000 if meta["zero_based"] else 0)
        return b"TBI\1" + struct.pack("<8i", n_ref, form, meta["name_col"], meta["begin_col"], meta["end_col"], ord(meta["meta_char"]), meta["skip"], len(names)) + names, STATS_BIN, None
    if kind == "csi":
        version, aux = meta.get("version") or 2, meta.get("aux") or b""
        shift, depth = meta.get("min_shift") or 14, meta.get("depth") or 5
        return b"CSI" + bytes([version]) + struct.pack("<3i", shift, depth, len(aux)) + aux + struct.pack("<i", n_ref), level_offset(depth + 1) + 1, version
    raise ValueError(kind)


def _reference(rows: list[dict], stats_bin: int, version: int | None) -> bytes:
    """Bytes of one reference: bins, chunks and tiles in order, tiles without records as 0."""
    own: dict = defaultdict(list)
    for r in rows:
        own[r["kind"]].append(r)
    bins = defaultdict(list)
    for r in own["bin"]:
        bins[r["bin"]].append(r)
    out = [struct.pack("<i", len(bins) + len(own["stats"]))]
    for number in sorted(bins):
        chunks = sorted(bins[number], key=lambda r: r["chunk_begin"])
        out.append(struct.pack("<I", number))
        if version:
            out.append(struct.pack("<Q", chunks[0]["left_voff"] or 0))
        if version == 2:
            out.append(struct.pack("<Q", chunks[0]["records"] or 0))
        out.append(struct.pack("<i", len(chunks)) + b"".join(struct.pack("<2Q", r["chunk_begin"], r["chunk_end"]) for r in chunks))
    for r in own["stats"]:
        out.append(struct.pack("<I", stats_bin) + (struct.pack("<Q", 0) if version else b"") + (struct.pack("<Q", 0) if version == 2 else b"") + struct.pack("<i4Q", 2, r["chunk_begin"], r["chunk_end"], r["mapped"], r["unmapped"]))
    if version is None:
        tiles = {r["tile"]: r["voff"] for r in own["linear"]}
        n = max(tiles, default=-1) + 1
        out.append(struct.pack("<i", n) + b"".join(struct.pack("<Q", tiles.get(t, 0)) for t in range(n)))
    return b"".join(out)


def encode_index(rows: list[dict], kind: str, n_ref: int, meta: dict | None = None) -> bytes:
    """Bytes of a bai, csi or tbi index."""
    head, stats_bin, version = _head(kind, n_ref, meta or {})
    by: dict = defaultdict(list)
    unplaced = None
    for r in rows:
        if r["kind"] == "unplaced":
            unplaced = r["unmapped"]
        else:
            by[r["ref_id"]].append(r)
    out = [head, *(_reference(by[ref], stats_bin, version) for ref in range(n_ref))]
    return b"".join(out) + (b"" if unplaced is None else struct.pack("<Q", unplaced))


def index_rows(bins: DataFrame, linear: DataFrame | None, stats: DataFrame | None) -> DataFrame:
    """The tables of an index as rows of ROW's columns."""
    kinds = dict(x.split() for x in ROW.split(", "))
    parts = [bins.select(F.lit("bin").alias("kind"), "ref_id", "bin", "left_voff", "records", "chunk_begin", "chunk_end")]
    if linear is not None:
        parts.append(linear.select(F.lit("linear").alias("kind"), "ref_id", "tile", "voff"))
    if stats is not None:
        parts.append(stats.select(F.lit("stats").alias("kind"), "ref_id", F.col("begin_voff").alias("chunk_begin"), F.col("end_voff").alias("chunk_end"), "mapped", "unmapped"))
    full = [p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for p in parts]
    return reduce(DataFrame.unionAll, full)


def write_index(path: str, kind: str, n_ref: int, bins: DataFrame, linear: DataFrame | None = None, stats: DataFrame | None = None, unplaced: int | None = None, meta: dict | None = None) -> None:
    """Index tables of one alignment file to an index file. A task encodes a reference, whose rows the format bounds; one task writes the encoded references,
    which come to it in order, into the one file. Nothing passes through the driver but the number of bytes."""
    head, stats_bin, version = _head(kind, n_ref, meta or {})
    rows = index_rows(bins, linear, stats).where(F.col("ref_id").between(0, n_ref - 1))
    spark = rows.sparkSession

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        whole = ("bin", "left_voff", "records", "chunk_begin", "chunk_end", "tile", "voff", "mapped", "unmapped")
        own = [r | {c: None if r[c] is None else int(r[c]) for c in whole} for r in own]
        return pd.DataFrame({"ref_id": [int(key[0])], "data": [_reference(own, stats_bin, version)]})

    # 64-bit offsets do not fit a pandas column of numbers with gaps
    text = rows.select("kind", "ref_id", *[F.col(c).cast("string").alias(c) for c in COLUMNS[2:]])
    encoded = cut(text.groupBy("ref_id").applyInPandas(encode, "ref_id INT, data BINARY"))
    every = spark.range(n_ref).select(F.col("id").cast("int").alias("ref_id")).join(encoded, "ref_id", "left")

    def write(batches):
        size, empty = len(head), _reference([], stats_bin, version)
        with files.open_output(path) as out:
            out.write(head)
            for pdf in batches:
                for data in pdf["data"]:
                    out.write(data if data is not None else empty)
                    size += len(data if data is not None else empty)
            if unplaced is not None:
                out.write(struct.pack("<Q", unplaced))
        yield pd.DataFrame({"size": [size]})

    every.repartition(1).sortWithinPartitions("ref_id").select("data").mapInPandas(write, "size BIGINT").collect()


class _File(InputPartition):
    def __init__(self, path: str, src: int):
        self.path, self.src = path, src


class _Reader(DataSourceReader):
    def __init__(self, options: dict, meta: bool):
        self.path, self.meta = options["path"], meta

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(files.list_files(self.path))]

    def read(self, part: _File):
        rows, meta = parse_index(files.read_bytes(part.path))
        if self.meta:
            yield (part.src, *meta.values())
        else:
            for r in rows:
                yield (part.src, *r.values())


class CoordinateIndex(DataSource):
    """spark.read.format("coordinate_index"): rows of every index file of the path. With option view=meta one row a file: geometry, columns, names."""

    @classmethod
    def name(cls) -> str:
        return "coordinate_index"

    def schema(self) -> str:
        return "_src_id INT, " + (META if self.options.get("view") == "meta" else ROW)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, self.options.get("view") == "meta")


def register(spark: SparkSession) -> None:
    """All formats of this package for spark.read and df.write."""
    from readloom.sources.bam import Bam
    from readloom.sources.bgzf import BgzfLines
    from readloom.sources.cram import CramBlocks
    from readloom.sources.fasta import FastaSegments
    from readloom.sources.sam import SamText

    for source in (Bam, BgzfLines, CoordinateIndex, CramBlocks, FastaSegments, SamText):
        spark.dataSource.register(source)
