"""Sequence files: index build over splits, index text, range reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from readloom.session import broadcast_if_small
from readloom.sources import files
from readloom.sources.bgzf import RangePartition, byte_ranges

FAI = "name STRING, length BIGINT, start BIGINT, bases_per_line INT, bytes_per_line INT"
SEGMENT = "_src_id INT, part BIGINT, ord INT, name STRING, header_at BIGINT, seq_at BIGINT, bases BIGINT, first_bases INT, first_bytes INT, short_bases INT, short_at BIGINT, long_bases INT, long_at BIGINT, last_bases INT, lines BIGINT"


class FastaReader(DataSourceReader):
    """One row a stretch of a sequence in a byte range. A line belongs to the range in which it starts; a stretch without name goes on from the range before."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self):
        return byte_ranges(self.path, self.split)

    def read(self, part: RangePartition) -> Iterator[tuple]:
        with files.open_input(part.path) as f:
            seg, no = self._new(None, None), 0
            for at, line in self._lines(f, part):
                text = line.rstrip(b"\r\n")
                if text.startswith(b">"):
                    if seg["lines"] or seg["header_at"] is not None:
                        yield self._row(part, no, seg)
                        no += 1
                    seg = self._new(text[1:].split(b" ")[0].split(b"\t")[0].decode(), at)
                elif text or seg["lines"]:
                    self._add(seg, at, len(text), len(line))
            if seg["lines"] or seg["header_at"] is not None:
                yield self._row(part, no, seg)

    @staticmethod
    def _lines(f, part: RangePartition) -> Iterator[tuple[int, bytes]]:
        at = part.start
        if at:
            f.seek(at - 1)
            while chunk := f.read(1 << 16):
                if (i := chunk.find(b"\n")) >= 0:
                    at += i
                    break
                at += len(chunk)
            else:
                return
        f.seek(at)
        rest = b""
        while at < part.end:
            chunk = f.read(1 << 20)
            data = rest + chunk
            i = 0
            while at < part.end and (j := data.find(b"\n", i)) >= 0:
                yield at, data[i : j + 1]
                at += j + 1 - i
                i = j + 1
            rest = data[i:]
            if not chunk:
                if rest and at < part.end:
                    yield at, rest
                return

    @staticmethod
    def _new(name, at) -> dict:
        return {"name": name, "header_at": at, "seq_at": None, "bases": 0, "first_bases": None, "first_bytes": None, "short_bases": None, "short_at": None, "long_bases": None, "long_at": None, "last_bases": None, "lines": 0}

    @staticmethod
    def _add(s: dict, at: int, bases: int, size: int) -> None:
        if s["seq_at"] is None:
            s["seq_at"], s["first_bases"], s["first_bytes"] = at, bases, size
        elif bases and (s["short_bases"] is None or s["last_bases"] < s["short_bases"]):
            s["short_bases"], s["short_at"] = s["last_bases"], at  # the narrowest line that another follows, and where that begins
        if s["long_bases"] is None or bases > s["long_bases"]:
            s["long_bases"], s["long_at"] = bases, at
        s["bases"] += bases
        s["last_bases"] = bases
        s["lines"] += 1

    @staticmethod
    def _row(part: RangePartition, no: int, s: dict) -> tuple:
        return (part.src, part.start, no, s["name"], s["header_at"], s["seq_at"], s["bases"], s["first_bases"], s["first_bytes"], s["short_bases"], s["short_at"], s["long_bases"], s["long_at"], s["last_bases"], s["lines"])


class FastaSegments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_segments"

    def schema(self) -> str:
        return SEGMENT

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def build_fai(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """FAI rows of a sequence file, with `problem` where the file cannot be indexed: no name, a repeated name, a long line, a short line that is not the last.

    Only the stretches (a row a sequence and byte range) meet, never the lines."""
    s = spark.read.format("fasta_segments").option("path", path).option("splitBytes", split).load()
    w = Window.partitionBy("_src_id").orderBy("part", "ord")
    s = s.withColumn("k", F.sum(F.col("header_at").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = Window.partitionBy("_src_id", "k").orderBy("part", "ord")
    full = F.first("first_bases", ignorenulls=True).over(g.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("full", full).withColumn("before", F.last("last_bases", ignorenulls=True).over(g.rowsBetween(Window.unboundedPreceding, -1)))
    # judged against the first line of the sequence, wherever that is
    bad_short = F.least(F.when(F.col("short_bases") < F.col("full"), F.col("short_at")), F.when((F.col("before") < F.col("full")) & (F.col("bases") > 0), F.col("seq_at")))
    bad_long = F.when(F.col("long_bases") > F.col("full"), F.col("long_at"))
    rows = s.groupBy("_src_id", "k").agg(
        F.max("name").alias("name"), F.coalesce(F.sum("bases"), F.lit(0)).cast("bigint").alias("length"), F.min("seq_at").alias("start"), F.min("full").alias("bases_per_line"),
        F.min_by("first_bytes", "seq_at").alias("bytes_per_line"), F.min(bad_short).alias("short_at"), F.min(bad_long).alias("long_at"), F.min("header_at").alias("header_at"),
    )
    dup = F.row_number().over(Window.partitionBy("_src_id", "name").orderBy("k"))
    problem = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.concat(F.lit("missing sequence name at "), F.coalesce("header_at", "start").cast("string")))
        .when(F.col("long_at").isNotNull() & (F.col("short_at").isNull() | (F.col("long_at") < F.col("short_at"))), F.concat(F.lit("unexpected long line at offset "), F.col("long_at").cast("string")))
        .when(F.col("short_at").isNotNull(), F.concat(F.lit("unexpected short line before offset "), F.col("short_at").cast("string")))
        .when(F.col("dup") > 1, F.concat(F.lit("duplicate sequence identifier "), F.col("name"), F.lit(" at "), F.col("header_at").cast("string")))
    )
    return rows.withColumn("dup", dup).select("name", "length", "start", "bases_per_line", "bytes_per_line", problem.alias("problem"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """Strict: five columns, whole numbers; a repeated name raises when the rows are computed."""
    rows = spark.read.csv(path, sep="\t", schema=FAI, mode="FAILFAST", quote="")
    n = F.count("*").over(Window.partitionBy("name"))
    return rows.withColumn("name", F.when(n > 1, F.raise_error(F.concat(F.lit("non-unique name: "), F.col("name"))).cast("string")).otherwise(F.col("name")))


def write_fai(fai: DataFrame, path: str) -> None:
    """One index file, by ascending start; an index has a row a sequence of one file."""
    with files.open_output(path) as out:
        for r in fai.orderBy("start").select("name", "length", "start", "bases_per_line", "bytes_per_line").toLocalIterator():
            out.write("\t".join(map(str, r)).encode() + b"\n")


def byte_offset(pos, start, bases, size):
    """Byte of base pos (columns or numbers), in whole numbers."""
    if not any(isinstance(x, Column) for x in (pos, start, bases, size)):
        return start + pos // bases * size + pos % bases
    pos, start, bases, size = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (pos, start, bases, size))
    # the division of whole numbers, which has no function of its own
    return start + F.call_function("div", pos, bases) * size + pos % bases


def read_ranges(requests: DataFrame, fai: DataFrame, path: str) -> DataFrame:
    """request columns + seq for requests(name, beg, end), 0-based half-open; a null beg means the whole sequence. Unknown names and ranges outside the
    sequence give a null seq and an error text."""
    j = requests.join(broadcast_if_small(fai.select("name", "length", "start", "bases_per_line", "bytes_per_line")), "name", "left")
    columns = [c for c in requests.columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema] + ["seq STRING", "error STRING"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with files.open_input(path) as f:
            for pdf in batches:
                seqs, errors = [], []
                for r in pdf.itertuples(index=False):
                    if pd.isna(r.length):
                        seqs.append(None)
                        errors.append("unknown sequence")
                        continue
                    n, start, bases, size = int(r.length), int(r.start), int(r.bases_per_line or 0), int(r.bytes_per_line or 0)
                    beg, end = (0, n) if pd.isna(r.beg) else (int(r.beg), int(r.end))
                    if not 0 <= beg <= end <= n:
                        seqs.append(None)
                        errors.append("out of range")
                        continue
                    at = lambda p: byte_offset(p, start, bases, size)  # noqa: B023, E731
                    f.seek(at(beg) if beg < end else 0)
                    raw = f.read(at(end - 1) + 1 - at(beg)) if beg < end else b""
                    seqs.append(raw.replace(b"\n", b"").replace(b"\r", b"").decode())
                    errors.append(None)
                yield pdf[columns].assign(seq=seqs, error=errors)

    return j.select(*columns, "length", "start", "bases_per_line", "bytes_per_line").mapInPandas(read, schema)
