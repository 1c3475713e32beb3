"""Text alignment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from readloom.functions import cigar as C
from readloom.functions import records as R
from readloom.functions import sequences as S
from readloom.functions import tags as T
from readloom.operators.header import Header, parse_header
from readloom.operators.rejects import load_records
from readloom.sources import files
from readloom.sources.bam import PartsWriter


def header_text(path: str) -> str:
    """Leading `@` lines of a file, of the first one of a folder. Only they are read."""
    out, rest = [], b""
    with files.open_input(files.list_files(path)[0]) as f:
        while chunk := f.read(1 << 16):
            lines = (rest + chunk).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if not line.startswith(b"@"):
                    return "".join(out)
                out.append(line.decode("utf-8", "replace") + "\n")
        if rest.startswith(b"@"):
            out.append(rest.decode("utf-8", "replace") + "\n")
    return "".join(out)


def record_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines that are neither header nor blank. Splittable; a last line without end is read too."""
    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))


def read_sam(spark: SparkSession, path: str) -> tuple[Header, DataFrame, DataFrame]:
    """(header, records, rejects) of a text file. Records have reference ids if the header names the references, sequences upper-cased with unknown
    letters as N, missing qualities as null, tags as typed structs. Rejects keep the raw line and the reason."""
    header = parse_header(header_text(path))
    lines = record_lines(spark, path).withColumn("line_id", F.monotonically_increasing_id())
    records, rejects = load_records(lines, "line_id", "value")
    refs = header.table(spark, "SQ").select(F.col("sn").alias("rname"), "ref_id")
    mates = refs.select(F.col("rname").alias("mate_rname"), F.col("ref_id").alias("mate_ref_id"))
    out = records.join(refs, "rname", "left").join(mates, "mate_rname", "left")
    return header, out.select(
        "line_id", "qname", "flag", "ref_id", "rname", "pos", "mapq", "cigar", "mate_ref_id", "mate_rname", "mate_pos", "tlen",
        S.normalise_seq(F.col("seq")).alias("seq"), "qual", F.transform("aux_text", T.parse_aux).alias("aux"),
    ), rejects


def inferred_references(lines: DataFrame, line: str = "value", order: str = "ord") -> DataFrame:
    """(ref_id, sn, ln) of header-less text: names in the order first seen, RNAME before RNEXT of a line, length 0. order: a column that orders the lines."""
    f = F.split(F.col(line), "\t")
    names = lines.select(F.posexplode(F.array(F.get(f, F.lit(2)), F.get(f, F.lit(6)))).alias("i", "sn"), order).where("sn IS NOT NULL AND sn NOT IN ('*', '=', '')")
    first = names.groupBy("sn").agg(F.min(F.struct(order, "i")).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("ref_id"), "sn", F.lit(0).alias("ln"))


def format_line(flag_style: str = "decimal") -> Column:
    """Text line of a record with the columns of the alignments table. Null where qualities and sequence differ in length."""
    star = lambda c: F.coalesce(c, F.lit("*"))
    bad = (F.size("qual") > 0) & (F.size("qual") != F.coalesce(F.length("seq"), F.lit(0)))
    mate = F.when(F.col("mate_rname").isNull(), "*").when(F.col("mate_rname") == F.col("rname"), "=").otherwise(F.col("mate_rname"))
    fixed = F.concat_ws(
        "\t", star(F.col("qname")), R.flag_text(F.col("flag"), flag_style), star(F.col("rname")), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), F.coalesce("mapq", F.lit(0)).cast("string"),
        C.format_cigar(F.col("cigar")), mate, (F.coalesce("mate_pos", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"),
        F.when(F.coalesce(F.length("seq"), F.lit(0)) == 0, "*").otherwise(F.col("seq")), S.encode_qual(F.col("qual")),
    )
    tags = F.array_join(F.transform("aux", lambda a: F.concat(F.lit("\t"), T.format_aux(a))), "")
    return F.when(~F.coalesce(bad, F.lit(False)), F.concat(fixed, F.coalesce(tags, F.lit(""))))


def write_sam(df: DataFrame, path: str, header: str, flag_style: str = "decimal", layout: str = "file") -> None:
    """One text file: header, then the lines in the order of df's partitions; or, with layout folder, such a file a partition."""
    df.select(format_line(flag_style).alias("line")).write.format("sam_text").mode("append").option("path", path).option("header", header).option("layout", layout).save()


class _TextWriter(PartsWriter):
    ending = ".sam"

    def __init__(self, options: dict):
        super().__init__(options)
        self.text = options.get("header", "")

    def head(self) -> bytes:
        return self.text.encode()

    def encode(self, batches, out) -> None:
        for b in batches:
            lines = b.column(0).to_pylist()
            if None in lines:
                raise ValueError("sequence/quality length mismatch")
            if lines:
                out.write(("\n".join(lines) + "\n").encode())


class SamText(DataSource):
    """df.write.format("sam_text"): a line column, options path, header and layout."""

    @classmethod
    def name(cls) -> str:
        return "sam_text"

    def schema(self) -> str:
        return "line STRING"

    def writer(self, schema, overwrite: bool) -> _TextWriter:
        return _TextWriter(self.options)
