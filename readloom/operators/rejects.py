"""Loading of delimited record lines with the failing ones set aside.

A line is read permissively under the explicit schema RECORD_SCHEMA: fields are split at tabs, every one is cast, the raw text is kept beside. Lines
whose text does not satisfy the schema are then classed by the first check that fails: field count, quoting, then each field in order. The built-in
CSV reader is not used for the split: its quoting spans separators, while here a tab always separates, and it takes no open-ended tail of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import staged

FIXED = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
RECORD_SCHEMA = (
    "qname STRING, flag INT, rname STRING, pos BIGINT, mapq SMALLINT, cigar ARRAY<STRUCT<len: BIGINT, op: STRING>>, mate_rname STRING, mate_pos BIGINT, "
    "tlen INT, seq STRING, qual ARRAY<SMALLINT>, aux_text ARRAY<STRING>"
)
#: Fixed ranges of the integer array subtypes.
INT_RANGES = {"c": (-(1 << 7), (1 << 7) - 1), "C": (0, (1 << 8) - 1), "s": (-(1 << 15), (1 << 15) - 1), "S": (0, (1 << 16) - 1), "i": (-(1 << 31), (1 << 31) - 1), "I": (0, (1 << 32) - 1)}
_FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _upto(text: Column, limit: int) -> Column:
    """text is ASCII digits of a value not over limit, leading zeros allowed."""
    digits = F.regexp_replace(text, r"\A0+(?=[0-9])", "")
    return text.rlike(r"\A[0-9]+\z") & (F.length(digits) <= len(str(limit))) & (F.expr("0L") + F.substring(digits, 1, 18).try_cast("bigint") <= limit)


def _signed(text: Column, low: int, high: int) -> Column:
    digits = F.regexp_replace(text, r"\A[+-]?0*(?=[0-9])", "")
    value = F.substring(digits, 1, 18).try_cast("bigint")
    value = F.when(text.startswith("-"), -value).otherwise(value)
    return text.rlike(r"\A[+-]?[0-9]+\z") & (F.length(digits) <= 18) & value.between(low, high)


def _within(low: int, high: int):
    return lambda x: _signed(x, low, high)


def is_aux_text(a: Column) -> Column:
    """TAG:TYPE:VALUE with a value of its type."""
    kind, value = F.substring(a, 4, 1), a.substr(F.lit(6), F.length(a))
    sub = F.substring(a, 6, 1)
    numbers = a.substr(F.lit(7), F.length(a))  # with the leading comma
    items = F.split(a.substr(F.lit(8), F.length(a)), ",", -1)
    in_range = F.lit(False)
    for letter, (low, high) in INT_RANGES.items():
        in_range = F.when(sub == F.lit(letter), F.forall(items, _within(low, high))).otherwise(in_range)
    in_range = F.when(sub == "f", F.forall(items, lambda x: x.rlike(rf"\A{_FLOAT}\z"))).otherwise(in_range)
    ok = (
        F.when(kind == "A", value.rlike(r"\A[!-~]\z"))
        .when(kind == "i", _signed(value, -(1 << 31), (1 << 32) - 1))
        .when(kind == "f", value.rlike(rf"\A{_FLOAT}\z"))
        .when(kind == "Z", value.rlike(r"\A[ -~]*\z"))
        .when(kind == "H", value.rlike(r"\A[0-9A-Fa-f]*\z") & (F.length(value) % 2 == 0))
        .when(kind == "B", numbers.startswith(",") & in_range)
        .otherwise(F.lit(False))
    )
    return a.rlike(r"\A[A-Za-z][A-Za-z0-9]:[AifZHB]:") & F.coalesce(ok, F.lit(False))


def split_line(line: Column) -> Column:
    """Fields of a line, one trailing CR dropped. A null line has no field."""
    bare = F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    return F.coalesce(F.split(bare, "\t", -1), F.expr("CAST(array() AS ARRAY<STRING>)"))


def _quoted(x: Column) -> Column:
    return x.startswith('"')


def _inside(x: Column) -> Column:
    return x.substr(F.lit(2), F.length(x) - 2)


def read_permissive(df: DataFrame, line: str) -> DataFrame:
    """df with __f (raw fields), __u (unwrapped fields) and __corrupt (raw text of lines that cannot be records, else null) and __reason."""
    lines = staged(df, __f=split_line(F.col(line)))
    f = F.col("__f")
    misquoted = F.exists(
        F.transform(f, lambda x, i: (i != 10) & _quoted(x) & ((F.length(x) < 2) | ~x.endswith('"') | F.replace(_inside(x), F.lit('""'), F.lit("")).contains('"'))), lambda bad: bad
    )
    unwrapped = F.transform(f, lambda x, i: F.when((i != 10) & _quoted(x), F.replace(_inside(x), F.lit('""'), F.lit('"'))).otherwise(x))
    has_quote = F.exists(f, _quoted)
    fields = staged(lines, __q=F.when(F.size(f) < 11, F.lit("fields")).when(has_quote & misquoted, F.lit("quoting")), __u=F.when(has_quote, unwrapped).otherwise(f))
    v = {name: F.get(F.col("__u"), F.lit(i)) for i, name in enumerate(FIXED)}
    aux = F.slice(F.col("__u"), 12, F.greatest(F.size("__u") - 11, F.lit(0)))
    pos_top, seq_given = (1 << 31) - 1, v["seq"] != "*"
    checks = {
        "qname": v["qname"].rlike(r"\A[!-?A-~]{1,254}\z"),
        "flag": _upto(v["flag"], 65535) | v["flag"].rlike(r"\A0x[0-9A-Fa-f]{1,4}\z"),
        "rname": v["rname"] != "",
        "pos": _upto(v["pos"], pos_top),
        "mapq": _upto(v["mapq"], 255),
        "cigar": C.is_cigar_text(v["cigar"]) & (~seq_given | (v["cigar"] == "*") | C.is_valid(_ops(v["cigar"]), F.length(v["seq"]).cast("bigint"))),
        "rnext": v["rnext"] != "",
        "pnext": _upto(v["pnext"], pos_top),
        "tlen": _signed(v["tlen"], -pos_top, pos_top),
        "seq": (v["seq"] == "*") | v["seq"].rlike(r"\A[A-Za-z=.]+\z"),
        "qual": (v["qual"] == "*") | (seq_given & v["qual"].rlike(r"\A[!-~]+\z") & (F.length(v["qual"]) == F.length(v["seq"]))),
        "aux": F.forall(aux, is_aux_text),
    }
    reason = F.when(F.col("__q").isNotNull(), F.col("__q"))
    for name, ok in checks.items():
        reason = reason.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    return staged(fields, __reason=reason).withColumn("__corrupt", F.when(F.col("__reason").isNotNull(), F.col(line)))


def _ops(text: Column) -> Column:
    lens = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=XB])"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=XB])"), F.lit(2))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.try_cast("bigint").alias("len"), o.alias("op")))


def reject_lines(df: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """(line_id, reason) of every line that is not a record. A null or empty line fails with `fields`; repeated lines are judged one by one."""
    return read_permissive(df.select(F.col(line_id).alias("line_id"), F.col(line).alias("line")), "line").where("__reason IS NOT NULL").select("line_id", F.col("__reason").alias("reason"))


def load_records(df: DataFrame, line_id: str = "line_id", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(records, rejects). Records are typed by RECORD_SCHEMA with 0-based positions, `*` as null, RNEXT `=` resolved; rejects keep the raw text
    and the reason. Every input line is in exactly one of the two."""
    read = read_permissive(df.select(F.col(line_id).alias("line_id"), F.col(line).alias("line")), "line")
    v = {name: F.get(F.col("__u"), F.lit(i)) for i, name in enumerate(FIXED)}
    star = lambda c: F.when(c != "*", c)
    flag = F.when(v["flag"].startswith("0x"), F.conv(F.substring(v["flag"], 3, 4), 16, 10)).otherwise(v["flag"]).cast("int")
    records = read.where("__reason IS NULL").select(
        "line_id",
        v["qname"].alias("qname"),
        flag.alias("flag"),
        star(v["rname"]).alias("rname"),
        (v["pos"].cast("bigint") - 1).alias("pos"),
        v["mapq"].cast("smallint").alias("mapq"),
        C.parse_cigar(v["cigar"]).alias("cigar"),
        F.when(v["rnext"] == "=", star(v["rname"])).otherwise(star(v["rnext"])).alias("mate_rname"),
        (v["pnext"].cast("bigint") - 1).alias("mate_pos"),
        v["tlen"].cast("int").alias("tlen"),
        star(v["seq"]).alias("seq"),
        F.when((v["qual"] != "*") & (v["seq"] != "*"), F.transform(F.split(v["qual"], ""), lambda c: (F.ascii(c) - 33).cast("smallint"))).alias("qual"),
        F.slice(F.col("__u"), 12, F.greatest(F.size("__u") - 11, F.lit(0))).alias("aux_text"),
    )
    rejects = read.where("__reason IS NOT NULL").select("line_id", F.col("__reason").alias("reason"), F.col("__corrupt").alias("raw"))
    return records, rejects
