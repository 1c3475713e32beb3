"""Alignment operations (CIGAR): ARRAY<STRUCT<len BIGINT, op STRING>> arithmetic as native higher-order expressions.

A null array counts as the empty CIGAR; an operation without length counts as length 0, without or with unknown letter as consuming nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=XB"  # fixed order of the packed code 0..9
MAX_OP_LEN = (1 << 28) - 1
_EMPTY = "CAST(array() AS ARRAY<STRUCT<len: BIGINT, op: STRING>>)"


def empty_cigar() -> Column:
    return F.expr(_EMPTY)


def ref_consumption(op: Column) -> Column:
    """Reference bases per unit of length: M D N = X one, B minus one, others none."""
    return F.when(op.isin("M", "D", "N", "=", "X"), F.lit(1)).when(op == "B", F.lit(-1)).otherwise(F.lit(0))


def query_consumption(op: Column) -> Column:
    """Read bases per unit of length: M I S = X one, others none."""
    return F.when(op.isin("M", "I", "S", "=", "X"), F.lit(1)).otherwise(F.lit(0))


def _len(x: Column) -> Column:
    return F.coalesce(x["len"], F.lit(0).cast("bigint"))


def _ref_step(x: Column) -> Column:
    return _len(x) * ref_consumption(x["op"])


def _query_step(x: Column) -> Column:
    return _len(x) * query_consumption(x["op"])


def ops_or_empty(cigar: Column) -> Column:
    return F.coalesce(cigar, empty_cigar())


def parse_cigar(text: Column) -> Column:
    """Text to operations, lengths over 2^28-1 split in several; `*`, null and the empty text give the empty array, malformed text null."""
    lens = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=XB])"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=XB])"), F.lit(2))
    pairs = F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("bigint").alias("len"), o.alias("op")))

    def pieces(x: Column) -> Column:
        full = F.expr(f"CAST({MAX_OP_LEN} AS BIGINT)")
        count = F.greatest(F.ceil(x["len"] / full), F.lit(1).cast("bigint"))
        return F.transform(
            F.sequence(F.lit(1).cast("bigint"), count),
            lambda i: F.struct(F.when(i < count, full).otherwise(x["len"] - (count - 1) * full).alias("len"), x["op"].alias("op")),
        )

    split = F.when(F.exists(pairs, lambda x: x["len"] > MAX_OP_LEN), F.flatten(F.transform(pairs, pieces))).otherwise(pairs)
    return (
        F.when(text.isNull() | text.isin("*", ""), empty_cigar())
        .when(is_cigar_text(text), split)
        .otherwise(F.lit(None))
    )


def is_cigar_text(text: Column) -> Column:
    """`*`, or one or more of 1-13 digits and an operation. Done by deletion, since a repeated group recurses in the regex engine."""
    rest = F.regexp_replace(text, "[0-9]{1,13}[MIDNSHP=XB]", "")
    return (text == "*") | ((F.length(text) > 0) & (rest == "") & ~text.rlike("[0-9]{14}"))


def format_cigar(cigar: Column) -> Column:
    c = ops_or_empty(cigar)
    return F.when(F.size(c) == 0, F.lit("*")).otherwise(F.array_join(F.transform(c, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))


def pack_op(length: Column, op: Column) -> Column:
    """len<<4 | code, as stored in binary records."""
    return F.shiftleft(length.cast("bigint"), 4).bitwiseOR((F.position(op, F.lit(OPS)) - 1).cast("bigint"))


def unpack_op(packed: Column) -> Column:
    return F.struct(
        F.shiftrightunsigned(packed, 4).alias("len"),
        F.substring(F.lit(OPS), packed.bitwiseAND(F.lit(15).cast("bigint")).cast("int") + 1, F.lit(1)).alias("op"),
    )


def lengths(cigar: Column) -> Column:
    """STRUCT<ref, read>: reference and read bases described; B is left out of ref."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        ops_or_empty(cigar),
        F.struct(zero.alias("ref"), zero.alias("read")),
        lambda a, x: F.struct((a["ref"] + F.when(x["op"] == "B", zero).otherwise(_ref_step(x))).alias("ref"), (a["read"] + _query_step(x)).alias("read")),
    )


def read_length(cigar: Column) -> Column:
    return F.aggregate(ops_or_empty(cigar), F.lit(0).cast("bigint"), lambda a, x: a + _query_step(x))


def is_valid(cigar: Column, length: Column) -> Column:
    """H only at an end; S at an end or beside an H; nothing that reads bases starts left of the start; read bases add up to length."""
    zero, none = F.lit(0).cast("bigint"), F.lit("")

    def step(a: Column, x: Column) -> Column:
        op = F.coalesce(x["op"], none)
        # judged when the next operation is seen: that makes the last one inner, if it was not the first
        inner = a["i"] >= 2
        odd = inner & ((a["last"] == "H") | ((a["last"] == "S") & (a["before"] != "H") & (op != "H")))
        left = (a["p"] < 0) & (query_consumption(op) != 0)
        return F.struct((a["p"] + _ref_step(x)).alias("p"), (a["q"] + _query_step(x)).alias("q"), (a["ok"] & ~odd & ~left).alias("ok"), op.alias("last"), a["last"].alias("before"), (a["i"] + 1).alias("i"))

    start = F.struct(zero.alias("p"), zero.alias("q"), F.lit(True).alias("ok"), none.alias("last"), none.alias("before"), F.lit(0).alias("i"))
    return F.aggregate(ops_or_empty(cigar), start, step, lambda a: F.when(a["ok"], a["q"]).otherwise(F.lit(-1).cast("bigint"))) == length


def reach(pos: Column, cigar: Column) -> Column:
    """Running maximum of the reference position over the operations, the start included (B steps back)."""
    p = pos.cast("bigint")
    return F.aggregate(
        ops_or_empty(cigar),
        F.struct(p.alias("p"), p.alias("e")),
        lambda a, x: F.struct((a["p"] + _ref_step(x)).alias("p"), F.greatest(a["e"], a["p"] + _ref_step(x)).alias("e")),
        lambda a: a["e"],
    )


def overlap(pos: Column, cigar: Column, beg: Column, end: Column) -> Column:
    """Aligned bases inside [beg, end): operations that consume read and reference alike."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        ops_or_empty(cigar),
        F.struct(pos.cast("bigint").alias("p"), zero.alias("o")),
        lambda a, x: F.struct(
            (a["p"] + _ref_step(x)).alias("p"),
            (
                a["o"]
                + F.when(
                    query_consumption(x["op"]) == ref_consumption(x["op"]),
                    F.greatest(zero, F.least(a["p"] + _ref_step(x), end.cast("bigint")) - F.greatest(a["p"], beg.cast("bigint"))),
                ).otherwise(zero)
            ).alias("o"),
        ),
        lambda a: a["o"],
    )
