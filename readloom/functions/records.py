"""Scalar functions of one alignment record: flags, placement, bins, tags. Null flags count as 0, null positions as -1."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import bins, cigar as C


class Flag(IntFlag):
    """Fixed values of the twelve flag bits."""

    PAIRED = 0x1
    PROPER_PAIR = 0x2
    UNMAPPED = 0x4
    MATE_UNMAPPED = 0x8
    REVERSE = 0x10
    MATE_REVERSE = 0x20
    READ1 = 0x40
    READ2 = 0x80
    SECONDARY = 0x100
    QC_FAIL = 0x200
    DUPLICATE = 0x400
    SUPPLEMENTARY = 0x800


LETTERS = "pPuUrR12sfdS"  # fixed: one letter a bit, lowest first
_PAIR_ONLY = 0x2 | 0x8 | 0x20 | 0x40 | 0x80


def flag_or_zero(flag: Column) -> Column:
    return F.coalesce(flag.cast("int"), F.lit(0))


def has(flag: Column, mask: int) -> Column:
    """All bits of mask are set."""
    return flag_or_zero(flag).bitwiseAND(F.lit(int(mask))) == int(mask)


def lacks(flag: Column, mask: int) -> Column:
    """No bit of mask is set."""
    return flag_or_zero(flag).bitwiseAND(F.lit(int(mask))) == 0


def flag_filter(flag: Column, require: int = 0, exclude: int = 0) -> Column:
    return has(flag, require) & lacks(flag, exclude)


def _shown(flag: Column) -> Column:
    f = flag_or_zero(flag)
    return F.when(f.bitwiseAND(F.lit(1)) == 1, f).otherwise(f.bitwiseAND(F.lit(0xFFF & ~_PAIR_ONLY)))


def flag_letters(flag: Column, padded: bool = True) -> Column:
    """Twelve characters with `-` for a clear bit, or the letters of the set bits only. Without the paired bit the pair bits do not show."""
    f = _shown(flag)
    parts = [F.when(f.bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)).otherwise(F.lit("-" if padded else "")) for i, x in enumerate(LETTERS)]
    return F.concat(*parts)


def flag_text(flag: Column, style: str = "decimal") -> Column:
    f = flag_or_zero(flag)
    if style == "decimal":
        return f.cast("string")
    if style == "hex":
        return F.concat(F.lit("0x"), F.lower(F.hex(f)))
    if style == "string":
        return flag_letters(flag, padded=False)
    raise ValueError(f"unknown flag style {style!r}")


def parse_flag(text: Column) -> Column:
    """Base-0 text (decimal, 0x, 0b, 0o or leading zero) to a number up to 65535, else null."""
    t = F.lower(text)
    value = (
        F.when(t.rlike(r"\A0x[0-9a-f]{1,4}\z"), F.conv(F.substring(t, 3, 9), 16, 10).cast("bigint"))
        .when(t.rlike(r"\A0b[01]{1,16}\z"), F.conv(F.substring(t, 3, 20), 2, 10).cast("bigint"))
        .when(t.rlike(r"\A0o?[0-7]{1,6}\z"), F.conv(F.regexp_replace(t, "o", ""), 8, 10).cast("bigint"))
        .when(t.rlike(r"\A[0-9]{1,6}\z"), t.cast("bigint"))
    )
    return F.when(value <= 65535, value.cast("int"))


def record_end(flag: Column, pos: Column, cigar: Column) -> Column:
    """pos+1 if unmapped or without operations, else the reach of the operations."""
    ops = C.ops_or_empty(cigar)
    return F.when(has(flag, Flag.UNMAPPED) | (F.size(ops) == 0), pos.cast("bigint") + 1).otherwise(C.reach(pos, ops))


def record_len(flag: Column, pos: Column, cigar: Column) -> Column:
    return record_end(flag, pos, cigar) - pos


def record_bin(flag: Column, pos: Column, cigar: Column) -> Column:
    """Index bin as stored in binary records: 4680 if read and mate are unmapped, else the bin of [pos, end) cut to 16 bits."""
    b = bins.bin_for(pos.cast("bigint"), record_end(flag, pos, cigar))
    return F.when(has(flag, Flag.UNMAPPED | Flag.MATE_UNMAPPED), F.lit(4680).cast("bigint")).otherwise(b.bitwiseAND(F.lit(0xFFFF).cast("bigint")))


def strand(flag: Column) -> Column:
    return F.when(has(flag, Flag.REVERSE), F.lit(-1)).otherwise(F.lit(1))


def is_placed(ref_id: Column, pos: Column) -> Column:
    return ref_id.isNotNull() & (ref_id >= 0) & (F.coalesce(pos, F.lit(-1).cast("bigint")) != -1)


def is_mapped(flag: Column) -> Column:
    return lacks(flag, Flag.UNMAPPED)


def seq_length(seq: Column) -> Column:
    return F.coalesce(F.length(seq), F.lit(0))


def record_error(r: dict[str, Column]) -> Column:
    """Why a record cannot be built, or null: ranges of positions, lengths and the agreement of reference and position."""
    top = (1 << 31) - 2
    pos, mate = (F.coalesce(r[k].cast("bigint"), F.lit(-1).cast("bigint")) for k in ("pos", "mate_pos"))
    n = seq_length(r["seq"])
    q = F.coalesce(F.size(r["qual"]), F.lit(0)) if "qual" in r else F.lit(0)
    return (
        F.when(~pos.between(-1, top), F.lit("position out of range"))
        .when(~mate.between(-1, top), F.lit("mate position out of range"))
        .when(F.abs(F.coalesce(r["tlen"], F.lit(0)).cast("bigint")) > (1 << 31) - 1, F.lit("template length out of range"))
        .when(r["qname"].isNull() | ~F.octet_length(r["qname"]).between(1, 254), F.lit("name length out of range"))
        .when(n < 1, F.lit("no sequence"))
        .when((q > 0) & (q != n), F.lit("sequence/quality length mismatch"))
        .when(r["ref_id"].isNull() & (pos != -1), F.lit("position without reference"))
        .when(r["ref_id"].isNotNull() & (pos == -1), F.lit("reference without position"))
        .when(r["mate_ref_id"].isNull() & (mate != -1), F.lit("mate position without reference"))
        .when(r["mate_ref_id"].isNotNull() & (mate == -1), F.lit("mate reference without position"))
    )


def is_valid_record(r: dict[str, Column]) -> Column:
    """The six consistency rules of placement, pairing bits, quality and sequence length."""
    flag = r["flag"]
    unplaced = r["ref_id"].isNull() | (F.coalesce(r["pos"], F.lit(-1).cast("bigint")) == -1)
    mate_unplaced = r["mate_ref_id"].isNull() | (F.coalesce(r["mate_pos"], F.lit(-1).cast("bigint")) == -1)
    n = seq_length(r["seq"])
    q = F.greatest(F.coalesce(F.size(r["qual"]), F.lit(0)), F.lit(0))
    bad = (
        (unplaced & lacks(flag, Flag.UNMAPPED))
        | (has(flag, Flag.PAIRED) & mate_unplaced & lacks(flag, Flag.MATE_UNMAPPED))
        | has(flag, Flag.UNMAPPED | Flag.PROPER_PAIR)
        | has(flag, Flag.PAIRED | Flag.MATE_UNMAPPED | Flag.PROPER_PAIR)
        | ((q != 0) & (q != n))
        | ((n != 0) & (C.read_length(r["cigar"]) != n))
    )
    return ~bad


def first_tag(aux: Column, tag: str) -> Column:
    """The first aux element with the tag, as a struct; null if there is none."""
    if len(tag) != 2:
        raise ValueError("a tag has two characters")
    return F.get(F.filter(aux, lambda a: a["tag"] == tag), F.lit(0))
