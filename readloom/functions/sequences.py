"""Bases and qualities: 4-bit packing and Phred+33 text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODES = "=ACMGRSVTWYHKDBN"  # fixed: letter of each 4-bit code
_HEX = "0123456789ABCDEF"


def normalise_seq(seq: Column) -> Column:
    """Upper case, digits 0-3 as A C G T, everything that is no code as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "0123", "ACGT"), "[^=ACMGRSVTWYHKDBN]", "N")


def pack_seq(seq: Column) -> Column:
    """Two bases a byte, the first in the high half; an odd length is padded with zero."""
    digits = F.translate(normalise_seq(seq), CODES, _HEX)
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def unpack_seq(packed: Column, length: Column) -> Column:
    return F.translate(F.hex(packed), _HEX, CODES).substr(F.lit(1), length.cast("int"))


def base_at(seq: Column, pos: Column) -> Column:
    """0-based; null outside the sequence."""
    return F.when((pos >= 0) & (pos < F.length(seq)), seq.substr(pos.cast("int") + 1, F.lit(1)))


def decode_qual(text: Column, length: Column) -> Column:
    """Phred+33 text to numbers; `*` with a sequence means 255 for each base."""
    return (
        F.when((text == "*") & (length > 0), F.array_repeat(F.lit(255).cast("smallint"), length.cast("int")))
        .when((text == "*") | (text == ""), F.expr("CAST(array() AS ARRAY<SMALLINT>)"))
        .otherwise(F.transform(F.split(text, ""), lambda c: (F.ascii(c) - 33).cast("smallint")))
    )


def encode_qual(qual: Column) -> Column:
    """Numbers to Phred+33 text; null, empty and all-255 as `*`."""
    missing = qual.isNull() | (F.size(qual) <= 0) | F.forall(qual, lambda q: q == 255)
    return F.when(missing, F.lit("*")).otherwise(F.array_join(F.transform(qual, lambda q: F.char((q + 33).cast("int"))), ""))
