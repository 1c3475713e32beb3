"""Optional fields of a record: text, typed struct and binary sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUX_TYPE = (
    "STRUCT<tag: STRING, type: STRING, subtype: STRING, sval: STRING, ival: BIGINT, fval: FLOAT, iarr: ARRAY<BIGINT>, farr: ARRAY<FLOAT>, bval: BINARY>"
)
INTEGER_TYPES = ("c", "C", "s", "S", "i", "I")  # fixed


def smallest_type(value: Column) -> Column:
    """Type letter of the smallest integer that holds value: unsigned if not negative, else signed. Null if none does."""
    return (
        F.when(value.between(0, 255), "C").when(value.between(0, 65535), "S").when(value.between(0, (1 << 32) - 1), "I")
        .when(value.between(-128, -1), "c").when(value.between(-32768, -1), "s").when(value.between(-(1 << 31), -1), "i")
    )


def kind(type_: Column) -> Column:
    """All integer types are `i` in text."""
    return F.when(type_.isin(*INTEGER_TYPES), F.lit("i")).otherwise(type_)


def parse_aux(text: Column) -> Column:
    """TAG:TYPE:VALUE to the typed struct. The text must be valid (see rejects); an empty value is kept for Z and H."""
    t, value = F.substring(text, 4, 1), text.substr(F.lit(6), F.length(text))
    number = value.try_cast("bigint")
    items = F.split(value.substr(F.lit(3), F.length(value)), ",", -1)
    sub = F.substring(value, 1, 1)
    return F.struct(
        F.substring(text, 1, 2).alias("tag"),
        F.when(t == "i", smallest_type(number)).otherwise(t).alias("type"),
        F.when(t == "B", sub).alias("subtype"),
        F.when(t.isin("A", "Z"), value).alias("sval"),
        F.when(t == "i", number).alias("ival"),
        F.when(t == "f", value.try_cast("float")).alias("fval"),
        F.when((t == "B") & (sub != "f"), F.transform(items, lambda x: x.try_cast("bigint"))).alias("iarr"),
        F.when((t == "B") & (sub == "f"), F.transform(items, lambda x: x.try_cast("float"))).alias("farr"),
        F.when(t == "H", F.unhex(value)).alias("bval"),
    )


def new_int_aux(tag: str, value: Column) -> Column:
    """An integer field of the smallest type; null outside -2^31..2^32-1."""
    t = smallest_type(value.cast("bigint"))
    return F.when(t.isNotNull(), F.struct(F.lit(tag).alias("tag"), t.alias("type"), value.cast("bigint").alias("ival")))


_RANGES = {"c": (-(1 << 7), (1 << 7) - 1), "C": (0, (1 << 8) - 1), "s": (-(1 << 15), (1 << 15) - 1), "S": (0, (1 << 16) - 1), "i": (-(1 << 31), (1 << 31) - 1), "I": (0, (1 << 32) - 1)}  # fixed


def new_aux(tag: str, type_: str, value: Column, subtype: str | None = None) -> Column:
    """A field of any type: A (one character), c C s S i I (whole numbers), f, Z (text), H (binary), B (an array, with its subtype). Null where the value is null or
    not of the type. Type `int` takes the smallest signed, `uint` the smallest unsigned integer type that holds the value."""
    kinds = {"int": "csi", "uint": "CSI"}.get(type_, type_)
    parts = {"sval": "STRING", "ival": "BIGINT", "fval": "FLOAT", "iarr": "ARRAY<BIGINT>", "farr": "ARRAY<FLOAT>", "bval": "BINARY"}
    letter, ok = F.lit(type_), value.isNotNull()
    if kinds[0] in _RANGES:
        number = value.cast("bigint")
        part, letter = "ival", F.lit(None).cast("string")
        for k in reversed(kinds):
            letter = F.when(number.between(*_RANGES[k]), F.lit(k)).otherwise(letter)
        ok, value = letter.isNotNull(), number
    elif type_ in ("A", "Z"):
        part = "sval"
        ok = value.rlike(r"\A[!-~]\z" if type_ == "A" else r"\A[ -~]*\z")
    elif type_ == "f":
        part = "fval"
    elif type_ == "H":
        part = "bval"
    elif type_ == "B" and subtype == "f":
        part = "farr"
        ok = F.size(value) > 0
    elif type_ == "B" and subtype in _RANGES:
        part = "iarr"
        ok = (F.size(value) > 0) & F.forall(value, lambda x: F.coalesce(x.between(*_RANGES[subtype]), F.lit(False)))
    else:
        raise ValueError(f"no such type: {type_}{subtype or ''}")
    fields = [(value if k == part else F.lit(None)).cast(t).alias(k) for k, t in parts.items()]
    return F.when(ok, F.struct(F.lit(tag).alias("tag"), letter.alias("type"), F.lit(subtype).cast("string").alias("subtype"), *fields))


def aux_value_text(a: Column) -> Column:
    return (
        F.when(a["type"].isin(*INTEGER_TYPES), a["ival"].cast("string"))
        .when(a["type"] == "f", a["fval"].cast("string"))
        .when(a["type"] == "H", F.hex(a["bval"]))
        .when((a["type"] == "B") & (a["subtype"] == "f"), F.concat(F.lit("f"), F.array_join(F.transform(a["farr"], lambda x: F.concat(F.lit(","), x.cast("string"))), "")))
        .when(a["type"] == "B", F.concat(a["subtype"], F.array_join(F.transform(a["iarr"], lambda x: F.concat(F.lit(","), x.cast("string"))), "")))
        .otherwise(a["sval"])
    )


def format_aux(a: Column) -> Column:
    return F.concat(a["tag"], F.lit(":"), kind(a["type"]), F.lit(":"), F.coalesce(aux_value_text(a), F.lit("")))
