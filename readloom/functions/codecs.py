"""Variable-length integers of the columnar container format, decoded and encoded as native expressions, and in Python for the readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(b: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("bigint")


def itf8_decode(b: Column) -> Column:
    """INT of the 1-5 leading bytes; the count of leading ones of the first byte says how many follow."""
    x = [_byte(b, i) for i in range(5)]
    low = lambda v, n: v.bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
    sh = F.shiftleft
    u = (
        F.when(x[0] < 0x80, x[0])
        .when(x[0] < 0xC0, sh(low(x[0], 6), 8).bitwiseOR(x[1]))
        .when(x[0] < 0xE0, sh(low(x[0], 5), 16).bitwiseOR(sh(x[1], 8)).bitwiseOR(x[2]))
        .when(x[0] < 0xF0, sh(low(x[0], 4), 24).bitwiseOR(sh(x[1], 16)).bitwiseOR(sh(x[2], 8)).bitwiseOR(x[3]))
        .otherwise(sh(low(x[0], 4), 28).bitwiseOR(sh(x[1], 20)).bitwiseOR(sh(x[2], 12)).bitwiseOR(sh(x[3], 4)).bitwiseOR(low(x[4], 4)))
    )
    return F.when(u >= 1 << 31, u - (1 << 32)).otherwise(u).cast("int")


def _hex(v: Column, width: int) -> Column:
    return F.lpad(F.hex(v), width, "0")


def itf8_encode(v: Column) -> Column:
    u = v.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    five = F.concat(_hex(F.shiftrightunsigned(u, 28).bitwiseOR(F.lit(0xF0).cast("bigint")), 2), _hex(F.shiftrightunsigned(u, 4).bitwiseAND(F.lit(0xFFFFFF).cast("bigint")), 6), _hex(u.bitwiseAND(F.lit(0xF).cast("bigint")), 2))
    text = (
        F.when(u < 1 << 7, _hex(u, 2)).when(u < 1 << 14, _hex(u.bitwiseOR(F.lit(0x8000).cast("bigint")), 4)).when(u < 1 << 21, _hex(u.bitwiseOR(F.lit(0xC00000).cast("bigint")), 6))
        .when(u < 1 << 28, _hex(u.bitwiseOR(F.lit(0xE0000000).cast("bigint")), 8)).otherwise(five)
    )
    return F.unhex(text)


def ltf8_encode(v: Column) -> Column:
    """1-9 bytes of a BIGINT: n leading ones in the first byte announce n more bytes."""
    out = F
    for n in range(8):
        bits = 7 * (n + 1)
        mark = ((1 << n) - 1) << (8 - n)
        out = out.when((v >= 0) & (v < F.lit(1 << bits)), F.concat(_hex(F.shiftrightunsigned(v, 8 * n).bitwiseOR(F.lit(mark).cast("bigint")), 2), _hex(v.bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("bigint")), 2 * n) if n else F.lit("")))
    return F.unhex(out.otherwise(F.concat(F.lit("FF"), _hex(v, 16))))


def ltf8_decode(b: Column) -> Column:
    first = _byte(b, 0)
    out = F
    for n in range(8):
        top = 0x100 - (1 << (7 - n))
        value = first.bitwiseAND(F.lit((1 << (7 - n)) - 1).cast("bigint"))
        for i in range(1, n + 1):
            value = F.shiftleft(value, 8).bitwiseOR(_byte(b, i))
        out = out.when(first < top, value)
    value = F.lit(0).cast("bigint")
    for i in range(1, 9):
        value = F.shiftleft(value, 8).bitwiseOR(_byte(b, i))
    return out.otherwise(value)


def read_itf8(buf: bytes, at: int) -> tuple[int, int]:
    """(value, next offset)."""
    b = buf[at]
    more = 0 if b < 0x80 else 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
    if at + more >= len(buf):
        raise ValueError("truncated integer")
    if more == 4:
        u = (b & 0xF) << 28 | buf[at + 1] << 20 | buf[at + 2] << 12 | buf[at + 3] << 4 | buf[at + 4] & 0xF
    else:
        u = int.from_bytes(bytes([b & (0x7F >> more)]) + buf[at + 1 : at + 1 + more], "big")
    return u - (1 << 32) if u >> 31 else u, at + more + 1


def read_ltf8(buf: bytes, at: int) -> tuple[int, int]:
    b, more = buf[at], 0
    while more < 8 and b & (0x80 >> more):
        more += 1
    if at + more >= len(buf):
        raise ValueError("truncated integer")
    head = b & (0x7F >> more) if more < 8 else 0
    u = int.from_bytes(bytes([head]) + buf[at + 1 : at + 1 + more], "big")
    return u - (1 << 64) if u >> 63 else u, at + more + 1


def write_itf8(v: int) -> bytes:
    u = v & 0xFFFFFFFF
    more = next((n for n in range(4) if u < 1 << 7 * (n + 1)), 4)
    if more == 4:
        return bytes([0xF0 | u >> 28, u >> 20 & 0xFF, u >> 12 & 0xFF, u >> 4 & 0xFF, u & 0xF])
    return (u | (0xFF << (8 - more) & 0xFF) << 8 * more).to_bytes(more + 1, "big")


def write_ltf8(v: int) -> bytes:
    u = v & (1 << 64) - 1
    more = next((n for n in range(8) if u < 1 << 7 * (n + 1)), 8)
    return bytes([0xFF]) + u.to_bytes(8, "big") if more == 8 else (u | (0xFF << (8 - more) & 0xFF) << 8 * more).to_bytes(more + 1, "big")
