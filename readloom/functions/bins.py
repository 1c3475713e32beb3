"""Hierarchical interval bins, 8 children a node: fixed-depth (16 kb leaves, 29 bits) and of any leaf shift and depth; virtual offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_SHIFT, DEPTH = 14, 5
BIN_LIMIT, STATS_BIN = 37449, 37450  # fixed values of the index format
MAX_POS = (1 << 29) - 2


def level_offset(level: int) -> int:
    return ((1 << (3 * level)) - 1) // 7


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def bin_for(beg: Column | int, end: Column | int, min_shift: int = TILE_SHIFT, depth: int = DEPTH) -> Column:
    """Smallest bin that holds [beg, end). end is lowered by one first, so an empty interval is judged by beg-1 and beg."""
    b, e = _long(beg), _long(end) - 1
    out = F
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        bs, es = F.shiftright(b, shift), F.shiftright(e, shift)
        out = out.when(bs == es, bs + level_offset(level))
    return out.otherwise(_long(0))


def overlapping_bins(beg: Column | int, end: Column | int, min_shift: int = TILE_SHIFT, depth: int = DEPTH) -> Column:
    """ARRAY<BIGINT> of every bin that may hold an interval meeting [beg, end)."""
    b, e = _long(beg), _long(end) - 1
    levels = [F.array(_long(0))]
    for level in range(1, depth + 1):
        shift, off = min_shift + 3 * (depth - level), level_offset(level)
        lo, hi = F.shiftright(b, shift) + off, F.shiftright(e, shift) + off
        levels.append(F.when(hi >= lo, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)")))
    return F.flatten(F.array(*levels))


def is_valid_index_pos(pos: Column) -> Column:
    return pos.between(-1, MAX_POS)


def csi_max_pos(min_shift: int, depth: int) -> int:
    return (1 << (min_shift + 3 * depth)) - 2


def minimum_shift_for(max_pos: int, depth: int) -> int:
    """Smallest leaf shift under 32 with which depth levels hold max_pos."""
    return next((s for s in range(32) if max_pos <= csi_max_pos(s, depth)), -1)


def minimum_depth_for(max_pos: int, min_shift: int) -> int:
    return next((d for d in range(32) if max_pos <= csi_max_pos(min_shift, d)), -1)


def minimum_shift_col(max_pos: Column, depth: int) -> Column:
    """minimum_shift_for of a column, -1 if none."""
    return reduce(lambda rest, s: F.when(max_pos <= F.lit(csi_max_pos(s, depth)), F.lit(s)).otherwise(rest), [s for s in range(31, -1, -1) if s + 3 * depth < 62], F.lit(-1))


def minimum_depth_col(max_pos: Column, min_shift: int) -> Column:
    return reduce(lambda rest, d: F.when(max_pos <= F.lit(csi_max_pos(min_shift, d)), F.lit(d)).otherwise(rest), [d for d in range(31, -1, -1) if min_shift + 3 * d < 62], F.lit(-1))


def voffset(file_offset: Column, block_offset: Column) -> Column:
    return F.shiftleft(_long(file_offset), 16).bitwiseOR(_long(block_offset))


def voffset_file(v: Column) -> Column:
    return F.shiftright(_long(v), 16)


def voffset_block(v: Column) -> Column:
    return _long(v).bitwiseAND(_long(0xFFFF))


#: Children of a node of tiles, and levels: node n of a level stands for the 8 ** level tiles from n * 8 ** level on.
NODE_BITS = 3


def tile_nodes(first: Column, last: Column, levels: int = DEPTH + 1) -> Column:
    """ARRAY<STRUCT<level, node>>: the fewest whole nodes that make up the tiles first to last; at most 14 a level, whatever the number of tiles. Empty if
    last < first. The highest level takes what is left, so that it is the longest array."""
    b, e = _long(first), _long(last) + 1
    lo, hi = ([F.shiftright(b + ((1 << NODE_BITS * i) - 1), NODE_BITS * i) for i in range(levels)], [F.shiftright(e, NODE_BITS * i) for i in range(levels)])

    def run(level: int, start: Column, stop: Column) -> Column:
        nodes = F.transform(F.sequence(start, F.greatest(start, stop - 1)), lambda i: F.struct(F.lit(level).alias("level"), i.alias("node")))
        return F.when(start < stop, nodes).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<level: INT, node: BIGINT>>)"))

    out = [run(levels - 1, lo[-1], hi[-1])]
    for i in range(levels - 1):
        up_lo, up_hi = F.shiftleft(lo[i + 1], NODE_BITS), F.shiftleft(hi[i + 1], NODE_BITS)
        above = up_lo < up_hi
        out += [run(i, lo[i], F.when(above, up_lo).otherwise(hi[i])), run(i, F.when(above, up_hi).otherwise(hi[i]), hi[i])]
    return F.concat(*out)
