"""Coordinate indexes as tables: build, range lookup, chunk merging.

An index is three flat tables: bins (source, ref_id, bin, chunk_begin, chunk_end), linear tiles (source, ref_id, tile, voff) and statistics. Works for any
interval table with the columns source, ref, beg, end, voff_begin, voff_end, whose names are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import bins as B

Strategy = Callable[[DataFrame, list[str]], DataFrame]


#: Bits of a virtual offset below a shard border (16 MB of compressed file).
SHARD_BITS = 40


def _runs(df: DataFrame, keys: list[str], opens: Callable[[Column, Column], Column], sums: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("chunk_begin", "chunk_end")
    run = df.withColumn("__r", F.max("chunk_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    run = run.withColumn("__i", F.sum((F.col("__r").isNull() | opens(F.col("__r"), F.col("chunk_begin"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(*keys, "__i").agg(F.min("chunk_begin").alias("chunk_begin"), F.max("chunk_end").alias("chunk_end"), *[F.sum(c).alias(c) for c in sums]).drop("__i")


def _islands(df: DataFrame, keys: list[str], opens: Callable[[Column, Column], Column], sums: list[str]) -> DataFrame:
    """Chunks joined by running maximum of their ends. First within stretches of the file, then across them, so that a hot key is not one task's rows."""
    local = _runs(df.withColumn("__s", F.shiftright("chunk_begin", SHARD_BITS)), [*keys, "__s"], opens, sums).drop("__s")
    return _runs(local, keys, opens, sums)


def identity(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.select(*keys, "chunk_begin", "chunk_end")


def adjacent(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Joins chunks that touch or overlap."""
    return _islands(chunks.select(*keys, "chunk_begin", "chunk_end").distinct(), keys, lambda end, begin: end < begin, [])


def squash(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.min("chunk_begin").alias("chunk_begin"), F.max("chunk_end").alias("chunk_end"))


def compressor(near: int) -> Strategy:
    """Joins chunks whose compressed offsets lie within near bytes."""

    def merge(chunks: DataFrame, keys: list[str]) -> DataFrame:
        return _islands(chunks.select(*keys, "chunk_begin", "chunk_end").distinct(), keys, lambda end, begin: B.voffset_file(end) + near < B.voffset_file(begin), [])

    return merge


def build_bins(records: DataFrame, keys: list[str], beg: Column, end: Column, min_shift: int = B.TILE_SHIFT, depth: int = B.DEPTH) -> DataFrame:
    """keys, bin, chunk_begin, chunk_end, and per bin left_voff and records. A record joins the chunk before it in its bin unless that ends at or before the
    record's own beginning. records: placed records with _voff_begin and _voff_end."""
    r = records.select(*keys, B.bin_for(beg, end, min_shift, depth).alias("bin"), F.col("_voff_begin").alias("chunk_begin"), F.col("_voff_end").alias("chunk_end"))
    r = r.groupBy(*keys, "bin", "chunk_begin", "chunk_end").agg(F.count("*").alias("n"))
    chunks = _islands(r, [*keys, "bin"], lambda end, begin: end <= begin, ["n"])
    w = Window.partitionBy(*keys, "bin")
    return chunks.select(*keys, "bin", "chunk_begin", "chunk_end", F.min("chunk_begin").over(w).alias("left_voff"), F.sum("n").over(w).alias("records"))


#: Tiles that the fixed-depth index has; no record has one beyond.
TILES = (B.MAX_POS >> B.TILE_SHIFT) + 1


def build_linear(records: DataFrame, keys: list[str], beg: Column, end: Column) -> DataFrame:
    """keys, tile, voff: the least offset of a record that overlaps the 16 kb tile.

    Positions beyond the index (over 2^29 - 2) have no tile. A record is cut at blocks of 512 tiles, of which the index has 64; stretches of tiles are opened
    once their offsets are combined. So a record has 64 rows at most, however long it is, and a short one has one."""
    first, last = F.shiftright(beg.cast("bigint"), B.TILE_SHIFT), F.shiftright(F.greatest(beg.cast("bigint"), end.cast("bigint") - 1), B.TILE_SHIFT)
    ends = records.select(*keys, first.alias("__a"), F.least(last, F.lit(TILES - 1)).alias("__b"), "_voff_begin").where("__a <= __b")
    block = ends.select("*", F.explode(F.expr("sequence(__a div 512, __b div 512)")).alias("__k"))
    runs = block.groupBy(*keys, F.expr("greatest(__a, __k * 512)").alias("__a"), F.expr("least(__b, __k * 512 + 511)").alias("__b")).agg(F.min("_voff_begin").alias("voff"))
    return runs.select(*keys, F.explode(F.sequence("__a", "__b")).alias("tile"), "voff").groupBy(*keys, "tile").agg(F.min("voff").alias("voff"))


def first_offsets(regions: DataFrame, linear: DataFrame, keys: list[str]) -> DataFrame:
    """region_id, floor: the least offset of the tiles that a region meets; no row for a region without tiles. An equi-join on (keys, node): tiles are
    combined into nodes of 8, 64 and more, and a region asks for the few nodes that make up its tiles. The join exchanges both sides, see lookup."""
    t0, t1 = F.shiftright(F.greatest(F.col("beg"), F.lit(0)), B.TILE_SHIFT), F.shiftright(F.least(F.col("end") - 1, F.lit(B.MAX_POS)), B.TILE_SHIFT)
    asked = regions.where("end > beg").select("region_id", *keys, F.explode(B.tile_nodes(t0, t1)).alias("x")).select("region_id", *keys, "x.level", "x.node")
    levels = F.explode(F.sequence(F.lit(0), F.lit(B.DEPTH))).alias("level")
    known = linear.select(*keys, "tile", "voff", levels).groupBy(*keys, "level", F.expr("shiftright(CAST(tile AS BIGINT), 3 * level)").alias("node")).agg(F.min("voff").alias("voff"))
    return asked.hint("merge").join(known, [*keys, "level", "node"]).groupBy("region_id").agg(F.min("voff").alias("floor"))


def lookup(
    regions: DataFrame, bins: DataFrame, linear: DataFrame | None, keys: list[str], merge: Strategy = adjacent, min_shift: int = B.TILE_SHIFT, depth: int = B.DEPTH, strict: bool = False,
) -> DataFrame:
    """region_id, keys, chunk_begin, chunk_end: the chunks that may hold records meeting each region (a superset), merged by the strategy.

    regions: region_id, keys, beg, end. With linear tiles a chunk must end after the least offset of the tiles that the region meets; without, after the
    bin's left offset. Regions without chunks, past the index or on unknown keys have no row; with strict the latter two raise when computed. The joins are
    equi-joins on (keys, bin) and (keys, node). Both exchange their sides: the planner takes opened regions for as large as the regions were, and would
    broadcast through the driver what has hundreds of rows a region."""
    if strict:
        known = bins.select(*keys).distinct().withColumn("__known", F.lit(True))
        checked = regions.join(known, keys, "left")
        problem = F.when(F.col("__known").isNull(), "unknown reference: ").when(F.col("beg") >= F.lit(1 << (min_shift + 3 * depth)), "region past the index: ")
        failure = F.raise_error(F.concat(problem, F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("bigint")
        regions = checked.withColumn("beg", F.when(problem.isNull(), F.col("beg").cast("bigint")).otherwise(failure)).drop("__known")
    wanted = regions.where("end > beg").select("region_id", *keys, F.col("beg"), F.explode(B.overlapping_bins(F.col("beg"), F.col("end"), min_shift, depth)).alias("bin"))
    hit = wanted.hint("merge").join(bins.select(*keys, "bin", "chunk_begin", "chunk_end", "left_voff"), [*keys, "bin"])
    if linear is None:
        hit = hit.where("chunk_end > left_voff")
    else:
        hit = hit.join(first_offsets(regions, linear, keys), "region_id").where("chunk_end > floor")
    return merge(hit, ["region_id", *keys])


#: Tiles of an interval up to which both sides are cut into them; with longer intervals about, they are laid out by nodes.
FEW_TILES = 64


def interval_join(left: DataFrame, right: DataFrame, on: list[str], width: int | None = None) -> DataFrame:
    """Pairs of left [beg, end) and right [rbeg, rend) that overlap and agree on the keys. left: on, beg, end; right: on, rbeg, rend; other names must differ.

    Without width an equi-join with a range condition, best while a key has few rows. With width both sides are cut into tiles of it and joined on (keys, tile),
    so a hot key is spread; a pair is kept by the tile in which the later beginning lies, so it comes out once. In pairs with an interval of more than
    FEW_TILES tiles, each is laid out as the few nodes of tiles that make it up, and meets the other's beginnings by (keys, node): a pair overlaps if one
    begins within the other. Rows and arrays then grow with the logarithm of a length only. Empty intervals and null ends meet nothing."""
    meets = (F.col("beg") < F.col("rend")) & (F.col("rbeg") < F.col("end"))
    if width is None:
        return left.join(right, on).where(meets)
    tile_sql = lambda c: f"(({c} - pmod({c}, {width}L)) div {width}L)"
    tile = lambda c: F.expr(tile_sql(c))
    a, b = left.where("end > beg"), right.where("rend > rbeg")
    spans = [(tile(f"({e} - 1)") - tile(x)) for x, e in (("beg", "end"), ("rbeg", "rend"))]
    most = max(df.agg(F.max(n).alias("n")).head()["n"] or 0 for df, n in zip((a, b), spans, strict=True))
    columns = [*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on]]
    tiles = lambda x, e: F.explode(F.sequence(tile(x), tile(f"({e} - 1)")))
    short_a, short_b = a.where(spans[0] < FEW_TILES), b.where(spans[1] < FEW_TILES)
    short = short_a.withColumn("__tile", tiles("beg", "end")).join(short_b.withColumn("__tile", tiles("rbeg", "rend")), [*on, "__tile"])
    short = short.where(meets & (F.col("__tile") == tile("greatest(beg, rbeg)"))).select(*columns)
    if most < FEW_TILES:
        return short
    levels = 1 + len(range(0, most.bit_length(), B.NODE_BITS))

    def holding(outer: DataFrame, x: str, e: str, inner: DataFrame, at: str) -> DataFrame:
        """Pairs whose inner interval begins at a tile of the outer one."""
        nodes = outer.withColumn("__n", F.explode(B.tile_nodes(tile(x), tile(f"({e} - 1)"), levels)))
        above = inner.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("__node", F.expr(f"shiftright({tile_sql(at)}, {B.NODE_BITS} * __level)"))
        keyed = nodes.withColumn("__level", F.col("__n.level")).withColumn("__node", F.col("__n.node")).drop("__n")
        return keyed.join(above, [*on, "__level", "__node"]).drop("__level", "__node")

    def by_node(x: DataFrame, y: DataFrame) -> DataFrame:
        one = holding(y, "rbeg", "rend", x, "beg").where(meets & (F.col("beg") >= F.col("rbeg"))).select(*columns)
        return one.unionByName(holding(x, "beg", "end", y, "rbeg").where(meets & (F.col("beg") < F.col("rbeg"))).select(*columns))

    return short.unionByName(by_node(a.where(spans[0] >= FEW_TILES), b)).unionByName(by_node(short_a, b.where(spans[1] >= FEW_TILES)))
