"""Merging of overlapping intervals into continuous periods, with the gaps between them.

Two levels, so that no task ever needs all intervals of one entity:

1. Intervals are clipped at the borders of fixed-width shards (an interval over many shards becomes two fragments, not one a shard) and combined
   per start before the first exchange. Each (entity, shard) then merges its fragments alone. At most `shard_width` different starts exist in a
   shard, so the work of a task is bounded however many rows an entity has.
2. Only the first and the last stretch of each shard go on to the entity level, where coverage that touches or crosses shard borders is stitched
   and coalesced. Inner stretches and gaps of a shard are final, unless a longer interval covers the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions a shard. Bounds the distinct fragment starts that one task holds for one shard.
SHARD_WIDTH = 1 << 16


def _filled(c: Column, t: T.DataType) -> Column:
    """c with a default in place of null, so that the keys compare as plain equality; the null bits are kept beside."""
    if isinstance(t, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.coalesce(c, F.lit("1970-01-01").cast(t))
    return F.coalesce(c, F.lit(0).cast(t))


def merge_intervals(
    df: DataFrame, keys: list[str], beg: str, end: str, shard_width: int = SHARD_WIDTH, out: tuple[str, str, str] = ("kind", "beg_pos", "end_pos")
) -> DataFrame:
    """Periods and gaps per entity: columns keys, kind (`period` or `gap`), begin, end.

    Intervals are half-open whole numbers; touching ones join. Rows with a null begin or end, or with end <= begin, cover nothing. Null keys form
    an entity of their own. Repeated rows change nothing; other columns are ignored, whatever their names; an empty input gives an empty result.
    """
    w = shard_width
    K = [f"__k{i}" for i in range(len(keys))]
    types = [df.schema[k].dataType for k in keys]
    nulls = sum((F.when(df[k].isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0))
    base = df.select(
        *[_filled(df[k], t).alias(n) for k, t, n in zip(keys, types, K, strict=True)], nulls.alias("__nulls"), df[beg].cast("bigint").alias("__b"), df[end].cast("bigint").alias("__e")
    ).where("__e > __b")
    K = [*K, "__nulls"]
    s0, s1 = F.expr(f"(__b - pmod(__b, {w}L)) div {w}L"), F.expr(f"(__e - 1 - pmod(__e - 1, {w}L)) div {w}L")
    piece = lambda s, b, e: F.struct(s.alias("s"), b.alias("b"), e.alias("e"))
    clipped = base.select(
        *K,
        F.explode(
            F.when(s0 == s1, F.array(piece(s0, F.col("__b"), F.col("__e")))).otherwise(F.array(piece(s0, F.col("__b"), s1 * w), piece(s1, s1 * w, F.col("__e"))))
        ).alias("p"),
    ).select(*K, F.col("p.s").alias("__s"), F.col("p.b").alias("__b"), F.col("p.e").alias("__e"))
    starts = clipped.groupBy(*K, "__s", "__b").agg(F.max("__e").alias("__e"))

    shard = Window.partitionBy(*K, "__s")
    before = shard.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    upto = shard.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        starts.withColumn("__r", F.max("__e").over(before))
        .withColumn("__new", (F.col("__r").isNull() | (F.col("__b") > F.col("__r"))).cast("int"))
        .withColumn("__i", F.sum("__new").over(upto))
        .groupBy(*K, "__s", "__i")
        .agg(F.min("__b").alias("__b"), F.max("__e").alias("__e"), F.max(F.when(F.col("__new") == 1, F.col("__r"))).alias("__from"))
        .withColumn("__n", F.max("__i").over(shard))
    )

    edges = local.where("__i = 1 OR __i = __n").select(*K, "__s", "__i", "__b", "__e")
    entity = Window.partitionBy(*K).orderBy("__b")
    stitched = (
        edges.withColumn("__r", F.max("__e").over(entity.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("__new", (F.col("__r").isNull() | (F.col("__b") > F.col("__r"))).cast("int"))
        .withColumn("__run", F.sum("__new").over(entity.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    runs = stitched.groupBy(*K, "__run").agg(
        F.min("__b").alias("__b"), F.max("__e").alias("__e"), F.max(F.when(F.col("__new") == 1, F.col("__r"))).alias("__from"), F.min(F.when(F.col("__new") == 1, F.col("__s"))).alias("__s")
    )
    one = lambda kind, b, e: F.struct(F.lit(kind).alias("kind"), b.alias("b"), e.alias("e"))
    # a gap before a run is the shard's own affair if the run before ended in the same shard
    across = F.col("__from").isNotNull() & (F.expr(f"(__from - 1 - pmod(__from - 1, {w}L)) div {w}L") != F.col("__s"))
    wide = runs.select(
        *K,
        F.explode(
            F.when(across, F.array(one("period", F.col("__b"), F.col("__e")), one("gap", F.col("__from"), F.col("__b")))).otherwise(F.array(one("period", F.col("__b"), F.col("__e"))))
        ).alias("x"),
    )
    covered = stitched.where((F.col("__i") == 1) & (F.col("__r") > F.col("__s") * w)).select(*K, "__s")
    inner = local.where("__i > 1").join(covered, [*K, "__s"], "left_anti")
    narrow = inner.select(
        *K,
        F.explode(
            F.when(F.col("__i") < F.col("__n"), F.array(one("period", F.col("__b"), F.col("__e")), one("gap", F.col("__from"), F.col("__b")))).otherwise(F.array(one("gap", F.col("__from"), F.col("__b"))))
        ).alias("x"),
    )
    back = [F.when(F.col("__nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(n)).cast(t).alias(k) for i, (k, t, n) in enumerate(zip(keys, types, K[:-1], strict=True))]
    return wide.unionByName(narrow).select(*back, F.col("x.kind").alias(out[0]), F.col("x.b").alias(out[1]), F.col("x.e").alias(out[2]))
