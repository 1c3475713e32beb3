"""Per-key results when a few keys hold most rows.

Heavy keys are found with a frequent-items sketch of the key hashes (one pass, partial sketches merged). Their rows never go through a hash exchange by
key: they are joined with a broadcast of the few heavy keys' rows and combined on the map side. All other keys take the ordinary shuffle. The
union is exact whatever the sketch says, since it only decides the route.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch may name, the counters it keeps, and the share of all rows from which a key is heavy.
TOP_KEYS, COUNTERS, HEAVY_SHARE = 64, 4096, 0.01
#: Rows of the other side that heavy keys may have for the broadcast; beyond it they are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
SALTS = 32


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_hashes(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> list[int]:
    """Hashes of the keys that may hold the share of all rows; at most TOP_KEYS numbers come to the driver."""
    row = df.select(key_hash(keys).alias("h")).agg(F.expr(f"approx_top_k(h, {TOP_KEYS}, {COUNTERS})").alias("top"), F.count("*").alias("n")).head()
    return [x["item"] for x in row["top"] or [] if x["count"] >= max(2, share * row["n"])]


def _is_heavy(keys: list[str], heavy: list[int]) -> Column:
    return key_hash(keys).isin(heavy) if heavy else F.lit(False)


#: Aggregates without a partial form: a group's values all meet in one task.
_WHOLE = re.compile(r"collect_list|collect_set|array_agg|listagg|string_agg|percentile\(|median|mode\(|DISTINCT", re.I)


def aggregate_per_key(df: DataFrame, keys: list[str], *aggs: Column, merge: list[Column] | None = None) -> DataFrame:
    """groupBy(keys).agg(aggs), exact, without a task that waits for the heaviest key. Null keys form a group. An empty df gives an empty result.

    The aggregates must have a partial form (count, sum, min, max and the like), so that a heavy key reaches its last task as a row a task. Others (sketches
    with costly buffers, lists) need merge: heavy keys are then aggregated by key and SALTS salts, and merge, columns over the names of aggs, combines
    the salts' results. Without merge they are refused."""
    if merge is None and (bad := next((str(c) for c in aggs if _WHOLE.search(str(c))), None)):
        raise ValueError(f"no partial form, give merge: {bad}")
    spark = df.sparkSession
    heavy = heavy_hashes(df, keys)
    if not heavy:
        return df.groupBy(*keys).agg(*aggs)
    marks = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "__h BIGINT"))  # at most TOP_KEYS rows
    hashed = df.withColumn("__h", key_hash(keys))
    hot = hashed.join(marks, "__h", "left_semi")
    if merge is None:
        hot = hot.groupBy(*keys).agg(*aggs)
    else:
        hot = hot.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).groupBy(*keys, "__salt").agg(*aggs).groupBy(*keys).agg(*merge)
    rest = hashed.join(marks, "__h", "left_anti").groupBy(*keys).agg(*aggs)
    return hot.unionByName(rest)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left joined with right (inner or left), where left's keys may be skewed. Key types must agree. Null keys match nothing.

    Heavy keys of left meet a broadcast of right's rows of those keys, whose number is counted first; if it is over BROADCAST_ROWS they are salted."""
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    heavy = heavy_hashes(left.where(F.coalesce(*[F.col(k).cast("string") for k in on]).isNotNull()), on)
    if not heavy:
        return left.join(right, on, how)
    is_heavy = _is_heavy(on, heavy)
    few = right.where(is_heavy)
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = left.where(is_heavy).join(F.broadcast(few), on, how)
    else:
        salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot = left.where(is_heavy).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")
    return hot.unionByName(left.where(~is_heavy).join(right.where(~is_heavy), on, how))


def dominant_keys(counts: DataFrame, owner: str, key: str, weight: str, percent: int) -> DataFrame:
    """Keys that hold at least percent of their owner's positive weight. counts: one row an (owner, key). The null key counts in the sum only."""
    totals = counts.groupBy(F.col(owner).alias("__o")).agg(F.sum(weight).alias("__total"))
    return (
        counts.join(totals, F.col(owner).eqNullSafe(F.col("__o")))
        .where((F.col(weight) > 0) & (F.col(weight) * 100 >= F.col("__total") * percent) & F.col(key).isNotNull())
        .select(owner, key)
    )
