"""Percentiles per group: exact by distributed multi-select, and within a stated error from mergeable summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import cut

#: A target with at most so many different values left is finished by one sort of them.
FINISH_VALUES = 2048
#: Targets (groups times percentiles) up to which their state is broadcast; beyond it the join is left to the planner.
BROADCAST_TARGETS = 50_000
#: The data are written anew when the ranges that are left hold less than one part in so many of them.
SHRINK = 4
#: Relative error of the logarithmic summaries.
RELATIVE_ERROR = 0.01


def combine_values(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, cnt: the exact summary. Summaries of partitions, files or days are combined by adding cnt. Null values are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("cnt"))


def merge_summaries(summaries: DataFrame, group: list[str]) -> DataFrame:
    return summaries.groupBy(*group, "value").agg(F.sum("cnt").alias("cnt"))


def _local_medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One proposal a target and partition: the weighted median of the medians of its batches. Holds one batch and a number a batch and target."""
    seen: list[pd.DataFrame] = []

    def median(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["gid", "i", "v"], kind="stable")
        g, i, c = x["gid"].to_numpy(), x["i"].to_numpy(), x["w"].to_numpy()
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
        run = np.cumsum(c)
        base = np.r_[0, run][first]
        total = np.add.reduceat(c, first)
        at = np.searchsorted(run, base + (total + 1) // 2)
        return pd.DataFrame({"gid": g[first], "i": i[first], "v": x["v"].to_numpy()[at], "w": total})

    for pdf in batches:
        if len(pdf):
            seen.append(median(pdf))
            if len(seen) > 64:
                seen = [median(pd.concat(seen))]
    if seen:
        yield median(pd.concat(seen))


def exact_percentiles(summary: DataFrame, group: list[str], quantiles: list[float], finish: int = FINISH_VALUES) -> DataFrame:
    """group, q, value, n: the smallest value with at least ceil(q n) of the group's n values at or below it. Rank error 0.

    summary: group, value (of any numeric type, which is kept; NaN is the largest number), cnt BIGINT as of combine_values; rows of one value may repeat,
    null values count nothing. Multi-select: partitions propose local medians, their weighted median is a target's pivot, values are counted below, at and
    above it, the ranges that cannot hold the target are discarded, until each is found or at most `finish` rows of it are left. Null groups form a group;
    an empty summary gives an empty result. The state is a row a group and percentile: up to BROADCAST_TARGETS they are kept by the driver, beyond it
    they are a table.
    """
    spark = summary.sparkSession
    kind = summary.schema["value"].dataType.simpleString()
    base = cut(summary.where("value IS NOT NULL").select(F.struct(*group).alias("g"), F.col("value").alias("v"), F.col("cnt").cast("bigint").alias("w")))
    # the numbers of groups are fixed by being written
    groups = cut(base.groupBy("g").agg(F.sum("w").alias("n"), F.count("*").alias("left")).withColumn("gid", F.monotonically_increasing_id()))
    small = groups.limit(BROADCAST_TARGETS // len(quantiles) + 1).count() <= BROADCAST_TARGETS // len(quantiles)
    near = F.broadcast if small else (lambda df: df)
    hold = (lambda df: spark.createDataFrame(df.collect(), df.schema)) if small else cut
    data = base.join(near(groups.select(F.col("g").alias("g2"), "gid")), F.col("g").eqNullSafe(F.col("g2"))).select("gid", "v", "w")
    size = groups.agg(F.sum("left").alias("s")).head()["s"] or 0
    levels = F.posexplode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("i", "q")
    bound = F.lit(None).cast(kind)
    targets = hold(
        groups.select("gid", "n", "left", levels).select(
            "gid", "i", "q", F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 6))).cast("bigint").alias("k"), "left", bound.alias("lo"), bound.alias("hi"), bound.alias("found")
        )
    )
    target = ["gid", "i"]

    def ranged(rows: DataFrame, state: DataFrame) -> DataFrame:
        """Rows of a group with every target of it in whose open range (lo, hi) they lie."""
        inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
        return rows.join(near(state), "gid").where(inside)

    for _ in range(200):
        busy = targets.where(F.col("found").isNull() & (F.col("left") > finish))
        if busy.isEmpty():
            break
        ranges = busy.select(*target, "lo", "hi")
        proposals = ranged(data, ranges).select(*target, "v", "w").mapInPandas(_local_medians, f"gid BIGINT, i INT, v {kind}, w BIGINT")
        by = Window.partitionBy(*target)
        pivots = hold(
            ranges.join(
                proposals.withColumn("run", F.sum("w").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                .withColumn("all", F.sum("w").over(by)).where("run * 2 >= all").groupBy(*target).agg(F.min("v").alias("p")), target
            )
        )
        below, above = F.col("v") < F.col("p"), F.col("v") > F.col("p")
        weight = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
        counts = ranged(data, pivots).groupBy(*target, "p").agg(weight(below).alias("below"), weight(~below & ~above).alias("at"), F.count_if(below).alias("nb"), F.count_if(above).alias("na"))
        idle, low = F.col("p").isNull(), F.col("k") <= F.col("below")
        hit = ~low & (F.col("k") <= F.col("below") + F.col("at"))
        targets = hold(
            targets.join(near(counts), target, "left").select(
                *target, "q", F.when(idle | low | hit, F.col("k")).otherwise(F.col("k") - F.col("below") - F.col("at")).alias("k"),
                F.when(idle, F.col("left")).when(low, F.col("nb")).otherwise(F.col("na")).alias("left"), F.when(idle | low | hit, F.col("lo")).otherwise(F.col("p")).alias("lo"),
                F.when(~idle & low, F.col("p")).otherwise(F.col("hi")).alias("hi"), F.when(~idle & hit, F.col("p")).otherwise(F.col("found")).alias("found"),
            )
        )
        still = targets.where("found IS NULL")
        rest = still.agg(F.sum("left").alias("s")).head()["s"] or 0
        if rest * SHRINK <= size:  # what is discarded is left behind once it is most of the data
            kept = still.groupBy("gid").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
            inside = F.exists("r", lambda x: (x["lo"].isNull() | (F.col("v") > x["lo"])) & (x["hi"].isNull() | (F.col("v") < x["hi"])))
            data, size = cut(data.join(near(kept), "gid").where(inside).select("gid", "v", "w")), rest
    merged = ranged(data, targets.where("found IS NULL").select(*target, "lo", "hi", "k")).groupBy(*target, "k", "v").agg(F.sum("w").alias("w"))
    rank = Window.partitionBy(*target).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = merged.withColumn("run", F.sum("w").over(rank)).where("run >= k").groupBy(*target).agg(F.min("v").alias("last"))
    out = targets.join(near(last), target, "left").join(near(groups.select("gid", "g", "n")), "gid")
    return out.select(*[F.col(f"g.{c}").alias(c) for c in group], "q", F.coalesce("found", "last").alias("value"), "n")


def log_bucket(value: Column, error: float = RELATIVE_ERROR) -> Column:
    """Signed logarithmic bucket: every value of a bucket is within the relative error of its middle. Zero has a bucket of its own."""
    gamma = math.log((1 + error) / (1 - error))
    size = F.floor(F.log(F.abs(value.cast("double"))) / F.lit(gamma)).cast("int") + 1_000_000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def bucket_value(bucket: Column, error: float = RELATIVE_ERROR) -> Column:
    gamma = (1 + error) / (1 - error)
    middle = F.exp((F.abs(bucket) - 1_000_000) * F.lit(math.log(gamma))) * F.lit(2 * gamma / (1 + gamma))
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, middle).otherwise(-middle)


def log_summary(df: DataFrame, group: list[str], value: str, error: float = RELATIVE_ERROR) -> DataFrame:
    """group, bucket, cnt: a summary of bounded size (some thousand buckets whatever the range) that is combined by adding cnt."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, log_bucket(F.col(value), error).alias("bucket")).agg(F.count("*").alias("cnt"))


def summary_percentiles(summary: DataFrame, group: list[str], quantiles: list[float], error: float = RELATIVE_ERROR) -> DataFrame:
    """group, q, value, n from combined log summaries: value is within the relative error of the exact nearest-rank percentile."""
    s = summary.groupBy(*group, "bucket").agg(F.sum("cnt").alias("cnt"))
    w = Window.partitionBy(*group)
    run = s.withColumn("run", F.sum("cnt").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("cnt").over(w))
    x = run.select("*", F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("q")).where(F.col("run") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 6))))
    return x.groupBy(*group, "q").agg(F.min("bucket").alias("b"), F.first("n").alias("n")).select(*group, "q", bucket_value(F.col("b"), error).alias("value"), "n")
