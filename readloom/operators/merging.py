"""Ordering, merging and de-duplication of record tables. Order is carried by columns (_src_id, _src_ord), never by partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import cut

TIES = ["_src_id", "_src_ord"]


def name_order() -> list[Column]:
    return [F.col("qname").asc_nulls_first()]


def coordinate_order(by: str = "rname") -> list[Column]:
    """Reference name (byte-wise, chr10 before chr2) or dictionary order (by="ref_id"), then position; unplaced last."""
    unplaced = F.col("ref_id").isNull() | (F.coalesce(F.col("pos"), F.lit(-1).cast("bigint")) == -1)
    return [unplaced.asc(), F.col(by).asc(), F.col("pos").asc()]


def sort_records(df: DataFrame, order: list[Column], ties: list[str] | None = None) -> DataFrame:
    """Global sort: a range exchange and sorted runs that spill."""
    return df.orderBy(*order, *[F.col(c) for c in ties or TIES])


def number_rows(ordered: DataFrame, out: str = "ord") -> DataFrame:
    """0-based place of every row of a globally ordered df. Its ranges are written once; only their row counts meet in one place, so no task sees all rows."""
    sorted_ = cut(ordered).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i"))
    sizes = sorted_.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return sorted_.join(F.broadcast(offsets), "__p").withColumn(out, F.col("__i") + F.col("__o")).drop("__p", "__i", "__o")


def with_ordinals(df: DataFrame, order: list[Column], out: str = "ord") -> DataFrame:
    """df with the 0-based place of every row in the global order."""
    return number_rows(sort_records(df, order), out)


def reassign_references(df: DataFrame, links: DataFrame) -> DataFrame:
    """ref_id and mate_ref_id replaced through links (_src_id, old_id, new_id); an id without link becomes null."""
    one = links.select("_src_id", F.col("old_id").alias("ref_id"), F.col("new_id").alias("__r"))
    two = links.select("_src_id", F.col("old_id").alias("mate_ref_id"), F.col("new_id").alias("__m"))
    out = df.join(one, ["_src_id", "ref_id"], "left").join(two, ["_src_id", "mate_ref_id"], "left")
    return out.withColumn("ref_id", F.col("__r")).withColumn("mate_ref_id", F.col("__m")).select(*df.columns)


def merge_sources(sources: list[DataFrame], order: str = "coordinate", keys: list[Column] | None = None, orders: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Records of several sources in one order: `coordinate`, `queryname`, `unsorted` (concatenation) or `unknown` with sort keys of the caller.

    orders: the sort order each source states; they must agree. Ties go to the lower source, then to its own order (the columns of ties)."""
    if orders and len(set(orders)) > 1:
        raise ValueError(f"sources differ in sort order: {sorted(set(orders))}")
    everything = reduce(lambda a, b: a.unionByName(b), sources)
    if order == "coordinate":
        return sort_records(everything, coordinate_order(), ties)
    if order == "queryname":
        return sort_records(everything, name_order(), ties)
    return sort_records(everything, keys or [], ties)


def drop_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the first by source and order."""
    first = F.min_by(F.struct(*df.columns), F.struct(*TIES)).alias("__x")
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(first).select("__x.*")


#: Records of one source that one task holds against each other.
RUN = 1 << 16


def order_violations(df: DataFrame) -> DataFrame:
    """(_src_id, _src_ord, ref_id, pos) of placed records that come after one of a higher (ref_id, pos): an index cannot be built over them.

    Two levels: within runs of RUN places of a source, and between the runs by the highest of all runs before, so a large source is not one task's work."""
    placed = df.where("ref_id IS NOT NULL AND pos >= 0").select("_src_id", "_src_ord", "ref_id", "pos", F.struct("ref_id", "pos").alias("__at"), F.expr(f"_src_ord div {RUN}").alias("__run"))
    runs = placed.groupBy("_src_id", "__run").agg(F.max("__at").alias("__top"))
    before = Window.partitionBy("_src_id").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_src_id", "__run", F.max("__top").over(before).alias("__above"))
    inside = Window.partitionBy("_src_id", "__run").orderBy("_src_ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("__seen", F.max("__at").over(inside)).join(runs, ["_src_id", "__run"])
    return seen.where(F.greatest("__seen", "__above") > F.col("__at")).select("_src_id", "_src_ord", "ref_id", "pos")
