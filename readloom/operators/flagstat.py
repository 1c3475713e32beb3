"""Flag summaries and per-reference statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.records import Flag, has, is_mapped, is_placed, lacks

#: Counters by name; fixed bits.
_BITS = {
    "secondary": Flag.SECONDARY, "supplementary": Flag.SUPPLEMENTARY, "duplicates": Flag.DUPLICATE, "paired": Flag.PAIRED, "read1": Flag.READ1, "read2": Flag.READ2,
    "proper_pair_bit": Flag.PROPER_PAIR, "unmapped": Flag.UNMAPPED, "mate_unmapped": Flag.MATE_UNMAPPED, "reverse": Flag.REVERSE, "mate_reverse": Flag.MATE_REVERSE, "qc_fail": Flag.QC_FAIL,
}


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("N/A")).otherwise(F.format_string("%.2f%%", part * 100.0 / whole))


def flagstat(df: DataFrame) -> DataFrame:
    """One row per quality-control outcome that occurs (qc_failed false, true): a single pass, one partial and one final aggregate.

    `total` counts the paired bit and `mapped` is paired less unmapped, as the published tool prints them; `rows` counts records."""
    flag, mate = F.col("flag"), F.col("mate_ref_id")
    other = F.col("ref_id").isNotNull() & mate.isNotNull() & (F.col("ref_id") != mate)
    both = lacks(flag, Flag.UNMAPPED | Flag.MATE_UNMAPPED)
    counts = df.groupBy(has(flag, Flag.QC_FAIL).alias("qc_failed")).agg(
        F.count("*").alias("rows"),
        *[F.count_if(has(flag, bit)).alias(name) for name, bit in _BITS.items()],
        F.count_if(has(flag, Flag.PROPER_PAIR) & lacks(flag, Flag.UNMAPPED)).alias("properly_paired"),
        F.count_if(both).alias("both_mapped"),
        F.count_if(has(flag, Flag.MATE_UNMAPPED) & lacks(flag, Flag.UNMAPPED)).alias("singletons"),
        F.count_if(both & other).alias("mate_other_ref"),
        F.count_if(both & other & (F.coalesce(F.col("mapq"), F.lit(0)) > 4)).alias("mate_other_ref_mapq5"),
    )
    mapped = F.col("paired") - F.col("unmapped")
    return counts.select(
        "*",
        F.col("paired").alias("total"),
        mapped.alias("mapped"),
        _percent(mapped, F.col("paired")).alias("mapped_pct"),
        _percent(F.col("properly_paired"), F.col("paired")).alias("properly_paired_pct"),
        _percent(F.col("singletons"), F.col("paired")).alias("singletons_pct"),
    )


def reference_stats(df: DataFrame, source: str = "_src_id") -> DataFrame:
    """source, ref_id, begin_voff, end_voff, mapped, unmapped of the placed records of each reference."""
    return (
        df.where(is_placed(F.col("ref_id"), F.col("pos")))
        .groupBy(source, "ref_id")
        .agg(
            F.min("_voff_begin").alias("begin_voff"),
            F.max("_voff_end").alias("end_voff"),
            F.count_if(is_mapped(F.col("flag"))).alias("mapped"),
            F.count_if(~is_mapped(F.col("flag"))).alias("unmapped"),
        )
    )


def unplaced_count(df: DataFrame, source: str = "_src_id") -> DataFrame:
    return df.where(~is_placed(F.col("ref_id"), F.col("pos"))).groupBy(source).agg(F.count("*").alias("unplaced"))


def flagstat_all(df: DataFrame) -> DataFrame:
    """As flagstat, with totals of all records: `total` counts records and `mapped` those not unmapped, each with its share of them."""
    s = flagstat(df).drop("total", "mapped", "mapped_pct")
    mapped = F.col("rows") - F.col("unmapped")
    return s.select("*", F.col("rows").alias("total"), mapped.alias("mapped"), _percent(mapped, F.col("rows")).alias("mapped_pct"))
