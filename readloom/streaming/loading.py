"""Loading and counting as streams. The loading operators are stateless projections, so the batch code serves unchanged."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readloom.operators.rejects import load_records
from readloom.sources.files import scratch


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """Stream over the files of a table, be it one file or a folder."""
    r = spark.readStream.schema(schema)
    path = f"{sf_dir}/{name}.parquet"
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if os.path.isfile(path) else r.parquet(path)


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they arrive, header and blank lines left out."""
    return spark.readStream.text(folder).where(~F.col("value").startswith("@") & (F.col("value") != ""))


def stream_records(lines: DataFrame, line_id: str, line: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) streams."""
    return load_records(lines, line_id, line)


def windowed_counts(df: DataFrame, time: str, width: str, keys: list[str], delay: str) -> DataFrame:
    """Rows per time window and keys; a window is final once the watermark, `delay` behind the latest time, has passed its end. Later rows are dropped."""
    return df.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def first_deliveries(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys were not delivered within the delay before; state is dropped with the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there now and return the result as a table in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark, "out"), scratch(spark, "state")
    if mode == "complete":
        q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    q.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
