"""Column functions: everything here is a Catalyst expression, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added behind a generator, across which the optimizer neither copies their definitions nor moves filters into them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
