"""Emission order: an order-preserving merge of many inputs as one window and one sort.

The merge takes, at every step, the smallest head by (time, input). A row therefore leaves once the
largest time that its input has shown so far is reached, so the order of leaving is that of
the running maximum, then input, then place; rows without a time carry their predecessor's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_carried(df: DataFrame, time: Column, by: str = "file_index", seq: str = "line_no", name: str = "carried") -> DataFrame:
    w = Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.max(time).over(w))


def emission_order(df: DataFrame, time: Column, by: str = "file_index", seq: str = "line_no") -> DataFrame:
    return with_carried(df, time, by, seq).orderBy(F.col("carried").asc_nulls_first(), by, seq).drop("carried")
