"""Rule routing over streams: line-by-line rule sets, and counts per event-time window."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.route import Parsed, route
from ..plans.rules import RuleSet


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder as lines; a stream has no line numbers, so line_no is 0."""
    raw = spark.readStream.format("text").load(folder)
    return raw.select(F.lit(0).alias("file_index"), F.col("_metadata.file_path").alias("source"), F.lit(0).cast("bigint").alias("line_no"), F.col("value").alias("text"))


def route_stream(lines: DataFrame, rules: RuleSet, now: datetime | None = None, tz: str = "UTC") -> Parsed:
    """Stateless routing of a stream; multi-line rules need a batch."""
    if any(r.continuation for r in rules.rules):
        raise ValueError("rules with a continuation need the order of a whole file")
    return Parsed(route(lines, rules, now or datetime.now(timezone.utc), tz), rules)


def windowed_counts(table: DataFrame, time: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Rows per tumbling window; rows later than the watermark are dropped."""
    return table.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n_rows"))
