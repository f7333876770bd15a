"""Tools on Parquet files: concatenation, dump and restore as JSON Lines, metadata."""

from __future__ import annotations

import json
import os

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.settings import resolve_compression
from ..sources.sinks import _single, strict, write_parquet
from .order import emission_order

NAMES = {T.StringType(): "string", T.LongType(): "int", T.DoubleType(): "float", T.TimestampType(): "timestamp"}


class SchemaError(ValueError):
    pass


def _micros(c: str):
    return F.unix_micros(F.col(c))


def concat(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """UNION ALL in argument order, or merged by the first timestamp column if there is one.

    frames: (name, rows). Rows keep their place through monotonically increasing ids, which
    follow file order within a frame.
    """
    head, first = frames[0]
    for name, df in frames[1:]:
        if len(df.columns) != len(first.columns):
            raise SchemaError(f"{head} and {name} have {len(first.columns)} and {len(df.columns)} columns")
        for a, b in zip(first.schema, df.schema):
            if (a.name, a.dataType) != (b.name, b.dataType):
                raise SchemaError(f"{head} and {name} differ: {a.name} {a.dataType.simpleString()} and {b.name} {b.dataType.simpleString()}")
    time = next((f.name for f in first.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))), None)
    rows = None
    for i, (_, df) in enumerate(frames):
        part = df.select("*", F.lit(i).alias("__file"), F.monotonically_increasing_id().alias("__seq"))
        rows = part if rows is None else rows.union(part)
    if time is None:
        return rows.orderBy("__file", "__seq").select(*first.columns)
    return emission_order(rows, F.col(f"`{time}`"), "__file", "__seq").select(*first.columns)


def source_codec(path: str) -> str:
    """Codec of a file's first column chunk; empty if it has none."""
    meta = pq.ParquetFile(path).metadata
    if not meta.num_row_groups or not meta.num_columns:
        return ""
    name = meta.row_group(0).column(0).compression.lower()
    return {"lz4_raw": "lz4"}.get(name, name)


def concat_parquet(spark: SparkSession, sources: list[str], output: str, compression: dict | None = None, max_rows: int | None = None) -> None:
    if any(os.path.normpath(output) == os.path.normpath(s) for s in sources):
        raise SchemaError("the output is one of the sources")
    codec, level = resolve_compression(compression or {}, None, source_codec(sources[0]))
    write_parquet(strict(concat([(s, spark.read.parquet(s)) for s in sources])), output, codec, level, max_rows)


def escaped(json_text):
    """JSON text with the characters that are unsafe in HTML and scripts escaped."""
    for c in "<>&  ":
        json_text = F.replace(json_text, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return json_text


def dump_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row (value): keys sorted, timestamps as RFC 3339 in UTC."""
    for f in df.schema:
        if f.dataType not in NAMES:
            raise SchemaError(f"column {f.name} has unsupported type {f.dataType.simpleString()}")
    cols = []
    for name in sorted(df.columns):
        c, t = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(t, T.TimestampType):
            seconds = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
            us = F.pmod(_micros(name), F.lit(1_000_000))
            frac = F.when(us == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(us.cast("string"), 6, "0"), "0+$", "")))
            c = F.concat(seconds, frac, F.lit("Z"))
        elif isinstance(t, T.DoubleType):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(bad, F.raise_error(F.lit(f"column {name} holds a number that JSON cannot write")).cast("double")).otherwise(c)
        cols.append(c.alias(name))
    return df.select(escaped(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("value"))


def header(df: DataFrame, codec: str = "") -> str:
    h = {"columns": [{"name": f.name, "type": NAMES[f.dataType]} for f in df.schema]}
    if codec:
        h["compression"] = codec
    return json.dumps(h, separators=(",", ":"), ensure_ascii=False)


def dump(spark: SparkSession, source: str, target: str) -> None:
    """A Parquet file as JSON Lines: a header with the schema and codec, then the rows in order."""
    df = spark.read.parquet(source)
    rows = dump_lines(df)
    first = spark.createDataFrame([(header(df, source_codec(source)),)], "value string")
    both = first.coalesce(1).withColumn("k", F.lit(0).cast("long")).union(rows.withColumn("k", F.monotonically_increasing_id() + 1)).orderBy("k").select("value")
    _single(both, target, lambda p: both.coalesce(1).write.text(p))


def parse_header(line: str) -> tuple[T.StructType, str]:
    h = json.loads(line)
    if not h.get("columns"):
        raise SchemaError("the header names no columns")
    types = {v: k for k, v in NAMES.items()}
    for c in h["columns"]:
        if c["type"] not in types:
            raise SchemaError(f"column {c['name']} has unsupported type {c['type']}")
    return T.StructType([T.StructField(c["name"], types[c["type"]]) for c in h["columns"]]), h.get("compression", "")


def restore_rows(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows of dump lines (value); a bad line or timestamp fails the job."""
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema])
    r = lines.select(F.from_json("value", raw, {"mode": "FAILFAST"}).alias("r"))
    cols = []
    for f in schema:
        c = F.col(f"r.`{f.name}`")
        cols.append((c.cast("timestamp") if isinstance(f.dataType, T.TimestampType) else c).alias(f.name))
    return r.select(*cols)


def restore(spark: SparkSession, source: str, target: str, compression: dict | None = None) -> None:
    with open(source, encoding="utf-8") as f:
        schema, codec = parse_header(f.readline())
    chosen, level = resolve_compression(compression or {}, None, codec)
    lines = spark.read.text(source).withColumn("k", F.monotonically_increasing_id()).where("k > 0").orderBy("k").select("value")
    write_parquet(strict(restore_rows(lines, schema)), target, chosen, level)


_INFO = "path string, size bigint, rows bigint, row_groups bigint, version string, created_by string, column string, type string, codec string, n_values bigint, compressed bigint, uncompressed bigint"


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file, row group and column, read on the executors."""

    def read(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                f = pq.ParquetFile(path)
                m = f.metadata
                for g in range(m.num_row_groups):
                    for c in range(m.num_columns):
                        k = m.row_group(g).column(c)
                        rows.append(
                            (path, os.path.getsize(path), m.num_rows, m.num_row_groups, m.format_version, m.created_by, k.path_in_schema, k.physical_type, k.compression, k.num_values, k.total_compressed_size, k.total_uncompressed_size)
                        )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _INFO.split(", ")])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200))).mapInPandas(read, _INFO)


def column_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sums per file and column, with the compressed share in percent and the ratio."""
    f = footers(spark, paths).groupBy("path", "column").agg(*[F.sum(c).alias(c) for c in ("n_values", "compressed", "uncompressed")])
    return f.withColumn("pct", F.when(F.col("uncompressed") > 0, F.col("compressed") / F.col("uncompressed") * 100)).withColumn(
        "ratio", F.when(F.col("compressed") > 0, F.col("uncompressed") / F.col("compressed"))
    )
