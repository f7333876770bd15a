"""Outputs: one Parquet file (or folder) per rule name, the rejected lines, atomic publication."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .settings import ZSTD, write_options


def strict(df: DataFrame) -> DataFrame:
    """df with every column declared NOT NULL, so that Parquet columns are required."""
    # converted rows hold no nulls; the default only tells Catalyst so
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), _zero(f.dataType)).alias(f.name) for f in df.schema])


def _zero(t: T.DataType):
    return F.timestamp_micros(F.lit(0)) if isinstance(t, T.TimestampType) else F.lit("" if isinstance(t, T.StringType) else 0).cast(t)


def publish(temporary: str, target: str) -> None:
    """Move a finished file into place; readers see the old or the new one, never a part."""
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    os.chmod(temporary, 0o644)
    os.replace(temporary, target)


def _single(df: DataFrame, target: str, write) -> None:
    folder = os.path.dirname(os.path.abspath(target))
    os.makedirs(folder, exist_ok=True)
    work = tempfile.mkdtemp(dir=folder, prefix=".")
    try:
        write(f"{work}/out")
        parts = sorted(p for p in os.listdir(f"{work}/out") if p.startswith("part-"))
        publish(f"{work}/out/{parts[0]}", target)
    finally:
        shutil.rmtree(work, ignore_errors=True)


def write_parquet(df: DataFrame, target: str, codec: str = "zstd", level: int | None = None, max_rows: int | None = None, single: bool = True) -> None:
    """One file at target (or a folder of files), in the order of df."""
    df.sparkSession.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    if codec == "brotli" or (level is not None and codec == "lz4"):
        _by_arrow(df, target, codec, level, max_rows)
        return
    options = write_options(codec, level, max_rows)
    if not single:
        df.write.mode("overwrite").options(**options).parquet(target)
        return
    _single(df, target, lambda out: df.coalesce(1).write.options(**options).parquet(out))


def _by_arrow(df: DataFrame, target: str, codec: str, level: int | None, max_rows: int | None) -> None:
    """Codecs that Spark does not bundle; rows stream to the driver partition by partition."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC")}
    schema = pa.schema([pa.field(n, types[t], False) for n, t in df.dtypes])
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(target)), prefix=".")
    os.close(fd)
    try:
        with pq.ParquetWriter(temporary, schema, compression=codec, compression_level=level if level is None or codec != "zstd" else ZSTD[level]) as w:
            rows = []
            limit = max_rows or 100_000
            for r in df.toLocalIterator(prefetchPartitions=True):
                rows.append(r.asDict())
                if len(rows) == limit:
                    w.write_table(pa.Table.from_pylist(rows, schema), row_group_size=limit)
                    rows = []
            if rows:
                w.write_table(pa.Table.from_pylist(rows, schema), row_group_size=limit)
        publish(temporary, target)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_outputs(parsed, out: str, codec: str = "zstd", level: int | None = None, max_rows: int | None = None, ordered: bool = True, single: bool = True) -> dict[str, int]:
    """One output per rule name that has rows, and unmatched.txt; rows written per name.

    Every output is attempted; the failures are raised together at the end.
    """
    found = parsed.ordered() if ordered else parsed
    found.lines.persist()
    written, failures = {}, []
    try:
        names = [r.name for r in parsed.rules.rules]
        per = {r["rule"]: r["count"] for r in found.lines.groupBy("rule").count().collect()}
        for name in found.names:
            n = sum(c for k, c in per.items() if k is not None and names[k] == name)
            if not n:
                continue
            try:
                write_parquet(strict(found.table(name)), os.path.join(out, f"{name}.parquet"), codec, level, max_rows, single)
                written[name] = n
            except Exception as e:  # noqa: BLE001
                failures.append(f"{name}: {e}")
        if per.get(None):
            bad = found.unmatched.select(F.concat_ws("\t", "source", F.col("line_no").cast("string"), "text").alias("value"))
            try:
                target = os.path.join(out, "unmatched.txt")
                if single:
                    _single(bad, target, lambda p: bad.coalesce(1).write.text(p))
                else:
                    bad.write.mode("overwrite").text(target)
                written[""] = per[None]
            except Exception as e:  # noqa: BLE001
                failures.append(f"unmatched: {e}")
    finally:
        found.lines.unpersist()
    if failures:
        raise OSError("; ".join(failures))
    return written
