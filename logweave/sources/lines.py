"""Log files as rows (file_index, source, line_no, text), one partition per file.

A file is decoded by its extension. A file that cannot be opened or read gives one row with
`error` set after the lines that could be read, so the other files go on.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_index int, source string, line_no bigint, text string, error string"


def _zstd(path: str):
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True)


OPENERS = {".gz": gzip.open, ".xz": lzma.open, ".bz2": bz2.open, ".zst": _zstd}


def open_decoded(path: str):
    """Bytes of a file, decompressed as its extension says."""
    return OPENERS.get(os.path.splitext(path.lower())[1], open)(path, "rb") if not path.lower().endswith(".zst") else _zstd(path)


def numbered(stream, max_line_bytes: int = 0):
    """(number, text) of each line: split at newlines, one carriage return before it dropped."""
    n = 0
    for raw in io.BufferedReader(stream) if not isinstance(stream, io.BufferedIOBase) else stream:
        n += 1
        line = raw[:-1] if raw.endswith(b"\n") else raw
        line = line[:-1] if line.endswith(b"\r") else line
        if max_line_bytes and len(line) >= max_line_bytes:
            raise ValueError(f"line {n} is longer than {max_line_bytes} bytes")
        yield n, line.decode("utf-8", "replace")


class _File(InputPartition):
    def __init__(self, index: int, path: str):
        self.index, self.path = index, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split("\n")
        self.limit = int(options.get("max_line_bytes", 0))

    def partitions(self):
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, part):
        try:
            with open_decoded(part.path) as f:
                for n, text in numbered(f, self.limit):
                    yield part.index, part.path, n, text, None
        except Exception as e:  # noqa: BLE001  any failure of one file is that file's own
            yield part.index, part.path, None, None, f"{type(e).__name__}: {e}"


class LogLines(DataSource):
    @classmethod
    def name(cls):
        return "loglines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_lines(spark: SparkSession, paths: list[str], max_line_bytes: int = 0) -> DataFrame:
    """Lines of files; "-" (once) is standard input, read on the driver."""
    if paths.count("-") > 1:
        raise ValueError("standard input can be named once")
    spark.dataSource.register(LogLines)
    files = [p for p in paths if p != "-"]
    out = None
    if files:
        out = spark.read.format("loglines").options(paths="\n".join(files), max_line_bytes=max_line_bytes).load()
        place = [i for i, p in enumerate(paths) if p != "-"]
        if place != list(range(len(files))):
            out = out.withColumn("file_index", F.element_at(F.array(*map(F.lit, place)), F.col("file_index") + 1))
    if "-" in paths:
        at = paths.index("-")
        rows = [(at, "-", n, text, None) for n, text in numbered(sys.stdin.buffer, max_line_bytes)]
        mine = spark.createDataFrame(rows, SCHEMA)
        out = mine if out is None else out.unionByName(mine)
    return out


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out over the session's cores if its files make fewer partitions than that; a scan
    of many partitions, as any large one is, stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
