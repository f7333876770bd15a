"""Best-fit packing of token sequences: minimum bin slack over a length histogram.

Only lengths matter for packing, and there are at most `capacity` different ones, so the plan is
made on the driver from a histogram whose size never depends on the data. A bin starts with the
longest length left; a bitset subset-sum dynamic program over the lengths still available
(longest first) finds the fullest feasible filling for the rest. The filling is then removed as
often as its lengths last, so each step uses up a length and the plan has few patterns.

Pieces are matched with the plan by their rank among pieces of their length. Ranks come from
windows over (length, bucket) plus the bucket's offset (prefix sums over blocks of buckets), with as many buckets as the row count asks
for, so a length that holds any share of the rows is never gathered in one task.

Defined results: null text counts as empty, an empty text is one piece (its closing id); repeated
rows are packed as often as they occur; an empty table gives an empty result; other input columns
are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize

CAPACITY = 1024
#: Rows that one ranking window is meant to hold.
RANK_ROWS = 2_000
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: full ones from the end, so only the first may be shorter."""
    head = n % capacity or min(n, capacity)
    bounds = [0, *range(head, n + 1, capacity)]
    return list(zip(bounds, bounds[1:]))


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode = bpe.fast_encoder(tokenizer)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (a, b) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"piece": "int32"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) from counts whose sum is the largest that is at most room; among
    equal sums, long lengths are preferred."""
    lengths = sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for x in lengths:
        left, size = min(counts[x], room // x), 1
        while left > 0 and not reach >> room & 1:
            take = min(size, left)
            steps.append((reach, x, take))
            reach |= reach << (x * take) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: list[int] = []
    for before, x, take in reversed(steps):
        if not before >> at & 1:
            out += [x] * take
            at -= x * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many bins, their lengths) covering the histogram exactly."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        filling = [top, *fullest(left, capacity - top)]
        left[top] += 1
        need = {x: filling.count(x) for x in set(filling)}
        times = min(left[x] // c for x, c in need.items())
        out.append((times, filling))
        for x, c in need.items():
            left[x] -= c * times
            if not left[x]:
                del left[x]
    return out


def _intervals(bins: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """For every length the runs of ranks that a pattern takes; sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, filling in bins:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            c = filling.count(x)
            rows.append((x, used.get(x, 0), c, base, offset))
            used[x] = used.get(x, 0) + c * times
            offset += c * x
        base += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("length", "first", "each", "base", "offset"))}


def ranked(pieces: DataFrame, rank_rows: int = RANK_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """pieces with a gapless rank (from 0) per length, and the length histogram."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    n_buckets = max(1, math.ceil(sum(histogram.values()) / rank_rows))
    # the bucket depends on the row's content only: a task that runs again gives the same ranks
    b = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    sizes = b.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # prefix sums in two levels, so that the buckets of a frequent length are not one task either
    side = max(1, math.isqrt(n_buckets))
    sizes = materialize(sizes.withColumn("block", F.floor(F.col("bucket") / side).cast("int")), "bucket-sizes")
    blocks = sizes.groupBy("length", "block").agg(F.sum("n").alias("n"))
    earlier = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = blocks.select("length", "block", earlier("block", "length").alias("head"))
    offsets = sizes.withColumn("inner", earlier("bucket", "length", "block")).join(heads, ["length", "block"]).select("length", "bucket", (F.col("head") + F.col("inner")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    out = b.withColumn("rn", within).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("rn") - 1)
    return out.drop("bucket", "rn", "ahead"), histogram


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = materialize(pieces, "pieces")
    ranks, histogram = ranked(pieces, rank_rows)
    # bounded by the capacity alone: at most `capacity` patterns of a few dozen lengths each
    runs = _intervals(plan(histogram, capacity), capacity)
    key = runs["length"] * (1 << 50) + runs["first"]

    def place(batches):
        for pdf in batches:
            length = pdf["length"].to_numpy("int64")
            at = np.searchsorted(key, length * (1 << 50) + pdf["rank"].to_numpy("int64"), side="right") - 1
            k = pdf["rank"].to_numpy("int64") - runs["first"][at]
            each = runs["each"][at]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=runs["base"][at] + k // each, offset=runs["offset"][at] + k % each * length
            )

    return ranks.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(tokenized_pieces(docs, tokenizer, end_id, capacity), capacity)
