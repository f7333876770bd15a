"""Exact deduplication against a minimal-perfect-hash index of historical digests.

History: the distinct digests seen so far are cut into shards by their leading bytes. A shard
is one row: the pilots of a minimal perfect hash, the full 32-byte digest of every slot, and
per slot the winner's locator (largest doc_id) and the number of rows. A lookup computes the
slot and compares all 32 bytes, so a nonmember can never be taken for a member. Members are
folded into their slot; nonmembers are grouped among themselves.

Defined results: null text counts as empty; repeated rows of one doc_id count as rows, each
returned; ties keep the largest doc_id; rows with a null doc_id never win against another, and
where a text has no other rows its keep_id is null and one of them is kept; an empty table
gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mph
from .common import ascii_lower, materialize

#: Digests of one index shard; bounds the memory of a lookup task.
SHARD_KEYS = 2048
#: The winner of rows that all have no doc_id.
NOBODY = -(2**63)
_INDEX = "shard long, pilots binary, digests binary, winners binary, counts binary"
_WINNERS = "digest binary, keep_id long, n long"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row): SHA-256 of the text with A-Z lower-cased; row numbers rows without a doc_id."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"))


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _shard(n_shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(n_shards))


def _array(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, blobs)), dtype=np.uint8).reshape(-1, 32)


def build_index(distinct: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard from distinct (digest, keep_id, n)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = _array(pdf["digest"])
        pilots = mph.build(d)
        at = mph.slots(pilots, len(d), d)
        slot_digests = np.empty_like(d)
        slot_digests[at] = d
        win, cnt = np.empty(len(d), "<i8"), np.empty(len(d), "<i8")
        win[at] = pdf["keep_id"].fillna(NOBODY).to_numpy("int64")
        cnt[at] = pdf["n"].to_numpy("int64")
        return pd.DataFrame(
            {"shard": [int(pdf["shard"].iloc[0])], "pilots": [pilots.tobytes()], "digests": [slot_digests.tobytes()], "winners": [win.tobytes()], "counts": [cnt.tobytes()]}
        )

    return distinct.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(one, _INDEX)


def lookup(incoming: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """Fold distinct incoming (digest, keep_id, n) into the index: (digest, keep_id, n) of every
    digest of either side."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right) == 0:
            return left[["digest", "keep_id", "n"]]
        r = right.iloc[0]
        pilots = np.frombuffer(r["pilots"], np.uint32)
        known = np.frombuffer(r["digests"], np.uint8).reshape(-1, 32)
        win, cnt = np.frombuffer(r["winners"], "<i8").copy(), np.frombuffer(r["counts"], "<i8").copy()
        fresh = left.iloc[:0]
        if len(left):
            d = _array(left["digest"])
            at = mph.slots(pilots, len(known), d)
            member = (known[at] == d).all(axis=1)
            ids = left["keep_id"].fillna(NOBODY).to_numpy("int64")
            win[at[member]] = np.maximum(win[at[member]], ids[member])
            cnt[at[member]] += left["n"].to_numpy("int64")[member]
            fresh = left[~member]
        old = pd.DataFrame({"digest": [x.tobytes() for x in known], "keep_id": win, "n": cnt})
        return pd.concat([old, fresh[["digest", "keep_id", "n"]]], ignore_index=True)

    a = incoming.withColumn("shard", _shard(n_shards)).groupBy("shard")
    return a.cogroup(index.groupBy("shard")).applyInPandas(one, _WINNERS)


def exact_dedup(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    The rows up to the middle of the doc_id range are the history that the index is built
    from; the later arrivals are looked up in it.
    """
    rows = materialize(digests(docs), "digests")
    stats = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = (stats[0] + stats[1]) // 2 if stats[0] is not None else 0
    n_shards = max(1, math.ceil(stats[2] / shard_keys))
    past = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    index = materialize(build_index(_distinct(rows.where(past)), n_shards), "mph-index")
    groups = lookup(_distinct(rows.where(~past)), index, n_shards)
    # only repeated digests need a join; every other row keeps itself
    repeats = materialize(groups.where("n > 1"), "repeats")
    j = rows.join(repeats.withColumn("keep_id", F.when(F.col("keep_id") != NOBODY, F.col("keep_id"))), "digest", "left")
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    # of rows without an id the first one stays, if no row has one
    nobody = rows.where("doc_id is null").groupBy("digest").agg(F.min("row").alias("first"))
    nobody = materialize(nobody.withColumnRenamed("digest", "d"), "nobody")
    j = j.join(nobody, (F.col("digest") == F.col("d")) & F.col("doc_id").isNull(), "left")
    stays = F.when(keep.isNull(), F.col("row") == F.col("first")).otherwise(F.coalesce(F.col("doc_id") == keep, F.lit(False)))
    return j.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
