"""Line deduplication across documents.

A line's key is the line stripped of blanks at both ends with A-Z lower-cased. Keys are
hashed (128 bits), counted over distinct documents, and a key found in min_docs documents or
more loses all its lines but those of the largest doc_id that holds it. Lines shorter than
min_chars (of the key) always stay. Documents are reassembled in line order.

Defined results: null or empty text is one empty line; repeated rows of one doc_id count as
one document and are cut alike; ties cannot occur (the largest doc_id is unique); an empty
table gives an empty result; rows with a null doc_id are no document that counts, and keep all
their lines; other columns pass through untouched, and where one is called n_lines or n_dropped the
count of that name has underscores before it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, LOWER, UPPER, ascii_lower, materialize, spare

MIN_CHARS = 40
MIN_DOCS = 5
_FOLD = str.maketrans(UPPER, LOWER)


def _key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(_FOLD)


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, doc_id) of the keys to drop from doc_id: frequent, and held by a larger doc_id."""
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split("text", "\n", -1)).alias("line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", _key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    hashed = materialize(keys.select("doc_id", F.unhex(F.md5(F.col("k").cast("binary"))).alias("h")).distinct(), "line-keys")
    hot = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("h", "last")
    # read back, so that both sides of the join are dealt anew and a hot line's rows can be split
    hot = materialize(hot, "frequent-lines")
    return hashed.join(hot, "h").where("doc_id < last").select("h", "doc_id")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """docs with text cut, plus n_lines and n_dropped unless counts is off."""
    drops = frequent_lines(docs, min_chars, min_docs)
    own = docs.columns
    key, dropped = spare(own, "key"), spare(own, "dropped")
    per_doc = drops.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("h").alias(dropped))
    joined = docs.withColumn(key, F.col("doc_id").cast("long")).join(per_doc, key, "left")
    more = [spare(own, "n_lines"), spare(own, "n_dropped")] if counts else []
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in more]])
    at = own.index("text")

    def cut(batches):
        for b in batches:
            texts, drop = b.column(at).to_pylist(), b.column(len(own)).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for t, d in zip(texts, drop):
                lines = (t or "").split("\n")
                n_lines.append(len(lines))
                if d:
                    gone = set(d)
                    stay = [
                        x for x in lines
                        if len(x) < min_chars or len(k := line_key(x)) < min_chars or hashlib.md5(k.encode()).digest() not in gone
                    ]
                    n_dropped.append(len(lines) - len(stay))
                    t = "\n".join(stay)
                else:
                    n_dropped.append(0)
                kept.append(t or "")
            cols = [b.column(i) for i in range(len(own))]
            cols[at] = pa.array(kept, pa.string())
            tail = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if more else []
            yield pa.RecordBatch.from_arrays([*cols, *tail], names=schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in own], F.col(dropped)).mapInArrow(cut, schema)
