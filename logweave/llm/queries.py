"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import bpe, quality, toxicity
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .html_extract import extract
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .packing import best_fit_packing
from .pii import digest as pii_digest

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    def run(batches):
        codec = bpe.load(tokenizer)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

                def tokens(text=text, ids_hash=ids_hash):
                    nonlocal n
                    for ids in codec.encode_stream(text or ""):
                        if ids:
                            ids_hash.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                            n += len(ids)
                            yield ids

                for part in codec.decode_stream(tokens()):
                    text_hash.update(part.encode())
                rows.append((doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
}

SQL = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(s) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY s)""",
    "op9_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents),
        k AS (
          SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        hot AS (
          SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT k.doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE hot.last IS NOT NULL AND k.doc_id <> hot.last) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.last IS NULL OR k.doc_id = hot.last), '')) AS kept_sha256
        FROM k LEFT JOIN hot USING (key) GROUP BY k.doc_id""",
}
