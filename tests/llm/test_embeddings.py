"""Embedding near-dedup: repeated vec_ids, recall at the table's dimension, growth with the table."""

import numpy as np
import pytest

from logweave.llm import embedding_dedup as E

DIM = 64
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(n, seed, cosine=0.93):
    """n unlike vectors, and for a third of them a partner at exactly that cosine."""
    rng = np.random.default_rng(seed)
    base = unit(rng.standard_normal((n, DIM)))
    k = n // 3
    off = rng.standard_normal((k, DIM))
    off = unit(off - (off * base[:k]).sum(1, keepdims=True) * base[:k])
    return np.concatenate([base, cosine * base[:k] + np.sqrt(1 - cosine**2) * off])


def rows_of(x, label=0):
    return [(i, [float(f) for f in v], label) for i, v in enumerate(x)]


def test_repeated_ids_keep_all_their_vectors(spark):
    rng = np.random.default_rng(1)
    a, b, c = unit(rng.standard_normal((3, DIM)))
    near = lambda v: unit(v + 0.02 * rng.standard_normal(DIM))
    rows = [(5, a, 0), (5, b, 0), (2, near(a), 0), (9, near(b), 0), (7, c, 0), (7, c, 0), (None, c, 0), (8, c, 0), (1, a, 1), (3, None, 0), (4, [0.0] * DIM, 0), (None, None, None)]
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], y) for i, v, y in rows], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_dedup(df).collect()), key=str)
    want = [(5, 1, 2, False), (5, 1, 2, False), (2, 1, 2, True), (9, 1, 2, False), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, True), (8, 1, 7, False), (1, 0, 1, True), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert E.embedding_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [300, 3000, 12000])
def test_recall_at_the_threshold(n):
    x = planted(n, 2, 0.931)
    code = 1 << int(np.ceil(np.log2(E.WORDS_PER_ROOT * np.sqrt(len(x)))))
    f = E.Filters(DIM, code).decode(x)
    met = np.mean([np.intersect1d(f[i], f[n + i]).size > 0 for i in range(n // 3)])
    assert met >= 0.95


def test_links_equal_brute_force_over_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = v.collect()
    x = unit(np.array([r["embedding"] for r in rows], float))
    label = np.array([r["label"] for r in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: r for r in E.embedding_dedup(v, block_rows=(16, 16)).collect()}
    found = np.array([got[r["vec_id"]]["n_links"] for r in rows])
    assert (found <= hit.sum(1)).all() and found.sum() >= 0.98 * hit.sum()


def test_comparisons_grow_with_the_table(spark):
    """At most as n ** 1.2 in all."""
    per = []
    for n in (1500, 6000):
        x = planted(n, 3)
        df = spark.createDataFrame([(i, 0, E_code(len(x)), 1, [float(f) for f in v]) for i, v in enumerate(x)], "cid bigint, space bigint, code int, k bigint, embedding array<float>")
        per.append(E.meetings(df, E.BLOCK_ROWS).count() / len(x))
    assert per[1] <= 4**0.2 * per[0], per


def E_code(n):
    return 1 << int(np.ceil(np.log2(E.WORDS_PER_ROOT * np.sqrt(n))))
