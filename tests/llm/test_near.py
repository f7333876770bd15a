"""MinHash near-dedup: passages in unlike documents, repeated doc_ids, defined results."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.llm import near_dedup
from test_operators import brute_near, prose

SCHEMA = "doc_id bigint, text string"


def words(rng, k):
    return [f"w{rng.randrange(10**9)}" for _ in range(k)]


def result(spark, rows, width=4):
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA), width, 80).collect()
    assert len(got) == len(rows)
    return got


def passage_rows(rng, n, shares):
    """Documents of one passage and words of their own; some are near copies of others."""
    passage, rows = words(rng, 120), []
    for i in range(n):
        own = words(rng, int(120 * (q := rng.choice(shares)) / (1 - q)))
        rows.append((i, " ".join(passage + own)))
        if i % 10 == 0:
            v = passage + own
            v[rng.randrange(len(v))] = "changed"
            rows.append((10**6 + i, " ".join(v)))
    return rows


@pytest.mark.parametrize("outside", [10, 2048])
def test_documents_of_one_passage_equal_brute_force(spark, monkeypatch, outside):
    monkeypatch.setattr(near_dedup, "OUTSIDE", outside)
    rng = random.Random(8)
    rows = passage_rows(rng, 260, [0.05, 0.1, 0.11, 0.12, 0.15, 0.25, 0.4, 0.6])
    want = brute_near(rows, 4)
    for r in result(spark, rows):
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r


def test_pairs_grow_with_the_members_of_a_passage(spark, monkeypatch):
    """One passage in unlike documents: pairs and blocks stay in proportion to the documents."""
    per = []
    for n in (300, 1200):
        work = []
        estimated, blocks = near_dedup._estimated, near_dedup._in_blocks
        with monkeypatch.context() as m:
            m.setattr(near_dedup, "_estimated", lambda p, *a: work.append(p.count()) or estimated(p, *a))
            m.setattr(near_dedup, "OUTSIDE", 100)
            m.setattr(near_dedup, "_in_blocks", lambda h, *a: work.append(h.count()) or blocks(h, *a))
            got = result(spark, passage_rows(random.Random(9), n, [0.4, 0.5, 0.6]))
        assert sum(not r["kept"] for r in got) == n // 10
        per.append(sum(work) / n)
    assert per[1] <= 1.3 * per[0], per


def test_repeated_ids_keep_all_their_texts(spark):
    rng = random.Random(10)
    a, b, c = prose(rng, 120), prose(rng, 120), prose(rng, 120)
    near = lambda t: t + " tail"
    rows = [(4, a), (4, b), (9, near(a)), (3, near(b)), (7, c), (7, c), (2, near(c)), (5, None), (5, ""), (None, a), (None, None), (6, prose(rng, 50)), (6, prose(rng, 50)), (8, "one"), (8, None)]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in result(spark, rows))
    want = [("4", 3, False)] * 2 + [("9", 3, False), ("3", 3, True)] + [("7", 2, False)] * 2 + [("2", 2, True)] + [("5", 5, True)] * 2 + [("None", None, True)] * 2 + [("6", 6, True)] * 2 + [("8", 8, True)] * 2
    assert got == sorted(want)


@pytest.mark.parametrize("column", ["__gone", "id", "comp", "fp"])
def test_clashing_names_pass_through(spark, column):
    rng = random.Random(11)
    t = prose(rng, 60)
    df = spark.createDataFrame([(1, t), (2, t), (3, None), (None, t)], SCHEMA).withColumn(column, F.col("doc_id") * 7)
    got = sorted((str(r["doc_id"]), r["text"], r[column]) for r in near_dedup.keep_first(df).collect())
    assert got == [("1", t, 7), ("3", None, 21), ("None", t, None)]
    assert near_dedup.keep_first(df.limit(0)).count() == 0 and near_dedup.keep_first(df).columns == df.columns
