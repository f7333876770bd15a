"""Embedding near-duplicates by spherical-cap filters.

Vectors are compared within a label by cosine. A filter is a direction; a vector belongs to it
when it lies in the cap around it. Filter directions are structured: the space is turned at
random and cut into two blocks, each with its own random code of unit vectors, and a
direction is one code word per block. A vector's score for a direction is then the sum of its
scores for the code words, so all directions beyond the threshold are list-decoded from the
few code words that can reach it instead of being tried one by one. Vectors meet in the filters
they share, and a product of full double-precision cosines inside a filter verifies them.

The filters grow with the table: a label's vectors of one length, n of them, get code words in a number
of about 4 sqrt(n) a block (a power of two), so about 16 n directions a table. A vector's caps
reach down to a share of its best score that rises with the code; it is in about a dozen of
them (their number grows as about n ** 0.12), most of which hold nobody else, and an unlike
vector shares one with it with a probability that falls faster than 1 / n. Tests hold the growth
of the comparisons from n to 4 n, and recall at the table's dimension, against brute force.

1. Equal vectors of a label form a class that meets only once and counts with its size.
2. Ids and filter numbers alone are joined with the filters of two or more members; what is
   left of a class's filters then goes with its vector, once, to the comparisons.
3. Filters of many members are cut into blocks and the blocks compared in pairs, so
   no task holds more than two blocks. A pair counts in the first filter that both share, so links
   are counted, never listed: per comparison only counts and a spanning forest of the links
   leave the task.

Defined results: vectors that are null, zero or hold null or non-finite components link with
nothing, as do rows without a label or a vec_id; they keep themselves. Vectors of different
lengths don't link. Rows of one vec_id are one vertex with all their vectors: each row has the links of its
own vector, and all have one component. A vec_id that repeats with the same vector counts once among the links
of others, with different vectors once for each. Ties keep the smallest vec_id; a null vec_id has
a null component and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, scratch

COSINE = 0.93
TABLES, SEED = 3, 11
#: A vector joins the directions whose score is at least a share of its own best: CAP with 256 code
#: words a block, and CAP_STEP more for each doubling of them, so that a vector's filters hardly grow in number.
CAP, CAP_STEP = 0.945, 0.003
#: Code words of a block: about WORDS_PER_ROOT times the root of the number of vectors, within bounds.
WORDS_PER_ROOT, LEAST_WORDS, MOST_WORDS = 4, 16, 1 << 15
#: Rows of a block: BLOCK_ROOT times the root of a filter's members, within bounds.
BLOCK_ROOT, BLOCK_ROWS = 4, (128, 1024)
#: Scores of a batch that are held at a time.
SCORES = 1 << 20


class Filters:
    """The directions of one dimension and code size; the same on every executor."""

    def __init__(self, dim: int, code: int, tables: int = TABLES):
        rng = np.random.default_rng(SEED)
        self.dim, self.code = dim, code
        self.cap = CAP + CAP_STEP * (np.log2(code) - 8)
        self.cut = dim // 2
        self.turns, self.words = [], []
        for _ in range(tables):
            q, _r = np.linalg.qr(rng.standard_normal((dim, dim)))
            self.turns.append(q)
            # a block of few dimensions has no use for many words
            w = [rng.standard_normal((min(code, 4 ** min(k, 8)), k)) for k in (self.cut, dim - self.cut)]
            self.words.append([x / np.linalg.norm(x, axis=1, keepdims=True) if x.size else x for x in w])

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector."""
        out: list[list[np.ndarray]] = [[] for _ in range(len(unit))]
        step = max(1, SCORES // self.code)
        for t, (turn, (v, w)) in enumerate(zip(self.turns, self.words)):
            for at in range(0, len(unit), step):
                z = unit[at : at + step] @ turn
                a, b = z[:, : self.cut] @ v.T, z[:, self.cut :] @ w.T
                top_a, top_b = a.max(axis=1), b.max(axis=1)
                least = self.cap * (top_a + top_b)
                for i in range(len(z)):
                    # words that reach the threshold with the best word of the other block
                    x, y = np.flatnonzero(a[i] >= least[i] - top_b[i]), np.flatnonzero(b[i] >= least[i] - top_a[i])
                    j, k = np.nonzero(a[i][x][:, None] + b[i][y][None, :] >= least[i])
                    out[at + i].append((t * self.code + x[j]) * self.code + y[k])
        return [np.sort(np.concatenate(o)) if o else np.empty(0, np.int64) for o in out]


def _units(vectors: pa.Array, n: int) -> np.ndarray:
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    # scaled first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, key (identity of the vector within its label; null if it can't link)."""
    e = F.col("embedding")
    if not vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>"):
        e = e.cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e.alias("embedding"))
    fine = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    # -0.0 and 0.0 are one number
    key = F.md5(F.concat(F.col("label").cast("string"), F.lit(":"), F.to_json(F.struct(F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))))).cast("binary"))
    return v.withColumn("key", F.when(fine, F.unhex(key)))


def _code(n):
    """Code words of a block for n vectors: a power of two."""
    words = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(n.cast("double")) * WORDS_PER_ROOT)))
    return F.least(F.greatest(words, F.lit(float(LEAST_WORDS))), F.lit(float(MOST_WORDS))).cast("int")


def filters_of(reps: DataFrame) -> DataFrame:
    """(cid, space, filters (sorted)) of classes (cid, space, code, embedding)."""

    def run(batches):
        made: dict[tuple[int, int], Filters] = {}
        for batch in batches:
            vectors = batch.column("embedding")
            length = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            code = batch.column("code").to_numpy(zero_copy_only=False)
            for dim, c in sorted(set(zip(length.tolist(), code.tolist()))):
                rows = batch.take(pa.array(np.flatnonzero((length == dim) & (code == c))))
                f = made.get((dim, c)) or made.setdefault((dim, c), Filters(dim, c))
                got = f.decode(_units(rows.column("embedding"), len(rows)))
                yield pa.RecordBatch.from_arrays([rows.column("cid"), rows.column("space"), pa.array(got, pa.list_(pa.int64()))], names=["cid", "space", "filters"])

    return reps.select("cid", "space", "code", "embedding").mapInArrow(run, "cid long, space long, filters array<long>")


def shared_filters(hits: DataFrame, block_rows: tuple[int, int]) -> DataFrame:
    """(cid, filters: array of (filter, g)): a class's filters that hold another class too, sorted,
    with the number of blocks of each. Only ids and numbers move here."""
    flat = hits.select("cid", "space", F.explode("filters").alias("filter"))
    held = flat.groupBy("space", "filter").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = F.least(F.greatest(F.sqrt(F.col("m").cast("double")) * BLOCK_ROOT, F.lit(float(block_rows[0]))), F.lit(float(block_rows[1])))
    held = materialize(held.select("space", "filter", F.ceil(F.col("m") / rows).cast("int").alias("g")), "filter-sizes")
    shared = flat.join(held, ["space", "filter"]).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("filter", "g"))).alias("filters"))
    return materialize(shared, "shared-filters")


def _earlier(lists: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of left and right rows have a number in both their lists."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    numbers, place, times = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    # a number of one row alone is shared with nobody
    shared = times > 1
    place, row, common = (np.cumsum(shared) - 1)[place], np.repeat(np.arange(len(size)), size), shared[place]
    held = np.zeros((len(size), int(shared.sum())), np.float32)
    held[row[common], place[common]] = 1
    return held[left] @ held[right].T > 0


def _forest(hit: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links of hit that join all that its links join."""
    shift = 0 if same else len(hit)
    comp = np.arange(shift + hit.shape[1])
    out = []
    for p in np.flatnonzero(hit.any(axis=1)):
        q = np.flatnonzero(hit[p])
        roots, first = np.unique(comp[q + shift], return_index=True)
        out += [(p, q[x]) for x in first[roots != comp[p]]]
        comp[np.isin(comp, roots)] = comp[p]
    return out


def _compare(rows: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links of one filter between two blocks (or within one): per vector its number n, and the
    links of a forest with n = -1."""
    same = rows["x"][0] == rows["y"][0]
    side = rows["side"].to_numpy()
    left, right = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if len(left) == 0 or len(right) == 0:
        return None
    unit = _units(rows["embedding"].combine_chunks(), len(side))
    hit = unit[left] @ unit[right].T >= cosine
    if same:
        hit = np.triu(hit, 1)
    if not hit.any():
        return None
    # a pair belongs to the first filter that both are in
    hit &= ~_earlier(rows["before"].combine_chunks(), left, right)
    ids, k = rows["cid"].to_numpy(), rows["k"].to_numpy()
    tree = np.array(_forest(hit, same), np.int64).reshape(-1, 2)
    cid = np.concatenate([ids[left], ids[right], ids[left][tree[:, 0]]])
    n = np.concatenate([hit @ k[right], hit.T @ k[left], np.full(len(tree), -1)])
    other = np.concatenate([ids[left], ids[right], ids[right][tree[:, 1]]])
    return cid[n != 0], n[n != 0], other[n != 0]


#: What names a comparison; rows arrive sorted by it.
MEETING = ["space", "filter", "x", "y"]


def _meetings(batches):
    """The rows of one comparison after the other; besides a batch, at most one comparison is held."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if kept is not None:
            rows = pa.concat_tables([kept, rows])
        turn = np.zeros(max(len(rows) - 1, 0), bool)
        for name in MEETING:
            c = rows[name]
            turn |= pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy()
        cuts = [0, *(np.flatnonzero(turn) + 1)]
        yield [rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        kept = rows.slice(cuts[-1])
    if kept is not None and len(kept) > 1:
        yield [kept]


def _links(pairs: DataFrame, cosine: float) -> DataFrame:
    """The result of _compare for every comparison of pairs.

    Most comparisons hold a few rows, so they are read as sorted runs of a partition; one call
    of Python for each would cost more than its work.
    """

    def run(batches):
        for several in _meetings(batches):
            found = [f for f in (_compare(rows, cosine) for rows in several) if f]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["cid", "n", "other"])

    return pairs.repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(run, "cid long, n long, other long")


def meetings(reps: DataFrame, block_rows: tuple[int, int]) -> DataFrame:
    """One row per class, shared filter and block that its block meets, with the vector."""
    shared = shared_filters(materialize(filters_of(reps), "filters"), block_rows)
    # the vector joins its filters once; only here does it go to more than one place
    flat = reps.select("cid", "space", "k", "embedding").join(shared, "cid").select("*", F.posexplode("filters").alias("before", "f"))
    own = F.pmod(F.xxhash64("cid"), F.col("f.g")).cast("int")
    placed = flat.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("f.g") - 1)))
    return placed.select(
        "space", F.col("f.filter").alias("filter"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "cid", "k", "embedding", F.slice(F.col("filters.filter"), F.lit(1), F.col("before")).alias("before"),
    )


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, block_rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    with scratch(vectors.sparkSession) as keep:
        all_rows = keep(materialize(classes(vectors), "vectors"))
        of_class = keep(_class_results(all_rows, cosine, block_rows))
    out = all_rows.select("vec_id", "key").join(of_class, "key", "left")
    cid = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(True)).alias("kept"))


def _class_results(all_rows: DataFrame, cosine: float, block_rows: tuple[int, int]) -> DataFrame:
    """(key, n, comp): links and component of every class of equal vectors."""
    fine = all_rows.where("key is not null")
    ids = fine.groupBy("key").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("k"))
    # numbers given once and written, so that they stay
    ids = materialize(ids.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    # vectors meet within a label and a length
    spaced = fine.join(ids, "key").where("vec_id = rep").dropDuplicates(["key"]).select("cid", "k", "embedding", F.concat(F.col("label").cast("string"), F.lit(":"), F.size("embedding").cast("string")).alias("name"))
    spaced = materialize(spaced, "vector-spaced")
    spaces = materialize(spaced.groupBy("name").agg(_code(F.count(F.lit(1))).alias("code")).withColumn("space", F.monotonically_increasing_id()), "spaces")
    reps = materialize(spaced.join(spaces, "name").select("cid", "space", "code", "k", "embedding"), "vector-reps")
    found = materialize(_links(meetings(reps, block_rows), cosine), "vector-links")
    counts = found.where("n > 0").groupBy("cid").agg(F.sum("n").alias("n"))
    links = found.where("n < 0").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    # a vec_id with several vectors joins their classes
    several = fine.select("vec_id", "key").distinct().join(ids.select("key", "cid"), "key").groupBy("vec_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z"), F.collect_set("cid").alias("all"))
    same = several.where("a < z").select("a", F.explode("all").alias("b"))
    comp = components(links.union(same).distinct())
    # a component is named by the smallest vec_id of its classes
    labelled = materialize(ids.join(comp.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", "k", "rep", "comp"), "vector-labels")
    names = materialize(labelled.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least")), "vector-names")
    of_class = labelled.join(names, "comp", "left").join(counts, "cid", "left")
    return materialize(of_class.select("key", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n"), F.coalesce("least", "rep").alias("comp")), "vector-result")
