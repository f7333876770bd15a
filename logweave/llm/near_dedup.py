"""Near-duplicate documents by bottom-k sketches over word shingles.

A document's set holds the hashes of its distinct word shingles (64 bits, one hash function);
its sketch is the SKETCH smallest. Documents are linked when their sets' Jaccard similarity is
at least percent / 100, and kept when they have the smallest doc_id of their linked component.

1. Documents with equal sets form a class; the smallest doc_id stands for it. Only
   representatives go on, so copies are never expanded into pairs.
2. Inverted lists of retained values generate overlaps. A value of the union's sketch lies in
   both sets with the pair's similarity, so 16 lists miss a pair at 0.8 with probability
   0.2**16. A value in more than HOT sketches is hot: it marks a shared passage or a large
   family. A document emits its cold values if at least COLD of its sketch is cold, and
   lists of a second kind, among such documents only, if at most MIXED of it is cold. If one of
   a linked pair is more than MIXED cold, the other is at least 0.43 cold and most cold values
   are shared; otherwise both are in the second kind. So each linked pair meets, cold lists
   have at most HOT members, and a passage within documents that are otherwise unlike makes no
   long lists.
3. Stars first: each list compares its members with one centre, the most central one. What
   the stars link needs no more pairs. Lists whose members then lie in different
   components compare members across components: all of them in short lists; in long lists a
   further star, then step 4. So no link between components is lost, and a family of near
   copies costs about linear work.
4. A long list may still span components. With at most OUTSIDE members outside its largest
   component, these are compared with members of similar size in blocks, OUTSIDE / BLOCK of them
   for each member. With more, it holds a passage in documents that are otherwise
   unlike. Its smallest member is its base. Documents that are linked by the passage alone are
   linked to the base too, as it adds least to the union. What a member has beyond the base is its
   rest; the RESTS smallest values of the rest make lists of their own, in which members meet
   that share more than the passage. With a share q of a member outside the base, a partner at
   0.8 has at least 1 - 0.2 / q of both rests in common, so these lists miss it with a
   probability of (0.2 / q) ** RESTS, under 1e-6 for q of REST_SHARE or more. Long lists of rests
   (a second common passage) go through the step again. Only members with less outside the base
   are compared in blocks, among themselves.
5. Overlaps pass a size bound and the union-sketch estimate (at least ESTIMATE, which a pair at
   0.8 misses with probability under 1e-7); exact Jaccard over full sets confirms them.

Defined results: null, empty and blank texts have empty sets and link with nothing; texts with
fewer words than a shingle count as one shingle; rows of one doc_id are one vertex,
with all their texts if these differ, and each returned; ties keep the smallest doc_id; rows with a
null doc_id link with nothing, have a null component and are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, components, dealt, joined_components, materialize, parts, places, scratch, spare

SKETCH, LISTS, HOT, ESTIMATE = 64, 16, 50, 0.5
#: Lists of the second kind, and the larger sketch and closer estimate for blocks of long lists:
#: a pair at 0.8 fails it with a probability of about 1e-6.
HOT_LISTS, WIDE_SKETCH, WIDE_ESTIMATE = 10, 256, 0.68
COLD, MIXED = 0.25, 0.55
#: Rounds of further stars within long lists before the remaining members are compared in blocks.
STAR_ROUNDS = 1
#: Values of a rest that make lists, the share from which they suffice, and how often lists of rests are taken further.
RESTS, REST_SHARE, REST_ROUNDS = 32, 0.31, 2
#: Lists with no more members outside their largest component go through blocks at once: every other member meets a bounded number of blocks.
OUTSIDE = 2048
COLUMNS = ("tag", "v", "doc_id", "n", "comp")
#: Rows of a block.
BLOCK = 256

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's word shingles."""
    # on bytes, lower() and split() know only ASCII letters and ASCII blanks
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            h = (h * _P) ^ w[i : len(w) - k + 1 + i]
            h = h ^ (h >> np.uint64(31))
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        h ^= h >> np.uint64(31)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), fp (identity of the set), sk (sketch)."""

    def run(batches):
        hashes = _Hashes()
        for pdf in batches:
            n, fp, sk = [], [], []
            for t in pdf["text"]:
                s = shingle_set(t, width, hashes)
                n.append(len(s))
                fp.append(hashlib.md5(s.tobytes()).digest())
                sk.append(s[:SKETCH])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "fp": fp, "sk": sk})

    return _texts(docs).mapInPandas(run, "doc_id long, n long, fp binary, sk array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        hashes = _Hashes()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "s": [shingle_set(t, width, hashes) for t in pdf["text"]]})

    return _texts(docs).mapInPandas(run, "id long, s array<long>")


def fingerprints(sets: DataFrame) -> DataFrame:
    """sets with fp as sketches() gives it."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(fp=[hashlib.md5(np.asarray(s, np.int64).tobytes()).digest() for s in pdf["s"]])

    return sets.mapInPandas(run, "id long, s array<long>, fp binary")


def _similar_sizes(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _estimate(a, b):
    """Share of the union's sketch that lies in both sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _joined(pairs: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """Pairs (a, b, part) with the columns of both; rows is bucketed by id. The first join moves only
    the pairs, by b. Pairs come dealt into ranges of (a, b) and a's columns go to each range it is
    in, so the pairs of a hub are never one key of the second join."""
    side = lambda d, x, *more: d.select(F.col("id").alias(x), *more, *[F.col(c).alias(f"{c}{x}") for c in cols])
    return pairs.join(side(rows, "b"), "b").join(side(rows.join(places(pairs, "a"), "id"), "a", "part"), ["a", "part"])


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Dealt pairs (a, b, part), of distinct ones, that pass the size bound and the union-sketch estimate."""
    got = _joined(dealt(pairs, "a", "b", "overlaps"), reps, "n", "sk")
    return materialize(got.where(_similar_sizes("na", "nb", percent)).where(_estimate(F.col("ska"), F.col("skb")) >= ESTIMATE).select("a", "b", "part"), "candidates")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of dealt ones whose full sets are similar enough."""
    got = _joined(pairs, sets, "s")
    both = F.size(F.array_intersect("sa", "sb"))
    return materialize(got.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b"), "links")


def _postings(reps: DataFrame) -> DataFrame:
    """(tag, v, doc_id, n, m): members of the lists with at least two members, m being their number."""
    reps = reps.withColumnRenamed("id", "doc_id")
    flat = reps.select("doc_id", F.explode("sk").alias("v"))
    hot = materialize(flat.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > HOT).select("v"), "hot-values")
    own = flat.join(hot, "v").groupBy("doc_id").agg(F.collect_set("v").alias("hot"))
    cold = F.array_except("sk", F.coalesce("hot", F.array().cast("array<long>")))
    share = F.size("cold") / F.size("sk")
    d = reps.join(own, "doc_id", "left").withColumn("cold", cold)
    none = F.array().cast("array<long>")
    keys = F.concat(
        F.transform(F.slice(F.when(share >= COLD, F.col("cold")).otherwise(none), 1, LISTS), lambda v: F.struct(F.lit(0).alias("tag"), v.alias("v"))),
        F.transform(F.slice(F.when(share <= MIXED, F.col("sk")).otherwise(none), 1, HOT_LISTS), lambda v: F.struct(F.lit(1).alias("tag"), v.alias("v"))),
    )
    p = materialize(d.select("doc_id", "n", F.explode(keys).alias("k")).select("k.tag", "k.v", "doc_id", "n"), "postings")
    lists = materialize(p.groupBy("tag", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "lists")
    return materialize(p.join(lists, ["tag", "v"]), "members")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): the most central member of a list, with every other one."""
    central = members.groupBy("doc_id").agg(F.sum("m").alias("c"))
    ranked = members.select("tag", "v", "doc_id").join(central, "doc_id")
    centres = materialize(
        ranked.groupBy("tag", "v").agg(F.max(F.struct("c", (-F.col("doc_id")).alias("neg"))).alias("top")).select("tag", "v", (-F.col("top.neg")).alias("centre")), "centres"
    )
    return members.join(centres, ["tag", "v"]).where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()


def _with_comp(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the lists that still span several components, with their component."""
    m = materialize(
        members.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "labelled"
    )
    open_lists = materialize(
        m.groupBy("tag", "v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tag", "v"), "open-lists"
    )
    return materialize(m.join(open_lists, ["tag", "v"]), "open-members")


def _outside(m: DataFrame) -> DataFrame:
    """Members outside their list's largest component."""
    sizes = m.groupBy("tag", "v", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = materialize(sizes.groupBy("tag", "v").agg(F.max(F.struct("k", "comp")).alias("t")).select("tag", "v", F.col("t.comp").alias("main")), "main")
    return m.join(main, ["tag", "v"]).where("comp <> main").drop("main")


def _within_reach(n):
    """Number of the size class; linked sets lie in the same or in neighbouring classes."""
    return F.floor(F.log(n) / F.log(F.lit(1.26))).cast("int")


def _overlaps(pdf: pd.DataFrame, percent: int, first_key: bool) -> pd.DataFrame:
    """Pairs of one block of outside members with one block of members whose sketches overlap
    enough to pass the estimate, by one product of the two incidence matrices."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if len(left) == 0 or len(right) == 0:
        return none
    vl, vr = np.concatenate(left["sk"].to_list()), np.concatenate(right["sk"].to_list())
    values = np.intersect1d(vl, vr)

    def incidence(d: pd.DataFrame, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = d["sk"].map(len).to_numpy()
        row = np.repeat(np.arange(len(d)), size)
        col = np.minimum(np.searchsorted(values, v), len(values) - 1)
        ok = values[col] == v
        out = np.zeros((len(d), len(values)), np.float32)
        out[row[ok], col[ok]] = 1
        return out, size

    (x, kx), (y, ky) = incidence(left, vl), incidence(right, vr)
    common = x @ y.T
    union = np.minimum(WIDE_SKETCH, kx[:, None] + ky[None, :] - common)
    nx, ny = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    # sets that the wide sketch holds whole are compared exactly
    whole = (nx <= WIDE_SKETCH) & (ny <= WIDE_SKETCH)
    good = np.where(whole, common * 100 >= (nx + ny - common) * percent, common >= WIDE_ESTIMATE * union)
    good &= (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent)
    good &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
    if first_key:
        # a pair belongs to the list of its smallest common key
        here = int(pdf["v"].iloc[0])
        lower, heads = np.searchsorted(values, here), [d["sk"].map(lambda k: k[:HOT_LISTS]) for d in (left, right)]
        if lower:
            values = values[:lower]
            (p, _), (q, _) = (incidence(pd.DataFrame({"sk": h}), np.concatenate(h.to_list())) for h in heads)
            good &= p @ q.T == 0
    i, j = np.nonzero(good)
    # of exact links between the same two components one is enough
    sure = whole[i, j]
    _, first = np.unique(np.stack([left["comp"].to_numpy()[i[sure]], right["comp"].to_numpy()[j[sure]]]), axis=1, return_index=True)
    i, j = (np.concatenate([k[sure][first], k[~sure]]) for k in (i, j))
    a, b = left["doc_id"].to_numpy()[i], right["doc_id"].to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _in_blocks(held: DataFrame, sets: DataFrame, percent: int, first_key: bool) -> DataFrame:
    """Overlapping pairs across components among the members of lists (tag, v): those outside the
    list's largest component against all of similar size. With first_key, the lists are those
    of sketch values and a pair is given by the first of them that has both."""
    cls = held.select("tag", "v", "doc_id", "n", "comp").withColumn("z", _within_reach(F.col("n")))
    outside = _outside(cls).withColumn("z", F.explode(F.array(F.col("z") - 1, F.col("z"), F.col("z") + 1)))
    both = materialize(outside.withColumn("side", F.lit(0)).unionByName(cls.withColumn("side", F.lit(1))), "outside")
    key = ["tag", "v", "z"]
    count = lambda k: F.ceil(F.sum(F.when(F.col("side") == k, 1).otherwise(0)) / BLOCK).cast("int")
    blocks = materialize(both.groupBy(*key).agg(count(0).alias("g0"), count(1).alias("g1")).where("g0 > 0 and g1 > 0"), "blocks")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == 0, F.col("g0")).otherwise(F.col("g1"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("g1")).otherwise(F.col("g0")) - 1))
    placed = both.join(blocks, key).withColumn("own", own).withColumn("other", meets)
    x = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    y = F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    rows = placed.select(*key, x.alias("x"), y.alias("y"), "side", "doc_id", "n", "comp").join(sets.select(F.col("id").alias("doc_id"), F.slice("s", 1, WIDE_SKETCH).alias("sk")), "doc_id")
    # many small groups with much work in each: keep all partitions
    dealt = rows.repartition(parts(rows.sparkSession), *key, "x", "y")
    return dealt.groupBy(*key, "x", "y").applyInPandas(lambda pdf: _overlaps(pdf, percent, first_key), "a long, b long").distinct()


def _across(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of short lists in different components and of similar size."""
    x, y = (d.select("tag", "v", *[F.col(c).alias(f"{c}{s}") for c in ("doc_id", "n", "comp")]) for d, s in ((short, "a"), (short, "b")))
    found = x.join(y, ["tag", "v"]).where((F.col("doc_ida") < F.col("doc_idb")) & (F.col("compa") != F.col("compb")) & _similar_sizes("na", "nb", percent))
    return found.select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b"))


def _rests(based: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """based with linked (to the base), q (the share outside the base) and rest (its smallest values)."""
    got = _joined(dealt(based.select(F.col("base").alias("a"), F.col("doc_id").alias("b")), "a", "b", "based"), sets, "s")
    rest = F.array_except("sb", "sa")
    both = F.size("sb") - F.size("rest")
    got = got.select("a", "b", F.size("sa").alias("na"), F.col("sb"), rest.alias("rest"))
    return materialize(
        got.select(
            F.col("a").alias("base"), F.col("b").alias("doc_id"), F.size("sb").cast("long").alias("n"), (both * 100 >= (F.col("na") + F.size("rest")) * percent).alias("linked"),
            (F.size("rest") / F.size("sb")).alias("q"), F.slice("rest", 1, RESTS).alias("rest"),
        ),
        "rests",
    )


def _divided(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of lists with at most OUTSIDE members outside the largest component, and of the others."""
    sizes = held.groupBy("tag", "v", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("tag", "v").agg((F.sum("k") - F.max("k")).alias("out"))
    heavy = materialize(sizes.where(F.col("out") > OUTSIDE).select("tag", "v"), "heavy-lists")
    return held.join(heavy, ["tag", "v"], "left_anti"), materialize(held.join(heavy, ["tag", "v"]), "heavy-members")


def _remaining_links(held: DataFrame, short: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components: those among the pairs of short lists, and among the members of long ones (step 4)."""
    verified = lambda pairs: _verified(_estimated(pairs.distinct(), reps, percent), sets, percent)
    light, heavy = _divided(held)
    links, first_key, more = None, True, short
    for turn in range(REST_ROUNDS):
        if not heavy.limit(1).count():
            break
        base = materialize(heavy.groupBy("tag", "v").agg(F.min(F.struct("n", "doc_id")).alias("least")).select("tag", "v", F.col("least.doc_id").alias("base")), "bases")
        based = materialize(heavy.join(base, ["tag", "v"]), "based")
        rests = _rests(based.where("doc_id <> base").select("base", "doc_id").distinct(), sets, percent)
        mine = rests.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        keys = mine.select("doc_id", "n", "comp", F.xxhash64(F.lit(turn), "base").alias("tag"), F.explode("rest").alias("v"))
        sizes = materialize(keys.groupBy("tag", "v").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tag", "v", "m"), "rest-lists")
        lists = materialize(keys.join(sizes, ["tag", "v"]), "rest-postings")
        pairs = _across(lists.where(F.col("m") <= HOT), percent)
        # too little outside the base for lists: blocks, as for the light lists
        close = based.join(rests.select("base", "doc_id", "q"), ["base", "doc_id"], "left").where(F.coalesce("q", F.lit(0.0)) < REST_SHARE).select(*COLUMNS)
        pairs = pairs.union(_in_blocks(light.select(*COLUMNS).unionByName(close), sets, percent, first_key))
        pairs, more = pairs if more is None else pairs.union(more), None
        new = verified(pairs).unionByName(rests.where("linked").select(F.col("base").alias("a"), F.col("doc_id").alias("b")))
        links = new if links is None else links.unionByName(new)
        labels = joined_components(labels, new)
        light, heavy = _divided(_with_comp(lists.where(F.col("m") > HOT).select("tag", "v", "doc_id", "n"), labels))
        first_key = False
    # what is still heavy after every round goes through blocks too, so that no link is lost
    pairs = _in_blocks(light.select(*COLUMNS).unionByName(heavy.select(*COLUMNS)), sets, percent, first_key)
    last = verified(pairs if more is None else pairs.union(more))
    return last if links is None else links.unionByName(last)


def near_labels(reps: DataFrame, sets_of, percent: int, more: DataFrame | None = None) -> DataFrame:
    """(id, comp) of the representatives that are linked, more being further edges (a, b).
    sets_of gives the full sets (id, s), bucketed by id, of a table of ids."""
    members = _postings(reps)
    sets = sets_of(members.select(F.col("doc_id").alias("id")).distinct())
    links = _verified(_estimated(_stars(members), reps, percent), sets, percent)
    labels = components(links if more is None else links.unionByName(more))
    for _ in range(STAR_ROUNDS):
        left = _with_comp(members.where(F.col("m") > HOT), labels)
        # a further centre per long list, from outside the list's largest component
        centres = materialize(_outside(left).groupBy("tag", "v").agg(F.min(F.struct("doc_id", "comp")).alias("c")).select("tag", "v", "c.*").toDF("tag", "v", "centre", "cc"), "centres")
        pairs = left.join(centres, ["tag", "v"]).where("comp <> cc").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
        labels = joined_components(labels, _verified(_estimated(pairs, reps, percent), sets, percent))
    m = _with_comp(members, labels)
    short = _across(m.where(F.col("m") <= HOT), percent)
    return joined_components(labels, _remaining_links(m.where(F.col("m") > HOT), short, labels, reps, sets, percent))


def _renamed(base: DataFrame) -> DataFrame | None:
    """(doc_id, fp, id): numbers beyond all doc_ids for the texts of a doc_id that has several."""
    some = base.where("n > 0")
    several = some.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    texts = materialize(some.join(several, "doc_id").select("doc_id", "fp").distinct(), "several-texts")
    if not texts.limit(1).count():
        return None
    lo, hi = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    at = F.monotonically_increasing_id() + 1
    # ids are written once, so that they stay
    return materialize(texts.withColumn("id", F.lit(hi) + at if hi < 2**62 else F.lit(lo) - at), "several-ids")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with scratch(docs.sparkSession) as keep:
        base = keep(materialize(sketches(docs, width), "sketches"))
        of_class = keep(_class_components(docs, base, width, percent))
    # documents without words have no class; a key of their own each, so that they don't meet in one task
    own = F.when(F.col("n") > 0, F.col("fp")).otherwise(F.unhex(F.md5(F.concat(F.lit("none:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))))
    out = base.withColumn("own", own).join(of_class.withColumnRenamed("fp", "own"), "own", "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def _class_components(docs: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """(fp, comp): the component of every set of shingles."""
    renamed = _renamed(base.where("doc_id is not null"))
    rows = base.where("doc_id is not null and n > 0")
    if renamed is None:
        rows = rows.withColumn("id", F.col("doc_id"))
    else:
        rows = materialize(rows.join(renamed, ["doc_id", "fp"], "left").withColumn("id", F.coalesce("id", "doc_id")), "vertices")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    dealt = rows.repartition(parts(docs.sparkSession), "id")
    reps = dealt.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    reps = bucketed(reps.select("id", "n", "sk"), "id", "reps")

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = _texts(docs).repartition(parts(docs.sparkSession), "doc_id")
        needed = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        sets = full_sets(needed, width)
        if renamed is not None:
            own = texts.join(renamed.select("doc_id").distinct(), "doc_id", "left_semi")
            own = fingerprints(full_sets(own, width)).withColumnRenamed("id", "doc_id").join(renamed, ["doc_id", "fp"]).select("id", "s")
            own = own.join(ids, "id", "left_semi").dropDuplicates(["id"])
            sets = sets.unionByName(own).repartition(parts(docs.sparkSession), "id")
        return bucketed(sets, "id", "sets")

    # the texts of one doc_id are linked through their classes
    more = None
    if renamed is not None:
        own = renamed.join(classes, "fp").groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all"))
        more = own.select("a", F.explode("all").alias("b")).where("a <> b")
    labels = near_labels(reps, sets_of, percent, more)
    # copies take the label of their representative
    of_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("comp", "rep").alias("comp"))
    if renamed is not None:
        # the smallest doc_id may be behind a number of its own
        of_class = materialize(of_class, "class-labels")
        names = materialize(renamed.join(of_class, "fp").groupBy("comp").agg(F.min("doc_id").alias("least")), "class-names")
        true = F.when(F.col("comp").between(*base.agg(F.min("doc_id"), F.max("doc_id")).first()), F.col("comp"))
        of_class = of_class.join(names, "comp", "left").select("fp", F.coalesce(F.least("least", true), true, "least").alias("comp"))
    return materialize(of_class, "class-components")


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one document of each component."""
    name = spare(docs.columns, "gone")
    with scratch(docs.sparkSession) as keep:
        found = near_dedup(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
        gone = keep(materialize(found, "gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
