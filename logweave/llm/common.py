"""Shared helpers: table access, durable intermediates, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters and their lower-case forms, for A-Z-only lower-casing.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the operators' contracts: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"


#: Bounds of what a Python worker holds at a time; whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Where none is configured, a local master gets a fresh
    local one; on a cluster that would not be shared, so it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="logweave-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


#: Intermediate tables written in the open scopes, the innermost last: (path, catalog table or "").
_SCOPES: list[list[tuple[str, str]]] = []


def _note(path: str, table_name: str = "") -> None:
    if _SCOPES:
        _SCOPES[-1].append((path, table_name))


@contextmanager
def scratch(spark: SparkSession):
    """Intermediates written inside are deleted at the end, but for those handed to the function
    that it gives. What was built on the deleted ones must have been written by then."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(df._written)
        return df

    mine: list[tuple[str, str]] = []
    _SCOPES.append(mine)
    try:
        yield keep
    finally:
        _SCOPES.remove(mine)
        for path, table_name in mine:
            if path in kept:
                _note(path, table_name)
                continue
            if table_name:
                spark.sql(f"DROP TABLE IF EXISTS {table_name}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = (path,)
    return out


def spare(columns, name: str) -> str:
    """name, with underscores before it until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As materialize, bucketed by key: later joins on key don't shuffle this side. df should
    come dealt by key into parts() partitions, else many small files are written."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table_name}"
    df.write.bucketBy(parts(spark), key).sortBy(key).option("path", path).format("parquet").saveAsTable(table_name)
    _note(path, table_name)
    return spark.table(table_name)


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def dealt(df: DataFrame, key: str, tie: str, name: str) -> DataFrame:
    """df written in ranges of (key, tie), with its range as part. A join on key and part, with what
    is known of a key sent to its places(), then never has all of a hot key in one task. Ranges
    are sampled first, so df should end in a shuffle, else its work is done twice."""
    return materialize(df.repartitionByRange(key, tie).withColumn("part", F.spark_partition_id()), f"{name}-dealt")


def places(df: DataFrame, key: str) -> DataFrame:
    """(id, part): the parts that each key of a dealt table is in."""
    return df.select(F.col(key).alias("id"), "part").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (id, comp) per vertex
    that occurs in an edge, comp being the smallest id reachable.

    Every round takes the smallest neighbouring label (a partial aggregate, so a hub of any
    degree is combined before the shuffle), gives it to one's own root too, then halves the label
    chains by pointer jumping. Rounds grow with the logarithm of the longest shortest path, for
    typical graphs. Edges are dealt once into ranges, labels in every round; what is known of a
    vertex goes to each range it is in, so neither a hub's edges nor the members of a large
    component are one key of a join. After max_rounds without an end it raises an error; rounds
    grow with the logarithm of the graph's diameter, so 60 are far beyond any table.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a <> b")
    with scratch(spark) as keep:
        both = dealt(e.union(e.select(F.col("b"), F.col("a"))).distinct(), "b", "a", "edges")
        lab = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
        if not lab.limit(1).count():
            return keep(lab)
        sent_to = materialize(places(both, "b"), "edges-places")
        for _ in range(max_rounds):
            with scratch(spark) as keep_round:
                new = keep_round(_round(lab, both, sent_to))
                changed = new.join(lab.withColumnRenamed("comp", "old"), "id").where("comp <> old").limit(1).count()
            lab = new
            if not changed:
                return keep(lab)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _round(lab: DataFrame, both: DataFrame, sent_to: DataFrame) -> DataFrame:
    sent = lab.join(sent_to, "id").select(F.col("id").alias("b"), "part", "comp")
    near = both.join(sent, ["b", "part"]).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
    seen = lab.join(near, "id").select("id", "comp", F.least("comp", "near").alias("near"))
    # one row for the vertex, one that lowers its root
    low = seen.select(F.explode(F.array("id", "comp")).alias("id"), F.col("near").alias("comp")).groupBy("id").agg(F.min("comp").alias("comp"))
    low = dealt(low, "comp", "id", "labels")
    roots = places(low, "comp").join(low.select("id", F.col("comp").alias("root")), "id").select(F.col("id").alias("comp"), "part", "root")
    jump = low.join(roots, ["comp", "part"]).select("id", F.least("comp", "root").alias("comp"))
    return materialize(jump, "labels")


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, comp) after the further edges (a, b). Edges are first drawn between the
    components known, so the search is over what the new edges join, not over all links again."""
    known = lambda c, name: labels.select(F.col("id").alias(c), F.col("comp").alias(name))
    drawn = edges.join(known("a", "ca"), "a", "left").join(known("b", "cb"), "b", "left")
    drawn = drawn.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    moved = components(drawn).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    if not moved.limit(1).count():
        return labels
    old = labels.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    # ids that had no label yet
    fresh = moved.select(F.col("comp").alias("id"), F.col("root").alias("comp")).join(labels.select("id"), "id", "left_anti")
    return materialize(old.unionByName(fresh), "labels")
