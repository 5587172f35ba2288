"""What the training-data operators share: the shared folder, written intermediates, components, tokenised chunks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: whole texts travel in them, so a batch stays a few megabytes.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without that setting, one of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="opalspan-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's JVM ends in order."""
    path = f"{shared_dir(spark)}/opalspan/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


_FOLDERS: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._opalspan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() once nothing reads it any more."""
    path = getattr(df, "_opalspan_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch holds, in rows and in bytes; a row larger than that travels alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (node, component): component is the smallest node reachable.

    Alternating large-star and small-star contraction: every round is two grouped minima and two joins, so no
    neighbour list is gathered and a node with very many links is summed before it is shuffled. A round's edges
    are written to the shared folder; only their count and checksum reach the driver. Rounds grow with the
    logarithm of the longest path. Null ends and self links are dropped.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame) -> DataFrame:
        two = both(e)
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        return small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct()

    stamp = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"), F.col("src").alias("s"), F.col("dst").alias("d"))
    now = written(now.where("s is not null and d is not null and s <> d").select("u", "v").distinct(), "edges")
    mark = stamp(now)
    while mark[0]:
        following = written(star(now), "edges")
        discard(now)
        new = stamp(following)
        now = following
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of one batch -> (node, smallest node reachable in the batch) without the roots themselves."""
    if not len(a):
        return a[:0], b[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]
