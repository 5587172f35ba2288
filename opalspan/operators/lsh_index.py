"""A kept index of near-duplicates: banded MinHash signatures in tables that later batches join without building again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.operators.prep import _classes

#: Permutations of a signature, and bands that they are cut into. Two sets of Jaccard 0.8 share no band with a probability
#: of (1 - 0.8^4)^32, about 5 in 10^8.
PERMUTATIONS, BANDS = 128, 32
#: Files by a hash of the key, in each table; a join to an index shuffles only the batch.
BUCKETS = 32
#: Words of a shingle.
WORDS = 5

_RANDOM = np.random.default_rng(20_11)
_FACTORS = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Of each permutation the least of a set's 64-bit hashes, by multiplication and addition modulo 2^64."""
    x = hashes.astype(np.int64).view(np.uint64)
    x = x ^ (x >> np.uint64(31))
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    # a block that stays in a core's cache, a row a permutation, so that the least is taken along it
    block = np.empty((PERMUTATIONS, min(len(x), 256)), dtype=np.uint64)
    for k in range(0, len(x), 256):
        part = x[k : k + 256]
        now = block[:, : len(part)]
        np.multiply(part, _FACTORS[:, None], out=now)
        now += _SHIFTS[:, None]
        np.minimum(out, now.min(axis=1), out=out)
    return out


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = PERMUTATIONS // BANDS
    mix = np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        if not b.num_rows:
            continue
        sets = b.column(1)
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        signs = np.stack([signature(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])]).reshape(b.num_rows, BANDS, rows)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (b.num_rows, BANDS)).copy()
        for r in range(rows):
            key = (key ^ signs[:, :, r]) * mix
            key ^= key >> np.uint64(29)
        row = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
        yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), *(b.column(k).take(row) for k in range(b.num_columns) if k != 1)], names=["band", *(x for x in b.schema.names if x != "h")])


def bands(sets: DataFrame, *more: str) -> DataFrame:
    """sets(c, h) -> (band, c), BANDS rows a set, and more columns of theirs."""
    kinds = [f"{x} {sets.schema[x].dataType.simpleString()}" for x in ("c", *more)]
    return sets.select("c", "h", *more).mapInArrow(_banded, ", ".join(["band long", *kinds]))


class Index:
    """Tables of one index: sets of shingles by class, their bands, and the documents of each class. Documents with equal
    sets are one class, so copies cost a row."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None) -> None:
        self.spark, self.name, self.path = spark, name, path

    def _table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def _add(self, df: DataFrame, part: str, by: str) -> None:
        writer = df.repartition(BUCKETS, by).write.mode("append").format("parquet").bucketBy(BUCKETS, by).sortBy(by)
        if self.path:
            writer = writer.option("path", f"{self.path}/{part}")
        writer.saveAsTable(f"{self.name}_{part}")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}_bands")

    def add(self, docs: DataFrame, key: str = "id") -> None:
        """Documents docs(key, text) put into the index; a set that it knows gets no second row."""
        members, sets = _classes(docs, key, WORDS)
        new = sets.join(self._table("sets").select("c"), "c", "left_anti") if self.exists() else sets
        new = new.withColumn("n", F.size("h"))
        # what is new is settled before the tables grow
        members, new = _settled(members), _settled(new)
        self._add(members, "members", "c")
        self._add(bands(new), "bands", "band")
        self._add(new, "sets", "c")

    def near(self, docs: DataFrame, threshold: float = 0.8, key: str = "id") -> DataFrame:
        """(key, other, jaccard): documents of docs(key, text) and the first document of each class of the index whose set
        has at least the threshold in common with theirs. Candidates share a band; their sets decide."""
        members, sets = _classes(docs, key, WORDS)
        # written once: they are read for the bands and for the pairs
        sets = _settled(sets)
        mine = sets.withColumn("n", F.size("h"))
        found = bands(sets).join(self._table("bands").withColumnRenamed("c", "d"), "band").select("c", "d").distinct()
        known = self._table("sets").select(F.col("c").alias("d"), F.col("h").alias("g"), F.col("n").alias("m"))
        fits = (F.col("m") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("m") * threshold - 1e-9)
        both = found.join(mine, "c").join(known, "d").where(fits)
        size = F.size(F.array_intersect("h", "g"))
        pairs = both.select("c", "d", (size / (F.col("n") + F.col("m") - size)).alias("jaccard")).where(F.col("jaccard") >= threshold)
        first = self._table("members").groupBy(F.col("c").alias("d")).agg(F.min("id").alias("other"))
        return pairs.join(first, "d").join(members, "c").select(F.col("id").alias(key), "other", "jaccard")

    def drop(self) -> None:
        for part in ("members", "bands", "sets"):
            self.spark.sql(f"drop table if exists {self.name}_{part}")


def _settled(df: DataFrame) -> DataFrame:
    from opalspan.sources.shared import kept

    return kept(df, "index")
