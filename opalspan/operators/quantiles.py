"""Exact percentiles by selection: ranges are narrowed by histograms until the wanted values are alone in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opalspan.sources.shared import kept

#: Buckets of a histogram, and values of a range from which on it is narrowed.
BUCKETS, FEW = 1024, 10_000
#: Groups up to which ranges are sent to every task: as many rows as ranks, of some hundred bytes.
GROUPS = 10_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(keys, share, value) of each group: the exact percentile, interpolated between neighbours.

    A pass counts, for each wanted rank, the values of its range by bucket, in each task first; the bucket that holds the
    rank is the next range, between its own least and greatest value, so each pass parts it. Ranges of up to `few` values
    are sorted. No task gets a group's values, and none are shuffled until then. Nulls, NaN and infinities are left out;
    a group without values has no row; a null key is a group.
    """
    if not all(0 <= q <= 1 for q in shares):
        raise ValueError("shares lie between 0 and 1")
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) <> double('infinity')")
    sizes = kept(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    place = lambda q: F.col("n").cast("double") * q - q
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares])))
    state = kept(sizes.select(*names, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("base"), F.col("n").alias("m")), "ranks")
    small = sizes.count() <= GROUPS

    def inside(ranges: DataFrame) -> DataFrame:
        """Values in their group's ranges."""
        ranges = ranges.select(*[F.col(n).alias(f"r{n}") for n in names], "rank", "lo", "hi", "base")
        on = F.col("v").between(F.col("lo"), F.col("hi"))
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col(f"r{n}"))
        return rows.join(F.broadcast(ranges) if small else ranges, on)

    while True:
        wide = state.where((F.col("m") > few) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        # halves, as the difference of two finite numbers may not be one
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets))
        counted = inside(wide).withColumn("bucket", bucket).groupBy(*names, "rank", "base", "bucket").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*names, "rank").orderBy("bucket"))  # `buckets` rows at most
        chosen = counted.withColumn("upto", F.col("base") + upto).where((F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        narrowed = chosen.select(*names, "rank", "lo", "hi", (F.col("upto") - F.col("c")).alias("base"), F.col("c").alias("m"))
        state = kept(state.where((F.col("m") <= few) | (F.col("lo") >= F.col("hi"))).unionByName(narrowed), "ranks")
    alone = state.where(F.col("lo") >= F.col("hi")).select(*names, "rank", F.col("lo").alias("v"))
    order = F.row_number().over(Window.partitionBy(*names, "rank").orderBy("v"))  # `few` rows at most
    found = inside(state.where(F.col("lo") < F.col("hi"))).withColumn("at", order).where(F.col("at") == F.col("rank") - F.col("base") + 1).select(*names, "rank", "v")
    values = alone.unionByName(found).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values"))
    on = F.lit(True)
    for n in names:
        on = on & sizes[n].eqNullSafe(values[n])
    known = sizes.join(values, on).select(*[sizes[n] for n in names], "n", "values")
    at = lambda r: F.try_element_at(F.col("values"), r)

    def one(q: float):
        low, high = at(F.floor(place(q))), at(F.ceil(place(q)))
        return F.struct(F.lit(float(q)).alias("share"), (low + (high - low) * (place(q) - F.floor(place(q)))).alias("value"))

    out = known.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.explode(F.array(*[one(q) for q in shares])).alias("x"))
    return out.select(*[F.col(f"`{k}`") for k in keys], "x.*")
