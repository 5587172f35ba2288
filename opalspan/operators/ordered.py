"""Running counts over an order, without a task that holds a whole group: ranges of the order, and what stands before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalspan.sources.shared import kept

PART, FIRST = "_part", "_first"


def parts(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with _part, written: rows dealt to ranges of the order, which must be total; a later range has a higher _part.

    Ranges come from a sample, so the numbers are written with the rows: read again, they are the same. A group as large
    as a third of the table is in as many ranges as its size asks for.
    """
    dealt = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order)
    return kept(dealt.withColumn(PART, F.spark_partition_id()), "ranged")


def before(df: DataFrame, by: list[str], order: list[str], value: Column | None = None, name: str = "before", how: str = "sum") -> DataFrame:
    """df with the sum of `value` (1 a row) over the earlier rows of each group `by`, in a total order, or, as how = "max",
    their greatest value, null for the first.

    A range's own rows are taken together in a task a range and group; what whole ranges give, one row for each group in
    each range, is run over per group, and joined.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    value = F.lit(1) if value is None else value
    rows = ranged(df.withColumn("_value", value.cast("long")), *by, *order)
    own = Window.partitionBy(*by, PART)
    total = rows.groupBy(*by, PART).agg(fold("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(PART).alias("_of"), fold("_sum").over(earlier).alias("_offset"))
    same = F.col(PART) == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = fold("_value").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = F.coalesce("_inside", F.lit(0)) + F.coalesce("_offset", F.lit(0)) if how == "sum" else F.greatest("_inside", "_offset")
    out = rows.withColumn("_inside", inside).join(offset, same).withColumn(name, both)
    return out.drop("_value", "_inside", "_of", "_offset", PART, *[f"_by{i}" for i in range(len(by))])


def nth(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The n-th row of each group that has so many. Only the range that holds it is ranked."""
    rows = ranged(df, *by, *order)
    total = rows.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    holds = total.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where((F.col("_offset") < n) & (F.col("_offset") + F.col("_n") >= n))
    holds = holds.select(*by, PART, "_offset")
    place = F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order)) + F.col("_offset")
    return rows.join(holds, [*by, PART]).withColumn("_place", place).where(F.col("_place") == n).drop(PART, "_offset", "_place")


def taken(df: DataFrame, order: list[str], accepts: Column, k: int, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, counts): rows looked at in order until k are accepted, in each group `by`; rows with `accepts` false or
    null are dropped on the way.

    counts(by, accepted, dropped): dropped are those before the k-th accepted row, or all if there are fewer. Running
    counts of accepted rows decide, so nothing after the k-th is counted.
    """
    by = by or ["_all"]
    rows = df.withColumn("_all", F.lit(0)).withColumn("_good", F.coalesce(accepts, F.lit(False)))
    seen = before(rows, by, order, F.col("_good").cast("int"), "_before").where(F.col("_before") < k)
    counts = seen.groupBy(*by).agg(F.count_if("_good").alias("accepted"), F.count_if(~F.col("_good")).alias("dropped"))
    return seen.where("_good").drop("_good", "_before", "_all"), counts.drop("_all")
