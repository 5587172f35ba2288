"""Spans joined and merged as relations, in bins and ranges of offsets: one document may fill many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalspan.operators.ordered import before

#: Characters of a bin.
BIN = 1024


def _bins(start, end, size: int):
    return F.sequence(F.floor(start / size), F.greatest(F.floor(start / size), F.floor((end - 1) / size)))


def overlapping(a: DataFrame, b: DataFrame, key: str = "doc_id", size: int = BIN) -> DataFrame:
    """Pairs of spans of a and b, both (key, start, end, ...), of one document that overlap: (key, a, b), the rows as
    structs.

    Spans are dealt to the bins that they touch and joined by document and bin, so the spans of a document are compared
    only where they are near. A pair that shares several bins counts in the one where the later of the two starts. A null
    key, start or end overlaps nothing; repeated rows pair each.
    """
    side = lambda df, name: df.where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()).select(F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), F.explode(_bins(F.col("start"), F.col("end"), size)).alias("_bin"))
    x, y = F.col("a.start"), F.col("b.start")
    pairs = side(a, "a").join(side(b, "b"), ["_key", "_bin"]).where((x < F.col("b.end")) & (y < F.col("a.end")) & (F.floor(F.greatest(x, y) / size) == F.col("_bin")))
    return pairs.select(F.col("_key").alias(key), "a", "b")


def missed(gold: DataFrame, pred: DataFrame, key: str = "doc_id", size: int = BIN) -> DataFrame:
    """Rows of gold(key, start, end, ...) that no row of pred overlaps. Rows alike in key, start and end are judged alike."""
    hit = overlapping(gold.select(key, "start", "end").distinct(), pred.select(key, "start", "end").distinct(), key, size).select(key, "a.start", "a.end").distinct()
    return gold.join(hit, [key, "start", "end"], "left_anti").select(*gold.columns)


def islands(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans(key, ord, start, end, ...) with island: spans that chains of overlaps join have one number in their document.

    In order of start, an island begins where no earlier span reaches; earlier ends and begun islands come from running
    values over ranges, not from a task a document. (key, start, end, ord) must be unique.
    """
    order = ["start", "_down", "ord"]
    edged = before(spans.withColumn("_down", -F.col("end")), [key], order, F.col("end"), "_edge", "max")
    begins = F.when(F.col("start") < F.col("_edge"), 0).otherwise(1)
    counted = before(edged.withColumn("_begins", begins), [key], order, F.col("_begins"), "_earlier")
    return counted.withColumn("island", F.col("_earlier") + F.col("_begins")).select(*spans.columns, "island")


def union(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The recall-first union of spans(key, ord, start, end, label, source, score) of documents of any size: of each island
    the whole extent, the label of the longest validator's span, else of the longest, the first of equals."""
    marked = islands(spans, key)
    best = F.max(F.struct((F.col("source") == "validator").alias("v"), (F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), F.col("end").alias("e"), (-F.col("ord")).alias("o"), F.col("label").alias("label")))
    source = F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("merged")
    out = marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("best"), source.alias("source"), F.max("score").alias("score"))
    return out.select(key, "start", "end", F.col("best.label").alias("label"), "source", "score")
