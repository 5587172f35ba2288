"""Interval algebra: unions of overlapping spans, per document, as columns and over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalspan.functions.spans import SPAN, SPANS, by_start, cut, span

_STATE = f"struct<done:{SPANS},open:{SPAN},size:int,checked:boolean>"


def _sorted(spans: Column, order) -> Column:
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for x, y in reversed(list(zip(order(a), order(b)))):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return F.array_sort(spans, compare)


def recall_first_union(text: Column, *groups: Column) -> Column:
    """Overlapping spans of any label become one with their outer extent; adjacent ones stay apart.

    The label is that of the longest validator span if there is one, else of the longest span, the first of equals in
    order of (start, -end); source is the common one or `merged`; score is the greatest known.
    """
    spans = _sorted(F.concat(*groups) if len(groups) > 1 else groups[0], lambda s: (s["start"], -s["end"]))
    none = F.lit(None).cast(SPAN)
    begin = F.struct(F.array().cast(SPANS).alias("done"), none.alias("open"), F.lit(0).alias("size"), F.lit(False).alias("checked")).cast(_STATE)

    def step(acc: Column, s: Column) -> Column:
        o, size, checked = acc["open"], s["end"] - s["start"], s["source"] == "validator"
        wins = (checked & ~acc["checked"]) | ((checked == acc["checked"]) & (size > acc["size"]))
        joined = F.struct(
            acc["done"].alias("done"),
            span(o["start"], F.greatest(o["end"], s["end"]), F.when(wins, s["label"]).otherwise(o["label"]), F.lit(""), F.when(o["source"] == s["source"], o["source"]).otherwise(F.lit("merged")), F.greatest(o["score"], s["score"])).alias("open"),
            F.when(wins, size).otherwise(acc["size"]).alias("size"),
            (acc["checked"] | checked).alias("checked"),
        ).cast(_STATE)
        done = F.when(o.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(o)))
        fresh = F.struct(done.alias("done"), s.alias("open"), size.alias("size"), checked.alias("checked")).cast(_STATE)
        return F.when(o.isNotNull() & (s["start"] < o["end"]), joined).otherwise(fresh)

    ends = F.aggregate(spans, begin, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.transform(ends, lambda s: s.withField("text", cut(text, s["start"], s["end"])))


def merge_same_label(spans: Column) -> Column:
    """Overlapping spans of one label become one; its score is the greater, null as 0, its text is dropped. Order:
    start, end, label."""
    ordered = _sorted(spans, lambda s: (s["label"], s["start"], s["end"]))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = span(last["start"], s["end"], last["label"], F.lit(""), last["source"], F.greatest(F.coalesce(last["score"], F.lit(0.0)), F.coalesce(s["score"], F.lit(0.0))))
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["label"] == s["label"]) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        inside = s["end"] <= F.try_element_at(acc, F.lit(-1))["end"]
        return F.when(F.coalesce(meets & inside, F.lit(False)), acc).when(F.coalesce(meets, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return by_start(F.aggregate(ordered, F.array().cast(SPANS), step))


def drop_contained(spans: Column) -> Column:
    """Spans that lie inside another, different span go, whatever their labels; identical ones all stay."""
    longest = _sorted(spans, lambda s: (s["start"], s["start"] - s["end"]))
    same = lambda a, b: a.eqNullSafe(b)
    step = lambda acc, s: F.when(F.exists(acc, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & ~same(o, s)), acc).otherwise(F.concat(acc, F.array(s)))
    return by_start(F.aggregate(longest, F.array().cast(SPANS), step))


def union_relation(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """recall_first_union over a relation (key, ord, start, end, label, source, score): gaps and islands, one shuffle
    by key. For documents whose spans are too many for one row."""
    before = Window.partitionBy(key).orderBy("start", F.desc("end"), "ord")
    marked = spans.withColumn("edge", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    island = marked.withColumn("island", F.sum(F.when(F.col("start") < F.col("edge"), 0).otherwise(1)).over(before)).withColumn("rank", F.row_number().over(before))
    best = F.max(F.struct((F.col("source") == "validator").alias("v"), (F.col("end") - F.col("start")).alias("n"), (-F.col("rank")).alias("r"), F.col("label").alias("label")))
    one = F.min("source") == F.max("source")
    out = island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("best"), F.when(one, F.min("source")).otherwise("merged").alias("source"), F.max("score").alias("score"))
    return out.select(key, "start", "end", F.col("best.label").alias("label"), "source", "score")
