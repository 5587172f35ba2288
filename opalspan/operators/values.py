"""A table of values found in texts: an automaton of all of them, in parts when they are many."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of values that one automaton holds; a larger table is dealt to several by the values' first characters.
AUTOMATON = 4_000_000
#: First characters by which values are dealt.
FIRST = 3
_WORD = re.compile(r"\w")


def lowered(text: str) -> str:
    """In lower case, each character one: offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(values: list[tuple[int, str]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    same: dict[str, list[int]] = {}
    for i, v in values:
        if v:
            same.setdefault(lowered(v), []).append(i)
    for v, ids in same.items():
        out.add_word(v, (len(v), sorted(ids)))
    if same:
        out.make_automaton()
    return out if same else None


def occurrences(text: str, values) -> list[tuple[int, int, int]]:
    """(start, end, id) of each value with no word's character next to it; those of one value don't overlap, the first
    stays."""
    out, free = [], {}
    if values is None:
        return out
    for last, (n, ids) in values.iter(lowered(text)):
        start, end = last - n + 1, last + 1
        if start and _WORD.match(text[start - 1]) or end < len(text) and _WORD.match(text[end]):
            continue
        if free.get(ids[0], 0) <= start:
            free[ids[0]] = end
            out += [(start, end, i) for i in ids]
    return sorted(out)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (part, salt, kind): the part's values, then texts."""
    now, built, held = None, None, []
    for b in batches:
        keys, ids, starts, ends, found = [], [], [], [], 0
        rows = zip(*(b.column(i).to_pylist() for i in range(3, 6)), zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for row, (value, text, number, key) in enumerate(rows):
            if key != now:
                now, built, held = key, None, []
            if text is None:
                held.append((number, value))
                continue
            if held:
                built, held = automaton(held), []
            for start, end, i in occurrences(text, built):
                if not number and end - start < FIRST:
                    continue
                keys.append(row)
                ids.append(i)
                starts.append(start)
                ends.append(end)
                found += 1
        if found:
            at = pa.array(keys)
            yield pa.record_batch([b.column(6).take(at), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "value_id", "start", "end"])


def found_values(texts: DataFrame, key: str, values: DataFrame, automaton_chars: int = AUTOMATON) -> DataFrame:
    """(key, value_id, start, end): every place in texts(key, text) of values(value_id, value), in any case, between
    characters that are none of a word.

    Values are counted first. Up to `automaton_chars` characters they are one automaton; a larger table is dealt by first
    characters to as many as needed, and a text goes to those whose first characters it has somewhere. In either form a
    task reads values, then its texts, so memory is bounded by an automaton and a batch. Places of one value don't overlap,
    those of different values may. Null and empty values are nowhere, a null text has none; equal values are found each
    under their ids, repeated texts each; an empty table gives no rows.
    """
    spark = texts.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = values.select(F.col("value_id").cast("long").alias("value_id"), F.col("value").cast("string").alias("value")).where("value <> ''")
    size = known.agg(F.sum(F.length("value"))).first()[0] or 0
    parts = -(-size // automaton_chars) or 1
    kind = dict(texts.dtypes)[key]
    # per character, as offsets are: a first part of a value is dealt like the same characters in a text
    part = lambda c: F.pmod(F.xxhash64(F.rpad(F.lower(F.left(c, F.lit(FIRST))), FIRST, " ")), F.lit(parts))
    short = F.length("value") < FIRST
    salts = max(1, n // parts)
    every = F.array(*[F.lit(k).cast("long") for k in range(parts)])
    dealt = known.select(F.explode(F.when(short, every).otherwise(F.array(part(F.col("value"))))).alias("part"), "value_id", "value")
    side = dealt.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "value", F.lit(None).cast("string").alias("text"), "value_id", F.lit(None).cast(kind).alias("key"))
    rows = texts.where(F.col("text").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col("text").cast("string").alias("text"))
    spots = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - FIRST + 1))
    inside = F.array_distinct(F.transform(spots, lambda i: part(F.substr("text", i, F.lit(FIRST)))))
    whole = rows.withColumn("salt", F.pmod(F.xxhash64("key", "text", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    # a value shorter than what it is dealt by is in every part, and counts in the first one that a text goes to
    whole = whole.select("*", F.posexplode(inside if parts > 1 else F.array(F.lit(0).cast("long"))).alias("lead", "part"))
    both = side.unionByName(whole.select("part", "salt", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("value"), "text", (F.col("lead") == 0).cast("long").alias("value_id"), "key"))
    sorted_rows = both.repartition(n, "part", "salt").sortWithinPartitions("part", "salt", "kind").select("part", "salt", "kind", "value", "text", "value_id", "key")
    return sorted_rows.mapInArrow(_search, f"key {kind}, value_id long, start int, end int").withColumnRenamed("key", key)


def placed(hits: DataFrame, key: str) -> DataFrame:
    """hits(key, value_id, start, end) that stay when the longest value is placed first, all its places, and nothing
    overlaps; of equal length the smaller id."""
    order = lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"]).when(a["value_id"] < b["value_id"], -1).when(a["value_id"] > b["value_id"], 1).otherwise(a["start"] - b["start"])
    hit = F.struct((F.col("end") - F.col("start")).alias("size"), "value_id", "start", "end")
    kind = "array<struct<size:int,value_id:bigint,start:int,end:int>>"
    free = lambda out, h: ~F.exists(out, lambda o: (o["start"] < h["end"]) & (h["start"] < o["end"]))
    fold = F.aggregate(F.array_sort(F.collect_list(hit), order), F.array().cast(kind), lambda out, h: F.when(free(out, h), F.concat(out, F.array(h))).otherwise(out))
    return hits.groupBy(key).agg(fold.alias("_kept")).select(key, F.explode("_kept").alias("h")).select(key, "h.value_id", "h.start", "h.end")
