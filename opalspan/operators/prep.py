"""Data preparation: converting rows, samples, splits, near-duplicates, transcripts, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalspan.functions.spans import IGNORE, SPANS, by_start, cut, in_range, mapped_labels, masked, no_spans, span
from opalspan.functions.text import shingles, words
from opalspan.operators import bloom
from opalspan.operators.scoring import draw
from opalspan.sources.shared import kept


def convert_rows(raw: DataFrame) -> DataFrame:
    """Raw rows (uid, source_text, language, region, privacy_mask) -> (id, text, spans, meta, errors): sorted spans; a
    row whose value differs from its slice has errors and no spans."""
    text = F.col("source_text")
    bad = F.filter("privacy_mask", lambda m: m["value"] != cut(text, m["start"], m["end"]))
    spans = by_start(F.transform("privacy_mask", lambda m: span(m["start"], m["end"], m["label"], m["value"])))
    meta = F.map_filter(F.create_map(F.lit("language"), "language", F.lit("region"), "region"), lambda k, v: v.isNotNull())
    return raw.select(F.col("uid").cast("string").alias("id"), text.alias("text"), F.when(F.size(bad) == 0, spans).otherwise(no_spans()).alias("spans"), meta.alias("meta"), F.size(bad).alias("errors"))


def mapped(df: DataFrame, mapping: dict[str, str], default: str = IGNORE) -> DataFrame:
    """Spans relabelled; documents with a span outside the text go."""
    return df.where(in_range(F.col("text"), F.col("spans"))).withColumn("spans", mapped_labels(F.col("spans"), mapping, default))


def evaluation_scope(df: DataFrame, checked: bool) -> DataFrame:
    """Outside the service's scope, IBAN and IPADDRESS are not evaluated."""
    return df if checked else df.withColumn("spans", F.transform("spans", lambda s: s.withField("label", F.when(s["label"].isin("IBAN", "IPADDRESS"), F.lit(IGNORE)).otherwise(s["label"]))))


def windows_between_spans(df: DataFrame, parts: DataFrame, key: str = "id") -> DataFrame:
    """parts(key, offset, chunk) that no span of df crosses, with the contained spans moved to their window."""
    lo, hi = F.col("offset"), F.col("offset") + F.length("chunk")
    both = parts.join(df.select(key, "spans"), key)
    inside = F.filter("spans", lambda s: (s["start"] >= lo) & (s["end"] <= hi))
    crossed = F.exists("spans", lambda s: (s["start"] < hi) & (lo < s["end"]) & ~((s["start"] >= lo) & (s["end"] <= hi)))
    moved = F.transform(inside, lambda s: s.withField("start", s["start"] - lo).withField("end", s["end"] - lo))
    return both.where(~crossed).select(key, "offset", F.col("chunk").alias("text"), moved.cast(SPANS).alias("spans"))


def ranked(df: DataFrame, group: list[str], value: Column, key: str, buckets: int = 1024) -> DataFrame:
    """df with _rank, from 1, by (value, key) within each group, and _size of the group. value: 60 random bits.

    Values are cut into ranges; a range's first rank is the sum of the counts before it, so a window holds one range of
    one group. The counts are buckets times groups.
    """
    low = F.shiftright(value, 60 - (buckets - 1).bit_length()).cast("int")
    marked = df.withColumns({"_value": value, "_bucket": low})
    counts = marked.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*group)
    starts = counts.select(*group, "_bucket", (F.sum("_n").over(by.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("_size"))
    same = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in group] + [F.col("x._bucket") == F.col("y._bucket")]
    both = marked.alias("x").join(starts.alias("y"), same).select(*[F.col(f"x.`{c}`") for c in marked.columns], "y._before", "y._size")
    inner = Window.partitionBy(*group, "_bucket").orderBy("_value", key)
    return both.withColumn("_rank", F.row_number().over(inner) + F.col("_before")).drop("_value", "_bucket", "_before")


def stratified_order(df: DataFrame, seed: int, region: str = "region", key: str = "id") -> DataFrame:
    """df with stratum and place, ordered so that every prefix is nearly stratified.

    A stratum is the region and the rarest label present (ties by name; NONE without spans). Its documents, shuffled by
    hash, get (k + u) / n; ordering by that spreads each stratum evenly. The whole is sorted once. The number of labels
    is fixed, so their counts are broadcast.
    """
    counts = df.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rarity = counts.agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_freq"))
    rarest = F.array_min(F.transform(F.array_distinct(F.transform("spans", lambda s: s["label"])), lambda lab: F.struct(F.try_element_at(F.col("_freq"), lab).alias("n"), lab.alias("label"))))["label"]
    marked = df.crossJoin(F.broadcast(rarity)).withColumn("stratum", F.concat_ws("|", F.coalesce(F.col(region), F.lit("?")), F.coalesce(rarest, F.lit("NONE")))).drop("_freq")
    u = (draw(F.lit(seed), F.lit("u"), F.col(key)) % 1_000_000) / 1_000_000
    places = ranked(marked, ["stratum"], draw(F.lit(seed), F.col(key)), key).withColumn("place", (F.col("_rank") - 1 + u) / F.col("_size"))
    return places.drop("_rank", "_size").orderBy("place", key)


def sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in order of a hash."""
    return df.orderBy(draw(F.lit(seed), F.col(key)), key).limit(n)


def shuffled(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    return df.orderBy(draw(F.lit(seed), F.col(key)), key)


def equal_share_sample(df: DataFrame, n: int, group: str, seed: int, key: str = "id") -> DataFrame:
    """n rows in equal shares over groups; what does not divide goes to the first groups by name. Group sizes are
    few, so their shares are broadcast."""
    groups = df.select(group).distinct().withColumn("_r", F.row_number().over(Window.orderBy(group)) - 1)
    total = groups.agg(F.count(F.lit(1)).alias("_g"))
    share = groups.crossJoin(F.broadcast(total)).select(group, (F.floor(F.lit(n) / F.col("_g")) + (F.col("_r") < F.lit(n) % F.col("_g")).cast("int")).alias("_share"))
    places = ranked(df, [group], draw(F.lit(seed), F.col(key)), key)
    return places.join(F.broadcast(share), group).where("_rank <= _share").drop("_rank", "_size", "_share").select(*df.columns)


def halves_sample(df: DataFrame, flag: str, n: int, seed: int, key: str = "id") -> DataFrame:
    """Half of n flagged, half not."""
    return sample(df.where(F.col(flag)), n // 2, seed, key).unionByName(sample(df.where(~F.col(flag)), n - n // 2, seed, key))


def one_window_each(df: DataFrame, seed: int, key: str = "id", part: str = "offset") -> DataFrame:
    """One row per key, chosen by hash."""
    w = Window.partitionBy(key).orderBy(draw(F.lit(seed), F.col(key), F.col(part)), part)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def preferred(df: DataFrame, key: str, prefer: str, order: str) -> DataFrame:
    """One row per key: a preferred one if there is, else the first."""
    w = Window.partitionBy(key).orderBy(F.desc(F.col(prefer).cast("int")), order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _templates(df: DataFrame, key: str) -> DataFrame:
    text = masked(F.col("text"), F.col("spans")) if "spans" in df.columns else F.col("text")
    return df.select(F.col(key).alias("id"), text.alias("text"))


def _classes(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, c; classes: c, h) of documents by their sorted shingle hashes: equal sets are one class."""
    hashes = F.array_sort(F.transform(shingles(words(F.col("text")), n), lambda g: F.xxhash64(g)))
    sets = _templates(df, key).select("id", hashes.alias("h"))
    named = sets.withColumn("c", F.md5(F.array_join(F.transform("h", lambda x: F.hex(x)), ",")))
    return named.select("id", "c"), named.groupBy("c").agg(F.first("h").alias("h"))


#: Counters of hashes, by which frequent ones are told: 4 MB, whatever the sets.
COUNTERS = 1 << 20
#: Sets that a worker orders together.
TOGETHER = 500


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(COUNTERS, dtype=np.int64)
    for b in batches:
        seen += np.bincount(b.column(0).flatten().to_numpy() % COUNTERS, minlength=COUNTERS)
    at = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["at", "n"])


def _counters(sets: DataFrame) -> np.ndarray:
    """How many hashes of sets(h) fall to each counter. A row a counter reaches the driver, whatever the sets."""
    rows = sets.select("h").mapInArrow(_counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(COUNTERS, dtype=np.int64)
    seen[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(seen, 2**31 - 1).astype(np.int32)


def _prefixes(sets: DataFrame, seen: Broadcast, threshold: float) -> DataFrame:
    """sets(c, h) -> (c, n, i, p): each set's size, and the first hashes in order of their counters, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, TOGETHER) for whole in batches for k in range(0, whole.num_rows, TOGETHER)):
            n = pc.list_value_length(b.column(1)).to_numpy().astype(np.int64)
            flat, owner = b.column(1).flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, seen.value[flat % COUNTERS], owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place < (n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1)[owner]
            own = owner[first]
            yield pa.record_batch([b.column(0).take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(place[first].astype(np.int32)), pa.array(flat[order[first]])], names=["c", "n", "i", "p"])

    return sets.select("c", "h").mapInArrow(run, f"c {sets.schema['c'].dataType.simpleString()}, n int, i int, p long")


def class_pairs(a: DataFrame, b: DataFrame, threshold: float, within: bool = False) -> DataFrame:
    """(c, d, jaccard) of classes (c, h) and (d, g) at or over the threshold; exact. within: both are the same classes,
    and of each pair only c < d is wanted.

    Prefix filter: a pair at the threshold shares a hash among the first |x| - ceil(t |x|) + 1 of either in any one order,
    so only those are joined. The order puts hashes with low counters first: a passage that many sets hold stands behind
    and joins few of them. The first hash that a pair shares has all they share from there on, so what follows it must be
    long enough on both sides. Sets meet once for each pair that is left. All joins of sets are merge joins, whose sides
    are never gathered; the counters are broadcast.
    """
    other = b.select(F.col("d").alias("c"), F.col("g").alias("h"))
    seen = a.sparkSession.sparkContext.broadcast(_counters(a if within else a.select("h").unionByName(other.select("h"))))
    left = _prefixes(a, seen, threshold)
    right = _prefixes(other, seen, threshold).toDF("d", "m", "j", "p")
    fits = (F.col("m") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("m") * threshold - 1e-9)
    ends = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= (F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-6
    some = left.hint("merge").join(right, "p").where(fits & ends)
    some = (some.where("c < d") if within else some).select("c", "d").distinct()
    both = some.hint("merge").join(a, "c").hint("merge").join(b, "d")
    size = F.size(F.array_intersect("h", "g"))
    return both.select("c", "d", (size / (F.size("h") + F.size("g") - size)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def _first_sets(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, first; sets: first, h): a class is named by its first document. Sets are written once, as they are
    read for the counters, the prefixes and the pairs."""
    hashes = F.array_sort(F.transform(shingles(words(F.col("text")), n), lambda g: F.xxhash64(g)))
    named = _templates(df, key).select("id", hashes.alias("h")).withColumn("c", F.md5(F.array_join(F.transform("h", lambda x: F.hex(x)), ",")))
    sets = kept(named.groupBy("c").agg(F.first("h").alias("h"), F.min("id").alias("first")), "sets")
    return named.select("id", "c").join(sets.select("c", "first"), "c").select("id", "first"), sets.select("first", "h")


def near_duplicates(candidates: DataFrame, pool: DataFrame, threshold: float = 0.8, n: int = 5, key: str = "id") -> DataFrame:
    """(key, other, jaccard): candidates whose masked text shares at least the threshold of n-word shingles with one of
    the pool; exact. Equal texts are compared once; those of the pool are one row, named by the first."""
    members, a = _first_sets(candidates, key, n)
    _, b = _first_sets(pool, key, n)
    pairs = class_pairs(a.withColumnRenamed("first", "c"), b.select(F.col("first").alias("d"), F.col("h").alias("g")), threshold)
    return pairs.join(members.withColumnRenamed("first", "c"), "c").select(F.col("id").alias(key), F.col("d").alias("other"), "jaccard")


def near_duplicates_within(df: DataFrame, threshold: float = 0.8, n: int = 5, key: str = "id") -> DataFrame:
    """(key, other, jaccard) of all documents with all: pairs of class representatives, the later first, and for every
    other member of a class a row that names its representative."""
    members, sets = _first_sets(df, key, n)
    pairs = class_pairs(sets.withColumnRenamed("first", "c"), sets.select(F.col("first").alias("d"), F.col("h").alias("g")), threshold, True)
    same = members.where("id <> first").select("id", F.col("first").alias("other"), F.lit(1.0).alias("jaccard"))
    return pairs.select(F.col("d").alias("id"), F.col("c").alias("other"), "jaccard").unionByName(same).withColumnRenamed("id", key)


#: Documents of a group, and hashes of their sets, that a worker compares at once; a larger group is dealt to pairs of blocks.
AT_ONCE, HASHES_AT_ONCE = 4096, 4 << 20
#: Pairs that leave a worker together.
PAIRS = 50_000


def _near_in(run: pa.Table, threshold: float, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (p, q) of the documents of one run whose sets reach the threshold, and their similarity. A hash that one set
    has alone is in no intersection; sets stand in order of size, so those that can reach it follow each other."""
    sets = run.column("h").combine_chunks()
    size = pc.list_value_length(sets).to_numpy().astype(np.int64)
    order = np.argsort(size, kind="stable")
    rank = np.empty(len(size), dtype=np.int64)
    rank[order] = np.arange(len(size))
    values, code, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    at, code = np.repeat(rank, size)[shared], code[shared]
    code = code[np.argsort(at, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(size)))])
    size, key = size[order], run.column("key")[0].as_py()
    part, pool = (run.column(x).to_numpy()[order] for x in ("part", "pool"))
    cross = run.column("cross")[0].as_py()
    keys = [set(x) for x in run.column("keys").take(pa.array(order)).to_pylist()]
    alone = np.array([len(k) == 1 for k in keys])
    mark = np.zeros(len(values), dtype=bool)
    last = np.searchsorted(size, size / threshold + 1e-9, "right")
    for p, end in enumerate(last[:-1]):
        own, others = code[starts[p] : starts[p + 1]], code[starts[p + 1] : starts[end]]
        if not len(own) or not len(others):
            continue
        mark[own] = True
        sums = np.concatenate([[0], np.cumsum(mark[others])])
        mark[own] = False
        both = np.diff(sums[starts[p + 1 : end + 1] - starts[p + 1]])
        share = both / (size[p] + size[p + 1 : end] - both)
        q = np.flatnonzero(share >= threshold)
        share, q = share[q], q + p + 1
        # each pair comes from one run: between two blocks, or two sides, and by the least key that both have
        wanted = (part[q] != part[p]) | (not cross)
        wanted &= (pool[q] != pool[p]) | one
        if not alone[p]:
            wanted &= (alone[q] | np.array([min(keys[p] & keys[k]) == key for k in q], dtype=bool))
        q, share = q[wanted], share[wanted]
        if len(q):
            yield np.full(len(q), order[p]), order[q], share


def _compared(threshold: float, one: bool):
    """Rows sorted by (key, sub): the pairs (c, d, jaccard) of each run; unless all is one table, those of a candidate c and
    a row d of the pool."""

    def pairs(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.Table.from_batches(pieces).combine_chunks()
        ids, pool = run.column("c").combine_chunks(), run.column("pool").to_numpy()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            p, q, share = (np.concatenate(x) for x in zip(*held))
            p, q = np.where(pool[p], q, p), np.where(pool[p], p, q)
            held.clear()
            return pa.record_batch([ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(share)], names=["c", "d", "jaccard"])

        for some in _near_in(run, threshold, one):
            held.append(some)
            if sum(len(x[0]) for x in held) >= PAIRS:
                yield out()
        if held:
            yield out()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []
        for b in batches:
            key, sub = b.column("key").to_numpy(), b.column("sub").to_numpy()
            ends = [*(np.flatnonzero((np.diff(key) != 0) | (np.diff(sub) != 0)) + 1), b.num_rows] if b.num_rows else []
            for i, j in zip([0, *ends[:-1]], ends):
                if pieces and (key[i], sub[i]) != now:
                    yield from pairs(pieces)
                    pieces = []
                now = key[i], sub[i]
                pieces.append(b.slice(i, j - i))
        if pieces:
            yield from pairs(pieces)

    return runs


def near_duplicates_lsh(candidates: DataFrame, pool: DataFrame, threshold: float = 0.8, n: int = 5, key: str = "id", at_once: int = AT_ONCE, hashes_at_once: int = HASHES_AT_ONCE) -> DataFrame:
    """The same by MinHash: pairs that share one of the bands of 32 by four permutations, their sets of hashed shingles then
    compared; 5 pairs in 10^8 at Jaccard 0.8 share none. If both sides are one DataFrame, of each pair the later id comes
    first. Documents are read twice, so they must be the same both times.

    No set and no pair of texts is sent: a band's documents have one key, of its document with the least hash; texts that
    have a key go to it, once for each of their keys, and are cut into shingles again there. A crowded key is dealt to pairs
    of blocks. Bands with only their ids and sizes are sent once; the pairs found are written.
    """
    from opalspan.operators.lsh_index import bands

    one = candidates is pool
    side = lambda df, pool: _templates(df, key).select(F.lit(pool).alias("pool"), F.col("id").alias("c"), "text").where("c is not null and text is not null")
    docs = side(candidates, False) if one else side(candidates, False).unionByName(side(pool, True))
    grams = F.array_distinct(F.transform(shingles(words(F.col("text")), n), lambda g: F.xxhash64(g)))
    marks = bands(docs.select("c", grams.alias("h"), "pool").withColumn("n", F.size("h")), "pool", "n")
    of = Window.partitionBy("band")
    met = marks.select("pool", "c", "n", F.min(F.xxhash64("pool", "c")).over(of).alias("key"), F.count(F.lit(1)).over(of).alias("k"), (F.min("pool").over(of) != F.max("pool").over(of)).alias("sides"))
    proposed = kept(met.where("k > 1" if one else "sides").select("key", "pool", "c", "n").distinct(), "proposed")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) * 2 / at_once, F.sum("n") * 2 / hashes_at_once)).cast("int")
    crowded = proposed.groupBy("key").agg(blocks.alias("blocks")).where("blocks > 2")
    keyed = kept(proposed.groupBy("pool", "c").agg(F.collect_set("key").alias("keys")), "keys")
    # texts without a key go before the join, most of them by the filter: none are shuffled for it
    filled = bloom.built(keyed.select(F.xxhash64("pool", "c").alias("_h")), "_h")
    some = docs.crossJoin(F.broadcast(filled)).where(bloom.may_hold(F.col("_bloom"), F.xxhash64("pool", "c"))).select("pool", "c", "text")
    rows = some.join(keyed, ["pool", "c"]).withColumn("key", F.explode("keys")).join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("c", "pool", "text"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sub = F.least("part", "other") * F.col("blocks") + F.greatest("part", "other")
    rows = rows.select("key", sub.alias("sub"), (F.col("part") != F.col("other")).alias("cross"), "part", "pool", "c", "keys", "text")
    runs = rows.repartition("key", "sub").sortWithinPartitions("key", "sub").select("key", "sub", "cross", "part", "pool", "c", "keys", grams.alias("h"))
    kind = docs.schema["c"].dataType.simpleString()
    pairs = runs.mapInArrow(_compared(threshold, one), f"c {kind}, d {kind}, jaccard double")
    if one:
        return kept(pairs.where("c <> d").select(F.greatest("c", "d").alias(key), F.least("c", "d").alias("other"), "jaccard"), "pairs")
    types = [df.schema[key].dataType for df in (candidates, pool)]
    return kept(pairs.select(F.col("c").cast(types[0]).alias(key), F.col("d").cast(types[1]).alias("other"), "jaccard"), "pairs")


def take_deduped(candidates: DataFrame, duplicates: DataFrame, k: int, order: str, key: str = "id") -> DataFrame:
    """The first k candidates, in order, that are no duplicates."""
    return candidates.join(duplicates.select(key).distinct(), key, "left_anti").orderBy(order, key).limit(k)


def splits(train: DataFrame, validation: DataFrame, pool: int, nested: list[int], sizes: dict[str, int], holdout: list[str], seed: int, threshold: float = 0.8, region: str = "region", key: str = "id") -> DataFrame:
    """(key, split): nested prefixes of a stratified pool, then dev, test_id and test_holdout_regions from validation,
    disjoint and free of near-duplicates of the pool."""
    away = F.coalesce(F.col(region).isin(holdout), F.lit(False)) if holdout else F.lit(False)
    # the first rows by place are as many as the parameters say, so numbering them in one window is bounded
    numbered = lambda df, n: df.limit(n).withColumn("rank", F.row_number().over(Window.orderBy("place", key)))
    most = numbered(stratified_order(train.where(~away), seed, region, key), pool)
    out = most.select(key, F.explode(F.filter(F.array(*[F.when(F.col("rank") <= n, F.lit(f"train_{n}")) for n in [pool, *nested]]), lambda x: x.isNotNull())).alias("split"))
    near = near_duplicates(validation, most, threshold, key=key)
    placed = stratified_order(validation, seed + 1, region, key).join(near.select(key).distinct(), key, "left_anti")
    dev, test = sizes.get("dev", 0), sizes.get("test_id", 0)
    home = numbered(placed.where(~away).orderBy("place", key), dev + test)
    out = out.unionByName(home.select(key, F.when(F.col("rank") <= dev, "dev").otherwise("test_id").alias("split")))
    if holdout:
        far = placed.where(away).orderBy("place", key).limit(sizes.get("test_holdout_regions", 0))
        out = out.unionByName(far.select(key, F.lit("test_holdout_regions").alias("split")))
    return out


def transcripts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """turns(key, turn, role, text, spans) -> (key, text, spans): 'Role: text' lines in order, spans moved along;
    turns of the role `action` are left out."""
    speaker = F.initcap("role")
    line = turns.where("role <> 'action'").withColumn("line", F.concat(speaker, F.lit(": "), "text"))
    w = Window.partitionBy(key).orderBy("turn")
    offset = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length(speaker) + 2
    moved = line.withColumn("_o", offset.cast("int"))
    moved = moved.withColumn("spans", F.transform("spans", lambda s: s.withField("start", s["start"] + F.col("_o")).withField("end", s["end"] + F.col("_o"))))
    parts = moved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "line", "spans"))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"), F.flatten(F.transform("p", lambda x: x["spans"])).cast(SPANS).alias("spans"))


def consistent(expected: DataFrame, matched: DataFrame, key: str = "conv_id") -> DataFrame:
    """Keys for which no type was expected more often than matched; expected and matched are (key, turn, type)."""
    count = lambda df, n: df.groupBy(key, "turn", "type").agg(F.count(F.lit(1)).alias(n))
    short = count(expected, "want").join(count(matched, "have"), [key, "turn", "type"], "left").where(F.col("want") > F.coalesce("have", F.lit(0)))
    return expected.select(key).distinct().join(short.select(key).distinct(), key, "left_anti")


def card_spans(text: Column, card: Column) -> Column:
    """Occurrences of a scenario's values(label, text) in a conversation, longest first, any case, no overlaps."""
    from opalspan.operators.rules import labelled

    return F.transform(labelled(text, card), lambda s: span(s["start"], s["end"], s["label"], s["text"]))


def statistics(df: DataFrame, language: str = "lang") -> DataFrame:
    """(measure, name, value): rows, characters, rows per language, spans per label, quantiles of length."""
    row = lambda m, n, v: F.struct(F.lit(m).alias("measure"), n.cast("string").alias("name"), v.cast("double").alias("value"))
    size = F.length("text")
    q = F.percentile(size, F.array(F.lit(0.5), F.lit(0.95)))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("c"), q.alias("q"), F.max(size).alias("m"))
    out = whole.select(F.explode(F.array(row("rows", F.lit(""), F.col("n")), row("chars", F.lit(""), F.col("c")), row("length", F.lit("p50"), F.floor(F.col("q")[0])), row("length", F.lit("p95"), F.floor(F.col("q")[1])), row("length", F.lit("max"), F.col("m")))).alias("r"))
    per = df.groupBy(language).agg(F.count(F.lit(1)).alias("n")).select(row("rows_per_language", F.col(language), F.col("n")).alias("r"))
    out = out.unionByName(per)
    if "spans" in df.columns:
        labels = df.select(F.explode("spans").alias("s")).groupBy("s.label").agg(F.count(F.lit(1)).alias("n")).select(row("spans_per_label", F.col("label"), F.col("n")).alias("r"))
        out = out.unionByName(labels)
    return out.select("r.*")


def bad_examples(df: DataFrame, order: str, key: str = "id", n: int = 5, each: int = 3) -> DataFrame:
    """The first n rows of df(key, errors), in order, that have errors, with their first few. A task keeps n."""
    return df.where(F.size("errors") > 0).orderBy(order).limit(n).select(key, F.slice("errors", 1, each).alias("errors"))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def disjoint(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys in both, prefixes such as train- and suffixes such as #3 apart; empty if the sets are disjoint."""
    bare = lambda df: df.select(F.regexp_replace(F.regexp_replace(F.col(key).cast("string"), r"^(train|validation|test)-", ""), r"#\d+$", "").alias(key)).distinct()
    return bare(a).join(bare(b), key, "left_semi")


def numbered_spans(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, span_idx, label, text): spans by start, numbered from 0 in their document, as an audit sheet names them."""
    return df.select(key, F.posexplode(by_start(F.col("spans"))).alias("span_idx", "s")).select(key, "span_idx", "s.label", "s.text")


def audited(spans: DataFrame, verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every span of the sheet with its verdict, ok where there is none; a verdict without a span is left out."""
    return spans.join(verdicts, [key, "span_idx"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("ok")))


def mixture(parts: dict[str, DataFrame], seed: int, key: str = "id") -> DataFrame:
    """All rows of the parts, with their name as source, in one shuffled order; parts need the same columns."""
    named = [df.withColumn("source", F.lit(name)) for name, df in parts.items()]
    whole = named[0]
    for df in named[1:]:
        whole = whole.unionByName(df)
    return shuffled(whole, seed, key)


def in_region(pool: DataFrame, test: DataFrame, train: DataFrame, regions: list[str], n: int, seed: int, threshold: float = 0.8, region: str = "region", key: str = "id") -> DataFrame:
    """n documents of the regions in stratified order, none of them in the test set nor a near-duplicate of training."""
    own = pool.where(F.col(region).isin(regions)).join(test.select(key).distinct(), key, "left_anti")
    near = near_duplicates(own, train, threshold, key=key)
    return stratified_order(own, seed, region, key).join(near.select(key).distinct(), key, "left_anti").orderBy("place", key).limit(n)
