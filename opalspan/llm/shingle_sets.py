"""Near-duplicates by their sets of word shingles: SimHash fingerprints on the pigeonring propose pairs, MinHash bands those
whose fingerprints lie further apart, and the sets themselves confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalspan.llm.common import connected_components, contract, partitions, small_batches, written
from opalspan.llm.simhash import fingerprint_groups, majority

SEED = 42
#: Words of a shingle, and the least share of shingles (Jaccard) of a near-duplicate.
WORDS, SIMILARITY = 5, 0.8
#: A pair is proposed if all minima of one band are equal. At Jaccard 0.8 no band is with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: Different sets, and bytes of them, under one band key from which the key's rows are dealt to pairs of blocks.
HOT, HOT_BYTES = 4096, 16 << 20
#: Proposed sets up to which their names are broadcast; beyond that sets are shuffled to them.
FEW = 20_000

_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles; a shorter text is one shingle, one without words has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    code = {x: xxhash.xxh64_intdigest(x, SEED) for x in set(w)}
    h = np.array([code[x] for x in w], dtype=np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mixed(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _bands(s: np.ndarray) -> np.ndarray:
    """One key per band, none for an empty set."""
    if not len(s):
        return s
    low = np.full(len(_FACTORS), 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(low, (_FACTORS[:, None] * s[None, k : k + 4096]).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mixed(key + column)
    return key


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        keys = pa.array([_bands(s).view("<i8") for s in sets], pa.list_(pa.int64()))
        fps = np.array([majority(s) for s in sets], dtype="<u8").view("<i8")
        yield pa.record_batch([b.column(0), pa.array([_name(s) for s in sets], pa.int64()), pa.array(fps), keys], names=["doc_id", "node", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column(0).to_pylist()]
        yield pa.record_batch([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])


def run_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every group of one run. A node is compared with all that are not in its group yet."""
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(values), dtype=bool)
    rest, have = np.arange(1, len(nodes)), flat[starts[1] :]
    queue, a, b = [0], [], []
    while len(rest):
        if not queue:
            queue, have, rest = [rest[0]], have[size[rest[0]] :], rest[1:]
            continue
        p = queue.pop()
        own = flat[starts[p] : starts[p + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[have], np.concatenate([[0], np.cumsum(size[rest])[:-1]]), dtype=np.int64)
        mark[own] = False
        near = both >= similarity * (size[rest] + size[p] - both) - 1e-9
        if near.any():
            hit = rest[near]
            queue += hit.tolist()
            a.append(np.full(len(hit), nodes[p]))
            b.append(nodes[hit])
            have, rest = have[np.repeat(~near, size[rest])], rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sub): confirmed links of each run, contracted batch by batch."""
    now, nodes, sets = None, [], []
    a, b = [], []

    def done() -> None:
        if len(nodes) > 1:
            p, q = run_links(np.array(nodes, dtype=np.int64), sets)
            if len(p):
                a.append(p)
                b.append(q)

    for batch in batches:
        for key, sub, node, items in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (key, sub) != now:
                done()
                now, nodes, sets = (key, sub), [], []
            nodes.append(node)
            sets.append(np.frombuffer(items, dtype=np.uint64))
        if a:
            p, q = contract(np.concatenate(a), np.concatenate(b))
            a, b = [], []
            yield pa.record_batch([pa.array(p), pa.array(q)], names=["src", "dst"])
    done()
    if a:
        p, q = contract(np.concatenate(a), np.concatenate(b))
        yield pa.record_batch([pa.array(p), pa.array(q)], names=["src", "dst"])


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fp, keys) of each row, written: the name of its set of shingles, the set's SimHash fingerprint, and
    its band keys, none for an empty set."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(_marks, "doc_id long, node long, fp long, keys array<long>"), "bands")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Different (node, fp) -> (key, node): nodes whose fingerprints links of at most 3 bits join have one key; a node
    without others has none."""
    fps = written(nodes.select("fp").distinct(), "fps")
    keyed = nodes.join(fingerprint_groups(fps).withColumnRenamed("root", "key"), "fp").select("key", "node")
    return keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")


def open_keys(held: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, node) of the keys whose nodes the links (node, component) don't all join already."""
    named = held.join(linked, "node", "left").select("key", F.coalesce("component", "node").alias("c"))
    left = named.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
    return held.join(left, "key", "left_semi")


def confirmed(held: DataFrame, sets: DataFrame, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(key, node) and (node, items) -> (src, dst): links that span the groups of each key, by the sets. A key with very
    many sets, or very large ones, is dealt to pairs of blocks."""
    sizes = sets.select("node", F.length("items").alias("bytes"))
    crowded = held.join(sizes, "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where((F.col("n") > hot) | (F.col("bytes") > hot_bytes))
    crowded = crowded.select("key", F.ceil(F.greatest(F.col("n") * 2 / hot, F.col("bytes") * 2 / hot_bytes)).cast("int").alias("blocks"))
    dealt = held.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o)
    dealt = dealt.withColumn("sub", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))))
    rows = dealt.join(sets, "node").select("key", "sub", "node", "items").repartition(partitions(held.sparkSession), "key", "sub").sortWithinPartitions("key", "sub")
    small_batches(held.sparkSession)
    return written(rows.mapInArrow(_links, "src long, dst long"), "links")


def near_duplicates(docs: DataFrame, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, node, component_id) for each row of docs; node names its set of shingles.

    Links: sets with Jaccard >= SIMILARITY. component_id is the smallest doc_id reachable. Texts without words are
    equal; a null doc_id never names a component; repeated rows stay; an empty table gives no rows.

    SimHash comes first: nodes whose fingerprints the pigeonring joins are compared by their sets. At this similarity
    fingerprints may differ in more bits than a ring can find, so band keys propose what is left: those whose nodes are
    not all joined by then. Keys with the same nodes count once. Texts are read twice: once for fingerprints and bands,
    once for the sets of the nodes that are proposed.
    """
    marks = marked(docs)
    nodes = marks.groupBy("node").agg(F.min("doc_id").alias("low"))
    different = marks.dropDuplicates(["node"])
    near = written(by_fingerprint(different.where(F.size("keys") > 0).select("node", "fp")), "near")
    keyed = different.select("node", F.explode("keys").alias("key"))
    # keys with the same nodes propose the same pairs: of those, one stays
    same = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    shared = keyed.groupBy("key").agg(*same).where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    held = written(keyed.join(shared, "key", "left_semi"), "proposed")
    some = written(held.select("node").union(near.select("node")).distinct(), "proposed_nodes")
    side = F.broadcast(some) if some.count() <= FEW else some
    small_batches(docs.sparkSession)
    sets = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_sets, "node long, items binary").join(side, "node", "left_semi")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    first = confirmed(near, sets, hot, hot_bytes)
    rest = written(open_keys(held, connected_components(first)), "open")
    groups = connected_components(first.unionByName(confirmed(rest, sets, hot, hot_bytes)))
    named = nodes.join(groups.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("component", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = named.select("node", "root").join(lowest, "root").select("node", "component_id")
    return marks.join(whole, "node").select("doc_id", "node", "component_id")
