"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import connected_components, contract, partitions, small_batches, written

SEED = 42
#: Segments of a fingerprint on the ring, their width, and the links' greatest Hamming distance.
SEGMENTS, WIDTH, DISTANCE = 4, 16, 3
#: Rows under one ring key, its own and changed ones, from which they are dealt to pairs of blocks.
HOT = 16384
#: Runs of one key up to this length are compared by shifts, longer ones by blocks of a matrix.
SHORT, BLOCK = 48, 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingles' 64-bit hashes: a bit is set if it is set in over half of them; of none, 0."""
    ones = np.zeros(64, dtype=np.int64)
    h = h.astype("<u8", copy=False)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype="<u8")
        yield pa.record_batch([b.column(0), pa.array(found.view("<i8"))], names=["doc_id", "fp"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per input row, fp as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _ring_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under (segment, next segment) of every place on the ring, and with one bit of the next changed.

    Chains: a pair within distance 3 has a place whose first segment is equal and whose first two differ in at most
    one bit. Changing a bit changes parity, so only fingerprints of even parity send changed keys.
    """
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view("<u8")
        keys, who, role = [], [], []
        seg = [(fp >> np.uint64(WIDTH * i)) & np.uint64(0xFFFF) for i in range(SEGMENTS)]
        for i in range(SEGMENTS):
            after = seg[(i + 1) % SEGMENTS]
            base = (np.uint64(i) << np.uint64(32)) | (seg[i] << np.uint64(16))
            keys.append(base | after)
            who.append(fp)
            role.append(np.zeros(len(fp), dtype=np.int8))
            even = np.bitwise_count(after) % 2 == 0
            for bit in range(WIDTH):
                keys.append((base | (after ^ np.uint64(1 << bit)))[even])
                who.append(fp[even])
                role.append(np.ones(int(even.sum()), dtype=np.int8))
        yield pa.record_batch([pa.array(np.concatenate(keys).view("<i8")), pa.array(np.concatenate(who).view("<i8")), pa.array(np.concatenate(role))], names=["key", "fp", "role"])


def _viable(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The remaining chains of the ring, then the whole distance: 2 bits in three segments, 3 in all four."""
    place = key >> np.uint64(32)
    third = ((place + np.uint64(2)) % np.uint64(SEGMENTS)) * np.uint64(WIDTH)
    second = ((place + np.uint64(1)) % np.uint64(SEGMENTS)) * np.uint64(WIDTH)
    diff = x ^ y
    count = np.bitwise_count((diff >> second) & np.uint64(0xFFFF)).astype(np.int8) + np.bitwise_count((diff >> third) & np.uint64(0xFFFF)).astype(np.int8)
    return (count <= 2) & (np.bitwise_count(diff) <= DISTANCE) & (diff != 0)


def _run_links(key: np.uint64, fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one long run, contracted block by block: never more links than fingerprints are kept."""
    home = fp[role == 0]
    a, b = home[:0], home[:0]
    for i in range(0, len(home), BLOCK):
        x = home[i : i + BLOCK, None]
        for other, first in ((home, i), (fp[role == 1], 0)):
            for j in range(first, len(other), BLOCK):
                y = other[None, j : j + BLOCK]
                r, c = np.nonzero(_viable(key, x, y))
                if len(r):
                    p, q = contract(np.concatenate([a, x[r, 0]]), np.concatenate([b, y[0, c]]))
                    a, b = p, q
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sub): links of each run, contracted."""

    def out(k: np.ndarray, s: np.ndarray, fp: np.ndarray, role: np.ndarray) -> pa.RecordBatch | None:
        if len(k) < 2:
            return None
        edge = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(k)]]))
        a, b = [fp[:0]], [fp[:0]]
        for at in np.flatnonzero(sizes > SHORT):
            lo, hi = starts[at], starts[at] + sizes[at]
            p, q = _run_links(k[lo], fp[lo:hi], role[lo:hi])
            a.append(p)
            b.append(q)
        few = np.repeat((sizes <= SHORT) & (sizes > 1), sizes)
        k, s, fp, role = k[few], s[few], fp[few], role[few]
        for shift in range(1, min(SHORT, len(k))):
            same = np.flatnonzero((k[shift:] == k[:-shift]) & (s[shift:] == s[:-shift]))
            if not len(same):
                break
            x, y = fp[same], fp[same + shift]
            good = _viable(k[same], x, y) & ((role[same] == 0) | (role[same + shift] == 0))
            a.append(x[good])
            b.append(y[good])
        p, q = contract(np.concatenate(a), np.concatenate(b))
        return pa.record_batch([pa.array(p.view("<i8")), pa.array(q.view("<i8"))], names=["src", "dst"]) if len(p) else None

    kept: list[tuple] = []
    size = 0
    for b in batches:
        now = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(now[0]):
            continue
        now = (now[0].view("<u8"), now[1], now[2].view("<u8"), now[3])
        kept.append(now)
        size += len(now[0])
        if size < 200_000:
            continue
        k, s, fp, role = (np.concatenate(x) for x in zip(*kept))
        cut = int(np.flatnonzero((k == k[-1]) & (s == s[-1]))[0])
        if cut:
            if (r := out(k[:cut], s[:cut], fp[:cut], role[:cut])) is not None:
                yield r
        kept, size = [(k[cut:], s[cut:], fp[cut:], role[cut:])], 0
    if kept:
        k, s, fp, role = (np.concatenate(x) for x in zip(*kept))
        if (r := out(k, s, fp, role)) is not None:
            yield r


def dealt_keys(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fp -> (key, sub, fp, role): each fingerprint under its ring keys.

    A key with more than `hot` rows, whether they are its own or sent by its neighbours, is dealt to pairs of blocks, so
    that no task gets an unbounded run: about 2 * hot rows at most.
    """
    spark = fps.sparkSession
    small_batches(spark, 10_000)
    rows = fps.select("fp").mapInArrow(_ring_keys, "key long, fp long, role byte")
    seg = lambda i: F.shiftright("fp", WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    home = F.array(*[F.lit(i << 32).cast("long").bitwiseOR(F.shiftleft(seg(i), 16)).bitwiseOR(seg(i + 1)) for i in range(SEGMENTS)])
    # rows of a key: its own, and those that its 16 neighbours of even parity send. A key over `hot` rows has 1/17 of
    # them from itself or from one neighbour, so only keys with that many are looked at
    many = fps.select(F.explode(home).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * (WIDTH + 1) > hot)
    even = F.bit_count(F.col("key").bitwiseAND(F.lit(0xFFFF).cast("long"))) % 2 == 0
    sent = F.array(*[F.col("key").bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(WIDTH)])
    to = F.concat(F.array("key"), F.when(even, sent).otherwise(F.array().cast("array<long>")))
    crowded = many.select(F.explode(to).alias("key"), "n").groupBy("key").agg((F.sum("n") + F.lit(hot)).alias("n")).where(F.col("n") > 2 * hot)
    crowded = crowded.select("key", F.ceil(F.col("n") * 2 / hot).cast("int").alias("blocks"))
    dealt = rows.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o)
    dealt = dealt.withColumn("sub", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))))
    return dealt.select("key", "sub", "fp", "role")


def link_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fp -> (src, dst) links that span every group of fingerprints within distance 3."""
    rows = dealt_keys(fps, hot).repartition(partitions(fps.sparkSession), "key", "sub").sortWithinPartitions("key", "sub")
    return rows.mapInArrow(_links, "src long, dst long")


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """Distinct fp, with further columns -> the same with root: one fingerprint of all those that links of at most 3 bits
    join, found by the ring."""
    groups = connected_components(link_fingerprints(fps))
    return fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Links: fingerprints that differ in at most 3 bits. component_id is the smallest doc_id reachable. Null and empty
    texts have fingerprint 0 and link like any other; a null doc_id never names a component (its component is the
    smallest other doc_id there, or null); repeated rows stay; an empty table gives no rows.
    Whole texts are read once; equal fingerprints are one node, so groups of copies cost one row.
    """
    marks = written(signatures(docs), "fingerprints")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = fingerprint_groups(nodes)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = named.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return marks.join(whole, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with their columns, whose doc_id is the smallest of its group; an equal row stays once. Rows
    with a null doc_id stay, as no group can be named by them. Groups (doc_id, component_id) are those of
    near_duplicates unless others are given."""
    groups = near_duplicates(docs) if groups is None else groups
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # whatever the columns are called
    named = rows.where(F.col("row.doc_id").isNotNull()).join(first, F.col("row.doc_id").cast("long") == F.col("first"), "left_semi")
    return named.dropDuplicates().unionByName(rows.where(F.col("row.doc_id").isNull())).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
