"""Removal of long repeated byte strings by bucket-pointer refinement of suffix buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import discard, partitions, small_batches, written

#: Bytes of a string that counts as repeated, and of a passage: fewer than 50 words of ordinary text have.
LENGTH, PASSAGE = 400, 200
#: Bytes of text that are hashed at once, and context bytes that are refined at once.
PIECE, CHUNK = 1 << 19, 1 << 19
#: Distinct contexts of one initial bucket from which Spark refines the bucket, not one task.
HOT = 4_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
    inverse = pow(_MULTIPLIER, -1, 2**64)
    power = np.ones(n + 1, dtype=np.uint64)
    back = np.ones(n + 1, dtype=np.uint64)
    power[1:] = np.uint64(_MULTIPLIER)
    back[1:] = np.uint64(inverse)
    return table, np.multiply.accumulate(power), np.multiply.accumulate(back)


def _slide(v: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every window of `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        v = op(v[:-done], v[done:])
        done *= 2
    rest = width - done
    return op(v[: len(v) - rest], v[rest:]) if rest else v


class Anchors:
    """Selected q-grams of texts: every string of `length` bytes holds one, chosen by content alone."""

    def __init__(self, length: int) -> None:
        self.q = length // 2
        self.window = length - self.q + 1
        self.table, self.power, self.back = _tables(PIECE + 2 * length)
        bits = np.arange(256)
        self.rank = sum(((bits >> k) & 1) << (7 - k) for k in range(8)).astype(np.uint64)
        self.length = length

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data: texts end to end; ends: where each ends. Positions of anchors, their hashes (56 bits), and whether
        a string that holds the anchor may hold an equal q-gram too (periodic text repeats within itself)."""
        q, w = self.q, self.window
        n = len(data) - q + 1
        if n < w:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.power[: len(data)], dtype=np.uint64)])
        h = (sums[q:] - sums[:-q]) * self.back[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        v = (h & ~np.uint64(255)) | np.resize(self.rank, n)
        for e in ends[:-1].tolist():
            v[max(0, e - q + 1) : e] = np.uint64(2**64 - 1)
        low = _slide(v, w, np.minimum)
        pad = np.zeros(w - 1, np.uint64)
        chosen = _slide(np.concatenate([pad, low, pad]), w, np.maximum) == v
        at = np.flatnonzero(chosen & (v != np.uint64(2**64 - 1)))
        other = _slide(v ^ np.uint64(255), w, np.minimum)
        tied = ((low ^ other) & np.uint64(255)) != np.uint64(255)
        upto = np.concatenate([[0], np.cumsum(tied)])
        again = upto[np.minimum(at + 1, len(tied))] > upto[np.clip(at - w + 1, 0, len(tied))]
        return at, h[at] >> np.uint64(8), again


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _key(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - 2**63


def _anchor_rows(length: int):
    """(doc_id, text, and where there is a third column, runs outside which nothing repeats) -> anchors with the ends of
    their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length)
        q = finder.q
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[list] = [[], [], [], [], [], [], []]
            limits = b.column(2).to_pylist() if b.num_columns > 2 else None

            def flush(pieces: list[tuple[int, int, bytes]], found: dict[int, dict]) -> None:
                if not pieces:
                    return
                data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
                ends = np.cumsum([len(p[2]) for p in pieces])
                at, h, again = finder.find(data, ends)
                which = np.searchsorted(ends, at, side="right")
                starts = ends - np.array([len(p[2]) for p in pieces])
                for k, a, x, y in zip(which.tolist(), (at - starts[which]).tolist(), h.tolist(), again.tolist()):
                    known = found.setdefault(pieces[k][0], {})
                    known[a + pieces[k][1]] = x, y or known.get(a + pieces[k][1], (x, y))[1]

            pieces: list[tuple[int, int, bytes]] = []
            found: dict[int, dict] = {}
            size, raws, runs = 0, {}, []  # runs: row, first and last byte, in the order of pieces' first part
            for i, t in enumerate(b.column(1).to_pylist()):
                raw = _bytes(t)
                for first, last in [(0, len(raw))] if limits is None else merged(limits[i] or [], len(raw)):
                    if last - first < length:
                        continue
                    raws[i] = raw
                    runs.append((i, first, last))
                    for lo in range(first, max(first + 1, last - length + 1), PIECE - length):
                        part = raw[lo : min(last, lo + PIECE)]
                        if size + len(part) > PIECE:
                            flush(pieces, found)
                            pieces, size = [], 0
                        pieces.append((len(runs) - 1, lo, part))
                        size += len(part)
            flush(pieces, found)
            digest, keys = xxhash.xxh3_64_intdigest, {i: _key(raw) for i, raw in raws.items()}
            for run_at, marks in found.items():
                i, first, last = runs[run_at]
                view = memoryview(raws[i])
                for a, (h, again) in marks.items():
                    lo, hi = max(first, a - (length - q)), min(last, a + length)
                    if hi - lo < length:
                        continue
                    for c, x in zip(out, (ids[i], keys[i], h, digest(view[lo:hi], a - lo) - 2**63, lo, hi, again)):
                        c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "tkey", "h", "ctx", "s", "e", "again"])

    return run


def _subset(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tkey, text, wanted) -> contexts of the wanted anchors."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for d, k, t, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
            raw = _bytes(t)
            for w in wanted:
                for c, x in zip(out, (d, k, w["h"], w["s"], raw[w["s"] : w["e"]], w["many"], w["crowd"])):
                    c.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "tkey", "h", "lo", "ctx", "many", "crowd"])


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Of each string of q bytes a 64-bit hash, its initial bucket: differences of prefix sums, made independent of
    their place, then mixed."""
    n = len(data) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if len(data) > len(_GRAMS[1]) - 1:
        _GRAMS[:] = _tables(2 * len(data))
    table, power, back = _GRAMS
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[q:] - sums[:-q]) * back[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


_GRAMS = list(_tables(1 << 10))


def refine(data: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Bucket of each position: equal buckets hold equal strings of `length` bytes; -1 where fewer bytes are left
    (room) or the bucket has one member.

    Bucket-pointer refinement. Initial buckets are q-grams of an eighth of the length. A bucket is then sorted on the
    bucket identifiers at a later offset, the depth reached so far, which are themselves the refined ones; singletons
    leave.
    """
    n = len(data)
    bucket = np.full(n, -1, dtype=np.int32)
    if n < length:
        return bucket
    depth = max(1, length // 8)
    usable = np.flatnonzero(room >= depth)
    bucket[usable] = np.unique(grams(data, depth)[usable], return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        need = np.flatnonzero((room >= depth + step) & (bucket >= 0))
        first, later = bucket[need], bucket[need + step]
        good = later >= 0
        need, first, later = need[good], first[good], later[good]
        bucket = np.full(n, -1, dtype=np.int32)
        if len(need):
            pair = first.astype(np.int64) * (int(later.max()) + 1) + later
            _, at, count = np.unique(pair, return_inverse=True, return_counts=True)
            keep = count[at] > 1
            bucket[need[keep]] = at[keep]
        depth += step
    bucket[room < length] = -1
    return bucket


def repeated_starts(contexts: list[bytes], owner: list[int], lo: list[int], many: list[bool], length: int) -> list[np.ndarray]:
    """For each context, starts (in its text) of strings that also start elsewhere.

    owner and lo place a context in its text, so that one place seen in two contexts is one place; many: the context
    stands for several equal ones.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    bucket = refine(data, sizes[which] - inside, length)
    at = np.flatnonzero(bucket >= 0)
    place = (np.array(owner, dtype=np.int64)[which[at]] << 32) + np.array(lo, dtype=np.int64)[which[at]] + inside[at]
    b = bucket[at]
    order = np.lexsort((place, b))
    b, place, at = b[order], place[order], at[order]
    if not len(b):
        return [np.zeros(0, np.int64) for _ in contexts]
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    size = np.diff(np.concatenate([edge, [len(b)]]))
    several = np.minimum.reduceat(place, edge) != np.maximum.reduceat(place, edge)
    several |= np.maximum.reduceat(np.array(many)[which[at]].astype(np.int8), edge) > 0
    hit = np.sort(at[np.repeat(several, size)])
    cuts = np.searchsorted(hit, np.concatenate([[0], ends]))
    base = ends - sizes
    return [hit[cuts[i] : cuts[i + 1]] - base[i] + lo[i] for i in range(len(contexts))]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) over sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    first = starts[np.concatenate([[0], cut])]
    last = starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length
    return list(zip(first.tolist(), last.tolist()))


def _refine_rows(length: int):
    """Contexts sorted by initial bucket h -> covered intervals (doc_id, tkey, s, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            names: dict = {}
            owner = [names.setdefault((r[0], r[1]), len(names)) for r in rows]
            hits = repeated_starts([r[4] for r in rows], owner, [r[3] for r in rows], [r[5] for r in rows], length)
            c: list[list] = [[], [], [], []]
            for r, starts in zip(rows, hits):
                for s, e in _runs(starts, length):
                    for col, x in zip(c, (r[0], r[1], s, e)):
                        col.append(x)
            return pa.record_batch([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "tkey", "s", "e"])

        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if size >= CHUNK and r[2] != rows[-1][2]:
                    yield out(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield out(rows)

    return run


def _window_rows(length: int):
    """Contexts of crowded buckets -> a row for each string of `length` bytes: (first, later, doc_id, tkey, p, many),
    with the buckets of its first half and of the half that ends it."""
    q = -(-length // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            manys: list[np.ndarray] = []
            for d, k, _, lo, ctx, many in zip(*(b.column(i).to_pylist() for i in range(6))):
                h = grams(np.frombuffer(ctx, np.uint8), q).view(np.int64)
                n = len(ctx) - length + 1
                for c, x in zip(parts, (h[:n], h[length - q : length - q + n], None if d is None else np.full(n, d), np.full(n, k), np.arange(lo, lo + n, dtype=np.int32))):
                    c.append(pa.nulls(n, pa.int64()) if x is None else pa.array(x))
                manys.append(np.full(n, many))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns = [pa.concat_arrays(c) if c else pa.array([], t) for c, t in zip(parts, types)]
            yield pa.record_batch([*columns, pa.array(np.concatenate(manys) if manys else np.zeros(0, bool))], names=["first", "later", "doc_id", "tkey", "p", "many"])

    return run


def merged(spans: list, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], min(n, x["e"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for row, t, spans, shorter in zip(*(b.column(i).to_pylist() for i in range(4))):
            raw = _bytes(t)
            gone = merged(spans or [], len(raw))
            at, kept = 0, []
            for s, e in gone:
                kept.append(raw[at:s])
                at = e
            rest = b"".join([*kept, raw[at:]]) if gone else raw
            values = (row, rest.decode("utf-8", "ignore"), len(raw), sum(e - s for s, e in gone), len(gone), hashlib.sha256(rest).hexdigest(), sum(e - s for s, e in merged(shorter or [], len(raw))))
            for c, x in zip(out, values):
                c.append(x)
        types = (b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["row", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])


def by_text(spans: DataFrame) -> DataFrame:
    """(d, k, runs): the spans of each text, which are as many as its length allows."""
    return spans.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("k")).agg(F.collect_set(F.struct("s", "e")).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, within: DataFrame | None = None) -> DataFrame:
    """(doc_id, tkey, s, e): spans covered by strings of `length` bytes that also start elsewhere, in another text,
    elsewhere in this one, or in a repeated row. within: such spans of a shorter length; a longer string that repeats
    lies in one run of them, so only their runs are looked at."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.mapInArrow(_with_key, "doc_id long, tkey long, text string")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k"))
    if within is not None:
        texts = keyed.join(by_text(within), same).select("doc_id", "text", "runs")
    anchors = written(texts.mapInArrow(_anchor_rows(length), "doc_id long, tkey long, h long, ctx long, s int, e int, again boolean"), "anchors")
    buckets = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2"), F.max("again").alias("again")).where("n > 1 or again")
    buckets = written(buckets.select("h", ((F.col("c1") == F.col("c2")) & (F.col("n") > 1)).alias("uniform")), "buckets")
    shared = written(anchors.drop("again").join(buckets, "h"), "shared")
    mixed = shared.where("not uniform")
    classes = mixed.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", "s", "e")).alias("first"))
    classes = written(classes, "classes")
    twins = classes.where("n > 1").select("h", "ctx")
    direct = shared.where("uniform").select("doc_id", "tkey", "s", "e").unionByName(mixed.join(twins, ["h", "ctx"], "left_semi").select("doc_id", "tkey", "s", "e"))
    crowded = classes.groupBy("h").agg((F.count(F.lit(1)) > hot).alias("crowd"))
    wanted = classes.join(crowded, "h").groupBy("first.doc_id", "first.tkey").agg(F.collect_list(F.struct("h", F.col("first.s").alias("s"), F.col("first.e").alias("e"), (F.col("n") > 1).alias("many"), "crowd")).alias("wanted"))
    contexts = keyed.join(wanted.withColumnRenamed("doc_id", "d").withColumnRenamed("tkey", "k"), same)
    contexts = contexts.select("doc_id", "tkey", "text", "wanted").mapInArrow(_subset, "doc_id long, tkey long, h long, lo int, ctx binary, many boolean, crowd boolean")
    contexts = written(contexts, "contexts")
    discard(anchors)
    plain = contexts.where("not crowd").drop("crowd").repartition(partitions(spark), "h").sortWithinPartitions("h")
    spans = direct.unionByName(plain.mapInArrow(_refine_rows(length), "doc_id long, tkey long, s int, e int"))
    # a crowded bucket is refined once by Spark: buckets of the first half, sorted on those at the later offset
    windows = contexts.where("crowd").drop("crowd").mapInArrow(_window_rows(length), "first long, later long, doc_id long, tkey long, p int, many boolean").distinct()
    again = windows.groupBy("first", "later").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("any")).where("n > 1 or any").select("first", "later")
    again = written(again, "again")
    return spans.unionByName(windows.join(again, ["first", "later"], "left_semi").select("doc_id", "tkey", F.col("p").alias("s"), (F.col("p") + length).alias("e")))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [_key(_bytes(t)) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(keys, pa.int64()), b.column(1)], names=["doc_id", "tkey", "text"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """Every row of docs with all its columns, text without its repeated bytes, and n_bytes, n_removed, n_spans,
    kept_sha256, n_passage_bytes.

    Bytes covered by a string of `length` bytes that also starts anywhere else go, judged on the input; matches
    never cross documents. n_passage_bytes: bytes covered by such strings of `passage` bytes, which is shorter; none of
    them go; 0 without that length. A null text counts as empty; a repeated row is a match elsewhere, so both lose it; a
    null doc_id is a document like any other; input columns named like the new ones are dropped; an empty table gives no
    rows. text drops bytes of characters that were cut through; kept_sha256 is over all bytes kept.
    """
    shorter = written(repeated_spans(docs, passage), "passages") if passage else None
    runs = by_text(repeated_spans(docs, length, within=shorter))
    new = ["text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    names = [c for c in docs.columns if c not in new]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = row.schema["row"].dataType.simpleString()
    row = row.mapInArrow(_row_key, f"row {kind}, text string, tkey long")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k"))
    if passage:  # a text with longer repeats has shorter ones
        longer = runs.select(F.col("d").alias("d2"), F.col("k").alias("k2"), F.col("runs").alias("longer"))
        both = by_text(shorter).withColumnRenamed("runs", "shorter").join(longer, F.col("d").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2")), "left").select("d", "k", F.col("longer").alias("runs"), "shorter")
    else:
        both = runs.withColumn("shorter", F.lit(None).cast(dict(runs.dtypes)["runs"]))
    cut = row.join(both, same, "left").select("row", "text", "runs", "shorter").mapInArrow(_cut_rows, f"row {kind}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")
    return cut.select("row.*", *new)


def _row_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [_key(_bytes(t)) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.int64())], names=["row", "text", "tkey"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, LENGTH, PASSAGE).drop("text")
