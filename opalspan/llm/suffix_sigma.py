"""Phrase collocations: n-grams of every language counted by sorted truncated suffixes, their parts joined afterwards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import discard, partitions, small_batches, written

#: Words of a phrase at most, occurrences at least, phrases of a language that are returned.
MAX_WORDS, LEAST, TOP = 3, 10, 2000
#: A candidate goes where a longer one around it has this percentage of its occurrences.
COVERED = 50
#: Bytes of text that are counted before their suffixes are sent; words that are numbered at once.
BATCH_BYTES, BATCH_WORDS = 8 << 20, 1 << 20
#: Different suffixes of a group of first words up to which one task counts the group; a larger one is split.
HOT = 1 << 20
#: Rows of a language are ranked in so many parts before their best are ranked together.
PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 blank, 2 end of a piece, 0 part of a word.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2


def words_of(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of all texts end to end, lower-cased from A to Z, and of each the number of its piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    begins = np.unique((ends - ends[0])[:-1])
    begins = begins[begins < len(raw)]
    kind = _KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int32)
    size = np.diff(np.append(before[starts] - 1, before[-1:])) if len(starts) else starts
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + np.searchsorted(begins, starts, "right")
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = pa.py_buffer(np.ascontiguousarray(raw[inside]))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), data]), piece


def _packed(columns: list[np.ndarray], base: int) -> np.ndarray | None:
    """Numbers below `base` of each column as one key, if it fits."""
    if base ** len(columns) >= 2**63:
        return None
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key * base + c
    return key


def _summed(columns: list[np.ndarray], counts: np.ndarray, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the columns in ascending order, with their summed counts."""
    key = _packed(columns, base)
    order = np.argsort(key, kind="stable") if key is not None else np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.ones(len(counts), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts


def _blob(words: list[bytes], columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Suffixes as numbers of `words` from 1, 0 where there is no word, with counts."""
    text = b" ".join(words)
    head = np.array([len(text), len(counts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + text + b"".join(c.astype("<u4").tobytes() for c in columns) + counts.astype("<i8").tobytes())


def _read(blob: bytes, width: int) -> tuple[bytes, list[np.ndarray], np.ndarray]:
    """The words, joined by spaces, the columns and the counts."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size, n = np.frombuffer(raw, "<i8", 2)
    at = 16 + int(size)
    columns = [np.frombuffer(raw, "<u4", n, at + 4 * n * k) for k in range(width)]
    return raw[16:at], columns, np.frombuffer(raw, "<i8", n, at + 4 * n * width)


def _dealt(words: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(number, rows, blob) for the rows of each number in `to`; each blob holds its own words."""
    order = np.argsort(to, kind="stable")
    to, columns, counts = to[order], [c[order] for c in columns], counts[order]
    cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        used, again = np.unique(np.concatenate([[0], *(c[a:b] for c in columns)]), return_inverse=True)
        own = again[1:].reshape(len(columns), b - a)
        yield int(to[a]), b - a, _blob(words[used[1:] - 1].tolist(), list(own), counts[a:b])


def suffixes(texts: pa.Array, width: int = MAX_WORDS) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(words, columns, counts): the different suffixes of the texts' pieces, cut after `width` words, in parts of at
    most BATCH_WORDS words; columns hold numbers of words from 1, 0 past a piece's end."""
    words, piece = words_of(texts)
    for k in range(0, len(words), BATCH_WORDS):
        n = min(BATCH_WORDS, len(words) - k)
        coded = words.slice(k, n + width - 1).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64) + 1
        codes = np.append(codes, np.zeros(n + width - 1 - len(codes), np.int64))
        place = np.append(piece[k : k + n + width - 1], np.full(n + width - 1, -1))[: n + width - 1]
        columns = [np.where(place[j : j + n] == place[:n], codes[j : j + n], 0) for j in range(width)]
        distinct = np.array(coded.dictionary.to_pylist(), dtype=object)
        yield distinct, *_summed(columns, np.ones(n, np.int64), len(distinct) + 1)


def _send(buckets: int, width: int):
    """Suffixes of batches, counted, by language and bucket of their first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            lang, text = (whole.column(i).combine_chunks() for i in range(2))
            for name in pc.unique(lang).to_pylist():
                for words, columns, counts in suffixes(text.filter(pc.equal(lang, name)), width):
                    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                    rows = list(_dealt(words, columns, counts, bucket[columns[0] - 1]))
                    for i in range(0, len(rows), 64):
                        part = rows[i : i + 64]
                        yield pa.record_batch([pa.array([name] * len(part), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.binary())))], names=["lang", "bucket", "rows", "blob"])

        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= BATCH_BYTES:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


def _split(width: int):
    """Blobs of large groups dealt to the group's parts, by the words after the first: whole suffixes stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, bucket, parts, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows = [(0, 0, blob)]
                if parts > 1:
                    text, columns, counts = _read(blob, width)
                    words = text.split(b" ")
                    mark = np.fromiter(map(zlib.crc32, [b"", *words]), np.int64, len(words) + 1)
                    where = np.zeros(len(counts), np.int64)
                    for c in columns[1:]:
                        where = (where * 31 + mark[c]) % 2147483647
                    rows = list(_dealt(np.array(words, dtype=object), [c.astype(np.int64) for c in columns], counts, where % parts))
                part, _, blobs = zip(*rows)
                yield pa.record_batch([pa.array([lang] * len(rows), pa.string()), pa.array([bucket] * len(rows), pa.int64()), pa.array(part, pa.int64()), pa.array([parts] * len(rows), pa.int64()), pa.array(blobs, pa.binary())], names=["lang", "bucket", "part", "parts", "blob"])

    return run


def prefixes(columns: list[np.ndarray], counts: np.ndarray, least: list[int]) -> Iterator[tuple[int, int, int]]:
    """(row, k, n): the first k words of that row begin n suffixes, for n >= least[k].

    Rows are different suffixes in reverse lexicographic order, so all suffixes that share a prefix are neighbours. The
    stack holds counts of the prefixes that the last row has open; one that the next row does not share is done, and
    what it counted goes to the prefix that it extends.
    """
    n = len(counts)
    length = np.sum([c > 0 for c in columns], axis=0)
    shared, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for c in columns:
        same &= (c[1:] == c[:-1]) & (c[1:] > 0)
        shared[1:] += same
    stack: list[int] = []
    for row, (keep, size, count) in enumerate(zip(shared.tolist(), length.tolist(), counts.tolist())):
        while len(stack) > keep:
            done = stack.pop()
            if done >= least[len(stack) + 1]:
                yield row - 1, len(stack) + 1, done
            if stack:
                stack[-1] += done
        stack.extend([0] * (size - keep))
        stack[-1] += count
    while stack:
        done = stack.pop()
        if done >= least[len(stack) + 1]:
            yield n - 1, len(stack) + 1, done
        if stack:
            stack[-1] += done


def _counted(blobs: list[bytes], width: int, least: list[int]) -> tuple[int, list[tuple[int, str, int]]]:
    """All occurrences of the group's first words, and (k, phrase, n) of its prefixes."""
    parts = [_read(b, width) for b in blobs]
    lists = pc.split_pattern(pa.array([text for text, _, _ in parts], pa.binary()).cast(pa.string()), " ")
    flat, ends = lists.values.dictionary_encode(), lists.offsets.to_numpy()
    order = pc.array_sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ranks = rank[flat.indices.to_numpy()]
    names, columns = flat.dictionary.take(pa.array(order)).to_pylist(), [[] for _ in range(width)]
    for i, j, (_, cols, _) in zip(ends[:-1].tolist(), ends[1:].tolist(), parts):
        local = np.append(0, ranks[i:j])
        for out, c in zip(columns, cols):
            out.append(local[c])
    whole, counts = _summed([np.concatenate(c) for c in columns], np.concatenate([c for *_, c in parts]), len(names) + 1)
    whole, counts = [c[::-1] for c in whole], counts[::-1]
    found = [(k, " ".join(names[whole[j][row] - 1] for j in range(k)), n) for row, k, n in prefixes(whole, counts, least)]
    return int(counts.sum()), found


def _count(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, blobs = None, 1, []

        def out() -> pa.RecordBatch:
            # shorter prefixes of a split group are whole only when its parts are summed; whole suffixes are in one part
            own = [0, *([1 if parts > 1 else least] * (width - 1)), least]
            total, found = _counted(blobs, width, own)
            rows = [(0, "", total), *found]
            k, phrase, n = zip(*rows)
            return pa.record_batch([pa.array([now[0]] * len(rows), pa.string()), pa.array(k, pa.int32()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=["lang", "k", "phrase", "n"])

        for b in batches:
            for lang, bucket, part, several, blob in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now != (lang, bucket, part) and blobs:
                    yield out()
                    blobs = []
                now, parts = (lang, bucket, part), several
                blobs.append(blob)
        if blobs:
            yield out()

    return run


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(lang, k, phrase, n), written: phrases of k words with at least `least` occurrences in their language, and, as k =
    0, how many words the language has.

    Every word of a piece begins a suffix, cut after `max_words` words. A task counts equal ones of a batch before they
    are sent, as compressed blobs, by language and a hash of their first word; groups of over `hot` different suffixes
    are split by their further words. Each group is sorted in reverse order and counted with one stack. All is exact.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sent = written(rows.mapInArrow(_send(max(32, 2 * n), max_words), "lang string, bucket long, rows long, blob binary"), "suffixes")
    # written, so that its size is known: while it is small, the blobs are not shuffled to it
    large = written(sent.groupBy("lang", "bucket").agg(F.ceil(F.sum("rows") / F.lit(hot)).alias("parts")).where("parts > 1"), "large")
    keyed = sent.join(large, ["lang", "bucket"], "left").select("lang", "bucket", F.coalesce("parts", F.lit(1)).cast("long").alias("parts"), "blob")
    dealt = keyed.mapInArrow(_split(max_words), "lang string, bucket long, part long, parts long, blob binary")
    keys = ["lang", "bucket", "part"]
    counted = dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_count(max_words, least), "lang string, k int, phrase string, n long")
    out = written(counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0)), "phrases")
    discard(sent)
    discard(large)
    return out


def _some(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates in phrase_counts that no longer one covers.

    A candidate is cut after each k of its words; l and r are joined from the counts, the lowest score counts, of equal
    ones the smallest k. Products are decimals of 38 digits, so a million times a * a is exact up to a = 10^16.
    """
    words = F.split("phrase", " ")
    longer = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"))
    known = counts.where("k > 0")
    cuts = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _some(F.col("w"), F.lit(1), F.col("cut")).alias("first"), _some(F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    big = lambda c: f"cast({c} as decimal(18,0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000000 * {big('a')} * {big('a')}) div ({big('l')} * {big('r')})"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # phrases inside a longer candidate, of every shorter length from two on
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _some(F.col("w"), i, m))))
    inside = longer.where("k > 2").select("lang", F.explode(F.array_distinct(spots)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    out = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
    return out.drop("around")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score and a, descending, then
    by the phrase's bytes.

    A null lang is `und`, a null or empty text has no words; repeated rows count each; an empty table gives no rows; other
    columns of docs are not looked at. A language is ranked in PARTS parts first, so that no task gets all its rows.
    """
    from pyspark.sql import Window

    counts = phrase_counts(docs, max_words, least, hot)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = scored(counts).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
