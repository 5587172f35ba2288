"""Token ids in wavelet-matrix files: one compressed file per shard, with access, counting and occurrence lookup."""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opalspan.llm.common import partitions, small_batches, written
from opalspan.llm.tokens import word_encoder

MAGIC = b"OPWM2\0\0\0"
#: Tokens of a shard, and the id that ends a document.
SHARD, END = 1 << 19, 1
#: Places that a reader of all follows down the planes together, or an eighth of them if that is more.
READ = 1 << 20
#: Bytes of rows that are encoded together.
BLOCK = 16 << 20
#: Bits between two entries of a plane's rank directory, and bits of a plane that are compressed together.
STRIDE, CHUNK = 512, 1 << 18
_HEADER = struct.Struct("<8s4Q")


class WaveletMatrix:
    """Bit planes of a sequence of ids, highest bit first; each plane holds the ids sorted, stably, by the bits above.

    A plane is a rank directory (ones before every STRIDE bits) and its bits as 64-bit words, asked for by chunk.
    """

    def __init__(self, n: int, ones: list[int], directory: Callable[[int], np.ndarray], chunk: Callable[[int, int], np.ndarray]) -> None:
        self.n, self.width = n, len(ones)
        self.zeros = [n - x for x in ones]
        self._directory, self._chunk = directory, chunk

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        planes = split(ids)
        ranks = [directory(p) for p in planes]
        return cls(len(ids), [int(np.bitwise_count(p).sum()) for p in planes], ranks.__getitem__, lambda k, c: planes[k][c * (CHUNK // 64) : (c + 1) * (CHUNK // 64)])

    def _look(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places in plane k: the bits there, and the ones before them, by the directory and the words up to the
        place. A place is n at most."""
        bit, rank = np.empty(len(at), np.uint64), self._directory(k)[at // STRIDE].astype(np.int64)
        chunk = at // CHUNK
        for c in np.unique(chunk).tolist():
            mine = np.flatnonzero(chunk == c)
            a = at[mine] - c * CHUNK
            words = self._chunk(k, c) if c * CHUNK < self.n else np.zeros(1, np.uint64)
            words = np.append(words, np.uint64(0))  # for a place just behind the last bit
            # ones of the block's words before each word
            count = np.bitwise_count(words).astype(np.int64)
            before = np.cumsum(count) - count
            w, shift = a >> 6, (a & 63).astype(np.uint64)
            block = a // STRIDE * (STRIDE // 64)
            bit[mine] = (words[w] >> shift) & np.uint64(1)
            rank[mine] += before[w] - before[block] + np.bitwise_count(words[w] & ((np.uint64(1) << shift) - np.uint64(1)))
        return bit, rank

    def _spread(self, k: int) -> np.ndarray:
        """Of every place of plane k: the place that its rank leads to in the next one, from the plane's zeros on if its
        bit is one. Ranks are counted on in each chunk from the directory's entry."""
        kind = np.int32 if self.n < 1 << 30 else np.int64
        parts, ones = [], self._directory(k)
        for c in range(-(-self.n // CHUNK)):
            bits = np.unpackbits(self._chunk(k, c).view(np.uint8), bitorder="little")
            upto = np.cumsum(bits, dtype=kind)
            upto += kind(ones[c * (CHUNK // STRIDE)])
            at = np.arange(c * CHUNK, c * CHUNK + len(bits), dtype=kind)
            at -= upto
            # products, as a choice by booleans is slow where they are mixed
            upto += kind(self.zeros[k] - 1)
            upto -= at
            upto *= bits
            at += upto
            parts.append(at)
        return np.concatenate(parts)

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places, all followed down the planes together by rank. Where they are many for the
        planes' length, a plane's ranks are spread out once for all of them."""
        at = np.asarray(at)
        if not len(at):
            return np.zeros(0, np.uint32)
        if not (0 <= int(at.min()) and int(at.max()) < self.n):
            raise IndexError(at)
        many = len(at) * 16 >= self.n
        at = at.astype(np.int32 if many and self.n < 1 << 30 else np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        for k in range(self.width):
            out += out
            if many:
                at = self._spread(k).take(at)
                out += at >= self.zeros[k]
            else:
                bit, rank = self._look(k, at)
                out += bit.astype(np.uint32)
                at = np.where(bit, rank + at.dtype.type(self.zeros[k]), at - rank)
        return out

    def access(self, i: int) -> int:
        return int(self.tokens(np.array([i]))[0])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Places of the token's occurrences before i, below the lowest plane."""
        ends = np.array([0, i], dtype=np.int64)
        if token < 0 or token >> self.width:
            return 0, 0
        for k in range(self.width):
            _, rank = self._look(k, ends)
            ends = self.zeros[k] + rank if token >> (self.width - 1 - k) & 1 else ends - rank
        return int(ends[0]), int(ends[1])

    def count(self, token: int, upto: int | None = None) -> int:
        lo, hi = self._range(token, self.n if upto is None else upto)
        return hi - lo

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k: its block by the directory, then inside the block."""
        ones = self._directory(k).astype(np.int64)
        have = ones if bit else np.arange(len(ones)) * STRIDE - ones
        block = int(np.searchsorted(have, j, side="right")) - 1
        lo = block * STRIDE
        at = np.arange(lo, min(lo + STRIDE, self.n))
        bits, _ = self._look(k, at)
        return lo + int(np.flatnonzero(bits == bit)[j - int(have[block])])

    def select(self, token: int, j: int) -> int:
        """Place of the token's j-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i


def split(ids: np.ndarray) -> list[np.ndarray]:
    """The bit planes as 64-bit words."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now, planes = ids.astype(np.uint16 if width <= 16 else np.uint32), []
    for k in range(width - 1, -1, -1):
        mask = now & now.dtype.type(1 << k) != 0
        packed = np.packbits(mask, bitorder="little")
        planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8"))
        # np.compress, as an index of booleans takes over three times as long
        now = np.concatenate([np.compress(~mask, now), np.compress(mask, now)])
    return planes


def directory(plane: np.ndarray) -> np.ndarray:
    """Ones before every STRIDE bits, and at the end."""
    ones = np.bitwise_count(plane).astype(np.uint32)
    ones = np.concatenate([ones, np.zeros(-len(ones) % (STRIDE // 64), np.uint32)]).reshape(-1, STRIDE // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])


def to_file(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Layout: magic, then documents, tokens, planes and bytes of the table as unsigned 64-bit; the table of places
    (of the documents' frame, and for each plane its ones, directory and chunks), then the frames. Documents (null
    flags, ids, lengths), directories and chunks are zstd frames of their own, so one token is read from one chunk of
    each plane and nothing else is unpacked."""
    press = zstandard.ZstdCompressor(level=1).compress
    planes = split(ids)
    frames = [press(b"".join([bytes(d is None for d in docs), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array(lengths, "<u8").tobytes()]))]
    ones = []
    for p in planes:
        ones.append(int(np.bitwise_count(p).sum()))
        frames.append(press(directory(p).astype("<u4").tobytes()))
        frames += [press(p[c : c + CHUNK // 64].tobytes()) for c in range(0, len(p), CHUNK // 64)]
    table = np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes() + np.array(ones, "<u8").tobytes()
    return b"".join([_HEADER.pack(MAGIC, len(docs), len(ids), len(planes), len(table)), table, *frames])


def from_file(data: bytes) -> tuple[list[int | None], list[int], WaveletMatrix]:
    """Documents, lengths, and the matrix over the file's bytes: frames are unpacked when they are asked for."""
    magic, docs, n, width, size = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    places = np.frombuffer(data, "<u8", size // 8 - width, _HEADER.size).astype(np.int64) + _HEADER.size + size
    ones = np.frombuffer(data, "<u8", width, _HEADER.size + size - 8 * width).astype(np.int64).tolist()
    chunks = -(-n // CHUNK)
    view = memoryview(data)

    def frame(i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(view[places[i] : places[i + 1]])

    @functools.cache
    def ranks(k: int) -> np.ndarray:
        return np.frombuffer(frame(1 + k * (1 + chunks)), "<u4")

    @functools.cache
    def chunk(k: int, c: int) -> np.ndarray:
        return np.frombuffer(frame(2 + k * (1 + chunks) + c), "<u8")

    body = frame(0)
    names = np.frombuffer(body, "<i8", docs, docs).tolist()
    lengths = np.frombuffer(body, "<u8", docs, 9 * docs).tolist()
    return [None if x else d for x, d in zip(body[:docs], names)], lengths, WaveletMatrix(n, ones, ranks, chunk)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to BLOCK bytes; more only by a batch that is larger itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if held and size + b.nbytes > BLOCK:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if size:
        yield pa.concat_batches(held)


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        lengths: list = []
        parts: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([to_file(docs, lengths, np.concatenate(parts))], pa.binary())], names=["part", "shard", "before", "n", "file"])

        for b in blocks(batches):
            names = b.column(0).to_pylist()
            ids, sizes = encoder.encode_all(b.column(1))
            ids = np.insert(ids, np.cumsum(sizes), END)
            sizes += 1
            ends = np.cumsum(sizes)
            lo = at = 0
            while lo < len(names):
                # up to the document that fills the shard
                hi = min(len(names), int(np.searchsorted(ends, at + SHARD - size)) + 1)
                to = int(ends[hi - 1])
                docs += names[lo:hi]
                lengths += sizes[lo:hi].tolist()
                parts.append(ids[at:to])
                size, lo, at = size + to - at, hi, to
                if size >= SHARD:
                    yield out()
                    shard, before, size = shard + 1, before + size, 0
                    docs, lengths, parts = [], [], []
        if docs:
            yield out()

    return run


def write_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(part, shard, before, n, file): documents in ascending doc_id order over parts and shards, ids of a document
    followed by END; before: ids of the part's earlier shards. The files travel in a Parquet table, so that any store
    that Spark writes to can hold them.

    A null text is empty (its only id is END); null doc_ids come first; repeated ids are ordered by a hash of the
    text; other columns are ignored; an empty table gives no shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # the row's number parts equal rows, so that very many of them need not fit into one range
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    return written(rows.select("doc_id", "text").mapInArrow(_write(tokenizer), "part int, shard int, before long, n long, file binary"), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, shard, before, data in zip(*(b.column(i).to_pylist() for i in range(4))):
            names, lengths, matrix = from_file(data)
            ends = np.cumsum(lengths)
            starts = ends - np.array(lengths)
            step = max(READ, matrix.n // 8)
            ids = b"".join(matrix.tokens(np.arange(a, min(a + step, matrix.n))).astype("<u4").tobytes() for a in range(0, matrix.n, step))
            for lo in range(0, len(names), 500):
                cut = slice(lo, lo + 500)
                tokens = [ids[4 * s : 4 * e] for s, e in zip(starts[cut].tolist(), ends[cut].tolist())]
                yield pa.record_batch([pa.array([part] * len(tokens), pa.int32()), pa.array(names[cut], pa.int64()), pa.array(starts[cut] + before, pa.int64()), pa.array(lengths[cut], pa.int64()), pa.array(tokens, pa.binary())], names=["part", "doc_id", "start", "n_tokens", "ids"])


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start over all shards."""
    # one row per part, and parts are as many as the writer's range partitions
    totals = shards.groupBy("part").agg(F.sum("n").alias("n"))
    sums = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = shards.select("part", "shard", "before", "file").mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(sums), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def op3_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
