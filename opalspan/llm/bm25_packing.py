"""Packing of documents into windows by lexical retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import small_batches
from opalspan.llm.tokens import byte_encoder

WINDOW, END = 1024, 0
#: Pieces of one shard's index, and BM25's two parameters.
SHARD, K1, B = 512, 1.2, 0.75


class Index:
    """Inverted BM25 index of one shard: for each id, the pieces that have it and their weights.

    Ids in over half of the pieces have no positive weight and are left out, as BM25 has it.
    """

    def __init__(self, pieces: list[np.ndarray]) -> None:
        each = [np.unique(p, return_counts=True) for p in pieces]
        self.terms = [e[0] for e in each]
        doc = np.repeat(np.arange(len(pieces)), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate([e[1] for e in each]).astype(np.float32)
        length = np.array([len(p) for p in pieces], dtype=np.float32)
        df = np.bincount(term)
        idf = np.log((len(pieces) - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        good = weight > 0
        doc, term, weight = doc[good], term[good], weight[good]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
        self.n = len(pieces)

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        lo, size = self.ptr[t], self.ptr[t + 1] - self.ptr[t]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


class Packer:
    """Windows over a stream of documents; what is left of a shard's last window goes on into the next shard."""

    def __init__(self, window: int = WINDOW, shard: int = SHARD) -> None:
        self.window, self.shard, self.sequence = window, shard, 0
        self.pool: list[list] = []  # [document, start, ids]
        self.out: list[tuple] = []  # document, start, ids, sequence, offset

    def _emit(self, parts: list[tuple]) -> None:
        at = 0
        for doc, start, ids in parts:
            self.out.append((doc, start, ids, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        """Full windows of a long document stand alone; its rest waits for neighbours."""
        full = len(ids) // self.window * self.window
        for k in range(0, full, self.window):
            self._emit([(doc, k, ids[k : k + self.window])])
        if full < len(ids):
            self.pool.append([doc, full, ids[full:]])
            if len(self.pool) >= self.shard:
                self.pack(False)

    def pack(self, last: bool) -> None:
        """Seeds by length, each filled by its best unused neighbours; the last taken is cut at the window's end and
        its rest stays unused."""
        pool = self.pool
        if not pool:
            return
        index = Index([p[2] for p in pool])
        free = np.ones(len(pool), dtype=bool)
        for seed in sorted(range(len(pool)), key=lambda i: (-len(pool[i][2]), i)):
            while free[seed]:
                doc, start, ids = pool[seed]
                free[seed] = False
                parts, room = [(doc, start, ids)], self.window - len(ids)
                if room:
                    score = index.scores(seed)
                    left = np.flatnonzero(free)
                    for k in left[np.argsort(-score[left], kind="stable")].tolist():
                        d, s, x = pool[k]
                        take = min(room, len(x))
                        parts.append((d, s, x[:take]))
                        room -= take
                        if take < len(x):
                            pool[k] = [d, s + take, x[take:]]
                        else:
                            free[k] = False
                        if not room:
                            break
                if room and not last:
                    self.pool = [list(p) for p in parts]
                    return
                self._emit(parts)
        self.pool = []


def _pack(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        base = TaskContext.get().partitionId() << 36
        packer = Packer(window)
        end = np.array([END], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            cols = [[r[0][0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [r[2].tobytes() for r in rows], [r[0][1] for r in rows], [base + r[3] for r in rows], [r[4] for r in rows]]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(encoder.encode(t or "") + end, "<u4")
                packer.add((d, len(ids)), ids)
            if len(packer.out) > 1000:
                yield out()
        packer.pack(True)
        if packer.out:
            yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of documents in windows of `window` ids.

    A document's ids end with END. Full windows of long documents stand alone. The rest of each document is indexed
    by its ids in its task's current shard; the longest unused rest is the seed, BM25 ranks the unused others, and
    they fill the window in that order, the last one cut. Only the last window of a task has padding. Nothing is
    shuffled: a shard is a run of SHARD rests of one task's input, so memory is bounded by it.
    A null text is empty and gives END alone; null and repeated doc_ids are documents of their own; equal scores keep
    input order; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, window), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
