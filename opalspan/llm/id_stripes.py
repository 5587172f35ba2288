"""Alignment of two tokenizers: linked ids counted in dense blocks by stripes of ids, links scored beside their stripe."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import discard, partitions, small_batches, written
from opalspan.llm.tokens import _ODD, LONGEST, Memo, _byte_letters, byte_encoder, inner, ragged

#: Stripes: ids that are equal modulo this number. A block has a row for each id of its stripe, a column for each id of
#: the other side.
STRIPES = 256
#: Documents and bytes of text that are aligned at once, but for the last text's.
BATCH_DOCS, BATCH_BYTES = 2000, 4 << 20
#: Compressed bytes of a stripe for which one more task counts, or scores.
PART_BYTES = 32 << 20
#: Pieces between spaces whose ids of the second side a worker remembers, in each of two generations.
REMEMBERED = 120_000
#: Bytes of sums that a task holds before it sends them.
HELD_BYTES = 64 << 20


class Aligner:
    """Tokens, groups and links of texts by a byte-level vocabulary (A) and a piece vocabulary with byte fallback (B).

    A text, with a space before it, is cut at its spaces: neither vocabulary has a token that goes on past a space after
    another character, so pieces are encoded apart, different ones once. Texts where white space meets otherwise are
    encoded whole.
    """

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece

        self.a = byte_encoder(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        back = {v: k for k, v in _byte_letters().items()}
        vocabulary = self.a.matches.whole.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.rows = -(-len(self.bytes_a) // STRIPES)
        self.bits = len(self.bytes_b).bit_length()
        self.words: dict[str, bytes] = Memo(self._ids, REMEMBERED)
        # a token's text in a list of groups: with the sign that ends it inside its group, and at the group's end
        self.names = pa.array([f"{i}{end}" for side, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends for i in range(len(side))])

    def _ids(self, text: str) -> bytes:
        return array("I", self.b.encode(text)).tobytes()

    def _tokens(self, units: list[str], whole: list[bool]) -> tuple[list[bytes], list[bytes]]:
        a = [self.a.encode(" " + u) if w else self.a.pieces[u] for u, w in zip(units, whole)]
        # those that are not remembered are encoded in one call
        new = [u for u, w in zip(units, whole) if not w and u not in self.words and u not in self.words.old]
        made = {u: array("I", ids).tobytes() for u, ids in zip(new, self.b.encode(new, num_threads=1) if new else [])}
        b = [self._ids(u) if w else made.get(u) or self.words[u] for u, w in zip(units, whole)]
        for u, ids in made.items():
            if len(u) <= LONGEST:
                self.words.keep(u, ids)
        return a, b

    def _faithful(self, units: list[str], sides: list[pa.ListArray]) -> np.ndarray:
        """Of each unit whether the tokens of both sides are, joined, a space and the unit."""
        raw = [b" " + u.encode("utf-8", "surrogatepass") for u in units]
        length, good = np.array(list(map(len, raw)), np.int64), np.ones(len(units), bool)
        for side, names, size in zip(sides, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b)):
            ids, ends = side.values.to_numpy(), side.offsets.to_numpy()
            sums = np.append(0, np.cumsum(size[ids]))
            good &= sums[ends[1:]] - sums[ends[:-1]] == length
            flat = ids[np.repeat(good, np.diff(ends))].tolist()
            if b"".join([names[i] for i in flat]) != b"".join([r for r, g in zip(raw, good.tolist()) if g]):
                good &= [b"".join([names[i] for i in ids[i:j].tolist()]) == r for i, j, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raw)]
        return good

    def batch(self, texts: pa.Array) -> dict:
        """Of texts, in the order of `place`: counts, lists of groups as text, and links (code, text, occurrences), sorted.

        A link's code is its A id's stripe, row and B id. Texts that are null, empty or not what their tokens say have
        none.
        """
        texts = pc.fill_null(texts, "")
        apart = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.match_substring_regex(texts, f"[{_ODD}]"))))
        apart = np.asarray(apart.to_numpy(zero_copy_only=False), bool)
        place = np.argsort(apart, kind="stable")
        plain, others = pc.split_pattern(texts.filter(pa.array(~apart)), " "), texts.filter(pa.array(apart))
        sizes = np.append(np.diff(plain.offsets.to_numpy()), np.ones(len(others), np.int64))
        units = pa.concat_arrays([plain.flatten(), others]).dictionary_encode()
        ends = np.append(0, np.cumsum(sizes))
        where = units.indices.to_numpy()
        names = units.dictionary.to_pylist()
        whole = np.zeros(len(names), bool)
        whole[where[ends[len(plain)] :]] = True
        a, b = map(ragged, self._tokens(names, whole.tolist()))
        good = self._faithful(names, [a, b])
        links, groups, numbers = self._aligned(a, b, good)
        # an empty text is one empty unit, which says nothing
        valid = np.array([x > 0 for x in pc.binary_length(texts.take(pa.array(place))).to_pylist()], bool)
        bad = np.append(0, np.cumsum(~good[where]))
        valid &= bad[ends[1:]] == bad[ends[:-1]]
        sums = np.append(np.zeros((1, 4), np.int64), np.cumsum(numbers[where], axis=0), axis=0)
        counts = (sums[ends[1:]] - sums[ends[:-1]]) * valid[:, None]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(where))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), groups.take(pa.array(where))), "")
        codes = inner(lists, links)
        text = np.repeat(np.arange(len(place)), np.diff(codes.offsets.to_numpy()))
        of = codes.values.to_numpy()
        key, n = np.unique(((of.astype(np.int64) << 16) | text)[valid[text]], return_counts=True)
        return {"place": place, "valid": valid, "counts": counts, "groups": joined, "code": key >> 16, "text": key & 0xFFFF, "n": n}

    def _aligned(self, a: pa.ListArray, b: pa.ListArray, good: np.ndarray) -> tuple[pa.ListArray, pa.Array, np.ndarray]:
        """Links, groups as text, and (tokens of A, of B, groups, links) of each unit; none where it is not good.

        Tokens are intervals of bytes, all units end to end. Between two neighbouring ends of either side lies one token
        of each, and no two stretches have the same two: they are the links. Ends of both sides cut groups.
        """
        ids, ends, of = [], [], []
        for side, size in ((a, self.size_a), (b, self.size_b)):
            unit = np.repeat(np.arange(len(good)), np.diff(side.offsets.to_numpy()))
            kept = good[unit]
            flat = side.values.to_numpy()[kept]
            ids.append(flat)
            of.append(unit[kept])
            ends.append(np.cumsum(size[flat]))
        ea, eb = ends
        merged = np.concatenate([ea, eb])
        merged.sort(kind="stable")
        again = np.append(merged[1:] == merged[:-1], False)
        cuts, both = merged[~again], merged[again]
        ia, ib = np.searchsorted(ea, cuts), np.searchsorted(eb, cuts)
        ida = ids[0][ia].astype(np.int64)
        code = ((ida % STRIPES * self.rows + ida // STRIPES) << self.bits) | ids[1][ib]
        n = len(good)
        numbers = np.stack([np.bincount(x, minlength=n) for x in (*of, of[0][np.searchsorted(ea, both)], of[0][ia])], axis=1).astype(np.int64)
        links = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(numbers[:, 3])), pa.int32()), pa.array(code))
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
        named = np.empty(len(ea) + len(eb), np.int64)
        la, lb = len(self.bytes_a), len(self.bytes_b)
        named[np.arange(len(ea)) + np.searchsorted(gb, ga)] = ids[0] + la * (both[ga] == ea)
        named[np.arange(len(eb)) + np.searchsorted(ga, gb, "right")] = 2 * la + ids[1] + lb * (both[gb] == eb)
        tokens = self.names.take(pa.array(named))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(numbers[:, 0] + numbers[:, 1])), pa.int32()), tokens), "")
        return links, texts, numbers


@functools.lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    """A worker keeps its aligner, with what it remembers, from task to task."""
    return Aligner(a, b)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        for k in range(0, b.num_rows, BATCH_DOCS):
            part = b.slice(k, BATCH_DOCS)
            if held and (rows + part.num_rows > BATCH_DOCS or size >= BATCH_BYTES):
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
            held.append(part)
            rows += part.num_rows
            size += part.column(1).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Equally long arrays as 32-bit integers."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype("<u4").tobytes() for x in arrays))


def _arrays(blob: bytes, n: int, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).reshape(n, -1)


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_DOC_SQL = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"


def _groups(found: dict) -> list[str | None]:
    return [g.as_py()[:-1] if v else None for g, v in zip(found["groups"], found["valid"].tolist())]


def _send(a: str, b: str):
    """A row of documents for each batch, and a row for each of its stripes: its pairs with the number of documents that
    hold them, and apart the documents, with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        for k, table in enumerate(_gathered(batches)):
            found = own.batch(table.column(1).combine_chunks())
            ids = table.column(0).combine_chunks().take(pa.array(found["place"]))
            marks = [hashlib.sha256(g.encode()).hexdigest() if g is not None else "" for g in _groups(found)]
            docs = pa.StructArray.from_arrays([ids.cast(pa.int64()), *(pa.array(found["counts"][:, i]) for i in range(4)), pa.array(marks, pa.string())], [f.name for f in _DOC])
            whole = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            code = found["code"]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            pair, held = code[starts], np.diff(np.append(starts, len(code)))
            stripe = (pair >> own.bits) // own.rows
            cuts = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(stripe) else np.zeros(0, np.int64)
            rows = [(-1, 0, None, None)]
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pair)]):
                x, lo, hi = pair[i:j], int(starts[i]), int(starts[j]) if j < len(starts) else len(code)
                pairs = _squeezed((x >> own.bits) % own.rows, x & ((1 << own.bits) - 1), held[i:j])
                rows.append((int(stripe[i]), j - i, pairs, _squeezed(found["text"][lo:hi], found["n"][lo:hi])))
            s, n, pairs, links = zip(*rows)
            lists = pa.concat_arrays([whole, pa.nulls(len(rows) - 1, whole.type)])
            yield pa.record_batch([pa.array(s, pa.int32()), pa.array([first + k] * len(rows), pa.int64()), pa.array(n, pa.int64()), pa.array(pairs, pa.binary()), pa.array(links, pa.binary()), lists], names=["stripe", "batch", "n", "pairs", "links", "docs"])

    return run


def _cells(block: np.ndarray) -> tuple[int, bytes]:
    row, col = np.nonzero(block)
    raw = np.stack([row, col, block[row, col]]).astype("<i8").tobytes()
    return len(row), zstandard.ZstdCompressor(level=1).compress(raw)


def _count(rows: int, columns: int):
    """Sorted by (stripe, part): pairs summed into the stripe's dense block, its cells as one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, np.zeros((rows, columns), np.int64)
        flat = block.reshape(-1)

        def out() -> pa.RecordBatch:
            n, blob = _cells(block)
            return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["stripe", "n", "cells"])

        for b in batches:
            for stripe, part, n, pairs, cells in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now != (stripe, part):
                    if now is not None:
                        yield out()
                        block[:] = 0
                    now = (stripe, part)
                row, col, held = _arrays(pairs, 3) if pairs is not None else _arrays(cells, 3, "<i8")
                np.add.at(flat, row.astype(np.int64) * columns + col, held.astype(np.int64))
        if now is not None:
            yield out()

    return run


def _score(rows: int, columns: int):
    """Sorted by (stripe, part, kind): first the stripe's counts, a dense block with its row maxima, then its links. Sums
    of a batch's documents are held over several stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, sums, size = np.zeros((rows, columns), np.int64), np.zeros(rows, np.int64), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for batch, x in sums.items():
                yield pa.record_batch([pa.array([batch], pa.int64()), pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes())], pa.binary())], names=["batch", "sums"])

        for b in batches:
            for batch, n, pairs, links, cells in zip(*(b.column(i).to_pylist() for i in range(5))):
                if cells is not None:
                    block[:] = 0
                    row, col, count = _arrays(cells, 3, "<i8")
                    block[row, col] = count
                    best = block.max(axis=1)
                    continue
                row, col, held = _arrays(pairs, 3)
                text, times = _arrays(links, 2)
                count = block[row, col]
                top = np.repeat(count == best[row], held)
                if batch not in sums:
                    sums[batch] = np.zeros((2, 1), np.int64)
                x, most = sums[batch], int(text.max()) + 1
                if most > x.shape[1]:
                    size += 16 * (most - x.shape[1])
                    sums[batch] = x = np.concatenate([x, np.zeros((2, most - x.shape[1]), np.int64)], axis=1)
                times = times.astype(np.int64)
                np.add.at(x[0], text[top], times[top])
                np.add.at(x[1], text, np.repeat(count, held) * times)
                if size > HELD_BYTES:
                    yield from out()
                    sums, size = {}, 0
        yield from out()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (batch, kind): the batch's documents, then its sums."""
    names = [f.name for f in _DOC]

    def out(docs: pa.StructArray, total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([*(docs.field(n) for n in names), pa.array(total[0]), pa.array(total[1])], names=[*names, "n_best", "count_sum"])

    docs, total = None, np.zeros((2, 0), np.int64)
    for b in batches:
        for i in range(b.num_rows):
            if b.column(1)[i].is_valid:
                if docs is not None:
                    yield out(docs, total)
                docs = b.column(1)[i].values
                total = np.zeros((2, len(docs)), np.int64)
            else:
                x = _arrays(b.column(2)[i].as_py(), 2, "<i8")
                total[:, : x.shape[1]] += x
    if docs is not None:
        yield out(docs, total)


def linked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """What _send makes of docs(doc_id, text), written once and read by every later step."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(_send(a, b), f"stripe int, batch long, n long, pairs binary, links binary, docs array<{_DOC_SQL}>"), "links")


def _parts(sent: DataFrame, column: str) -> DataFrame:
    """(stripe, parts): STRIPES rows at most, so they can be sent to every executor."""
    return F.broadcast(sent.where("stripe >= 0").groupBy("stripe").agg(F.ceil(F.sum(F.length(column)) / F.lit(PART_BYTES)).cast("long").alias("parts")))


def _sizes(a: str, b: str) -> tuple[int, int]:
    own = aligner(a, b)
    return own.rows, len(own.bytes_b)


def stripe_counts(sent: DataFrame, a: str, b: str) -> DataFrame:
    """(stripe, n, cells), written: each stripe's counts of pairs. A stripe with many pairs is counted in parts first."""
    n = partitions(sent.sparkSession)
    kind, make = "stripe int, n long, cells binary", _count(*_sizes(a, b))
    dealt = sent.where("stripe >= 0").join(_parts(sent, "pairs"), "stripe").select("stripe", F.pmod(F.xxhash64("batch"), F.greatest("parts", F.lit(1))).alias("part"), "n", "pairs", F.lit(None).cast("binary").alias("cells"))
    some = dealt.repartition(n, "stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(make, kind)
    whole = some.select("stripe", F.lit(0).cast("long").alias("part"), "n", F.lit(None).cast("binary").alias("pairs"), "cells")
    return written(whole.repartition(n, "stripe").sortWithinPartitions("stripe").mapInArrow(make, kind), "counts")


def id_pairs(counts: DataFrame) -> DataFrame:
    """(a, b, n, best) from stripe_counts: linked ids, documents that hold them linked, whether no b of that a has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for stripe, cells in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                row, col, n = _arrays(cells, 3, "<i8")
                most = np.zeros(int(row.max()) + 1 if len(row) else 0, np.int64)
                np.maximum.at(most, row, n)
                yield pa.record_batch([pa.array(row * STRIPES + stripe), pa.array(col.astype(np.int64)), pa.array(n), pa.array(n == most[row])], names=["a", "b", "n", "best"])

    return counts.select("stripe", "cells").mapInArrow(run, "a long, b long, n long, best boolean")


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row of docs.

    a: a byte-level vocabulary's file, b: a piece model's. Texts that are null, empty or not what their tokens say have
    zeros and no digest; repeated rows are documents of their own, each counted; a null doc_id stays; of equal counts
    all are best; other columns are not looked at; an empty table gives no rows. Every text is encoded once; a batch's
    links are sent as compressed blobs by stripe, to the tasks that hold the stripe's counts, and stripes with many
    links to several. A document's sums come together by its batch.
    """
    sent = linked(docs, a, b)
    counts = stripe_counts(sent, a, b)
    n, empty = partitions(docs.sparkSession), F.lit(None).cast("binary")
    parts = _parts(sent, "links")
    links = sent.where("stripe >= 0").join(parts, "stripe").select("stripe", F.pmod(F.xxhash64("batch"), F.greatest("parts", F.lit(1))).alias("part"), F.lit(1).alias("kind"), "batch", "n", "pairs", "links", empty.alias("cells"))
    beside = counts.join(parts, "stripe").select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("batch"), "n", empty.alias("pairs"), empty.alias("links"), "cells")
    keys = ["stripe", "part"]
    dealt = links.unionByName(beside).repartition(n, *keys).sortWithinPartitions(*keys, "kind").select("batch", "n", "pairs", "links", "cells")
    sums = dealt.mapInArrow(_score(*_sizes(a, b)), "batch long, sums binary")
    whole = sent.where("stripe < 0").select("batch", "docs", empty.alias("sums"), F.lit(0).alias("kind"))
    both = whole.unionByName(sums.select("batch", F.lit(None).cast(f"array<{_DOC_SQL}>").alias("docs"), "sums", F.lit(1).alias("kind")))
    rows = both.repartition(n, "batch").sortWithinPartitions("batch", "kind").select("batch", "docs", "sums")
    return rows.mapInArrow(_joined, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, groups): groups of ids as `a1,a2|b1;a3|b2,b3`; null without tokens. One pass without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            found = aligner(a, b).batch(table.column(1).combine_chunks())
            ids = table.column(0).combine_chunks().take(pa.array(found["place"]))
            yield pa.record_batch([ids, pa.array(_groups(found), pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, groups string")


def op12_id_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
