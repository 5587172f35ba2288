"""Byte-level BPE by recursive DuckDB queries in each partition."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import small_batches
from opalspan.llm.tokens import BYTE_PATTERN, LONGEST, STOPS, Memo

#: Bytes squared of one query's words: the states of a word's merges add up to about half its square.
QUERY_STATES = 3_000_000
#: A word over this many bytes contracts every place of its least rank in one round; such words' queries stop after
#: so many rounds that they hold LONG_STATES states, and go on from where they stopped.
LONG_WORD, LONG_STATES = 64, 2_000_000
#: Words that a worker remembers in each generation.
KEPT = 250_000
#: Latin letters for Arrow's functions.
_LATIN = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"

#: Rounds: neighbours that the merge table has, each word's pair of least rank, leftmost of equals, contracted. A word
#: without a pair has no row in the next round, so its last round is its fixpoint.
_ROUNDS = """
with recursive state(round, word, pos, tok) as (
  select 0, word, pos, tok from tokens
  union all
  select round + 1, word, pos, tok from (
    select s.round, s.word, s.pos, case when s.pos = b.best.pos then b.best.id else s.tok end as tok, b.best.gone
    from state s join (
      select word, arg_min({'pos': pos, 'gone': after, 'id': id}, id::bigint * 4294967296 + pos) as best from (
        select p.word, p.pos, p.after, m.id from (
          select word, pos, tok, lead(tok) over w as next, lead(pos) over w as after, lead(word) over w as same
          from state window w as (order by word, pos)
        ) p join merges m on m.a = p.tok and m.b = p.next and p.same = p.word
      ) group by word
    ) b on b.word = s.word
  ) where pos <> gone
), last as (select word, max(round) as round from state group by word)
"""
_ENCODE = _ROUNDS + "select word, list(tok order by pos) from state join last using (word, round) group by word order by word"
#: The same, with each word's ids in decimal, their number, and what they decode to, by ordered aggregation.
_BOTH = _ROUNDS + "select word, string_agg(name, ',' order by pos), count(*), string_agg(hex, '' order by pos) from state join last using (word, round) join vocabulary on id = tok group by word order by word"
#: One query's rounds over long words, at most `{most}`. Each round contracts all places of a word's least rank from
#: the left, of overlapping ones every second, up to the first whose contraction makes a pair of a still lower rank
#: (`lower`): that pair comes before the places after it.
_LONG = """
with recursive state(round, word, pos, tok) as (
  select 0, word, pos, tok from tokens
  union all
  select round + 1, word, pos, tok from (
    with pairs as (
      select round, word, pos, tok, lag(tok) over w as prev, lead(tok) over w as next, lead(tok, 2) over w as beyond, lead(pos) over w as after
      from state window w as (partition by word order by pos)
    ), least_rank as (
      select p.*, m.id from pairs p join merges m on m.a = p.tok and m.b = p.next qualify id = min(id) over (partition by word)
    ), runs as (
      select *, sum(case when touches then 0 else 1 end) over (partition by word order by pos) as run
      from (select *, coalesce(lag(after) over (partition by word order by pos) = pos, false) as touches from least_rank)
    ), apart as (
      select * from runs qualify row_number() over (partition by word, run order by pos) % 2 = 1
    ), watched as (
      select h.*, x.a is not null or y.a is not null or z.a is not null as lowers from apart h
      left join lower x on x.a = h.prev and x.b = h.id left join lower y on y.a = h.id and y.b = h.beyond left join lower z on z.a = h.id and z.b = h.id
    ), chosen as (
      select * from watched qualify not coalesce(bool_or(lowers) over (partition by word order by pos rows between unbounded preceding and 1 preceding), false)
    )
    select p.round, p.word, p.pos, coalesce(c.id, p.tok) as tok from pairs p
    left join chosen c on c.word = p.word and c.pos = p.pos left join chosen g on g.word = p.word and g.after = p.pos
    where g.pos is null and p.round < {most} and p.word in (select word from chosen)
  )
), last as (select word, max(round) as round from state group by word)
select word, any_value(round) = {most}, list(tok order by pos) from state join last using (word, round) group by word order by word
"""
_DECODE = "select t.word, string_agg(v.hex, '' order by t.pos) as hex from tokens t join vocabulary v on v.id = t.tok group by t.word order by t.word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """One DuckDB connection with a vocabulary's merge table: a row for each cut of a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(ranks[b[:k]], ranks[b[k:]], r) for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        a, b, i = (pa.array(c, pa.int32()) for c in (zip(*pairs) if pairs else ([], [], [])))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB"})
        self.db.execute("set temp_directory = ''")
        self._table("merges", pa.table({"a": a, "b": b, "id": i}))
        self._table("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "name": pa.array([str(r) for r in ranks.values()]), "hex": pa.array([b.hex() for b in ranks])}))
        low = [(x, y) for x, y, r in pairs if r < max(x, y)]
        self._table("lower", pa.table({"a": pa.array([x for x, _ in low], pa.int32()), "b": pa.array([y for _, y in low], pa.int32())}))
        self.words = Memo(None, KEPT)
        self.plain = pattern == BYTE_PATTERN

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _query(self, sql: str, sequences: list[np.ndarray]) -> list:
        return self._ask(sql, np.concatenate(sequences).astype(np.int32), np.array([len(x) for x in sequences]))

    def _ask(self, sql: str, flat: np.ndarray, sizes: np.ndarray) -> list:
        """The query over sequences that stand end to end, each of its size."""
        pos = np.arange(len(flat), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        given = pa.table({"word": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "pos": pos, "tok": flat})
        self.db.register("tokens", given)
        out = self.db.execute(sql).fetchall()
        self.db.unregister("tokens")
        return [x[1:] for x in out]

    def _merge_long(self, words: list[bytes]) -> list[list[int]]:
        """Ids of long words: rounds in queries, until a query ends before its last round."""
        now: list = [self.byte[np.frombuffer(w, np.uint8)] for w in words]
        todo = list(range(len(words)))
        while todo:
            size, part = 0, []
            while todo and (not part or size + len(now[todo[-1]]) <= LONG_STATES // 8):
                size += len(now[todo[-1]])
                part.append(todo.pop())
            for i, (more, ids) in zip(part, self._query(_LONG.format(most=max(1, LONG_STATES // size)), [now[i] for i in part])):
                now[i] = np.array(ids, dtype=np.int32)
                if more:
                    todo.append(i)
        return [x.tolist() for x in now]

    def _in_queries(self, sql: str, words: list[bytes]) -> list:
        """Rows of one query for each part of the words, shortest first; null for words too long for rounds."""
        out: list = [None] * len(words)
        order = sorted((i for i in range(len(words)) if len(words[i]) <= LONG_WORD), key=lambda i: len(words[i]))
        part: list[int] = []
        states = 0

        def flush() -> None:
            if part:
                flat = self.byte[np.frombuffer(b"".join([words[k] for k in part]), np.uint8)]
                for i, row in zip(part, self._ask(sql, flat, np.array([len(words[k]) for k in part]))):
                    out[i] = row

        for i in order:
            if states + len(words[i]) ** 2 > QUERY_STATES and part:
                flush()
                part, states = [], 0
            part.append(i)
            states += len(words[i]) ** 2
        flush()
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of non-empty words, each merged by itself."""
        short = self._in_queries(_ENCODE, words)
        long = iter(self._merge_long([w for w, x in zip(words, short) if x is None]))
        return [next(long) if x is None else x[0] for x in short]

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """Bytes of each non-empty sequence of ids, by one ordered aggregation."""
        return [bytes.fromhex(x[0]) for x in self._query(_DECODE, [np.array(s, dtype=np.int32) for s in sequences])] if sequences else []

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each word its ids in decimal, each followed by a comma, and the bytes that they decode to."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        unhex = bytes.fromhex
        out = [None if x is None else (x[0].encode() + b",", unhex(x[2])) for x in self._in_queries(_BOTH, raw)]
        long = [i for i, x in enumerate(out) if x is None]
        each = self._merge_long([raw[i] for i in long])
        for i, ids, decoded in zip(long, each, self.decode(each)):
            out[i] = b"".join(b"%d," % x for x in ids), decoded
        return out

    def _look(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """The same for different words; those that are not remembered are merged, all of them together."""
        now, old = self.words, self.words.old
        out = [now.get(w) or old.get(w) for w in words]
        ask = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(ask), 50_000):
            part = ask[lo : lo + 50_000]
            for i, x in zip(part, self._words([words[i] for i in part])):
                out[i] = x
        for w, x in zip(words, out):
            if len(w) <= LONGEST and w not in now:
                now.keep(w, x)
        return out

    def _cut(self, k: str) -> list[str]:
        """Words of a piece with the space before it; with the usual pattern, letters, and letters with a stop after them,
        are cut without it."""
        if self.plain:
            if k.isalpha():
                return [" " + k]
            if k[-1:] in STOPS and k[:-1].isalpha():
                return [" " + k[:-1], k[-1]]
        return self.pattern.findall(" " + k)

    def _cut_all(self, firsts: pa.Array, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Different words; their places there, piece by piece, and how many each piece has; and the place in that order
        of each of the firsts and then of the pieces. With the usual pattern, pieces of Latin letters, and those with a
        stop after them, stand behind the rest."""
        alone, stopped = (pc.match_substring_regex(pieces, f"^[{_LATIN}]+{stop}$").to_numpy(zero_copy_only=False) & self.plain for stop in ("", f"[{''.join(STOPS)}]"))
        kinds = [np.flatnonzero(x) for x in (~(alone | stopped), alone, stopped)]
        rest, one, two = (pieces.take(pa.array(x)) for x in kinds)
        found = [*map(self.pattern.findall, firsts.to_pylist()), *map(self._cut, rest.to_pylist())]
        spaced = pc.binary_join_element_wise(" ", pa.concat_arrays([one, pc.utf8_slice_codeunits(two, 0, -1)]), "")
        words = pa.concat_arrays([pa.array([w for x in found for w in x], pa.string()), spaced, pc.utf8_slice_codeunits(two, -1)]).dictionary_encode()
        at, n = words.indices.to_numpy(), len(two)
        at = np.concatenate([at[: len(at) - 2 * n], at[len(at) - 2 * n :].reshape(2, n).T.ravel()])
        sizes = np.concatenate([list(map(len, found)), np.ones(len(one)), np.full(n, 2)]).astype(np.int64)
        place = np.empty(len(sizes), np.int32)
        place[np.concatenate([np.arange(len(firsts)), *(x + len(firsts) for x in kinds)])] = np.arange(len(sizes))
        return words.dictionary, at, sizes, place

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of each text the number of its ids, the ids in decimal, each followed by a comma, and the bytes that they
        decode to. Texts are cut by the pattern; a different piece between spaces is cut once, with the space before it.

        Single spaces end no run of white space early, so each piece, with its space, is cut by the pattern as in the
        whole text. A text with two spaces in a row, or one at its end, is one piece; a first one has no space.
        """
        whole = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        flat, ends = split.flatten(), split.offsets.to_numpy()
        first = np.zeros(len(flat), bool)
        first[ends[:-1]] = True
        each = flat.filter(pa.array(~first)).dictionary_encode()
        words, at, sizes, place = self._cut_all(pc.if_else(whole, texts, flat.filter(pa.array(first))), each.dictionary)
        order = np.empty(len(flat), np.int32)
        order[first] = place[: len(texts)]
        order[~first] = place[len(texts) :][each.indices.to_numpy()]
        known = self._look(words.to_pylist())
        ids, decoded = (joined(joined(pa.array([x[i] for x in known], pa.binary()), at, np.cumsum([0, *sizes])), order, ends) for i in (0, 1))
        return pc.count_substring(ids.cast(pa.string()), ","), ids, decoded

    def texts(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Of each text its ids in decimal, each followed by a comma, and the bytes that they decode to."""
        _, ids, decoded = self.encode_all(pa.array(texts, pa.string()))
        return list(zip(ids.cast(pa.string()).to_pylist(), decoded.to_pylist()))


def joined(parts: pa.Array, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """What stands at the given places, put together from each end to the next one."""
    got = parts.take(pa.array(at))
    _, offsets, data = got.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(at) + 1) if len(at) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets[ends]), data or pa.py_buffer(b"")])


@functools.lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Bpe:
    """A worker keeps its connection, with the words that it remembers, from task to task."""
    return Bpe(read_ranks(path), pattern)


def _run(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, decoded = coder(path, pattern).encode_all(pc.fill_null(b.column(1), ""))
            yield pa.record_batch([b.column(0), n.cast(pa.int64()), pc.binary_slice(ids, 0, -1).cast(pa.string()), decoded], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of docs: ids in decimal, joined by commas; decoded: the bytes that
    the ids stand for.

    Each match of the pattern is merged by itself, all words by recursive queries, whatever their length. A worker
    merges a word once while it remembers it, and remembers from task to task. A null text is
    empty and has no ids; repeated rows stay; other columns are ignored. Nothing is shuffled.
    """
    small_batches(docs.sparkSession, 2000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(ranks, pattern), "doc_id long, n_tokens long, ids string, decoded binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) from rows (doc_id, ids array<int>); no ids give no bytes, an id outside the vocabulary none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(read_ranks(ranks), pattern)
        for b in batches:
            ids = [[x for x in s or [] if x is not None and 0 <= x < len(bpe.ranks)] for s in b.column(1).to_pylist()]
            some = iter(bpe.decode([s for s in ids if s]))
            yield pa.record_batch([b.column(0), pa.array([next(some) if s else b"" for s in ids], pa.binary())], names=["doc_id", "decoded"])

    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded binary")


def op9_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
