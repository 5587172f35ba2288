from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import tiktoken

from opalspan.llm import bm25_packing, bpe_duckdb, tokens, wavelet_output

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "é", "日本", "12", "!!", " ", " \n", "🙂", "The", "\x1c", "́", "Σ", "İ", " ", "½", "<|endoftext|>"]
DOCS = "doc_id long, text string, ids string"


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(PIECES, k=r.randint(0, 25))) for _ in range(n)]


def test_encoders_equal_the_library():
    for name, encoder in (("word_bpe_49k.json", tokens.word_encoder), ("byte_bpe_50k.json", tokens.byte_encoder)):
        path = public.path(name)
        t, encode = tokens.library(path), encoder(path).encode
        xs = texts(1, 1500) + ["", "x" * 3000]
        assert list(map(encode, xs)) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(xs, add_special_tokens=False)]


def test_words_met_again_stay(monkeypatch):
    """Many words met once don't push out those that come again, whatever the bounds ids equal the library's."""
    made = []
    memo = tokens.Proven(lambda k: made.append(k) or k.encode(), 20)
    for k in range(20):
        for key in [f"often{i}" for i in (*range(10), *range(10))] + [f"once{k}.{i}" for i in range(200)]:
            assert memo[key] == key.encode()
    assert sum(k.startswith("often") for k in made) == 10 and len(made) == 10 + 20 * 200
    assert len(memo) + len(memo.old) + len(memo.once) <= 60
    monkeypatch.setattr(tokens, "BYTE_PIECES", 30)
    monkeypatch.setattr(tokens, "BYTE_WORDS", 5)
    path, r = public.path("byte_bpe_50k.json"), random.Random(4)
    t, encoder = tokens.library(path), tokens.ByteEncoder(path)
    words = ["the", "The", "Über", "日本", "a1", "x.", "it's", "no,", ".", ",", "e\u0301", "...", "end.\nNext"] + [f"{'q' * (k % 7)}w{chr(97 + k % 26)}{'.' * (k % 2)}" for k in range(200)]
    xs = [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(200)]
    assert list(map(encoder.encode, xs)) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(xs, add_special_tokens=False)]


def test_texts_encoded_together():
    """Every Latin letter and control character, letters that the pattern's engine has and the library has not, and odd
    texts, in one call; a different word is looked up once, in whatever pieces it stands."""
    path = public.path("word_bpe_49k.json")
    t, encoder = tokens.library(path), tokens.WordEncoder(path)
    xs = [f.format(chr(c)) for c in (*range(1, 0x260), 0x558, 0x58B, 0x88F, 0x2C65, 0xA7CE) for f in ("{0}", "a{0}b {0}", "A{0}{0}B'S", "1{0}. {0},", "' {0}'ll{0}")]
    xs += texts(8, 500) + ["", " ", "it'still 'VE"]
    ids, sizes = encoder.encode_all(pa.array(xs))
    want = [np.array(e.ids, "<u4") for e in t.encode_batch(xs, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and (ids == np.concatenate(want)).all()
    asked, get = [], encoder.words.__missing__
    encoder.words = type("Asked", (dict,), {"__missing__": lambda self, k: asked.append(k) or get(k)})()
    encoder.encode_all(pa.array(["Word word, WORD.\nword%% word", "words word... \u65e5 \u65e5"] * 50))
    assert sorted(x for x in asked if x) == sorted(["word", "words", ",", ".", "%%", "...", "\u65e5"])
    assert encoder.encode_all(pa.array([], pa.string()))[0].tolist() == []


def test_shards_of_any_blocks(spark, monkeypatch):
    """Blocks of several batches, shards that end inside a block, and shards over several blocks hold the same rows."""
    path = public.path("word_bpe_49k.json")
    t, xs = tokens.library(path), texts(9, 90) + ["many words " * 300, None]
    monkeypatch.setattr(wavelet_output, "TaskContext", type("One", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    batches = [pa.record_batch([pa.array(range(a, min(a + 7, len(xs))), pa.int64()), pa.array([x or "" for x in xs[a : a + 7]])], names=["doc_id", "text"]) for a in range(0, len(xs), 7)]
    for block, shard in ((1, 1), (1, 200), (700, 50), (1 << 20, 50), (1 << 20, 1 << 20)):
        monkeypatch.setattr(wavelet_output, "BLOCK", block)
        monkeypatch.setattr(wavelet_output, "SHARD", shard)
        files = [b.to_pylist()[0] for b in wavelet_output._write(path)(iter(batches))]
        assert [f["before"] for f in files] == np.cumsum([0] + [f["n"] for f in files]).tolist()[:-1]
        got = [row for b in wavelet_output._read(pa.RecordBatch.from_pylist([{k: f[k] for k in ("part", "shard", "before", "file")}]) for f in files) for row in b.to_pylist()]
        assert [r["doc_id"] for r in got] == list(range(len(xs)))
        assert all(r["ids"] == np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r, x in zip(got, xs))
        assert all(f["n"] >= shard for f in files[:-1])


def test_pieces_cut_without_the_pattern():
    """The usual pattern's words of a piece, whatever is in it; another pattern is always asked."""
    ranks = bpe_duckdb.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    for pattern, plain in ((public.PATTERN, True), (r"\p{Lu}?\p{Ll}+|.", False)):
        bpe = bpe_duckdb.Bpe(ranks, pattern)
        assert bpe.plain == plain
        for k in ["", "a", "aB", "aB,", "a.", ".", ",", "..", "a..", "Ü,", "日本.", "e\u0301", "e\u0301.", "1.", "it's", "a\nb", "\u0558."]:
            assert bpe._cut(k) == bpe.pattern.findall(" " + k)


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (1000, 2), (5000, 49408)):
        x = r.integers(0, top, n)
        docs, sizes, m = wavelet_output.from_file(wavelet_output.to_file([7, None], [n, 0], x))
        assert docs == [7, None] and sizes == [n, 0] and (m.tokens(np.arange(n)) == x).all()
        for i in range(0, n, 97):
            t, where = int(x[i]), np.flatnonzero(x == x[i])
            assert m.access(i) == t and m.count(t) == len(where) and m.count(t, i) == (where < i).sum()
            assert [m.select(t, j) for j in range(len(where))][:5] == where[:5].tolist()


def test_shards_round_trip(spark):
    path = public.path("word_bpe_49k.json")
    t = tokens.library(path)
    rows = [(k if k != 5 else None, x, "clash") for k, x in enumerate(texts(2, 40) + [None, "", "word " * 5000])]
    rows.append(rows[3])
    got = wavelet_output.read_shards(wavelet_output.write_shards(spark.createDataFrame(rows, DOCS).repartition(5), path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x))
    want = {}
    for d, x, _ in rows:
        want.setdefault(d, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    at = 0
    for r in got:
        assert bytes(r["ids"]) in want[r["doc_id"]] and r["start"] == at
        at += r["n_tokens"]
    assert wavelet_output.read_shards(wavelet_output.write_shards(spark.createDataFrame([], DOCS), path)).count() == 0


def test_packing(spark):
    path = public.path("byte_bpe_50k.json")
    t = tokens.library(path)
    rows = [(k, x, "clash") for k, x in enumerate(texts(3, 60) + [None, "", "long text here " * 900])]
    got = bm25_packing.pack(spark.createDataFrame(rows, DOCS).coalesce(2), path, 64).collect()
    whole = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x, _ in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(whole[r["doc_id"]]) == r["doc_tokens"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, total in [(sorted(p), len(whole[d])) for d, p in by_doc.items()] + [(sorted(p), None) for p in by_seq.values()]:
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts]).tolist()[:-1]
        assert total is None and sum(n for _, n in parts) <= 64 or sum(n for _, n in parts) == total
    assert len(by_doc) == len(rows) and sum(sum(n for _, n in p) < 64 for p in by_seq.values()) <= 2
    assert bm25_packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_retrieval_prefers_alike():
    index = bm25_packing.Index([np.array(x) for x in ([1, 2, 3, 9], [4, 5, 6, 9], [1, 2, 7, 9], [8, 10, 11, 9], [12, 9])])  # at half of the pieces an id weighs nothing
    score = index.scores(0)
    assert score[2] > score[1] == score[3] == 0


def bm25(pieces):
    """score(seed, other) of every pair, from the formula, term by term."""
    n, mean = len(pieces), sum(map(len, pieces)) / len(pieces)
    df = collections.Counter(t for p in pieces for t in set(p))
    weight = lambda t, p: math.log((n - df[t] + 0.5) / (df[t] + 0.5)) * p.count(t) * 2.2 / (p.count(t) + 1.2 * (0.25 + 0.75 * len(p) / mean))
    return [[sum(w for t in set(a) if t in b and (w := weight(t, b)) > 0) for b in pieces] for a in pieces]


def test_retrieval_scores():
    r = random.Random(31)
    pieces = [[min(r.randrange(60), r.randrange(60)) for _ in range(r.randint(1, 40))] for _ in range(50)]
    index, want = bm25_packing.Index([np.array(p) for p in pieces]), bm25(pieces)
    for seed in range(50):
        assert np.allclose(index.scores(seed), want[seed], rtol=1e-4, atol=1e-4)
    assert sum(x > 0 for row in want for x in row) > 500


def test_greedy_filling():
    """Windows of one shard, piece by piece: the longest unused rest, then the best unused neighbours, the last one cut."""
    r = random.Random(32)
    docs = [np.array([min(r.randrange(90), r.randrange(90)) for _ in range(r.randint(1, 150))]) for _ in range(60)]
    packer = bm25_packing.Packer(64, 1000)
    for k, ids in enumerate(docs):
        packer.add((k, len(ids)), ids)
    packer.pack(True)
    got = [(d[0], start, len(ids), seq, at) for d, start, ids, seq, at in packer.out]
    want, pool, seq = [], [], 0
    for k, ids in enumerate(docs):
        full = len(ids) // 64 * 64
        for start in range(0, full, 64):
            want.append((k, start, 64, seq, 0))
            seq += 1
        if full < len(ids):
            pool.append([k, full, ids[full:].tolist()])
    score = bm25([p[2] for p in pool])
    free = list(range(len(pool)))
    for seed in sorted(range(len(pool)), key=lambda i: (-len(pool[i][2]), i)):
        while seed in free:
            free.remove(seed)
            at = len(pool[seed][2])
            want.append((pool[seed][0], pool[seed][1], at, seq, 0))
            for k in sorted(free, key=lambda i: (-round(score[seed][i], 4), i)):
                if at == 64:
                    break
                take = min(64 - at, len(pool[k][2]))
                want.append((pool[k][0], pool[k][1], take, seq, at))
                at += take
                pool[k] = [pool[k][0], pool[k][1] + take, pool[k][2][take:]]
                if not pool[k][2]:
                    free.remove(k)
            seq += 1
    assert got == want and len({x[3] for x in got}) > 40


def test_bpe(spark):
    ranks = bpe_duckdb.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, x, "clash") for k, x in enumerate(texts(4, 200) + [None, "", "the" * 400, "q" * 900])]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in bpe_duckdb.encode_decode(df, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).collect()}
    for d, x, _ in rows:
        ids = enc.encode_ordinary(x or "")
        assert (got[d]["ids"], got[d]["n_tokens"], bytes(got[d]["decoded"])) == (",".join(map(str, ids)), len(ids), (x or "").encode())
    back = spark.createDataFrame([(1, enc.encode_ordinary("héllo 日本")), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe_duckdb.decode(back, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).collect()} == {1: "héllo 日本", 2: "", 3: ""}
    assert zlib.crc32(b"") == 0


def test_bpe_of_many_texts_together(monkeypatch):
    """Ids and bytes of texts in one call, as the library's; a different piece is cut once, a different word asked once,
    while words are forgotten and met again."""
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe_duckdb.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    xs = [f.format(chr(c)) for c in (*range(1, 0x250), 0x3A3, 0x301, 0x65E5) for f in ("{0}", "a a{0}b {0}, {0}", " A{0}{0}. B'S {0}a.", "x  {0}", "x {0} ")]
    xs += texts(10, 300) + ["", " ", "  ", "Über, über. x", "the" * 400 + " the"]
    monkeypatch.setattr(bpe_duckdb, "KEPT", 200)
    bpe = bpe_duckdb.Bpe(ranks, public.PATTERN)
    for lo in range(0, len(xs), 900):
        n, ids, decoded = bpe.encode_all(pa.array(xs[lo : lo + 900]))
        want = [library.encode_ordinary(x) for x in xs[lo : lo + 900]]
        assert n.to_pylist() == list(map(len, want)) and decoded.to_pylist() == [x.encode() for x in xs[lo : lo + 900]]
        assert ids.to_pylist() == ["".join(f"{i}," for i in w).encode() for w in want]
    assert [len(x) for x in bpe.encode_all(pa.array([], pa.string()))] == [0, 0, 0]
    cut, asked, find, ask = [], [], bpe._cut, bpe._words
    bpe._cut, bpe._words = lambda k: cut.append(k) or find(k), lambda ws: asked.extend(ws) or ask(ws)
    bpe.encode_all(pa.array(["one zwei, zwei. 3rd% 3rd%", "zwei zwei, 3rd% zwei."] * 50 + ["tail  3rd%"]))
    assert cut == ["3rd%"] and len(asked) == len(set(asked))
    other = bpe_duckdb.Bpe(ranks, r"\p{Lu}?\p{Ll}+|.")
    assert other.texts(["aB cd. x", ""])[0] == ("".join(f"{i}," for w in ["a", "B", " ", "cd", ".", " ", "x"] for i in library.encode_ordinary(w)), b"aB cd. x")


def test_long_words_by_rounds():
    """Words far over LONG_WORD, runs of one letter, and pairs whose contraction makes a pair of lower rank."""
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe_duckdb.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    letters = "etaoinshrdlucmfwypvbgk"
    words = ["".join(r.choices(letters, range(len(letters), 0, -1), k=n)) for n in (64, 65, 66, 90, 200, 401, 3000)]
    words += ["a" * n for n in (65, 66, 67, 1001)] + ["=" * 500, "aab" * 90, "\u65e5\u672c" * 60, "".join(r.choices("\u0430\u0431\u0432\u0433", k=300))]
    coder = bpe_duckdb.coder(path, public.PATTERN)
    for w, (ids, decoded) in zip(words, coder.texts(words)):
        assert ids == "".join(f"{i}," for i in library.encode_ordinary(w)) and decoded == w.encode()


def test_one_token_from_one_chunk():
    """A token is read from one chunk of each plane, found by the stored directory."""
    x = np.random.default_rng(3).integers(0, 40_000, 3 * wavelet_output.CHUNK + 17)
    _, _, m = wavelet_output.from_file(wavelet_output.to_file([1], [len(x)], x))
    asked, chunk = [], m._chunk
    m._chunk = lambda k, c: asked.append((k, c)) or chunk(k, c)
    assert m.access(len(x) - 1) == x[-1] and len(asked) == m.width == 16
    assert m.count(int(x[5]), 1000) == (x[:1000] == x[5]).sum() and m.select(int(x[5]), 0) == np.flatnonzero(x == x[5])[0]
