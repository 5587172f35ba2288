"""Languages of texts, alignment of tokenizers and collocations against brute force, and odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from opalspan.llm import byte_gru, id_stripes, suffix_sigma
from opalspan.llm.tokens import _byte_letters, library

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, phrase string, n long, label string, score string, lang_pred string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "", 0, "", "", "") for d, t, lang in rows], DOCS)


# collocations


def phrases(rows, least=10, top=2000):
    """By the definition, phrase by phrase."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang, low = "und" if lang is None else lang, (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in candidates.items():
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        around = [b for (other, *v), b in candidates.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= 50 * a for b in around):
            out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    ranked = []
    for lang in sorted(n):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return ranked


def made(seed, texts=60):
    r = random.Random(seed)
    vocabulary = ["a", "B", "the", "Zür", "x y", "q ", "\U0001f600", "n't"] + [f"w{i}" for i in range(12)]
    rows = []
    for d in range(texts):
        words = []
        for _ in range(r.randint(0, 80)):
            words += ["New", "york", "City"] if r.random() < 0.08 else [r.choice(vocabulary[: r.randint(2, 20)])]
        text = "".join(w + r.choice([" ", " ", " ", "\t ", ".", "\n", "  ", ",\r"]) for w in words)
        rows.append((d, text, r.choice(["en", "de", None, ""])))
    return rows + [(900, None, "en"), (901, "", None), (902, "lone", "fr"), (903, " . \t!\n", "fr"), (None, "the the the", "en"), *rows[:5], *rows[:5]]


@pytest.mark.parametrize("least,top,hot", [(10, 2000, 1 << 20), (2, 15, 1 << 20), (3, 2000, 5)])
def test_collocations(spark, least, top, hot):
    rows = made(least)
    got = suffix_sigma.collocations(frame(spark, rows), least=least, top=top, hot=hot)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    got = sorted(map(tuple, got.collect()))
    want = phrases(rows, least, top)
    assert got == sorted(want) and len(want) >= 10


def test_collocations_without_rows(spark):
    assert suffix_sigma.collocations(frame(spark, [])).collect() == []
    assert suffix_sigma.collocations(frame(spark, [(1, None, "en"), (2, "one", None)])).collect() == []


def test_long_text_in_parts(spark, monkeypatch):
    rows = [(1, "a b c d. " * 30 + "a b", "en"), (2, "b c a b c " * 9, "en")]
    whole = {}
    for size in (1 << 20, 7, 2):
        monkeypatch.setattr(suffix_sigma, "BATCH_WORDS", size)
        sums = collections.Counter()
        for words, columns, counts in suffix_sigma.suffixes(__import__("pyarrow").array([t for _, t, _ in rows])):
            for x, n in zip(zip(*columns), counts.tolist()):
                sums[tuple(words[i - 1] for i in x if i)] += n
        whole[size] = sums
    assert whole[7] == whole[2] == whole[1 << 20] and whole[7][b"a", b"b", b"c"] == 30 + 9


def test_scores_are_exact(spark):
    # products of over 64 bits, and a quotient just below a whole number
    big = 3_000_000_007
    rows = [("x", 1, "p", big), ("x", 1, "q", big + 1), ("x", 2, "p q", big), ("x", 0, "", 10 * big)]
    got = suffix_sigma.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long")).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in got] == [(big, big, big + 1, 1000000 * big * big // (big * (big + 1)))]


def test_stack_counts_every_prefix():
    r = np.random.default_rng(3)
    raw = r.integers(1, 5, (3, 400))
    raw[1, r.random(400) < 0.2] = 0
    raw[2, (r.random(400) < 0.2) | (raw[1] == 0)] = 0
    columns, counts = suffix_sigma._summed(list(raw), np.ones(400, np.int64), 6)
    columns, counts = [c[::-1] for c in columns], counts[::-1]
    got = {tuple(int(columns[j][row]) for j in range(k)): n for row, k, n in suffix_sigma.prefixes(columns, counts, [0, 1, 1, 1])}
    want = collections.Counter(tuple(int(x) for x in raw[:k, i]) for i in range(400) for k in (1, 2, 3) if raw[k - 1, i])
    assert got == want


# alignment


def aligned(rows):
    """By the definition: whole texts through the libraries, all pairs of overlapping tokens."""
    tokenizer, pieces = library(A), sentencepiece.SentencePieceProcessor(model_file=B)
    back = {v: k for k, v in _byte_letters().items()}
    spans, counts = [], collections.Counter()

    def intervals(ids, raw):
        at, out = 0, []
        for i, x in zip(ids, raw):
            out.append((at, at + len(x), i))
            at += len(x)
        return out

    for _, text, _ in rows:
        whole = (" " + (text or "")).encode()
        ids = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        raw = [bytes(back[c] for c in tokenizer.id_to_token(i)) for i in ids]
        other = pieces.encode(text or "")
        names = [pieces.id_to_piece(i) for i in other]
        names = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(other, names)]
        if not text or b"".join(raw) != whole or b"".join(names) != whole:
            spans.append(None)
            continue
        a, b = intervals(ids, raw), intervals(other, names)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(set(links))
        groups, i, j = [], 0, 0
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            left, right = [x[2] for x in a if i < x[1] <= end], [y[2] for y in b if i < y[1] <= end]
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            i = end
        spans.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (d, _, _), s in zip(rows, spans):
        if s is None:
            out.append((d, 0, 0, 0, 0, "", 0, 0, None))
        else:
            out.append((d, s[0], s[1], s[2], len(s[3]), hashlib.sha256(s[4].encode()).hexdigest(), sum(counts[x] == best[x[0]] for x in s[3]), sum(counts[x] for x in s[3]), s[4]))
    return out, counts, best


def mixed(seed, n=150):
    r = random.Random(seed)
    bits = ["the", "Ärger", "isn't", "don’t", "naïve.", "a.b,c", "▁", "x▁y", "<0x41>", "<unk>", "</s>", "<|endoftext|>", "12,345", "你好", "\U0001f600!", "\n", "\t", " ", "  ", "\x1c", " ", "é", "Å", "\x00", "ß", "ﬁ", "\r\n", "foo_bar(", "İ", "　"]
    rows = [(d, r.choice(["", " "]).join(r.choices(bits, k=r.randint(0, 12))) if d % 2 else " ".join(r.choices(bits[:14], k=r.randint(1, 15))), "en") for d in range(n)]
    return rows + [(900, None, None), (901, "", "en"), (902, " ", "en"), (903, "  x", "en"), (904, "x ", "en"), (None, "the the", "en"), *rows[:4], *rows[:4]]


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(id_stripes, "BATCH_DOCS", 7)
        monkeypatch.setattr(id_stripes, "PART_BYTES", 200)
        monkeypatch.setattr(id_stripes, "HELD_BYTES", 100)
    rows = mixed(seed)
    want, counts, best = aligned(rows)
    got = id_stripes.align(frame(spark, rows), A, B)
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in got.collect()]
    key = lambda x: repr(x)
    assert sorted(got, key=key) == sorted((w[:8] for w in want), key=key)
    assert sum(w[1] == 0 for w in want) > 3 and sum(w[1] > 0 for w in want) > 40
    pairs = id_stripes.id_pairs(id_stripes.stripe_counts(id_stripes.linked(frame(spark, rows), A, B), A, B)).collect()
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs} == {p: (n, n == best[p[0]]) for p, n in counts.items()} and len(pairs) == len(counts)
    texts = [tuple(r) for r in id_stripes.groups(frame(spark, rows), A, B).collect()]
    assert sorted(texts, key=key) == sorted(((w[0], w[8]) for w in want), key=key)


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = sorted(map(tuple, docs.collect()), key=lambda x: len(x[1] or ""))[:120]
    want = aligned(rows)[0]
    got = id_stripes.align(frame(spark, rows), A, B).orderBy("doc_id")
    assert [tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()] == [w[:8] for w in sorted(want)]


def test_alignment_without_rows(spark):
    assert id_stripes.align(frame(spark, []), A, B).collect() == []


# languages


def test_gradients_of_the_network():
    r = np.random.default_rng(5)
    raw, long = r.integers(0, 256, (9, 6)).astype(np.uint8), np.array([9, 1, 4, 9, 7, 2])
    label = r.integers(0, 3, 6)
    net = byte_gru.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _ = net.gradients(raw, long, label)
    for name, x in net.p.items():
        at = [tuple(i) for i in np.argwhere(g[name] != 0)]
        for i in r.permutation(len(at))[:12]:
            i, eps, old = at[i], 1e-3, x[at[i]]
            x[i] = old + eps
            up = net.gradients(raw, long, label)[1]
            x[i] = old - eps
            down = net.gradients(raw, long, label)[1]
            x[i] = old
            assert abs((up - down) / (2 * eps) - g[name][i]) < 1e-3 * max(0.1, abs(g[name][i])), (name, i)


def test_pooling_reads_every_byte():
    net = byte_gru.Network(["a", "b"])
    texts = [b"", b"x", b"abc" * 200, bytes(range(256)) * 3]
    got = net.pooled(texts)
    for t, p in zip(texts, got):
        one = np.zeros(2)
        for i in range(0, len(t), byte_gru.STRETCH):
            x = np.frombuffer(t[i : i + byte_gru.STRETCH], np.uint8)[:, None]
            one += net.places(net.states(x, np.array([len(x)]))).sum(axis=(0, 2))
        assert np.allclose(p, one / max(1, len(t)), atol=1e-5)
    # the last byte of a stretch reaches the first place through the backward direction
    x = np.frombuffer(b"abcdefgh", np.uint8)[:, None]
    y = np.frombuffer(b"abcdefgz", np.uint8)[:, None]
    assert not np.allclose(net.states(x, np.array([8]))[0], net.states(y, np.array([8]))[0])


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    seen = byte_gru.sample(docs)
    assert seen[3] == ["de", "en", "es", "fr"] and seen[0].shape[0] == byte_gru.STRETCH
    found = byte_gru.predict(docs, byte_gru.fit(docs)).withColumn("out", byte_gru.fold(F.col("doc_id")) == 1).collect()
    held = [r for r in found if r["out"] and r["text"]]
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    right = np.mean([r["lang"] == r["lang_pred"] for r in held])
    assert len(held) > 250 and right > 0.97, right
    assert all(0 <= r["score"] <= 1 for r in found)


def test_languages_of_odd_rows(spark):
    r = random.Random(1)
    en, fr = ["the", "and", "house", "with"], ["le", "été", "maison", "avec"]
    rows = [(d, " ".join(r.choices(en if d % 2 else fr, k=30)), "en" if d % 2 else "fr") for d in range(90)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "12 345 !", None), (903, "the and the house", None), (None, "été avec maison", None), (904, "avec été " * 9000, None), (905, "É", "fr"), (906, "the", "")]
    net = byte_gru.fit(frame(spark, rows))
    assert net.labels in (["en", "fr"], ["", "en", "fr"])
    got = byte_gru.predict(frame(spark, rows), net)
    assert got.columns == ["doc_id", "text", "lang", "phrase", "n", "label", "lang_pred", "score"]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in got.collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == "en" and got[None][0] == got[904][0] == "fr"
    assert byte_gru.fit(frame(spark, [])) is None and byte_gru.fit(frame(spark, [(1, "abc", None), (2, None, "en")])) is None
    assert byte_gru.predict(frame(spark, []), None).collect() == []
    assert byte_gru.predict(frame(spark, [(1, "abc", "en")]), None).first()["lang_pred"] == "und"
